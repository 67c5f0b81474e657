"""Parsers of services' answers over whole tables, whose rows are made into such answers first, and small predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import alignment, evaluation
from ..sources import feeds as S
from .registry import Tables, query

TODAY = "1996-06-01"


def _today() -> Column:
    return F.lit(TODAY).cast("date")


def _shown(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])


@query(
    """SELECT 'B' || p_partkey AS poi_id, CASE WHEN p_partkey % 9 = 0 THEN 'B' || p_partkey WHEN p_partkey % 13 = 0 THEN '[closed] ' || p_name ELSE p_name END AS name, CASE WHEN p_partkey % 3 > 0 THEN '110000' END AS typecode, (30 + p_size / 100.0)::DOUBLE AS lat, (100 + p_partkey % 50 / 100.0)::DOUBLE AS lng, CASE WHEN p_partkey % 4 > 0 THEN p_size / 10.0::DOUBLE END AS rating,
 CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'late' ELSE 'early' END AS open_time, CASE WHEN p_partkey % 5 > 0 THEN 'u' || p_partkey END AS photo_url, p_brand || p_type AS address, CASE WHEN p_partkey % 6 = 0 THEN 'B0' END AS parent_id FROM part WHERE p_partkey % 7 > 0 AND p_partkey % 11 > 0"""
)
def src11_poi_response(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    id_ = F.when(k % 11 == 0, "").otherwise(_shown("B", k))
    code = F.when(k % 3 == 0, "[]").otherwise('"110000"')
    place = F.when(k % 7 == 0, "[]").otherwise(_shown('"', 100 + k % 50 / 100.0, ",", 30 + F.col("p_size") / 100.0, '"'))
    biz = F.when(k % 4 == 0, "[]").otherwise(_shown('{"rating":"', F.col("p_size") / 10.0, '","opentime":"early"', F.when(k % 4 == 1, ',"opentime2":"late"').otherwise(',"opentime2":[]'), "}"))
    name, photos = F.when(k % 9 == 0, "").when(k % 13 == 0, F.concat(F.lit("[closed] "), "p_name")).otherwise(F.col("p_name")), F.when(k % 5 == 0, "[]").otherwise(_shown('[{"url":"u', k, '"}]'))
    parent = F.when(k % 6 == 0, '"B0"').otherwise("[]")
    raw = _shown('{"id":"', id_, '","name":"', name, '","typecode":', code, ',"address":["', F.col("p_brand"), '","', F.col("p_type"), '"],"parent":', parent, ',"location":', place, ',"biz_ext":', biz, ',"photos":', photos, "}")
    return S.places(t.part.select(raw.alias("raw"))).select("poi_id", "name", "typecode", "lat", "lng", "rating", "open_time", "photo_url", "address", "parent_id")


@query("SELECT n_nationkey AS asked_id, CASE WHEN n_nationkey % 3 = 0 THEN 'a' || n_nationkey WHEN n_nationkey % 3 = 1 THEN 'c' || n_nationkey END AS adcode FROM nation")
def src12_picked_cities(t: Tables) -> DataFrame:
    """Each nation's name is asked for; the answers hold a province of that name, another city, and perhaps a city of that name."""
    k = F.col("n_nationkey")
    row = lambda pos, name, code, level: F.struct(F.lit(pos).alias("pos"), name.alias("name"), _shown(code, k).alias("adcode"), level.alias("level"))
    own, none = F.col("n_name"), F.lit("province")
    answers = F.array(row(0, own, "p", none), row(1, F.concat(own, F.lit(" town")), "c", F.when(k % 3 == 2, "district").otherwise("city")), row(2, own, "a", F.when(k % 3 == 0, "city").otherwise("district")))
    districts = t.nation.select(k.alias("asked_id"), F.explode(answers).alias("x")).select("asked_id", "x.*")
    return S.picked_cities(t.nation.select(k.alias("asked_id"), F.concat(F.lit(" "), "n_name").alias("name")), districts)


@query("SELECT 'C' || s_suppkey AS code, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN lower(s_name) ELSE '' END AS pinyin FROM supplier WHERE s_suppkey % 5 > 0")
def src13_station_file(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    record = F.when(k % 5 == 0, _shown("x|", F.col("s_name"))).otherwise(_shown("x|", F.col("s_name"), "| C", k, F.when(k % 2 == 0, F.concat(F.lit("|"), F.lower("s_name"))).otherwise("")))
    return S.stations(t.supplier.select(F.concat(F.lit("var names ='@"), record).alias("raw")))


@query(
    """SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'G' WHEN 1 THEN 'D' ELSE 'K' END || p_partkey AS service, CASE WHEN p_partkey % 2 = 0 THEN 'east' ELSE 'XX' END AS a, p_size * 10 + p_partkey % 60 AS minutes, p_partkey % 4 > 0 AS has_tickets, CASE p_partkey % 3 WHEN 0 THEN 'high_speed' WHEN 1 THEN 'bullet' ELSE 'conventional' END AS class,
 round_even(greatest(p_size * 20 * CASE p_partkey % 3 WHEN 0 THEN 0.45::DOUBLE WHEN 1 THEN 0.31::DOUBLE ELSE 0.16::DOUBLE END, 15.0::DOUBLE) * 2, 0) / 2 AS price, CASE p_partkey % 4 WHEN 0 THEN '无' ELSE '有' END AS seat FROM part WHERE p_partkey % 7 > 0"""
)
def src14_ticket_rows(t: Tables) -> DataFrame:
    k, minutes = F.col("p_partkey"), F.col("p_size") * 10 + F.col("p_partkey") % 60
    service = _shown(F.when(k % 3 == 0, "G").when(k % 3 == 1, "D").otherwise("K"), k)
    took = _shown(F.lpad(F.floor(minutes / 60).cast("string"), 2, "0"), ":", F.lpad((minutes % 60).cast("string"), 2, "0"))
    at = {3: service, 6: F.when(k % 2 == 0, "EE").otherwise("XX"), 8: F.lit("09:00"), 10: F.when(k % 7 == 0, "--").otherwise(took), 30: F.when(k % 4 == 0, "无").otherwise("有")}
    raw = F.concat_ws("|", *[at.get(n, F.lit("")) for n in range(33)])
    names = t.spark.createDataFrame([("EE", "east")], "code string, name string")
    found = S.tickets(t.part.select(k.alias("id"), raw.alias("raw"), (F.col("p_size") * 20.0).alias("km")), names)
    return found.select("id", "service", "a", "minutes", "has_tickets", "class", "price", F.col("seats")["二等座"].alias("seat"))


@query(f"SELECT o_orderkey AS id, date_diff('day', o_orderdate::DATE, DATE '{TODAY}') <= 30 AS fresh FROM orders")
def src15_fresh_cache(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("id"), S.is_fresh(F.to_date("o_orderdate"), _today()).alias("fresh"))


_WMO = " ".join(f"WHEN {code} THEN '{text}'" for code, text in S.WEATHER.items())


@query(
    f"""WITH d AS (SELECT s_suppkey AS city, i, DATE '{TODAY}' + i::INT AS day, s_suppkey + i AS code FROM supplier, range(20) AS u(i) WHERE i < 16)
SELECT city, day::VARCHAR AS day, CASE code % 100 {_WMO} ELSE '未知天气（编码 ' || (code % 100) || '）' END AS text, CASE WHEN i < 5 THEN (i * 2)::DOUBLE END AS high FROM d"""
)
def src16_daily_weather(t: Tables) -> DataFrame:
    """Twenty days are answered, with five temperatures; the horizon cuts at sixteen days."""
    days = F.sequence(F.lit(0), F.lit(19))
    listed = lambda f, n=20: F.array_join(F.transform(F.slice(days, 1, n), f), ",")
    raw = F.concat(
        F.lit('{"daily":{"time":['), listed(lambda i: F.concat(F.lit('"'), F.date_add(_today(), i).cast("string"), F.lit('"'))), F.lit('],"weather_code":['), listed(lambda i: ((F.col("s_suppkey") + i) % 100).cast("string")),
        F.lit('],"temperature_2m_max":['), listed(lambda i: (i * 2).cast("string"), 5), F.lit("]}}"),
    )
    return S.daily_weather(t.supplier.select(F.col("s_suppkey").alias("city"), raw.alias("raw")), _today()).select("city", F.col("day").cast("string").alias("day"), "text", "high")


@query(
    f"""SELECT s_suppkey AS city, (DATE '{TODAY}' + i::INT)::VARCHAR AS day, CASE s_suppkey % 7 WHEN 0 THEN '天气未知' WHEN 1 THEN '小雨' WHEN 2 THEN '浮尘' WHEN 3 THEN '沙尘暴' WHEN 4 THEN '扬沙' WHEN 5 THEN '冰雹' ELSE '冰针' END AS text, CASE WHEN i % 2 = 0 THEN '晴' END AS night, s_suppkey % 7 IN (1, 3, 5) AS bad, i::DOUBLE AS low FROM supplier, range(4) AS u(i) WHERE i <> 2"""
)
def src17_other_weather(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    day = lambda i: F.concat(
        F.lit('{"date":"'), F.when(i == 2, "soon").otherwise(F.date_add(_today(), i).cast("string")), F.lit('","day_weather":"'), F.element_at(F.array(*map(F.lit, ("", "小雨", "浮尘", "沙尘暴", "扬沙", "冰雹", "冰针"))), (k % 7 + 1).cast("int")), F.lit('","night_weather":"'), F.when(i % 2 == 0, "晴").otherwise(""), F.lit('","night_temp":"'), i.cast("string"), F.lit('"}')
    )
    raw = F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), day), ","), F.lit("]"))
    found = S.day_and_night_weather(t.supplier.select(k.alias("city"), raw.alias("raw")))
    return found.select("city", F.col("day").cast("string").alias("day"), "text", "night", S.is_bad_outdoors(F.col("text"), F.col("night")).alias("bad"), "low")


@query(
    f"""WITH a AS (SELECT s_suppkey AS city, i, 'first' AS source FROM supplier, range(3) AS u(i) WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_suppkey, i, 'second' FROM supplier, range(4) AS u(i) WHERE s_suppkey % 3 = 1)
SELECT s_suppkey AS city, source, min(i) AS first_day, max(i) AS last_day, count(i) AS days, coalesce(count_if(i % 2 = 1), 0)::BIGINT AS bad_days FROM supplier LEFT JOIN a ON city = s_suppkey GROUP BY 1, 2"""
)
def ru19_city_forecast(t: Tables) -> DataFrame:
    """The forecast of each city by its first source that has one, and what it covers; a city that none has keeps a null source."""
    k = F.col("s_suppkey")
    days = lambda rest, n: t.supplier.where(k % 3 <= rest).select(k.alias("city"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    found = S.first_source([("first", days(0, 3)), ("second", days(1, 4))], "city")
    rows = t.supplier.select(k.alias("city")).join(found, "city", "left")
    return rows.groupBy("city", "source").agg(F.min("i").cast("long").alias("first_day"), F.max("i").cast("long").alias("last_day"), F.count("i").alias("days"), F.count_if(F.col("i") % 2 == 1).alias("bad_days"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 8 = 0 THEN 'malformed' WHEN p_partkey % 9 = 0 THEN 'no_poi' WHEN p_partkey % 7 = 0 THEN 'no_required' WHEN p_partkey % 5 = 0 THEN 'negative_days' END AS error FROM part")
def src21_seed_errors(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    required = F.when(k % 7 == 0, "null").otherwise("true")
    raw = F.when(k % 8 == 0, '{"poi_id": "x').otherwise(_shown('{"poi_id":"', F.when(k % 9 == 0, "").otherwise(k.cast("string")), '","booking_required":', required, ',"advance_days":', F.when(k % 5 == 0, "-1").otherwise("3"), ',"channels":["web"]}'))
    return S.read_rules(t.part.select(k.alias("id"), raw.alias("raw"))).select("id", "error")


@query(
    f"""WITH k AS (SELECT n_nationkey AS city, i AS place, n_nationkey * 10 + i AS code FROM nation, (VALUES (1), (2)) v(i) WHERE n_nationkey % 7 > 0 AND (i = 1 OR n_nationkey % 2 = 0)),
q AS (SELECT o_orderkey AS asked_id, o_custkey % 25 AS a, o_orderkey % 25 AS b, DATE '{TODAY}' + (o_orderkey % 20)::INT AS day FROM orders),
x AS (SELECT q.*, k.code AS a_code, k.place, f.code AS b_code, CASE WHEN (k.code + f.code) % 3 = 0 THEN ['T' || k.code || f.code] END AS services FROM q LEFT JOIN k ON k.city = a LEFT JOIN k f ON f.city = b AND f.place = 1),
y AS (SELECT *, row_number() OVER (PARTITION BY asked_id ORDER BY services IS NULL, place) AS n FROM x),
z AS (SELECT *, CASE WHEN date_diff('day', DATE '{TODAY}', day) NOT BETWEEN 0 AND 14 THEN 'not_on_sale' WHEN a_code IS NULL OR b_code IS NULL THEN 'no_station' WHEN services IS NULL THEN 'no_train' END AS note FROM y WHERE n = 1)
SELECT asked_id, note, CASE WHEN note IS NULL THEN a_code END AS a_code, CASE WHEN note IS NULL THEN services END AS services FROM z"""
)
def src23_rail_answers(t: Tables) -> DataFrame:
    n, o = F.col("n_nationkey"), F.col("o_orderkey")
    known = t.nation.where(n % 7 > 0).select(n.alias("city"), F.explode(F.when(n % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("place")).withColumn("code", F.col("city") * 10 + F.col("place"))
    asked = t.orders.select(o.alias("asked_id"), (F.col("o_custkey") % 25).alias("a"), (o % 25).alias("b"), F.date_add(_today(), (o % 20).cast("int")).alias("day"))
    a, b = known.select(F.col("code").alias("a_code")), known.where("place = 1").select(F.col("code").alias("b_code"), F.lit(1).alias("one"))
    days = t.spark.range(20).select(F.date_add(_today(), F.col("id").cast("int")).alias("day"))
    options = a.withColumn("one", F.lit(1)).join(b, "one").where((F.col("a_code") + F.col("b_code")) % 3 == 0).drop("one").join(F.broadcast(days))  # a fixed list of stations and days
    options = options.withColumns({"minutes": F.lit(90), "service": _shown("T", F.col("a_code"), F.col("b_code"))})
    return S.rail_answers(asked, known, options, _today())


@query(
    """SELECT c_custkey AS id, coalesce(left(CASE WHEN c_custkey % 5 > 0 THEN '61' || (c_custkey % 3 + 10) || '02' END, 4) = '6110', false) OR c_nationkey = 3 AS in_city,
 CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 3 = 0 ELSE c_custkey % 4 < 2 END AS food, c_custkey % 6 > 0 AS shop, c_custkey % 7 BETWEEN 2 AND 4 AS clipped FROM customer"""
)
def fl06_predicates(t: Tables) -> DataFrame:
    """Region codes of one city, places to eat, names that a shop may have, and days inside a range."""
    k = F.col("c_custkey")
    adcode = F.when(k % 5 > 0, _shown("61", k % 3 + 10, "02"))
    code = F.when(k % 2 == 0, F.when(k % 3 == 0, "050100").otherwise("110000")).otherwise("")
    name = F.when(k % 6 == 0, "面与饭").otherwise("永和豆浆")
    return t.customer.select(
        k.alias("id"), alignment.in_city(adcode, F.when(F.col("c_nationkey") != 3, "611000")).alias("in_city"), N.is_food(code, F.when(k % 4 < 2, "餐饮服务").otherwise("购物")).alias("food"), N.looks_like_a_shop(name).alias("shop"), (k % 7).between(2, 4).alias("clipped")
    )


@query("SELECT e.event_id AS id, coalesce(e.value < 20 + e.event_id % 9 AND 10 < CASE WHEN e.event_id % 4 > 0 THEN e.value + 5 END, false) AS overlaps, e.event_type = 'view' AS visible, date_diff('day', DATE '2024-01-10', ts::DATE) BETWEEN 0 AND 14 AS on_sale FROM events e")
def fl13_more_predicates(t: Tables) -> DataFrame:
    """Ranges that overlap where both are known, rules that may be seen, days on sale."""
    e = F.col("event_id")
    rows = evaluation.ranges_overlap(F.col("value"), F.when(e % 4 > 0, F.col("value") + 5), F.lit(10.0), 20 + e % 9)
    return t.events.select(e.alias("id"), rows.alias("overlaps"), (F.col("event_type") == "view").alias("visible"), S.on_sale(F.to_date("ts"), F.lit("2024-01-10").cast("date")).alias("on_sale"))


@query(
    """WITH c AS (SELECT doc_id, i, CASE doc_id % 5 WHEN 0 THEN 'mall' WHEN 1 THEN 'poi' WHEN 2 THEN 'city' ELSE 'route' END AS subject_type, CASE (doc_id + i) % 4 WHEN 0 THEN 'praise' WHEN 1 THEN 'avoid' ELSE 'highlight' END AS polarity, CASE (doc_id + i) % 3 WHEN 0 THEN 'queue' ELSE 'other' END AS facet, source FROM documents, range(4) AS u(i) WHERE doc_id % 7 > 0 AND doc_id % 11 > 0)
SELECT doc_id, i AS pos, CASE WHEN i = 3 THEN '' ELSE coalesce(source, '') END AS subject_name, CASE WHEN i = 3 THEN '' ELSE subject_type END AS subject_type, CASE WHEN i = 3 THEN '' ELSE polarity END AS polarity, CASE WHEN i = 3 THEN 'other' ELSE facet END AS facet, CASE WHEN i = 3 THEN '' ELSE 'text ' || i END AS text, CASE WHEN i = 3 THEN '' ELSE ' q ' END AS quote,
 CASE WHEN i = 3 THEN 'no_object' WHEN subject_type = 'mall' THEN 'subject_type' WHEN polarity = 'praise' THEN 'polarity' END AS reason FROM c"""
)
def src19_extracted_claims(t: Tables) -> DataFrame:
    """Answers made of documents: some malformed, some without a list, and in each list elements of unknown values and one that is no object."""
    d = F.col("doc_id")
    kind = F.when(d % 5 == 0, "mall").when(d % 5 == 1, " poi ").when(d % 5 == 2, "city").otherwise("route")
    claim = lambda i: F.concat(
        F.lit('{"subject_name":'), F.coalesce(F.concat(F.lit('" '), "source", F.lit('\\t"')), F.lit("null")), F.lit(',"subject_type":"'), kind, F.lit('","polarity":"'), F.when((d + i) % 4 == 0, "praise").when((d + i) % 4 == 1, "avoid").otherwise("highlight"),
        F.lit('","facet":'), F.when((d + i) % 3 == 0, '"queue"').when((d + i) % 3 == 1, '"weather"').otherwise("7"), F.lit(f',"text":"text {i} ","quote":" q "}}'),
    )
    listed = F.concat(F.lit('{"claims":['), F.concat_ws(",", claim(0), claim(1), claim(2), F.when(d % 2 == 0, '"no object"').otherwise("[1]")), F.lit("]}"))
    raw = F.when(d % 7 == 0, F.concat(listed, F.lit("}"))).when(d % 11 == 0, '{"claims":{"a":1}}').otherwise(listed)
    return S.extracted_claims(t.documents.select("doc_id", raw.alias("raw"))).withColumn("pos", F.col("pos").cast("long"))
