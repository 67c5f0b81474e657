"""Candidates and outcomes of alignment, trips, alerts, validation and parsers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import booking
from ..operators.ordering import numbered
from ..sources import feeds
from .registry import Tables, query

TODAY = "1996-06-01"


@query("SELECT 'claim' AS kind, c_name AS name, n_name AS parent FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal < -950 UNION ALL SELECT 'task', s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal < 0")
def al20_attached_below(t: Tables) -> DataFrame:
    claims = t.customer.where("c_acctbal < -950").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.lit("claim").alias("kind"), F.col("c_name").alias("name"), F.col("n_name").alias("parent"))
    return claims.unionByName(t.supplier.where("s_acctbal < 0").join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.lit("task").alias("kind"), F.col("s_name").alias("name"), F.col("n_name").alias("parent")))


@query("SELECT p_partkey, p_name, row_number() OVER (ORDER BY (p_size > 25), p_name, p_partkey) AS place FROM part WHERE contains(p_name, 'a') ORDER BY place LIMIT 60")
def al21_local_search(t: Tables) -> DataFrame:
    found = t.part.where(F.col("p_name").contains("a")).orderBy(F.col("p_size") > 25, "p_name", "p_partkey").limit(60)
    return found.select("p_partkey", "p_name", F.row_number().over(Window.orderBy(F.col("p_size") > 25, "p_name", "p_partkey")).cast("long").alias("place"))  # 60 rows


@query("SELECT q, arg_min(n_nationkey, (length(n_name), n_nationkey)) AS n_nationkey FROM nation, (VALUES ('NATION'), ('NATION_12'), ('NATION_1_SOUTH'), ('UNITED'), ('CHINA CITY')) v(q) WHERE starts_with(n_name, q) OR starts_with(q, n_name) GROUP BY 1")
def fl05_prefix_both_ways(t: Tables) -> DataFrame:
    asked = t.spark.createDataFrame([("NATION",), ("NATION_12",), ("NATION_1_SOUTH",), ("UNITED",), ("CHINA CITY",)], "q string")
    rows = t.nation.join(F.broadcast(asked), F.col("n_name").startswith(F.col("q")) | F.col("q").startswith(F.col("n_name")))
    return rows.groupBy("q").agg(F.min_by("n_nationkey", F.struct(F.length("n_name"), "n_nationkey")).alias("n_nationkey"))


@query("SELECT c_custkey, coalesce(left(c_mktsegment, 4) = 'BUIL', false) AS inside, coalesce(e.n_nationkey, p.n) AS code FROM customer LEFT JOIN nation e ON e.n_nationkey = c_custkey % 40 LEFT JOIN (SELECT n_nationkey // 10 AS k, min(n_nationkey) AS n FROM nation GROUP BY 1) p ON p.k = (c_custkey % 40) // 10")
def fl07_roll_up(t: Tables) -> DataFrame:
    k = F.col("c_custkey") % 40
    exact = t.nation.select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_nationkey").alias("e"))
    ten = t.nation.groupBy(F.floor(F.col("n_nationkey") / 10).alias("d")).agg(F.min("n_nationkey").alias("p"))
    rows = t.customer.withColumn("k", k).withColumn("d", F.floor(k / 10)).join(exact, "k", "left").join(ten, "d", "left")
    return rows.select("c_custkey", F.coalesce(F.left("c_mktsegment", F.lit(4)) == "BUIL", F.lit(False)).alias("inside"), F.coalesce("e", "p").alias("code"))


@query(
    """WITH a AS (SELECT o_custkey, count(*) AS runs FROM orders GROUP BY 1), b AS (SELECT o_custkey, count(DISTINCT l_partkey) AS stored FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1), c AS (SELECT o_custkey, count(*) AS evidence FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)
SELECT c_custkey, coalesce(runs, 0) AS runs, coalesce(stored, 0) AS stored, coalesce(evidence, 0) AS evidence, coalesce(stored, 0) <> coalesce(evidence, 0) AS mismatch FROM customer LEFT JOIN a ON a.o_custkey = c_custkey LEFT JOIN b ON b.o_custkey = c_custkey LEFT JOIN c ON c.o_custkey = c_custkey"""
)
def jn17_reconcile(t: Tables) -> DataFrame:
    lines = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_distinct("l_partkey").alias("stored"), F.count(F.lit(1)).alias("evidence"))
    runs = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("runs"))
    rows = t.customer.select("c_custkey").join(runs, "c_custkey", "left").join(lines, "c_custkey", "left").fillna(0)
    return rows.select("c_custkey", "runs", "stored", "evidence", (F.col("stored") != F.col("evidence")).alias("mismatch"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY (event_type = 'view'), hour(ts) * 3600 + minute(ts) * 60 + second(ts), event_id) AS place FROM events")
def or04_item_order(t: Tables) -> DataFrame:
    seconds = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    return t.events.select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("event_type") == "view", seconds, "event_id")).cast("long").alias("place"))


@query(
    """WITH s AS (SELECT 'C' || s_suppkey AS code, n_name || CASE s_suppkey % 7 WHEN 0 THEN '' WHEN 1 THEN '南' WHEN 2 THEN '东' WHEN 3 THEN '北' WHEN 4 THEN '西' WHEN 5 THEN '新南' ELSE '机场' END AS name FROM supplier JOIN nation ON n_nationkey = s_nationkey)
SELECT n_nationkey AS city, code, name, row_number() OVER (PARTITION BY n_nationkey ORDER BY length(name) - length(n_name), CASE substr(name, length(n_name) + 1) WHEN '南' THEN 0 WHEN '东' THEN 1 WHEN '北' THEN 2 WHEN '西' THEN 3 ELSE 9 END, name, code)::INT AS place FROM nation JOIN s ON starts_with(name, n_name)"""
)
def or07_station_rank(t: Tables) -> DataFrame:
    """Stations made of suppliers, in the order in which they are asked for their nation."""
    suffix = F.element_at(F.array(*map(F.lit, ("", "南", "东", "北", "西", "新南", "机场"))), (F.col("s_suppkey") % 7 + 1).cast("int"))
    stations = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey")).select(F.concat(F.lit("C"), F.col("s_suppkey").cast("string")).alias("code"), F.concat("n_name", suffix).alias("name"))
    cities = t.nation.select(F.col("n_nationkey").alias("city"), F.when(F.col("n_nationkey") % 2 == 0, F.concat("n_name", F.lit("市"))).otherwise(F.col("n_name")).alias("name"))
    return feeds.ranked_stations(cities, stations)


@query("SELECT event_id, to_json({'event_id': event_id, 'kind': event_type, 'user': user_id}) AS payload FROM events")
def pj02_row_as_json(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.to_json(F.struct("event_id", F.col("event_type").alias("kind"), F.col("user_id").alias("user"))).alias("payload"))


@query("SELECT user_id, event_id, event_type, coalesce(CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END, event_id * 1.0::DOUBLE) AS value FROM events")
def pj01_first_known(t: Tables) -> DataFrame:
    return t.events.select("user_id", "event_id", "event_type", F.coalesce(F.when(F.col("event_id") % 3 != 0, F.col("value")), F.col("event_id") * 1.0).alias("value"))


@query(
    """WITH s AS (SELECT o_custkey AS trip, o_orderkey AS stay, o_orderdate::DATE AS first, o_orderdate::DATE + (o_orderkey % 4)::INT AS last, (o_orderkey % 500)::INT AS minutes FROM orders),
n AS (SELECT *, lead(stay) OVER w AS next, lead(first) OVER w AS next_first FROM s WINDOW w AS (PARTITION BY trip ORDER BY first, stay))
SELECT trip, stay, next, (CASE WHEN minutes > 240 THEN next_first ELSE last END)::VARCHAR AS day FROM n WHERE next IS NOT NULL"""
)
def tr03_transfer_day(t: Tables) -> DataFrame:
    first = F.to_date("o_orderdate")
    rows = t.orders.select(F.col("o_custkey").alias("trip"), F.col("o_orderkey").alias("stay"), first.alias("first"), F.date_add(first, (F.col("o_orderkey") % 4).cast("int")).alias("last"), (F.col("o_orderkey") % 500).alias("minutes"))
    w = Window.partitionBy("trip").orderBy("first", "stay")
    rows = rows.withColumns({"next": F.lead("stay").over(w), "next_first": F.lead("first").over(w)}).where("next IS NOT NULL")
    return rows.select("trip", "stay", "next", F.when(F.col("minutes") > 240, F.col("next_first")).otherwise(F.col("last")).cast("string").alias("day"))


@query("WITH d AS (SELECT o_custkey, count(*) AS stays, sum(1 + o_orderkey % 4)::BIGINT AS days, string_agg(o_orderpriority, '、' ORDER BY o_orderdate, o_orderkey) AS places, max(o_orderdate) AS newest FROM orders GROUP BY 1) SELECT o_custkey, stays, days, places FROM d ORDER BY newest DESC, o_custkey LIMIT 100")
def tr07_list_trips(t: Tables) -> DataFrame:
    places = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_orderpriority"))), lambda x: x["o_orderpriority"]), "、")
    rows = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("stays"), F.sum(1 + F.col("o_orderkey") % 4).alias("days"), places.alias("places"), F.max("o_orderdate").alias("newest"))
    return rows.orderBy(F.desc("newest"), "o_custkey").limit(100).select("o_custkey", "stays", "days", "places")


@query(
    f"""WITH r AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderdate::DATE - (o_orderkey % 30)::INT END AS release, CASE o_orderkey % 3 WHEN 0 THEN '20:00' WHEN 1 THEN '' END AS at_time FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW'),
d AS (SELECT *, date_diff('day', DATE '{TODAY}', release) AS days FROM r)
SELECT o_orderkey, CASE WHEN days IS NULL THEN '必须提前线上预约——官方未公布放票口径，出行前以官方渠道为准' WHEN days < 0 THEN '放票日已过 ' || abs(days) || ' 天，立刻确认是否还有票' WHEN days = 0 THEN '今天' || CASE WHEN at_time <> '' THEN ' ' || at_time ELSE '' END || ' 放票' WHEN coalesce(at_time, '') = '' THEN days || ' 天后可以开始预约' ELSE days || ' 天后放票' END AS headline, row_number() OVER (ORDER BY days NULLS LAST, o_orderkey) AS place FROM d JOIN customer ON o_custkey = c_custkey"""
)
def ru02_alerts(t: Tables) -> DataFrame:
    release = F.when(F.col("o_orderkey") % 11 != 0, F.date_sub(F.to_date("o_orderdate"), (F.col("o_orderkey") % 30).cast("int")))
    rows = t.orders.where("o_orderstatus = 'F' AND o_orderpriority <> '5-LOW'").withColumn("days", F.datediff(release, F.lit(TODAY).cast("date")))
    rows = rows.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    time = F.when(F.col("o_orderkey") % 3 == 0, "20:00").otherwise("")
    headline = booking.headline(F.col("days"), time)
    return numbered(rows.select("o_orderkey", headline.alias("headline"), "days"), [F.asc_nulls_last("days"), F.col("o_orderkey")]).select("o_orderkey", "headline", "place")


@query("SELECT user_id, arg_max(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), (ts, event_id)) AS k FROM events GROUP BY 1")
def ev07_latest_payload(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.max_by("props", F.struct("ts", "event_id")).alias("p")).select("user_id", F.from_json("p", "k bigint")["k"].alias("k"))


@query("SELECT o_orderkey, (o_orderkey % 600) AS minutes, CASE WHEN (o_orderkey % 600) // 60 = 0 THEN (o_orderkey % 600) || ' 分' WHEN (o_orderkey % 600) % 60 = 0 THEN (o_orderkey % 600) // 60 || ' 小时' ELSE (o_orderkey % 600) // 60 || ' 小时 ' || (o_orderkey % 600) % 60 || ' 分' END AS said FROM orders")
def fn_minutes_in_words(t: Tables) -> DataFrame:
    m = F.col("o_orderkey") % 600
    hours, rest = F.floor(m / 60).cast("string"), (m % 60).cast("string")
    said = F.when(m < 60, F.concat(m.cast("string"), F.lit(" 分"))).when(m % 60 == 0, F.concat(hours, F.lit(" 小时"))).otherwise(F.concat(hours, F.lit(" 小时 "), rest, F.lit(" 分")))
    return t.orders.select("o_orderkey", m.alias("minutes"), said.alias("said"))


@query(
    f"""WITH r AS (SELECT p_partkey AS poi_id, p_partkey % 5 > 0 AS required, CASE WHEN p_partkey % 4 > 0 THEN 'reviewed' ELSE 'draft' END AS status, CASE WHEN p_partkey % 7 > 0 THEN (p_partkey % 40)::INT END AS advance, CASE p_partkey % 3 WHEN 0 THEN '20:00' WHEN 1 THEN '' END AS at_time FROM part WHERE p_partkey % 6 > 0),
v AS (SELECT DISTINCT o_custkey AS trip, l_partkey AS poi_id, o_orderdate::DATE AS visit_date FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
d AS (SELECT trip, v.poi_id, visit_date, visit_date - advance AS release_date, date_diff('day', DATE '{TODAY}', visit_date - advance) AS days, at_time FROM v JOIN r ON r.poi_id = v.poi_id WHERE required AND status = 'reviewed')
SELECT trip, row_number() OVER (PARTITION BY trip ORDER BY days NULLS LAST, visit_date, poi_id)::INT AS place, poi_id, visit_date::VARCHAR AS visit_date, release_date::VARCHAR AS release_date, days, CASE WHEN days IS NULL THEN 'later' WHEN days < 0 THEN 'overdue' WHEN days = 0 THEN 'today' WHEN days <= 3 THEN 'soon' ELSE 'later' END AS urgency,
 CASE WHEN days IS NULL THEN '必须提前线上预约——官方未公布放票口径，出行前以官方渠道为准' WHEN days < 0 THEN '放票日已过 ' || abs(days) || ' 天，立刻确认是否还有票' WHEN days = 0 THEN '今天' || CASE WHEN at_time <> '' THEN ' ' || at_time ELSE '' END || ' 放票' WHEN coalesce(at_time, '') = '' THEN days || ' 天后可以开始预约' ELSE days || ' 天后放票' END AS headline FROM d"""
)
def ru02_alerts_of_trips(t: Tables) -> DataFrame:
    """Bookings that trips have to make: their visits by the rules that were reviewed and ask for one."""
    k = F.col("p_partkey")
    rules = t.part.where(k % 6 > 0).select(
        k.alias("poi_id"), (k % 5 > 0).alias("required"), F.when(k % 4 > 0, "reviewed").otherwise("draft").alias("status"), F.when(k % 7 > 0, (k % 40).cast("int")).alias("advance_days"),
        F.when(k % 3 == 0, "20:00").when(k % 3 == 1, "").alias("release_time"), F.array(F.lit("web")).alias("channels"),
    )
    visits = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("trip"), F.col("l_partkey").alias("poi_id"), F.to_date("o_orderdate").alias("visit_date")).distinct()
    found = booking.alerts(visits, rules, F.lit(TODAY).cast("date"))
    return found.select("trip", "place", "poi_id", F.col("visit_date").cast("string").alias("visit_date"), F.col("release_date").cast("string").alias("release_date"), F.col("days").cast("long").alias("days"), "urgency", "headline")
