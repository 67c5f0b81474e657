"""Trips, their budgets and roadbooks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import pool
from ..operators import trips as R
from ..operators.store import TableStore
from ..storage import shared_folder
from .registry import Tables, query

TODAY = "1996-06-01"


def _day(offset: Column) -> Column:
    return F.date_add(F.lit(TODAY).cast("date"), offset.cast("int"))


@query(
    """WITH d AS (SELECT o_custkey AS trip, o_orderkey AS day, o_orderdate::DATE AS date, row_number() OVER w - 1 AS seq, o_orderdate::DATE - lag(o_orderdate::DATE) OVER w AS step, o_orderkey % 7 AS said FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT trip, day, code FROM (SELECT trip, day, unnest(list_filter([CASE WHEN said <> seq THEN 'seq' END, CASE WHEN step <> 1 THEN 'gap' END], lambda x: x IS NOT NULL)) AS code FROM d)"""
)
def tr02_broken_days(t: Tables) -> DataFrame:
    """Days whose number isn't their place in the trip, or that don't follow the one before."""
    w = Window.partitionBy("o_custkey").orderBy("date", "o_orderkey")
    rows = t.orders.withColumn("date", F.to_date("o_orderdate")).withColumns({"seq": F.row_number().over(w) - 1, "step": F.datediff("date", F.lag("date").over(w))})
    codes = F.array_compact(F.array(F.when(F.col("o_orderkey") % 7 != F.col("seq"), "seq"), F.when(F.col("step") != 1, "gap")))
    return rows.select(F.col("o_custkey").alias("trip"), F.col("o_orderkey").alias("day"), F.explode(codes).alias("code"))


@query(
    f"""WITH o AS (SELECT o_custkey AS trip, DATE '{TODAY}' + (o_orderkey % 9)::INT AS date, 'c' || (o_orderkey % 2) AS city, max(CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey END) AS theme, list_sort(list(o_orderkey) FILTER (o_orderkey % 4 = 0)) AS items FROM orders GROUP BY 1, 2, 3),
n AS (SELECT c_custkey AS trip, DATE '{TODAY}' + i::INT AS date, CASE WHEN i < 4 THEN 'c0' ELSE 'c1' END AS city FROM customer, range(7) AS u(i))
SELECT n.trip, n.date::VARCHAR AS date, n.city, o.theme::VARCHAR AS theme, coalesce(o.items, []) AS items FROM n LEFT JOIN o ON o.trip = n.trip AND o.date = n.date AND o.city = n.city"""
)
def tr04_relaid_days(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    days = t.orders.groupBy(F.col("o_custkey").alias("trip"), _day(k % 9).alias("date"), F.concat(F.lit("c"), (k % 2).cast("string")).alias("city")).agg(F.max(F.when(k % 3 > 0, k)).cast("string").alias("theme"), F.sort_array(F.collect_list(F.when(k % 4 == 0, k))).alias("items"))
    layout = t.customer.select(F.col("c_custkey").alias("trip"), F.explode(F.sequence(F.lit(0), F.lit(6))).alias("i")).select("trip", _day(F.col("i")).alias("date"), F.when(F.col("i") < 4, "c0").otherwise("c1").alias("city"))
    return R.relaid(days, layout).select("trip", F.col("date").cast("string").alias("date"), "city", "theme", "items")


@query(
    f"""WITH d AS (SELECT c_custkey AS trip, c_nationkey AS n, i FROM customer, range(3) AS u(i) WHERE c_custkey % 10 > 0), x AS (SELECT *, 2 - i AS offset_, j FROM d, range(3) AS v(j))
SELECT trip, offset_ AS "offset", (DATE '{TODAY}' + offset_::INT)::VARCHAR AS date, CASE WHEN i > 0 THEN 'theme ' || i END AS theme, CASE WHEN j = 1 THEN 'meal' ELSE 'poi' END AS kind, 'place ' || j AS title, CASE WHEN j = 0 AND n % 2 = 0 THEN 'P' || n END AS poi_id, CASE WHEN j = 0 AND n % 2 = 1 THEN 'place 0' END AS unresolved FROM x WHERE j < 2"""
)
def tr05_planned_items(t: Tables) -> DataFrame:
    """Three days in reverse order, each with an attraction, a meal, and something unknown."""
    n = F.col("c_nationkey")
    spot = F.when(n % 2 == 0, F.lit('{"lat":30.5,"lng":100.5}')).otherwise("null")
    items = F.concat(F.lit('[{"type":"attraction","name":" place 0","amap_poi_id":"P'), n.cast("string"), F.lit('","location":'), spot, F.lit('},{"type":"lunch","name":"place 1"},{"type":"nap","name":"place 2"}]'))
    day = lambda i: F.concat(F.lit(f'{{"day":{3 - i},"theme":"{"theme " + str(i) if i else " "}","timeline":'), items, F.lit("}"))
    plan = F.concat(F.lit('{"destination":"'), F.when(F.col("c_custkey") % 10 > 0, "town").otherwise(""), F.lit(f'","start_date":"{TODAY}","days":['), day(0), F.lit(","), day(1), F.lit(","), day(2), F.lit("]}"))
    found = R.planned_items(t.customer.select(F.col("c_custkey").alias("trip"), F.lit(None).cast("date").alias("start_date"), plan.alias("plan")))
    return found.select("trip", F.col("offset").cast("long").alias("offset"), F.col("date").cast("string").alias("date"), "theme", "kind", "title", "poi_id", "unresolved")


@query("SELECT user_id AS trip, list({'day': day, 'items': items} ORDER BY day) AS days FROM (SELECT user_id, ts::DATE::VARCHAR AS day, list({'seq': event_id, 'kind': event_type} ORDER BY event_id) AS items FROM events GROUP BY 1, 2) GROUP BY 1".replace("list({'day': day, 'items': items} ORDER BY day) AS days", "to_json(list({'day': day, 'items': items} ORDER BY day))::VARCHAR AS days"))
def tr06_trip_tree(t: Tables) -> DataFrame:
    """Each trip with its days, and their items, as one nested row."""
    days = t.events.groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(F.array_sort(F.collect_list(F.struct(F.col("event_id").alias("seq"), F.col("event_type").alias("kind")))).alias("items"))
    return days.groupBy(F.col("user_id").alias("trip")).agg(F.to_json(F.array_sort(F.collect_list(F.struct("day", "items")))).alias("days"))


@query(
    """WITH b AS (SELECT o_custkey AS trip, 'intercity' AS c, o_totalprice AS a, o_orderkey % 5 = 0 AS r FROM orders WHERE o_orderkey % 3 > 0 UNION ALL SELECT c_custkey, 'other', c_acctbal, false FROM customer)
SELECT trip, round_even(coalesce(sum(a) FILTER (c = 'intercity'), 0), 2) AS intercity, round_even(coalesce(sum(a) FILTER (c = 'other'), 0), 2) AS other, round_even(sum(a), 2) AS total, bool_or(r) AS reference FROM b GROUP BY 1"""
)
def tr08_budgets(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    transfers = t.orders.select(F.col("o_custkey").alias("trip"), F.when(k % 3 > 0, F.col("o_totalprice")).alias("price"), (k % 5 == 0).alias("is_reference"))
    return R.budget(transfers, t.customer.select(F.col("c_custkey").alias("trip"), F.col("c_acctbal").alias("amount")))


@query(
    """WITH c AS (SELECT p_brand AS city, p_partkey AS poi_id, CASE WHEN p_partkey % 3 > 0 THEN p_size::DOUBLE END AS lat, CASE WHEN p_partkey % 4 > 0 THEN 'all day' END AS open_time, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS place FROM part),
a AS (SELECT *, sum(CASE WHEN lat IS NULL OR open_time IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY city ORDER BY place) AS turn, lat IS NULL OR open_time IS NULL AS needs FROM c)
SELECT poi_id, needs AND turn <= 20 AS asked, CASE WHEN lat IS NULL AND turn <= 20 AND poi_id % 5 > 0 THEN 1.5 ELSE lat END AS lat, CASE WHEN open_time IS NULL AND turn <= 20 AND poi_id % 5 > 0 THEN 'mornings' ELSE open_time END AS open_time FROM a"""
)
def tr12_filled_gaps(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    rows = t.part.select(
        F.col("p_brand").alias("city"), F.row_number().over(Window.partitionBy("p_brand").orderBy(k)).alias("place"), k.alias("poi_id"), F.lit(None).cast("string").alias("address"),
        F.when(k % 3 > 0, F.col("p_size").cast("double")).alias("lat"), F.lit(None).cast("double").alias("lng"), F.when(k % 4 > 0, "all day").alias("open_time"),
    )
    known = t.part.where(k % 5 > 0).select(k.alias("poi_id"), F.lit("road").alias("address"), F.lit(1.5).alias("lat"), F.lit(2.5).alias("lng"), F.lit("mornings").alias("open_time"))
    return R.filled(rows, known).select("poi_id", "asked", "lat", "open_time")


@query(
    """WITH o AS (SELECT s_nationkey AS city, s_suppkey AS poi_id, count(*) AS claims, count_if(l_quantity > 25)::BIGINT AS sure, any_value(s_name) AS name FROM supplier JOIN lineitem ON l_suppkey = s_suppkey WHERE s_nationkey % 3 > 0 GROUP BY 1, 2),
a AS (SELECT city, poi_id, 'own' AS source, claims, sure, name FROM o UNION ALL SELECT c_nationkey, c_custkey, 'search', 0, 0, c_name FROM customer WHERE c_nationkey NOT IN (SELECT city FROM o)),
r AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY claims DESC, sure DESC, name, poi_id) AS place FROM a) SELECT city, poi_id, source, place FROM r WHERE place <= 60"""
)
def so01_city_pools(t: Tables) -> DataFrame:
    """Candidates of each city: its own by their claims, or what a search gives where it has none, never both."""
    lines = t.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("claims"), F.count_if(F.col("l_quantity") > 25).alias("sure"))
    own = t.supplier.where("s_nationkey % 3 > 0").join(lines, "s_suppkey").select(F.col("s_nationkey").alias("city"), F.col("s_suppkey").alias("poi_id"), "claims", "sure", F.col("s_name").alias("name"))
    return R.pools(own, t.customer.select(F.col("c_nationkey").alias("city"), F.col("c_custkey").alias("poi_id"), F.col("c_name").alias("name"))).withColumn("place", F.col("place").cast("long"))


_LINE = "'<li>' || CASE WHEN event_id % 5 > 0 THEN strftime(ts, '%H:%M') || ' ' ELSE '' END || CASE WHEN event_id % 2 = 0 THEN 'A &amp; B &lt;' || event_id || '&gt;' ELSE event_type END || CASE WHEN event_id % 3 = 0 THEN ' <small>' || user_id || '</small>' ELSE '' END || '</li>'"


@query(
    f"""WITH d AS (SELECT user_id, ts::DATE AS day, string_agg({_LINE}, '' ORDER BY event_id) AS lines, count(*) AS n FROM events WHERE user_id % 7 > 0 GROUP BY 1, 2),
b AS (SELECT user_id, count(*) AS days, sum(n)::BIGINT AS items, string_agg('<section><h2>' || day || '</h2><ol>' || lines || '</ol></section>', '' ORDER BY day) AS body FROM d GROUP BY 1)
SELECT u.user_id AS trip, coalesce(days, 0) AS days, coalesce(items, 0) AS items, 0 AS external, sha256('<!DOCTYPE html><html><head><meta charset="utf-8"><title>Trip &lt;' || u.user_id || '&gt;</title><style>body{{font-family:sans-serif}}</style></head><body><h1>Trip &lt;' || u.user_id || '&gt;</h1>' || coalesce(body, '') || '</body></html>') AS page_sha256 FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN b ON b.user_id = u.user_id"""
)
def snk05_roadbooks(t: Tables) -> DataFrame:
    """A page for each trip, which loads nothing from elsewhere; some trips have no items."""
    e = F.col("event_id")
    title = F.when(e % 2 == 0, F.concat(F.lit("A & B <"), e.cast("string"), F.lit(">"))).otherwise(F.col("event_type"))
    items = t.events.where("user_id % 7 > 0").select(F.col("user_id").alias("trip"), F.to_date("ts").alias("date"), e.alias("seq"), F.when(e % 5 > 0, F.date_format("ts", "HH:mm")).alias("start_time"), title.alias("title"), F.when(e % 3 == 0, F.col("user_id").cast("string")).alias("note"))
    trips = t.events.select(F.col("user_id").alias("trip")).distinct().withColumn("name", F.concat(F.lit("Trip <"), F.col("trip").cast("string"), F.lit(">")))
    return R.roadbooks(trips, items).select("trip", "days", "items", F.col("external").cast("long").alias("external"), F.sha2("html", 256).alias("page_sha256"))


_PROBLEMS = """i AS (SELECT user_id AS trip, ts::DATE AS date, event_id AS seq, event_type AS kind, CASE WHEN event_id % 6 = 0 THEN '' ELSE 'road' END AS address, CASE event_id % 8 WHEN 0 THEN ' ' WHEN 1 THEN 'book' ELSE '' END AS booking, CASE WHEN event_id % 5 > 0 THEN event_id % 24 * 60 + event_id % 60 END AS minute,
 event_id % 9 > 0 AS has_leg, CASE WHEN event_id % 4 > 0 THEN 'walk' ELSE 'taxi' END AS mode, CASE WHEN event_id % 3 > 0 THEN event_id % 2000 END AS metres, event_id % 7 > 0 AS nav FROM events),
n AS (SELECT trip, date, count(*) AS n FROM i GROUP BY 1, 2), d AS (SELECT trip, date, n, CASE WHEN (trip + day(date)) % 6 = 0 THEN n ELSE n - 1 END AS legs, date - lag(date) OVER (PARTITION BY trip ORDER BY date) AS step FROM n),
s AS (SELECT trip, min(date) AS first, max(date) AS last FROM d GROUP BY 1), t AS (SELECT trip, CASE WHEN trip % 3 = 0 THEN DATE '2024-01-01' ELSE first END AS start, CASE WHEN trip % 4 = 0 THEN DATE '2024-01-31' ELSE last END AS end_, CASE WHEN trip % 5 = 0 THEN 1 ELSE 0 END AS external FROM s UNION ALL SELECT -1, NULL, NULL, 0),
x AS (SELECT i.*, d.legs = d.n - 1 AND lead(seq) OVER w IS NOT NULL AS leg, last_value(minute IGNORE NULLS) OVER (PARTITION BY i.trip, i.date ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM i JOIN d ON d.trip = i.trip AND d.date = i.date WINDOW w AS (PARTITION BY i.trip, i.date ORDER BY seq)),
c AS (SELECT t.trip, '' AS place, unnest([CASE WHEN s.trip IS NULL THEN 'no_days' END, CASE WHEN s.trip IS NOT NULL AND external > 0 THEN 'external_refs' END, CASE WHEN first <> start THEN 'start_mismatch' END, CASE WHEN last <> end_ THEN 'end_mismatch' END]) AS code FROM t LEFT JOIN s ON s.trip = t.trip
 UNION ALL SELECT trip, date::VARCHAR, unnest([CASE WHEN step <> 1 THEN 'date_gap' END, CASE WHEN legs <> n - 1 THEN 'leg_count' END]) FROM d
 UNION ALL SELECT trip, date || ' ' || seq, unnest([CASE WHEN kind = 'view' AND address = '' THEN 'poi_without_address' END, CASE WHEN booking = ' ' THEN 'empty_booking' END, CASE WHEN minute < before THEN 'time_out_of_order' END, CASE WHEN leg AND NOT has_leg THEN 'leg_missing' END, CASE WHEN leg AND has_leg AND metres IS NULL THEN 'leg_undescribed' END,
  CASE WHEN leg AND has_leg AND NOT nav THEN 'leg_without_nav' END, CASE WHEN leg AND has_leg AND mode = 'walk' AND metres >= 1500 THEN 'walk_too_far' END]) FROM x
 UNION ALL SELECT trip, 'b' || trip, unnest([CASE WHEN trip % 2 = 0 THEN 'booking_without_channel' END, CASE WHEN trip % 3 = 1 THEN 'booking_without_date' END]) FROM s)"""


@query(f"WITH {_PROBLEMS} SELECT trip, place, code, CASE WHEN code IN ('poi_without_address', 'leg_missing', 'leg_undescribed', 'leg_without_nav', 'walk_too_far') THEN 'warn' ELSE 'error' END AS severity FROM c WHERE code IS NOT NULL")
def ru17_roadbook_problems(t: Tables) -> DataFrame:
    """What is wrong with roadbooks made of events; odd coordinates are found by a query of their own."""
    e, u = F.col("event_id"), F.col("user_id")
    minute = F.when(e % 5 > 0, F.concat(F.lpad((e % 24).cast("string"), 2, "0"), F.lit(":"), F.lpad((e % 60).cast("string"), 2, "0")))
    leg = F.struct(F.when(e % 4 > 0, "walk").otherwise("taxi").alias("mode"), F.when(e % 3 > 0, e % 2000).alias("distance_m"), F.lit(None).cast("int").alias("minutes"), F.when(e % 7 > 0, "geo:").alias("nav"))
    items = t.events.select(
        u.alias("trip"), F.to_date("ts").alias("date"), e.alias("seq"), F.when(F.col("event_type") == "view", "poi").otherwise("meal").alias("kind"), F.when(e % 6 > 0, "road").otherwise("").alias("address"),
        F.when(e % 8 == 0, " ").when(e % 8 == 1, "book").otherwise("").alias("booking"), minute.alias("start_time"), F.when(e % 9 > 0, leg).alias("leg"),
    )
    n = items.groupBy("trip", "date").agg(F.count(F.lit(1)).alias("n"))
    days = n.select("trip", "date", F.when((F.col("trip") + F.dayofmonth("date")) % 6 == 0, F.col("n")).otherwise(F.col("n") - 1).alias("legs"))
    spans = days.groupBy("trip").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    trips = spans.select("trip", F.when(F.col("trip") % 3 == 0, F.lit("2024-01-01").cast("date")).otherwise(F.col("first")).alias("start"), F.when(F.col("trip") % 4 == 0, F.lit("2024-01-31").cast("date")).otherwise(F.col("last")).alias("end"), F.when(F.col("trip") % 5 == 0, 1).otherwise(0).alias("external"))
    trips = trips.unionByName(t.spark.createDataFrame([(-1, None, None, 0)], "trip long, start date, end date, external int"))
    bookings = spans.select("trip", F.concat(F.lit("b"), F.col("trip").cast("string")).alias("name"), F.when(F.col("trip") % 2 > 0, F.array(F.lit("web"))).otherwise(F.array().cast("array<string>")).alias("channels"), F.when(F.col("trip") % 3 != 1, F.col("first")).alias("visit_date"))
    bookings = bookings.unionByName(t.spark.createDataFrame([(-1, "nowhere", [], None)], bookings.schema))
    return R.trip_problems(trips, days, items, bookings)


_STORE = """s AS (SELECT o_custkey AS trip, o_orderkey AS stay FROM orders), d AS (SELECT trip, l_linenumber AS day, l_extendedprice AS price FROM s JOIN lineitem ON l_orderkey = stay),
a AS (SELECT trip, 'stay' AS name, count(*) AS n, 0.0::DOUBLE AS total FROM s GROUP BY 1 UNION ALL SELECT trip, 'day', count(*), 0 FROM d GROUP BY 1
 UNION ALL SELECT trip, 'transfer', count(*), sum(CASE WHEN trip % 3 = 0 THEN 2 * price ELSE price END) FROM d WHERE trip % 3 > 0 OR day > 1 GROUP BY 1)"""


@query(f"WITH {_STORE} SELECT trip, name, n, round(total, 2) AS total FROM a WHERE trip % 7 > 0")
def snk01_saved_trips(t: Tables) -> DataFrame:
    """What is left of trips in three tables after all were saved, the transfers of some replaced, and some deleted with all they had."""
    trip = F.col("o_custkey").alias("owner")
    stays = t.orders.select(trip, F.col("o_orderkey").alias("stay"))
    days = t.lineitem.join(stays, F.col("l_orderkey") == F.col("stay")).select("owner", F.col("l_linenumber").cast("long").alias("day"), F.col("l_extendedprice").cast("double").alias("price"))
    store = TableStore(t.spark, shared_folder(t.spark), "long", {"stay": "stay long", "day": "day long", "transfer": "day long, price double"})
    store.save(1, {"stay": stays, "day": days.select("owner", "day"), "transfer": days})
    again = days.where("owner % 3 = 0")
    store.save(2, {"transfer": again.where("day > 1").withColumn("price", 2 * F.col("price"))}, again.select("owner"))
    store.delete(3, stays.where("owner % 7 = 0").select("owner"))
    rows = None
    for name in store.schemas:
        total = F.round(F.sum("price"), 2) if name == "transfer" else F.lit(0.0)
        part = store.read(name).groupBy(F.col("owner").alias("trip")).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), total.alias("total"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


@query(f"WITH {_STORE} SELECT 'stay' AS name, count(*) AS gone FROM s WHERE trip % 7 = 0 UNION ALL SELECT 'day', count(*) FROM d WHERE trip % 7 = 0 UNION ALL SELECT 'transfer', 0")
def snk04_deleted_trips(t: Tables) -> DataFrame:
    """How many rows of each table go with deleted trips; transfers aren't stored here."""
    stays = t.orders.select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("stay"))
    days = t.lineitem.join(stays, F.col("l_orderkey") == F.col("stay")).select("owner", F.col("l_linenumber").cast("long").alias("day"))
    store = TableStore(t.spark, shared_folder(t.spark), "long", {"stay": "stay long", "day": "day long", "transfer": "day long, price double"})
    store.save(1, {"stay": stays, "day": days})
    store.delete(2, stays.where("owner % 7 = 0").select("owner"))
    return store.removed_by(2).select("name", F.col("rows").alias("gone"))


_POOL = """c AS (SELECT l_suppkey % 25 AS city, CASE WHEN l_partkey % 31 > 0 THEN l_partkey % 150 END AS poi_id, l_orderkey * 10 + l_linenumber AS claim_id, CASE l_returnflag WHEN 'R' THEN 'avoid' ELSE 'highlight' END AS polarity, CASE WHEN l_linestatus = 'F' THEN 'high' END AS confidence, l_linenumber AS sources FROM lineitem),
p AS (SELECT p_partkey AS poi_id, p_name AS name FROM part WHERE p_partkey % 8 > 0), r AS (SELECT p_partkey AS poi_id, p_partkey % 3 > 0 AS required, (p_partkey % 20)::INT AS days, CASE WHEN p_partkey % 2 = 0 THEN '20:00' END AS at_time FROM part WHERE p_partkey % 4 > 1),
i AS (SELECT user_id AS trip, CASE WHEN event_type = 'purchase' THEN 'meal' ELSE 'poi' END AS kind, CASE WHEN event_id % 9 > 0 THEN event_id % 160 END AS poi_id, 'hall ' || (event_id % 160) AS title, ts::DATE AS date, user_id % 25 AS city FROM events),
n AS (SELECT city, poi_id, count(*) AS claims, count_if(coalesce(confidence, '') = 'high')::BIGINT AS sure, count_if(polarity = 'highlight')::BIGINT AS highlights, count_if(polarity = 'avoid')::BIGINT AS avoids FROM c WHERE poi_id IS NOT NULL GROUP BY 1, 2),
k AS (SELECT n.*, coalesce(name, n.poi_id::VARCHAR) AS name, required, days, at_time, row_number() OVER (PARTITION BY city ORDER BY claims DESC, sure DESC, coalesce(name, n.poi_id::VARCHAR), n.poi_id) AS place FROM n LEFT JOIN p ON p.poi_id = n.poi_id LEFT JOIN r ON r.poi_id = n.poi_id QUALIFY place <= 60)"""


def _pool_tables(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Claims, places, rules and items made of lines, parts and events."""
    k, e = F.col("p_partkey"), F.col("event_id")
    claims = t.lineitem.select(
        (F.col("l_suppkey") % 25).alias("city"), F.when(F.col("l_partkey") % 31 > 0, F.col("l_partkey") % 150).alias("poi_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("claim_id"),
        F.when(F.col("l_returnflag") == "R", "avoid").otherwise("highlight").alias("polarity"), F.when(F.col("l_linestatus") == "F", "high").alias("confidence"), F.col("l_linenumber").alias("sources"),
    )
    places = t.part.where(k % 8 > 0).select(k.alias("poi_id"), F.col("p_name").alias("name"))
    rules = t.part.select(k.alias("poi_id"), (k % 3 > 0).alias("required"), F.when(k % 4 > 1, "reviewed").otherwise("draft").alias("status"), (k % 20).cast("int").alias("advance_days"), F.when(k % 2 == 0, "20:00").alias("release_time"))
    items = t.events.select(
        F.col("user_id").alias("trip"), F.when(F.col("event_type") == "purchase", "meal").otherwise("poi").alias("kind"), F.when(e % 9 > 0, e % 160).alias("poi_id"), F.concat(F.lit("hall "), (e % 160).cast("string")).alias("title"),
        F.to_date("ts").alias("date"), (F.col("user_id") % 25).alias("city"),
    )
    return claims, places, rules, items


@query(f"WITH {_POOL}, q AS (SELECT *, row_number() OVER (PARTITION BY poi_id, polarity ORDER BY coalesce(confidence, '') <> 'high', sources DESC, claim_id) AS place, count(*) OVER (PARTITION BY poi_id, polarity) AS n FROM c) SELECT trip, v.poi_id, polarity, place::INT AS place, claim_id, greatest(n - 8, 0) AS others FROM (SELECT DISTINCT trip, poi_id FROM i WHERE kind = 'poi' AND poi_id IS NOT NULL) v JOIN q ON q.poi_id = v.poi_id WHERE place <= 8")
def tr10_trip_insights(t: Tables) -> DataFrame:
    """The first claims for and against each place of a trip."""
    claims, _, _, items = _pool_tables(t)
    return pool.trip_insights(items, claims)


@query(f"WITH {_POOL} SELECT city, place::INT AS place, poi_id, name, claims, sure, highlights, avoids, required AS booking_required, days AS booking_days, at_time AS booking_time FROM k")
def tr11_city_candidates(t: Tables) -> DataFrame:
    """Candidates of each city, with what reviewed rules say of their booking."""
    claims, places, rules, _ = _pool_tables(t)
    return pool.city_candidates(claims, places, rules)


@query(
    f"""WITH {_POOL}, v AS (SELECT trip, poi_id, title, min(city) AS city FROM i WHERE kind = 'poi' AND poi_id IS NOT NULL GROUP BY 1, 2, 3), w AS (SELECT v.trip, k.poi_id IS NOT NULL AS known, coalesce(required, false) AS required FROM v LEFT JOIN k ON k.city = v.city AND k.poi_id = v.poi_id),
a AS (SELECT trip, count(*) AS total, count_if(known)::BIGINT AS recommended, count_if(required)::BIGINT AS bookings FROM w GROUP BY 1), u AS (SELECT trip, count_if(kind = 'poi' AND poi_id IS NULL)::BIGINT AS unresolved FROM i GROUP BY 1)
SELECT trip, coalesce(total, 0) AS total, coalesce(recommended, 0) AS recommended, coalesce(bookings, 0) AS bookings, unresolved, round(recommended / total, 6) AS ratio FROM u LEFT JOIN a USING (trip)"""
)
def tr09_trip_coverage(t: Tables) -> DataFrame:
    """How much of each trip is among the candidates of its city."""
    claims, places, rules, items = _pool_tables(t)
    return pool.trip_coverage(items, pool.city_candidates(claims, places, rules))
