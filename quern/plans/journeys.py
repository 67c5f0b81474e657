"""Booking rules, transfers between cities, legs between the items of a day, and places for meals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import booking as B
from ..operators import legs as L
from ..operators import roadbook
from .registry import Tables, query

TODAY = "1996-06-01"


def _today() -> Column:
    return F.lit(TODAY).cast("date")


_RULES = """r AS (SELECT p_partkey AS poi_id, p_partkey % 3 > 0 AS required, CASE WHEN p_partkey % 2 = 0 THEN 'reviewed' ELSE 'draft' END AS status, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size * 3 END AS advance, p_partkey % 4 > 0 AS channel,
 CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '25:00' WHEN 2 THEN '8:00' ELSE '08:30' END AS time, p_partkey % 6 = 5 AS no_name, p_partkey % 7 > 0 AS evidence, CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE DATE '1996-01-01' + (p_partkey % 200)::INT END AS reviewed_at FROM part)"""
_CODES = """list_filter([CASE WHEN required AND advance IS NULL THEN 'no_advance_days' END, CASE WHEN required AND advance > 90 THEN 'implausible_advance_days' END, CASE WHEN required AND NOT channel THEN 'no_channel' END,
 CASE WHEN NOT required AND advance IS NOT NULL THEN 'advance_days_without_required' END, CASE WHEN time IS NOT NULL AND NOT regexp_full_match(time, '([01]\\d|2[0-3]):[0-5]\\d') THEN 'bad_release_time' END,
 CASE WHEN status = 'reviewed' AND NOT evidence THEN 'reviewed_without_evidence' END, CASE WHEN status = 'reviewed' AND reviewed_at IS NULL THEN 'reviewed_without_date' END, CASE WHEN status = 'reviewed' AND reviewed_at + 90 <= DATE '1996-06-01' THEN 'review_overdue' END,
 CASE WHEN status = 'draft' AND evidence AND reviewed_at IS NOT NULL THEN 'draft_but_ready' END, CASE WHEN required AND no_name THEN 'unknown_real_name' END], lambda x: x IS NOT NULL)"""
_ERRORS = "['implausible_advance_days', 'no_channel', 'bad_release_time', 'reviewed_without_evidence', 'reviewed_without_date']"


def _rules(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    time = F.when(k % 6 == 1, "25:00").when(k % 6 == 2, "8:00").when(k % 6 != 0, "08:30")
    return t.part.select(
        k.alias("poi_id"), (k % 3 > 0).alias("required"), F.when(k % 2 == 0, "reviewed").otherwise("draft").alias("status"), F.when(k % 5 != 0, F.col("p_size") * 3).alias("advance_days"), time.alias("release_time"),
        F.when(k % 4 > 0, F.array(F.lit("web"))).otherwise(F.array().cast("array<string>")).alias("channels"), F.when(k % 6 != 5, F.lit(True)).alias("real_name"), F.lit(None).cast("string").alias("id_note"), F.lit(None).cast("string").alias("closed_days"),
        F.when(k % 7 > 0, "https://example.com").alias("evidence_url"), F.when(k % 8 != 0, F.date_add(F.lit("1996-01-01").cast("date"), (k % 200).cast("int"))).alias("reviewed_at"),
    )


@query(f"WITH {_RULES}, f AS (SELECT poi_id, unnest({_CODES}) AS code FROM r) SELECT poi_id, code, CASE WHEN list_contains({_ERRORS}, code) THEN 'error' ELSE 'warn' END AS severity FROM f")
def ru05_rule_findings(t: Tables) -> DataFrame:
    return B.findings(_rules(t), _today())


@query(
    f"""WITH {_RULES}, a AS (SELECT *, poi_id % 3 = 1 AS asked, poi_id % 9 = 1 AS revoke FROM r), x AS (SELECT * REPLACE ('reviewed' AS status, DATE '{TODAY}' AS reviewed_at) FROM a WHERE asked AND NOT revoke),
b AS (SELECT poi_id FROM x WHERE len(list_filter({_CODES}, lambda c: list_contains({_ERRORS}, c))) > 0)
SELECT a.poi_id, CASE WHEN asked AND revoke THEN 'draft' WHEN asked AND b.poi_id IS NULL THEN 'reviewed' ELSE status END AS status, CASE WHEN asked THEN revoke OR b.poi_id IS NULL END AS accepted FROM a LEFT JOIN b ON a.poi_id = b.poi_id"""
)
def ru06_reviewed_rules(t: Tables) -> DataFrame:
    asked = t.part.where("p_partkey % 3 = 1").select(F.col("p_partkey").alias("poi_id"), (F.col("p_partkey") % 9 == 1).alias("revoke"))
    return B.reviewed(_rules(t), asked, _today()).select("poi_id", "status", "accepted")


@query(
    f"""WITH {_RULES}, s AS (SELECT CASE WHEN poi_id % 17 = 0 THEN -poi_id - 1 ELSE poi_id END AS poi_id, required, CASE WHEN poi_id % 10 < 3 THEN coalesce(advance, 0) + 1 ELSE advance END AS advance FROM r WHERE poi_id % 13 > 0)
SELECT coalesce(r.poi_id, s.poi_id) AS poi_id, CASE WHEN s.poi_id IS NULL OR (r.poi_id IS NOT NULL AND r.advance IS NOT DISTINCT FROM s.advance) THEN r.status ELSE 'draft' END AS status,
 CASE WHEN s.poi_id IS NULL THEN 'kept' WHEN r.poi_id IS NULL THEN 'new' WHEN r.advance IS NOT DISTINCT FROM s.advance THEN 'unchanged' ELSE 'changed' END AS change FROM r FULL JOIN s ON r.poi_id = s.poi_id"""
)
def ru07_seeded_rules(t: Tables) -> DataFrame:
    k = F.col("poi_id")
    seed = _rules(t).where(k % 13 > 0).withColumn("advance_days", F.when(k % 10 < 3, F.coalesce("advance_days", F.lit(0)) + 1).otherwise(F.col("advance_days"))).withColumn("poi_id", F.when(k % 17 == 0, -k - 1).otherwise(k))
    return B.seeded(_rules(t), seed).select("poi_id", "status", "change")


@query(f"WITH {_RULES} SELECT poi_id, (reviewed_at + 90)::VARCHAR AS due, date_diff('day', DATE '{TODAY}', reviewed_at + 90) AS days_left FROM r WHERE status = 'reviewed' AND reviewed_at + 90 <= DATE '{TODAY}' + 14")
def ru08_due_rules(t: Tables) -> DataFrame:
    return B.due_rules(_rules(t), _today()).select("poi_id", F.col("due").cast("string").alias("due"), F.col("days_left").cast("long").alias("days_left"))


@query(
    f"""WITH {_RULES}, d AS (SELECT 'rule' AS kind, poi_id::VARCHAR AS id, reviewed_at + 90 AS due FROM r WHERE status = 'reviewed' UNION ALL SELECT 'claim', o_orderkey::VARCHAR, o_orderdate::DATE + 180 FROM orders WHERE o_orderstatus <> 'P'),
w AS (SELECT *, date_diff('day', DATE '{TODAY}', due) AS days_left FROM d WHERE due <= DATE '{TODAY}' + 14) SELECT kind, id, days_left, row_number() OVER (ORDER BY days_left, kind, id) AS place FROM w"""
)
def or10_scan_report(t: Tables) -> DataFrame:
    """Rules and claims that are due, soonest first."""
    from ..operators.ordering import numbered

    claims = t.orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"), F.date_add(F.to_date("o_orderdate"), 180).alias("due"))
    found = B.scan(_rules(t), claims, _today()).select("kind", "id", F.col("days_left").cast("long").alias("days_left"))
    return numbered(found, [F.col("days_left"), F.col("kind"), F.col("id")])


@query("SELECT DISTINCT o_custkey AS trip, l_partkey AS poi_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_partkey % 2 = 1")
def ru04_draft_places(t: Tables) -> DataFrame:
    visits = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("trip"), F.col("l_partkey").alias("poi_id"))
    return B.draft_places(visits, _rules(t))


def _advice(minutes: str, available: str, km: str, unknown: str) -> str:
    said = lambda mode, why: f"'{mode}|{why}'"
    return f"""CASE WHEN {km} <= 60 THEN {said('coach', 'short')} WHEN {unknown} AND coalesce({km} <= 1200, false) THEN {said('rail', 'by_distance')} WHEN {unknown} THEN {said('air', 'far')} WHEN NOT {available} OR {minutes} IS NULL THEN {said('air', 'no_rail')}
 WHEN {minutes} <= 240 THEN {said('rail', 'fast')} WHEN {minutes} < 360 THEN {said('rail', 'bearable')} ELSE {said('air', 'slow_rail')} END"""


@query(
    f"""WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_orderkey % 500)::INT END AS minutes, CASE WHEN o_orderkey % 13 > 0 THEN (o_orderkey % 3000)::DOUBLE END AS km, o_orderkey % 4 = 0 AS unknown, o_orderkey % 6 > 0 AS available FROM orders),
a AS (SELECT o_orderkey, {_advice('minutes', 'available', 'km', 'unknown')} AS a FROM x) SELECT o_orderkey, split_part(a, '|', 1) AS mode, split_part(a, '|', 2) AS why,
 CASE split_part(a, '|', 2) WHEN 'short' THEN ['drive', 'rail'] WHEN 'no_rail' THEN ['coach', 'drive'] WHEN 'far' THEN ['rail'] WHEN 'slow_rail' THEN ['rail'] ELSE ['air'] END AS other FROM a"""
)
def ru13_transfer_advice(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    advice = B.transfer_advice(F.when(k % 5 != 0, (k % 500).cast("int")), k % 6 > 0, F.when(k % 13 > 0, (k % 3000).cast("double")), k % 4 == 0)
    return t.orders.select(k, advice.alias("a")).select("o_orderkey", "a.mode", "a.why", "a.other")


@query(
    f"""WITH s AS (SELECT o_custkey AS trip, o_orderkey AS stay, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seq, o_orderkey % 5 AS city, DATE '{TODAY}' + (o_orderkey % 20)::INT AS first, DATE '{TODAY}' + (o_orderkey % 20)::INT + 2 AS last FROM orders),
t AS (SELECT s_suppkey % 5 AS a, s_suppkey // 5 % 5 AS b, DATE '{TODAY}' + (s_suppkey % 15)::INT AS d, 'G' || s_suppkey AS service, 100 + s_suppkey * 37 % 400 AS minutes, abs(s_suppkey % 5 - s_suppkey // 5 % 5) * 500.0 AS km FROM supplier),
n AS (SELECT a, b, d, list({{'m': minutes, 's': service}} ORDER BY minutes, service) AS trains FROM t GROUP BY 1, 2, 3), f AS (SELECT a, b, max(km) AS km FROM t GROUP BY 1, 2),
l AS (SELECT trip, stay, lead(stay) OVER w AS next, city AS a, lead(city) OVER w AS b, last, lead(first) OVER w AS next_first FROM s WINDOW w AS (PARTITION BY trip ORDER BY seq)),
p AS (SELECT l.*, km FROM l LEFT JOIN f ON f.a = l.a AND f.b = l.b WHERE next IS NOT NULL),
q AS (SELECT p.*, date_diff('day', DATE '{TODAY}', last) NOT BETWEEN 0 AND 14 AS unknown, CASE WHEN date_diff('day', DATE '{TODAY}', last) BETWEEN 0 AND 14 THEN coalesce(trains, []) END AS tr FROM p LEFT JOIN n ON n.a = p.a AND n.b = p.b AND d = last),
u AS (SELECT q.*, {_advice('tr[1].m', 'coalesce(len(tr), 0) > 0', 'km', 'unknown')} AS adv FROM q),
v AS (SELECT u.*, CASE WHEN split_part(adv, '|', 1) = 'air' OR coalesce(tr[1].m > 240, false) THEN next_first ELSE last END AS day FROM u),
x AS (SELECT v.trip, v.stay, v.next, v.day, v.km, date_diff('day', DATE '{TODAY}', day) NOT BETWEEN 0 AND 14 AS unknown, CASE WHEN date_diff('day', DATE '{TODAY}', day) BETWEEN 0 AND 14 THEN coalesce(trains, []) END AS tr FROM v LEFT JOIN n ON n.a = v.a AND n.b = v.b AND d = day),
y AS (SELECT x.*, {_advice('tr[1].m', 'coalesce(len(tr), 0) > 0', 'km', 'unknown')} AS adv FROM x)
SELECT trip, stay, next, day::VARCHAR AS day, split_part(adv, '|', 1) AS mode, split_part(adv, '|', 2) AS why, tr[1].s AS service, coalesce(list_transform(tr[2:4], lambda z: z.s), []) AS others FROM y"""
)
def ru16_transfers(t: Tables) -> DataFrame:
    k, s = F.col("o_orderkey"), F.col("s_suppkey")
    first = F.date_add(_today(), (k % 20).cast("int"))
    stays = t.orders.select(F.col("o_custkey").alias("trip"), k.alias("stay"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("seq"), (k % 5).alias("city"), first.alias("first"), F.date_add(first, 2).alias("last"))
    a, b = s % 5, F.floor(s / 5) % 5
    rail = t.supplier.select(a.alias("a"), b.alias("b"), F.date_add(_today(), (s % 15).cast("int")).alias("travel_date"), F.concat(F.lit("G"), s.cast("string")).alias("service"), (100 + s * 37 % 400).alias("minutes"), (F.abs(a - b) * 500.0).alias("km"))
    return B.transfers(stays, rail, _today()).withColumn("day", F.col("day").cast("string"))


_HALF = "2 * 6371000.0 * asin(sqrt(pow(sin(radians({2} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({2})) * pow(sin(radians({3} - {1}) / 2), 2)))"
_ITEMS = """o AS (SELECT p_partkey AS poi_id, 30 + (p_partkey * 37 % 1000) / 100000.0::DOUBLE AS lat, 100 + (p_partkey * 91 % 1000) / 100000.0::DOUBLE AS lng FROM part WHERE p_partkey % 4 > 0),
i AS (SELECT e.user_id AS trip, ts::DATE::VARCHAR AS day, e.event_id AS item_id, e.event_id AS seq, CASE e.event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '25:99' ELSE strftime(ts, '%H:%M') END AS start, 'hall ' || (e.event_id % 20) AS title, CASE WHEN event_type = 'purchase' THEN 'meal' ELSE 'poi' END AS kind,
 coalesce(o.lat, CASE WHEN e.event_id % 3 > 0 THEN 30 + (e.event_id % 1000) / 100000.0::DOUBLE END) AS lat, coalesce(o.lng, CASE WHEN e.event_id % 3 > 0 THEN 100 + (e.event_id % 1000) / 100000.0::DOUBLE END) AS lng FROM events e LEFT JOIN o ON o.poi_id = CASE WHEN event_type <> 'purchase' THEN e.event_id % 50 END),
m AS (SELECT *, CASE WHEN regexp_full_match(start, '([01]\\d|2[0-3]):[0-5]\\d') THEN left(start, 2)::INT * 60 + right(start, 2)::INT END AS minute FROM i),
l AS (SELECT *, lead(item_id) OVER w AS to_item, lead(lat) OVER w AS to_lat, lead(lng) OVER w AS to_lng FROM m WINDOW w AS (PARTITION BY trip, day ORDER BY minute IS NULL, minute, seq, item_id)),
g AS (SELECT trip, day, item_id, to_item, printf('%.5f,%.5f->%.5f,%.5f|%s', lat, lng, to_lat, to_lng, to_item::VARCHAR) AS key, """ + _HALF.format("lat", "lng", "to_lat", "to_lng") + """ AS metres FROM l WHERE to_item IS NOT NULL AND lat IS NOT NULL AND lng IS NOT NULL AND to_lat IS NOT NULL AND to_lng IS NOT NULL)"""


def _poi(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    return t.part.where(k % 4 > 0).select(k.alias("poi_id"), (30 + (k * 37 % 1000) / 100000.0).alias("lat"), (100 + (k * 91 % 1000) / 100000.0).alias("lng"))


def _items(t: Tables) -> DataFrame:
    e, meal = F.col("event_id"), F.col("event_type") == "purchase"
    start = F.when(e % 5 == 1, "25:99").when(e % 5 > 1, F.date_format("ts", "HH:mm"))
    return t.events.select(
        F.col("user_id").alias("trip"), F.to_date("ts").cast("string").alias("day"), e.alias("item_id"), e.alias("seq"), start.alias("start_time"), F.concat(F.lit("hall "), (e % 20).cast("string")).alias("title"),
        F.when(meal, "meal").otherwise("poi").alias("kind"), F.when(~meal, e % 50).alias("poi_id"), F.when(e % 3 > 0, 30 + (e % 1000) / 100000.0).alias("lat"), F.when(e % 3 > 0, 100 + (e % 1000) / 100000.0).alias("lng"),
        F.when(e % 7 == 0, "walk").alias("leg_mode"), F.when(e % 7 == 0, "worn out").alias("leg_key"), F.lit(None).cast("string").alias("address"),
    )


@query(f"WITH {_ITEMS} SELECT day, item_id, to_item, key FROM g")
def ge03_leg_fingerprints(t: Tables) -> DataFrame:
    return L.pending_legs(_items(t), _poi(t)).select("day", "item_id", "to_item", "key")


@query(f"WITH {_ITEMS} SELECT trip, day, item_id, to_item, round(metres, 1) AS metres FROM g")
def ge04_pending_legs(t: Tables) -> DataFrame:
    return L.pending_legs(_items(t), _poi(t)).select("trip", "day", "item_id", "to_item", F.round("metres", 1).alias("metres"))


@query(
    f"""WITH {_ITEMS}, r AS (SELECT item_id, key, CASE WHEN metres <= 1500 THEN 'walk' ELSE 'drive' END AS mode, round_even(metres * 1.3, 0)::BIGINT AS distance_m, round_even(metres * 1.3, 0)::BIGINT AS seconds FROM g WHERE item_id % 6 > 0)
SELECT i.item_id, coalesce(r.mode, CASE WHEN i.item_id % 7 = 0 THEN 'walk' END) AS leg_mode, distance_m AS leg_distance_m, CASE WHEN r.item_id IS NOT NULL THEN greatest(1, round_even(seconds / 60, 0)::INT) END AS leg_minutes FROM i LEFT JOIN r USING (item_id)"""
)
def ge05_applied_legs(t: Tables) -> DataFrame:
    """Items with the legs of routes that were found; the routes stand for answers of a route service."""
    pending = L.pending_legs(_items(t), _poi(t))
    long = F.bround(F.col("metres") * 1.3).cast("long")
    routes = pending.where("item_id % 6 > 0").select("key", F.when(F.col("metres") <= 1500, "walk").otherwise("drive").alias("how"), long.alias("distance_m"), long.alias("seconds"))
    return L.with_legs(_items(t), L.planned_legs(pending, routes)).select("item_id", "leg_mode", "leg_distance_m", "leg_minutes")


@query(f"WITH {_ITEMS}, a AS (SELECT trip, day, list(item_id ORDER BY seq) AS anchors FROM i WHERE kind = 'poi' AND lat IS NOT NULL AND lng IS NOT NULL GROUP BY 1, 2) SELECT item_id, title, coalesce(anchors, []) AS anchors FROM i LEFT JOIN a USING (trip, day) WHERE kind = 'meal' AND lat IS NULL")
def ge06_pending_meals(t: Tables) -> DataFrame:
    return L.pending_meals(_items(t), _poi(t)).select("item_id", "title", F.transform("anchors", lambda a: a["item_id"]).alias("anchors"))


_FOUND = f"""{_ITEMS}, w AS (SELECT item_id, trip, day, title, CASE WHEN item_id % 11 = 0 THEN title || '、面' ELSE title END AS asked, item_id % 20 AS h FROM i WHERE kind = 'meal' AND lat IS NULL),
c AS (SELECT item_id, trip, day, asked, p_partkey AS poi_id, p_partkey % 2 AS round, CASE p_partkey % 8 WHEN 0 THEN title WHEN 4 THEN title || '公园' WHEN 6 THEN title ELSE title || '-' || p_type END AS name, CASE p_partkey % 8 WHEN 0 THEN 1.0 WHEN 4 THEN 0.95 WHEN 6 THEN 1.0 ELSE 0.9 END::DOUBLE AS score,
 p_partkey % 5 > 0 AS food, p_partkey % 7 > 0 AS here, CASE WHEN p_partkey % 9 > 0 THEN 30 + (p_partkey % 1000) / 100000.0::DOUBLE END AS lat, CASE WHEN p_partkey % 9 > 0 THEN 100 + (p_partkey % 1000) / 100000.0::DOUBLE END AS lng FROM w JOIN part ON p_partkey // 8 = h)"""


def _meals(t: Tables) -> DataFrame:
    e = F.col("item_id")
    return L.pending_meals(_items(t), _poi(t)).withColumn("title", F.when(e % 11 == 0, F.concat("title", F.lit("、面"))).otherwise(F.col("title"))).withColumn("city", F.lit("610100"))


def _found(t: Tables) -> DataFrame:
    """Places that searches for meals find: those of the part with the number in the title."""
    k, title = F.col("p_partkey"), F.concat(F.lit("hall "), (F.col("item_id") % 20).cast("string"))
    rows = _meals(t).select("item_id").join(t.part.withColumn("h", F.floor(F.col("p_partkey") / 8)), F.col("item_id") % 20 == F.col("h"))
    name = F.when((k % 8).isin(0, 6), title).when(k % 8 == 4, F.concat(title, F.lit("公园"))).otherwise(F.concat(title, F.lit("-"), "p_type"))
    spot = lambda base: F.when(k % 9 > 0, base + (k % 1000) / 100000.0)
    return rows.select(
        "item_id", (k % 2).alias("round"), k.alias("poi_id"), name.alias("name"), F.when(k % 5 > 0, "050100").otherwise("110000").alias("typecode"), F.lit("").alias("type_name"), F.when(k % 7 > 0, "610102").otherwise("320100").alias("adcode"), spot(30).alias("lat"), spot(100).alias("lng"),
        F.lit("road 1").alias("address"),
    )


_DECIDED = f"""{_FOUND}, z AS (SELECT item_id, round, count_if(here) AS nh, count_if(here AND food) AS n, max(CASE WHEN here AND food THEN score END) AS top FROM c WHERE NOT contains(asked, '、') GROUP BY 1, 2),
y AS (SELECT z.*, count(c.poi_id) AS ties, max(c.poi_id) AS poi_id FROM z LEFT JOIN c ON c.item_id = z.item_id AND c.round = z.round AND here AND food AND score = top GROUP BY ALL),
x AS (SELECT y.*, c.lat, c.lng, CASE WHEN nh = 0 THEN 'other_city' WHEN n = 0 THEN 'no_food' WHEN top < 0.8::DOUBLE THEN 'unlike' WHEN ties > 1 THEN 'tie' WHEN c.lat IS NULL THEN 'no_place' ELSE 'found' END AS reason FROM y LEFT JOIN c ON c.item_id = y.item_id AND c.poi_id = y.poi_id),
v AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY reason <> 'found', round) AS k FROM x),
q AS (SELECT w.item_id, CASE WHEN contains(asked, '、') THEN 'no_shop' ELSE coalesce(reason, 'nothing') END AS reason, CASE WHEN reason = 'found' THEN poi_id END AS poi_id, v.lat, v.lng FROM w LEFT JOIN v ON v.item_id = w.item_id AND k = 1)"""


@query(f"WITH {_DECIDED} SELECT item_id, reason, poi_id FROM q")
def ge07_meal_decisions(t: Tables) -> DataFrame:
    return L.meal_decisions(_meals(t), _found(t)).select("item_id", "reason", "poi_id")


@query(
    f"""WITH {_FOUND}, d AS (SELECT item_id, poi_id, any_value(score) AS score, any_value(name) AS name, any_value(c.lat) AS lat, any_value(c.lng) AS lng, any_value(c.day) AS day, any_value(c.trip) AS trip FROM c WHERE here AND food AND NOT contains(asked, '、') GROUP BY 1, 2),
n AS (SELECT d.item_id, d.poi_id, any_value(score) AS score, any_value(name) AS name, round_even(min({_HALF.format('d.lat', 'd.lng', 'a.lat', 'a.lng')}), 0)::BIGINT AS metres FROM d LEFT JOIN i a ON a.trip = d.trip AND a.day = d.day AND a.kind = 'poi' AND a.lat IS NOT NULL AND a.lng IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, metres NULLS LAST, name, poi_id) AS place, count(*) OVER (PARTITION BY item_id) AS total FROM n) SELECT item_id, place, total, poi_id, score, metres FROM r WHERE place <= 8"""
)
def ge08_meal_candidates(t: Tables) -> DataFrame:
    found = L.meal_candidates(_meals(t).where("NOT contains(title, '、')"), _found(t))
    return found.withColumn("place", F.col("place").cast("long"))


@query(f"WITH {_DECIDED} SELECT i.item_id, coalesce(i.lat, CASE WHEN q.reason = 'found' THEN q.lat END) IS NOT NULL AS placed, q.reason IS NOT NULL AND q.reason = 'found' AS written FROM i LEFT JOIN q USING (item_id) WHERE kind = 'meal'")
def ge09_applied_meals(t: Tables) -> DataFrame:
    chosen = L.meal_decisions(_meals(t), _found(t)).where("reason = 'found'").withColumn("address", F.lit("road 1"))
    return L.with_meals(_items(t), chosen).where("kind = 'meal'").select("item_id", F.col("lat").isNotNull().alias("placed"), "written")


_BOOK = _ITEMS.replace("CASE WHEN event_type = 'purchase' THEN 'meal' ELSE 'poi' END AS kind,", "CASE WHEN event_type = 'purchase' THEN 'meal' ELSE 'poi' END AS kind, e.user_id, CASE WHEN event_type <> 'purchase' THEN e.event_id % 50 END AS poi_id, o.poi_id AS known,")
_LEG_MODE = "CASE WHEN {0} <= 1500 THEN 'walk' WHEN {0} <= 6000 THEN 'metro' ELSE 'taxi' END"


@query(
    f"""WITH {_BOOK}, c AS (SELECT l_partkey AS poi_id, count_if(l_returnflag <> 'R')::BIGINT AS highlights, count_if(l_returnflag = 'R')::BIGINT AS avoids FROM lineitem GROUP BY 1),
b AS (SELECT p_partkey AS poi_id, CASE WHEN p_partkey % 3 > 0 THEN CASE WHEN p_partkey % 5 = 0 THEN '必须提前线上预约，放票口径以官方渠道为准' ELSE '需预约，提前 ' || (p_partkey % 5) || ' 天' || CASE WHEN p_partkey % 2 = 0 THEN ' 20:00' ELSE '' END || '放票' END END AS booking FROM part WHERE p_partkey % 4 <> 1),
w AS (SELECT l.*, lead(title) OVER w AS to_title, row_number() OVER w AS turn, {_HALF.format("lat", "lng", "to_lat", "to_lng")} AS far FROM l WINDOW w AS (PARTITION BY trip, day ORDER BY minute IS NULL, minute, seq, item_id)),
x AS (SELECT w.*, to_lat IS NOT NULL AND to_lng IS NOT NULL AND lat IS NOT NULL AND lng IS NOT NULL AS ends, coalesce(highlights, 0) AS highlights, coalesce(avoids, 0) AS avoids, booking, item_id % 7 = 0 AS stored FROM w LEFT JOIN c ON c.poi_id = w.poi_id LEFT JOIN b ON b.poi_id = w.poi_id),
t AS (SELECT trip, day, turn, concat_ws('|', title, kind, start, highlights, avoids, booking) AS item, to_item IS NOT NULL AS way, kind = 'poi' AND known IS NULL AS warned,
 CASE WHEN ends THEN concat_ws('|', CASE WHEN stored THEN 'walk' ELSE {_LEG_MODE.format("far")} END, CASE WHEN stored THEN 77 ELSE round_even(far, 0)::BIGINT END, CASE WHEN NOT stored THEN greatest(1, round_even(far / 1000 / CASE WHEN far <= 1500 THEN 4.5::DOUBLE WHEN far <= 6000 THEN 25.0::DOUBLE ELSE 22.0::DOUBLE END * 60, 0)::INT) END, title || '>' || to_title, NOT stored) ELSE '-' END AS leg FROM x)
SELECT trip, day, count(*) AS n_items, count_if(way)::BIGINT AS n_legs, string_agg(item, chr(10) ORDER BY turn) AS items, coalesce(string_agg(leg, chr(10) ORDER BY turn) FILTER (way), '') AS legs, CASE WHEN trip % 2 = 0 THEN 'rain' END AS weather, count_if(warned)::BIGINT AS warnings FROM t GROUP BY 1, 2"""
)
def ru18_roadbook_days(t: Tables) -> DataFrame:
    """The days of roadbooks, with claims, bookings, stored and estimated ways, and weather; shown as text."""
    k = F.col("p_partkey")
    items = _items(t).withColumns({"leg_distance_m": F.when(F.col("item_id") % 7 == 0, 77), "leg_minutes": F.lit(None).cast("int")})
    poi = _poi(t).withColumns({"name": F.lit(None).cast("string"), "address": F.lit(None).cast("string")})
    claims = t.lineitem.select(F.col("l_partkey").alias("poi_id"), F.when(F.col("l_returnflag") == "R", "avoid").otherwise("highlight").alias("polarity"), F.lit("").alias("text"))
    rules = t.part.select(k.alias("poi_id"), F.when(k % 4 == 1, "draft").otherwise("reviewed").alias("status"), (k % 3 > 0).alias("required"), F.when(k % 5 > 0, (k % 5).cast("int")).alias("advance_days"), F.when(k % 2 == 0, "20:00").alias("release_time"))
    weather = items.where("trip % 2 = 0").select("trip", "day", F.lit("rain").alias("text")).distinct()
    found = roadbook.assembled(items, poi, claims, rules, weather)
    shown = F.array_join(F.transform("items", lambda x: F.concat_ws("|", x["title"], x["kind"], x["start_time"], x["highlights"], x["avoids"], x["booking"])), "\n")
    between = lambda x: F.regexp_replace(x["nav"], "^.*from=[^,]*,[^,]*,(.*)&to=[^,]*,[^,]*,(.*)&mode=.*$", "$1>$2")
    ways = F.array_join(F.transform("legs", lambda x: F.when(x.isNull(), "-").otherwise(F.concat_ws("|", x["mode"], x["distance_m"], x["minutes"], between(x), x["estimated"].cast("string")))), "\n")
    return found.select("trip", "day", F.size("items").cast("long").alias("n_items"), F.size("legs").cast("long").alias("n_legs"), shown.alias("items"), ways.alias("legs"), "weather", "warnings")
