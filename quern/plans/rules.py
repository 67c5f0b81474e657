"""Calendars, distances, rules, entities and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dates as D
from ..functions import geo as G
from ..operators import nearest
from .registry import Tables, query

TODAY = "1996-06-01"

_FACET = "CASE o_orderkey % 9 WHEN 0 THEN 'photo' WHEN 1 THEN 'price_diff' WHEN 2 THEN 'closure' WHEN 3 THEN 'hours' WHEN 4 THEN 'queue' WHEN 5 THEN 'crowd' WHEN 6 THEN 'transit' WHEN 7 THEN 'entrance' ELSE 'other' END"
_DUE = f"CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 9 <= 3 THEN o_orderdate::DATE + 90 ELSE o_orderdate::DATE + 180 END"
_LAT, _LNG = "(30 + ({0} * 37 % 1000) / 100.0)", "(100 + ({0} * 91 % 1000) / 100.0)"
_METRES = "2 * 6371000.0 * asin(sqrt(pow(sin(radians({2} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({2})) * pow(sin(radians({3} - {1}) / 2), 2)))"
_FACETS = ("photo", "price_diff", "closure", "hours", "queue", "crowd", "transit", "entrance", "other")


def _facet() -> Column:
    return F.element_at(F.array(*map(F.lit, _FACETS)), (F.col("o_orderkey") % 9 + 1).cast("int"))


def _lat(key: Column) -> Column:
    return 30 + (key * 37 % 1000) / 100.0


def _lng(key: Column) -> Column:
    return 100 + (key * 91 % 1000) / 100.0


@query(f"SELECT o_orderkey, {_FACET} AS facet, ({_DUE})::VARCHAR AS due FROM orders")
def kb04_verify_due(t: Tables) -> DataFrame:
    due = D.verify_due(F.to_date("o_orderdate"), F.lit(None).cast("date"), _facet())
    return t.orders.select("o_orderkey", _facet().alias("facet"), due.cast("string").alias("due"))


@query(f"SELECT o_orderkey, ({_DUE.replace('o_orderdate::DATE', '(CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate::DATE + 40 ELSE o_orderdate::DATE END)')})::VARCHAR AS due FROM orders")
def kb04_due_again(t: Tables) -> DataFrame:
    """The day on which claims are to be verified again, counted from when they last were, if they ever were."""
    seen = F.to_date("o_orderdate")
    verified = F.when(F.col("o_orderkey") % 4 == 0, F.date_add(seen, 40))
    return t.orders.select("o_orderkey", D.verify_due(seen, verified, _facet()).cast("string").alias("due"))


@query(f"WITH d AS (SELECT o_orderstatus, {_DUE} AS due FROM orders WHERE o_orderstatus <> 'P') SELECT o_orderstatus, count_if(due IS NULL)::BIGINT AS timeless, count_if(due <= DATE '{TODAY}')::BIGINT AS overdue, count_if(due > DATE '{TODAY}' AND due <= DATE '{TODAY}' + 14)::BIGINT AS soon, min(CASE WHEN due > DATE '{TODAY}' THEN due END)::VARCHAR AS next_due FROM d GROUP BY 1")
def ru09_due_claims(t: Tables) -> DataFrame:
    due, today = F.col("due"), F.lit(TODAY).cast("date")
    rows = t.orders.where("o_orderstatus <> 'P'").withColumn("due", D.verify_due(F.to_date("o_orderdate"), F.lit(None).cast("date"), _facet()))
    return rows.groupBy("o_orderstatus").agg(
        F.count_if(due.isNull()).alias("timeless"), F.count_if(due <= today).alias("overdue"),
        F.count_if((due > today) & (due <= F.date_add(today, D.SOON_DAYS))).alias("soon"), F.min(F.when(due > today, due)).cast("string").alias("next_due"),
    )


@query(f"SELECT o_orderkey, CASE WHEN ({_DUE}) <= DATE '{TODAY}' THEN 'needs_reverify' ELSE 'active' END AS status FROM orders WHERE o_orderstatus <> 'P'")
def ru11_mark_due(t: Tables) -> DataFrame:
    due = D.verify_due(F.to_date("o_orderdate"), F.lit(None).cast("date"), _facet())
    return t.orders.where("o_orderstatus <> 'P'").select("o_orderkey", F.when(due <= F.lit(TODAY).cast("date"), "needs_reverify").otherwise("active").alias("status"))


@query(
    f"""WITH r AS (SELECT o_orderkey, o_orderdate::DATE AS visit, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE (o_orderkey % 30)::INT END AS advance FROM orders WHERE o_orderstatus = 'F'),
d AS (SELECT *, visit - advance AS release, date_diff('day', DATE '{TODAY}', visit - advance) AS days FROM r)
SELECT o_orderkey, release::VARCHAR AS release, days, CASE WHEN days IS NULL THEN 'later' WHEN days < 0 THEN 'overdue' WHEN days = 0 THEN 'today' WHEN days <= 3 THEN 'soon' ELSE 'later' END AS urgency FROM d"""
)
def ru01_release_and_urgency(t: Tables) -> DataFrame:
    advance = F.when(F.col("o_orderkey") % 11 != 0, (F.col("o_orderkey") % 30).cast("int"))
    rows = t.orders.where("o_orderstatus = 'F'").withColumn("release", F.date_sub(F.to_date("o_orderdate"), advance))
    rows = rows.withColumn("days", F.datediff("release", F.lit(TODAY).cast("date")).cast("long"))
    return rows.select("o_orderkey", F.col("release").cast("string").alias("release"), "days", D.urgency(F.col("days")).alias("urgency"))


@query("SELECT o_orderkey, (isodow(o_orderdate::DATE) - 1) IN (0, 2) OR o_orderdate::DATE BETWEEN DATE '1995-01-20' AND DATE '1995-02-05' AS closed FROM orders")
def ru12_closed_days(t: Tables) -> DataFrame:
    day = F.to_date("o_orderdate")
    ranges = F.array(F.struct(F.lit("1995-01-20").cast("date").alias("a"), F.lit("1995-02-05").cast("date").alias("b")))
    return t.orders.select("o_orderkey", (F.weekday(day).isin(0, 2) | F.exists(ranges, lambda r: day.between(r["a"], r["b"]))).alias("closed"))


@query(
    """WITH x AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'G1' WHEN 1 THEN 'd22' WHEN 2 THEN 'K9' ELSE 'C7' END AS no, (p_partkey % 900)::DOUBLE AS km FROM part),
c AS (SELECT *, CASE WHEN upper(left(no, 1)) IN ('G', 'C') THEN 'high_speed' WHEN upper(left(no, 1)) = 'D' THEN 'bullet' ELSE 'conventional' END AS class FROM x)
SELECT p_partkey, class, CASE WHEN km <= 0 THEN 15.0 ELSE round_even(greatest(km * CASE class WHEN 'high_speed' THEN 0.45::DOUBLE WHEN 'bullet' THEN 0.31::DOUBLE ELSE 0.16::DOUBLE END, 15.0::DOUBLE) * 2, 0) / 2 END AS fare FROM c"""
)
def ru14_rail_fares(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    kind = G.train_class(F.element_at(F.array(*map(F.lit, ("G1", "d22", "K9", "C7"))), (k % 4 + 1).cast("int")))
    return t.part.select(k, kind.alias("class"), G.rail_fare((k % 900).cast("double"), kind).alias("fare"))


@query(
    f"""WITH e AS (SELECT user_id, event_id, {_LAT.format('event_id')} AS lat, {_LNG.format('event_id')} AS lng, lead(event_id) OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS nxt FROM events),
l AS (SELECT *, {_METRES.format('lat', 'lng', _LAT.format('nxt'), _LNG.format('nxt'))} AS m FROM e WHERE nxt IS NOT NULL)
SELECT event_id, nxt, round(m, 1) AS metres, CASE WHEN m <= 1500 THEN 'walk' WHEN m <= 6000 THEN 'metro' ELSE 'taxi' END AS mode,
 greatest(1, round_even(m / 1000 / CASE WHEN m <= 1500 THEN 4.5::DOUBLE WHEN m <= 6000 THEN 25.0::DOUBLE ELSE 22.0::DOUBLE END * 60, 0)::INT) AS minutes FROM l"""
)
def ge02_legs(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    rows = t.events.select("event_id", F.lead("event_id").over(w).alias("nxt")).where("nxt IS NOT NULL")
    rows = rows.withColumn("m", G.metres(_lat(F.col("event_id")), _lng(F.col("event_id")), _lat(F.col("nxt")), _lng(F.col("nxt"))))
    return rows.select("event_id", "nxt", F.round("m", 1).alias("metres"), G.leg_mode(F.col("m")).alias("mode"), G.leg_minutes(F.col("m")).alias("minutes"))


_SPOTS = f"s AS (SELECT s_suppkey, s_nationkey, {_LAT.format('s_suppkey')} AS lat, {_LNG.format('s_suppkey')} AS lng FROM supplier), c AS (SELECT c_custkey, c_nationkey, {_LAT.format('c_custkey')} AS clat, {_LNG.format('c_custkey')} AS clng FROM customer)"


def _asked_and_places(t: Tables) -> tuple[DataFrame, DataFrame]:
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    return t.customer.select(c.alias("asked_id"), "c_nationkey", _lat(c).alias("lat"), _lng(c).alias("lng")), t.supplier.select(s.alias("place_id"), F.col("s_nationkey").alias("c_nationkey"), _lat(s).alias("lat"), _lng(s).alias("lng"))


@query(f"WITH {_SPOTS} SELECT c_custkey, s_suppkey AS nearest FROM c JOIN s ON c_nationkey = s_nationkey QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY {_METRES.format('clat', 'clng', 'lat', 'lng')}, s_suppkey) = 1")
def jn12_nearest(t: Tables) -> DataFrame:
    """The nearest supplier of each customer in its own nation."""
    return nearest.nearest(*_asked_and_places(t), 1, ["c_nationkey"]).select(F.col("asked_id").alias("c_custkey"), F.col("place_id").alias("nearest"))


@query(f"WITH {_SPOTS}, d AS (SELECT c_custkey, s_suppkey, {_METRES.format('clat', 'clng', 'lat', 'lng')} AS metres FROM c, s) SELECT c_custkey, row_number() OVER (PARTITION BY c_custkey ORDER BY metres, s_suppkey)::INT AS place, s_suppkey, round(metres, 1) AS metres FROM d QUALIFY place <= 3")
def jn12_three_nearest(t: Tables) -> DataFrame:
    """The three nearest suppliers of each customer, wherever they are."""
    found = nearest.nearest(*_asked_and_places(t), 3)
    return found.select(F.col("asked_id").alias("c_custkey"), F.col("rank").alias("place"), F.col("place_id").alias("s_suppkey"), F.round("metres", 1).alias("metres"))


@query(f"WITH {_SPOTS} SELECT c_custkey, s_suppkey, round({_METRES.format('clat', 'clng', 'lat', 'lng')}, 1) AS metres FROM c, s WHERE {_METRES.format('clat', 'clng', 'lat', 'lng')} <= 60000")
def src09_around(t: Tables) -> DataFrame:
    """All suppliers around each customer."""
    return nearest.within(*_asked_and_places(t), 60_000.0, digits=1).select(F.col("asked_id").alias("c_custkey"), F.col("place_id").alias("s_suppkey"), "metres")


@query(
    f"""WITH p AS (SELECT c_custkey, c_nationkey, {_LAT.format('c_custkey')} + CASE WHEN c_custkey % 97 = 0 THEN 60 ELSE 0 END AS lat, {_LNG.format('c_custkey')} AS lng FROM customer),
m AS (SELECT c_nationkey, median(lat) AS mlat, median(lng) AS mlng, count(*) AS n FROM p WHERE lat BETWEEN 3 AND 54 AND lng BETWEEN 73 AND 136 GROUP BY 1)
SELECT c_custkey, CASE WHEN NOT (lat BETWEEN 3 AND 54 AND lng BETWEEN 73 AND 136) THEN 'coord_impossible' ELSE 'coord_off_city' END AS code FROM p LEFT JOIN m USING (c_nationkey)
WHERE NOT (lat BETWEEN 3 AND 54 AND lng BETWEEN 73 AND 136) OR (n >= 3 AND (abs(lat - mlat) > 1.0 OR abs(lng - mlng) > 1.0))"""
)
def ge10_odd_coordinates(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    rows = t.customer.select(k, "c_nationkey", (_lat(k) + F.when(k % 97 == 0, 60).otherwise(0)).alias("lat"), _lng(k).alias("lng"))
    possible = F.col("lat").between(3, 54) & F.col("lng").between(73, 136)
    middle = rows.where(possible).groupBy("c_nationkey").agg(F.median("lat").alias("mlat"), F.median("lng").alias("mlng"), F.count(F.lit(1)).alias("n"))
    rows = rows.join(middle, "c_nationkey", "left")
    off = (F.col("n") >= 3) & ((F.abs(F.col("lat") - F.col("mlat")) > 1.0) | (F.abs(F.col("lng") - F.col("mlng")) > 1.0))
    return rows.where(~possible | off).select("c_custkey", F.when(~possible, "coord_impossible").otherwise("coord_off_city").alias("code"))


@query(
    """WITH s AS (SELECT o_custkey AS trip, o_orderkey AS stay, (1 + o_orderkey % 4)::INT AS days, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seq FROM orders),
r AS (SELECT *, sum(days) OVER (PARTITION BY trip ORDER BY seq) - days AS before FROM s)
SELECT trip, stay, (before + i)::BIGINT AS day_index, i AS seq_in_stay, (DATE '1996-06-01' + (before + i)::INT)::VARCHAR AS date FROM r, unnest(range(days)) AS u(i)"""
)
def tr01_lay_out_days(t: Tables) -> DataFrame:
    w = Window.partitionBy("trip").orderBy("stay")
    rows = t.orders.select(F.col("o_custkey").alias("trip"), F.col("o_orderkey").alias("stay"), (1 + F.col("o_orderkey") % 4).cast("int").alias("days"))
    rows = rows.withColumn("before", F.sum("days").over(w) - F.col("days")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("days") - 1)))
    at = F.col("before") + F.col("i")
    return rows.select("trip", "stay", at.cast("long").alias("day_index"), F.col("i").cast("long").alias("seq_in_stay"), F.date_add(F.lit(TODAY).cast("date"), at.cast("int")).cast("string").alias("date"))


@query(
    """WITH c AS (SELECT c_nationkey AS n, c_mktsegment AS s, count(*) AS claims, count_if(c_acctbal > 5000)::BIGINT AS sure FROM customer GROUP BY 1, 2)
SELECT n, s, claims, sure, row_number() OVER (PARTITION BY n ORDER BY claims DESC, sure DESC, s) AS place FROM c"""
)
def tr11_candidate_pool(t: Tables) -> DataFrame:
    rows = t.customer.groupBy(F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("s")).agg(F.count(F.lit(1)).alias("claims"), F.count_if(F.col("c_acctbal") > 5000).alias("sure"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("n").orderBy(F.desc("claims"), F.desc("sure"), "s")).cast("long"))


@query(
    """WITH u AS (SELECT user_id, event_type, min(ts::DATE) AS first FROM events GROUP BY 1, 2), k AS (SELECT 'view' AS event_type, 3 AS rank UNION ALL SELECT 'click', 2)
SELECT user_id, count(*) AS visited, count(rank) AS recommended, round(count(rank) / nullif(count(*), 0), 6) AS ratio FROM u LEFT JOIN k USING (event_type) GROUP BY 1"""
)
def tr09_coverage(t: Tables) -> DataFrame:
    visited = t.events.groupBy("user_id", "event_type").agg(F.min(F.to_date("ts")).alias("first"))
    pool = t.spark.createDataFrame([("view", 3), ("click", 2)], "event_type string, rank int")
    n, known = F.count(F.lit(1)), F.count("rank")
    return visited.join(F.broadcast(pool), "event_type", "left").groupBy("user_id").agg(n.alias("visited"), known.alias("recommended"), F.round(known / F.nullif(n, F.lit(0)), 6).alias("ratio"))


@query(
    """WITH RECURSIVE f AS (SELECT 'C' || c_custkey AS id, CASE WHEN c_nationkey = 24 THEN NULL WHEN c_custkey % 50 = 1 THEN 'C' || (c_custkey + 1) WHEN c_custkey % 50 = 2 THEN 'C' || (c_custkey - 1) ELSE 'N' || c_nationkey END AS parent FROM customer
 UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation UNION ALL SELECT 'R' || r_regionkey, NULL FROM region WHERE r_regionkey <> 2),
w AS (SELECT id, id AS cur, [id] AS seen, 0 AS hop, false AS done FROM f UNION ALL
 SELECT w.id, f.parent, list_append(w.seen, f.parent), hop + 1, list_contains(w.seen, f.parent) FROM w JOIN f ON f.id = w.cur WHERE NOT done AND hop < 8 AND f.parent IS NOT NULL)
SELECT id, arg_max(cur, hop) AS root FROM w GROUP BY 1"""
)
def al05_roots(t: Tables) -> DataFrame:
    c = F.col("c_custkey")
    name = lambda prefix, key: F.concat(F.lit(prefix), key.cast("string"))
    parent = F.when(F.col("c_nationkey") == 24, F.lit(None).cast("string")).when(c % 50 == 1, name("C", c + 1)).when(c % 50 == 2, name("C", c - 1)).otherwise(name("N", F.col("c_nationkey")))
    forest = t.customer.select(name("C", c).alias("id"), parent.alias("parent"))
    forest = forest.unionByName(t.nation.select(name("N", F.col("n_nationkey")).alias("id"), name("R", F.col("n_regionkey")).alias("parent")))
    forest = forest.unionByName(t.region.where("r_regionkey <> 2").select(name("R", F.col("r_regionkey")).alias("id"), F.lit(None).cast("string").alias("parent")))
    return resolve_roots(forest)


def resolve_roots(forest: DataFrame, hops: int = 8) -> DataFrame:
    """id and root of each (id, parent): up the parents, to one that is unknown, has none, or was met before, in so many hops at most."""
    steps = forest.select(F.col("id").alias("cur"), F.col("parent").alias("up"))
    rows = forest.select("id", F.col("id").alias("cur"), F.array("id").alias("seen"), F.lit(False).alias("done"))
    for _ in range(hops):
        rows = rows.join(steps, "cur", "left")
        move = ~F.col("done") & F.col("up").isNotNull()
        again = F.array_contains("seen", F.coalesce("up", F.lit("")))
        rows = rows.select("id", F.when(move, F.col("up")).otherwise(F.col("cur")).alias("cur"), F.when(move, F.array_append("seen", F.col("up"))).otherwise(F.col("seen")).alias("seen"), (~move | again).alias("done"))
    return rows.select("id", F.col("cur").alias("root"))


@query(
    """WITH r AS (SELECT p_name, p_partkey, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey) AS refs FROM part), d AS (SELECT *, count(*) OVER (PARTITION BY p_name) AS n, row_number() OVER (PARTITION BY p_name ORDER BY refs DESC, p_partkey) AS place FROM r)
SELECT p_name, p_partkey, refs, place = 1 AS survivor FROM d WHERE n >= 2"""
)
def al18_duplicate_names(t: Tables) -> DataFrame:
    refs = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("refs"))
    rows = t.part.select("p_name", "p_partkey").join(refs, "p_partkey", "left").withColumn("refs", F.coalesce("refs", F.lit(0)))
    named = rows.groupBy("p_name").agg(F.count(F.lit(1)).alias("n"), F.min_by("p_partkey", F.struct(-F.col("refs"), "p_partkey")).alias("kept")).where("n >= 2")
    return rows.join(named, "p_name").select("p_name", "p_partkey", "refs", (F.col("p_partkey") == F.col("kept")).alias("survivor"))


@query(
    """WITH k AS (SELECT p_partkey, first_value(p_partkey) OVER (PARTITION BY p_name ORDER BY p_partkey) AS kept FROM part)
SELECT kept, count(*) AS lines, count(DISTINCT l_suppkey) AS suppliers FROM lineitem JOIN k ON l_partkey = p_partkey GROUP BY 1"""
)
def al19_merge_duplicates(t: Tables) -> DataFrame:
    kept = t.part.groupBy("p_name").agg(F.min("p_partkey").alias("kept"))
    moved = t.part.join(kept, "p_name").select(F.col("p_partkey").alias("l_partkey"), "kept")
    return t.lineitem.join(moved, "l_partkey").groupBy("kept").agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("l_suppkey").alias("suppliers"))


@query(
    """WITH p AS (SELECT l.doc_id, lang, quality, CASE WHEN n_chars > 300 THEN 1 ELSE 0 END AS guess FROM labels l JOIN documents d ON l.doc_id = d.doc_id)
SELECT lang, count(*) AS judged, round(count_if(guess = 1 AND quality = 1) / nullif(count_if(quality = 1), 0), 6) AS recall, round(count_if(guess = 1 AND quality = 1) / nullif(count_if(guess = 1), 0), 6) AS precision FROM p GROUP BY 1"""
)
def ev06_micro_metrics(t: Tables) -> DataFrame:
    rows = t.labels.join(t.documents.select("doc_id", "lang", "n_chars"), "doc_id").withColumn("guess", (F.col("n_chars") > 300).cast("int"))
    both, real, said = F.count_if((F.col("guess") == 1) & (F.col("quality") == 1)), F.count_if(F.col("quality") == 1), F.count_if(F.col("guess") == 1)
    ratio = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 6)
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("judged"), ratio(both, real).alias("recall"), ratio(both, said).alias("precision"))


@query("SELECT d.doc_id, coalesce(n, 0) AS n_labels, n IS NOT NULL AS gold FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id")
def ev09_worklist(t: Tables) -> DataFrame:
    labels = t.labels.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return t.documents.select("doc_id").join(labels, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n_labels"), F.col("n").isNotNull().alias("gold"))


@query("SELECT event_type, count(*) AS n, sum(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k FROM events GROUP BY 1")
def src22_json_column(t: Tables) -> DataFrame:
    k = F.from_json("props", "k bigint")["k"]
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("k"))
