"""Alignment of mentions with places: candidates, entities, outcomes, lineage, and what follows from decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import alignment as A
from ..operators import merging, naming
from ..storage import saved
from ..streaming.mentions import replay
from .registry import Tables, query

_PLACES = """p AS (SELECT p_partkey AS k, p_partkey // 8 AS b, p_partkey % 8 AS v, 'P' || p_partkey AS poi_id, 'hall ' || (p_partkey // 8) AS hall, p_type, p_name, p_size FROM part),
poi AS (SELECT k, b, v, poi_id, CASE v WHEN 1 THEN hall || '-' || p_type WHEN 2 THEN p_type || '-' || hall WHEN 3 THEN hall || '(' || p_type || ')' WHEN 4 THEN hall || '公园' WHEN 5 THEN hall || ' ' || p_name WHEN 7 THEN 'annex ' || b ELSE hall END AS name,
 CASE p_size % 5 WHEN 0 THEN '110000' WHEN 1 THEN '140100' WHEN 2 THEN '150500' WHEN 3 THEN '190301' ELSE '061001' END AS typecode, CASE p_size % 5 WHEN 2 THEN 'irrelevant' WHEN 3 THEN 'place_name' ELSE 'destination' END AS kind,
 CASE WHEN k % 11 = 0 THEN NULL WHEN k % 13 = 0 THEN '990101' ELSE '61' || (b % 90 + 10) || '01' END AS adcode, 30 + (b * 37 % 1000) / 100.0::DOUBLE + v * 0.0005::DOUBLE AS lat, 100 + (b * 91 % 1000) / 100.0::DOUBLE AS lng,
 CASE v WHEN 1 THEN 'P' || (k - 1) WHEN 2 THEN 'P' || (k - 1) WHEN 3 THEN 'P' || (k - 3) WHEN 5 THEN 'X' || b END AS parent_id FROM p),
m AS (SELECT c_custkey AS mention_id, CASE c_custkey % 4 WHEN 1 THEN ' hall ' || c_custkey || ' ' WHEN 3 THEN chr(9) || 'hall ' || c_custkey || chr(12288) ELSE 'hall ' || c_custkey END AS mention, CASE WHEN c_nationkey = 7 THEN NULL ELSE '61' || (c_custkey % 90 + 10) || '00' END AS city FROM customer)"""

_SCORED = f"""{_PLACES}, c AS (SELECT mention_id, trim(mention, ' ' || chr(9) || chr(12288)) AS l, city, v * 5 % 7 AS pos, v, b, poi_id, name AS r, kind, adcode, lat, lng FROM m JOIN poi ON b = mention_id AND v < 7),
s0 AS (SELECT *, CASE WHEN l = r THEN 1.0 WHEN regexp_replace(r, '公园$', '') = l THEN 0.95 ELSE 0.90 END::DOUBLE AS score, CASE WHEN l = r OR regexp_matches(r, '[-－—·(（_]' || l || '([-－—·(（_]|$)') THEN 'exact' ELSE 'contains' END AS note,
 CASE WHEN city IS NOT NULL AND coalesce(left(adcode, 4) <> left(city, 4), true) THEN 'other_city' WHEN kind = 'irrelevant' THEN 'not_a_destination' END AS reject FROM c),
s1 AS (SELECT *, round(score + CASE note WHEN 'exact' THEN 0.20::DOUBLE ELSE 0.12::DOUBLE END, 4) AS plain, max(CASE WHEN reject IS NULL AND note = 'exact' THEN 1 ELSE 0 END) OVER (PARTITION BY mention_id) AS exact FROM s0),
s AS (SELECT *, CASE WHEN exact = 1 AND note = 'contains' THEN round(plain - 0.12::DOUBLE, 4) ELSE plain END AS rank FROM s1)"""

_ROOT = "CASE WHEN v IN (1, 2, 3) THEN 'P' || (b * 8) WHEN v = 5 THEN 'X' || b ELSE poi_id END"
_OWNER = "CASE WHEN v IN (1, 3) THEN 'P' || (b * 8) ELSE poi_id END"
_ENTITIES = f"""{_SCORED}, u AS (SELECT *, {_ROOT} AS root_id FROM s WHERE reject IS NULL),
g AS (SELECT *, row_number() OVER (PARTITION BY mention_id, root_id ORDER BY rank DESC, plain DESC, pos) AS n, count(*) OVER (PARTITION BY mention_id, root_id) AS members, max(CASE WHEN poi_id = root_id THEN 1 ELSE 0 END) OVER (PARTITION BY mention_id, root_id) AS known FROM u),
e AS (SELECT * FROM g WHERE n = 1)"""
_METRES = "2 * 6371000.0 * asin(sqrt(pow(sin(radians(y.lat - x.lat) / 2), 2) + cos(radians(x.lat)) * cos(radians(y.lat)) * pow(sin(radians(y.lng - x.lng) / 2), 2)))"
_MERGED = f"""{_ENTITIES}, d AS (SELECT DISTINCT x.mention_id, x.root_id FROM e x JOIN e y ON x.mention_id = y.mention_id AND x.poi_id <> y.poi_id AND x.r = y.r AND x.kind = y.kind AND (-y.rank, -y.plain, y.pos) < (-x.rank, -x.plain, x.pos) AND {_METRES} <= 400),
k AS (SELECT e.* FROM e ANTI JOIN d ON d.mention_id = e.mention_id AND d.root_id = e.root_id)"""
_OUTCOMES = f"""{_MERGED}, w AS (SELECT *, row_number() OVER q AS place, lead(rank) OVER q AS second, count(*) OVER (PARTITION BY mention_id) AS entities FROM k WINDOW q AS (PARTITION BY mention_id ORDER BY rank DESC, plain DESC, pos)),
o AS (SELECT m.mention_id, m.city, w.poi_id, w.v, w.b, coalesce(w.entities, 0) AS entities, CASE WHEN m.city IS NULL THEN 'unresolved' WHEN rank IS NULL THEN 'no_candidate' WHEN rank < 0.8::DOUBLE THEN CASE WHEN w.entities = 1 AND rank >= 0.4::DOUBLE THEN 'aligned' ELSE 'no_candidate' END
 WHEN second IS NOT NULL AND round(rank - second, 10) < 0.08::DOUBLE THEN 'ambiguous' ELSE 'aligned' END AS outcome FROM m LEFT JOIN w ON w.mention_id = m.mention_id AND place = 1)"""


def _poi(t: Tables) -> DataFrame:
    """Places made of parts: eight of one hall, of which some are parts of others, near one another."""
    k = F.col("p_partkey")
    b, v = F.floor(k / 8), k % 8
    hall = F.concat(F.lit("hall "), b.cast("string"))
    name = (
        F.when(v == 1, F.concat(hall, F.lit("-"), "p_type")).when(v == 2, F.concat("p_type", F.lit("-"), hall)).when(v == 3, F.concat(hall, F.lit("("), F.col("p_type"), F.lit(")")))
        .when(v == 4, F.concat(hall, F.lit("公园"))).when(v == 5, F.concat(hall, F.lit(" "), "p_name")).when(v == 7, F.concat(F.lit("annex "), b.cast("string"))).otherwise(hall)
    )
    size = F.col("p_size") % 5
    code = F.when(size == 0, "110000").when(size == 1, "140100").when(size == 2, "150500").when(size == 3, "190301").otherwise("061001")
    adcode = F.when(k % 11 == 0, F.lit(None).cast("string")).when(k % 13 == 0, "990101").otherwise(F.concat(F.lit("61"), (b % 90 + 10).cast("string"), F.lit("01")))
    parent = F.when(v.isin(1, 2), F.concat(F.lit("P"), (k - 1).cast("string"))).when(v == 3, F.concat(F.lit("P"), (k - 3).cast("string"))).when(v == 5, F.concat(F.lit("X"), b.cast("string")))
    return t.part.select(
        b.alias("b"), v.alias("v"), F.concat(F.lit("P"), k.cast("string")).alias("poi_id"), name.alias("name"), code.alias("typecode"), F.lit("").alias("type_name"), adcode.alias("adcode"),
        (30 + (b * 37 % 1000) / 100.0 + v * 0.0005).alias("lat"), (100 + (b * 91 % 1000) / 100.0).alias("lng"), parent.alias("parent_id"),
    )


def _mentions(t: Tables) -> DataFrame:
    c = F.col("c_custkey")
    hall = F.concat(F.lit("hall "), c.cast("string"))
    city = F.when(F.col("c_nationkey") != 7, F.concat(F.lit("61"), (c % 90 + 10).cast("string"), F.lit("00")))
    return t.customer.select(c.alias("mention_id"), F.when(c % 4 == 1, F.concat(F.lit(" "), hall, F.lit(" "))).when(c % 4 == 3, F.concat(F.lit("\t"), hall, F.lit("\u3000"))).otherwise(hall).alias("mention"), city.alias("city"))


def _candidates(t: Tables) -> DataFrame:
    """What a search for each mention finds: the places of its hall but the annex."""
    return _mentions(t).join(_poi(t).where("v < 7").withColumnRenamed("b", "mention_id"), "mention_id").withColumn("pos", F.col("v") * 5 % 7)


@query(f"WITH {_SCORED} SELECT mention_id, poi_id, score, note, kind FROM s")
def al01_name_scores(t: Tables) -> DataFrame:
    return A.scored(_candidates(t)).select("mention_id", "poi_id", "score", "note", "kind")


@query(f"WITH {_SCORED} SELECT mention_id, poi_id, plain, coalesce(reject, '') AS reject, row_number() OVER (PARTITION BY mention_id ORDER BY plain DESC, pos) AS place FROM s")
def al03_scored_candidates(t: Tables) -> DataFrame:
    return A.ordered(A.scored(_candidates(t))).select("mention_id", "poi_id", "plain", F.coalesce("reject", F.lit("")).alias("reject"), F.col("place").cast("long").alias("place"))


@query(f"WITH {_SCORED} SELECT mention_id, poi_id, plain, rank FROM s WHERE rank <> plain")
def al04_demoted(t: Tables) -> DataFrame:
    return A.scored(_candidates(t)).where("rank <> plain").select("mention_id", "poi_id", "plain", "rank")


@query(f"WITH {_PLACES} SELECT DISTINCT 'X' || s_suppkey AS poi_id, s_name AS name FROM supplier JOIN poi ON parent_id = 'X' || s_suppkey")
def al06_missing_ancestors(t: Tables) -> DataFrame:
    """Ancestors that the places name and only a second table knows."""
    known = t.supplier.select(F.concat(F.lit("X"), F.col("s_suppkey").cast("string")).alias("poi_id"), F.col("s_name").alias("name"), F.lit(None).cast("string").alias("parent_id"))
    return A.missing_ancestors(_poi(t), known).select("poi_id", "name")


@query(f"WITH {_PLACES}, r AS (SELECT poi_id, {_ROOT} AS root_id FROM poi), n AS (SELECT root_id, count(*) AS below FROM r GROUP BY 1) SELECT r.poi_id, r.root_id, q.name AS root_name, r.root_id <> r.poi_id AND q.poi_id IS NOT NULL AS sub_of_known, below FROM r JOIN n USING (root_id) LEFT JOIN poi q ON q.poi_id = r.root_id")
def al07_lineage(t: Tables) -> DataFrame:
    """Each place's root, whether that is a known place above it, and how many places have the same one."""
    poi = saved(_poi(t).select("poi_id", "name", "parent_id"))
    roots = saved(A.roots(poi))
    below = roots.groupBy("root_id").agg(F.count(F.lit(1)).alias("below"))
    rows = roots.join(below, "root_id").join(poi.select(F.col("poi_id").alias("root_id"), F.col("name").alias("root_name"), F.lit(True).alias("known")), "root_id", "left")
    return rows.select("poi_id", "root_id", "root_name", ((F.col("root_id") != F.col("poi_id")) & F.coalesce("known", F.lit(False))).alias("sub_of_known"), "below")


@query(f"WITH {_ENTITIES} SELECT mention_id, root_id, members, poi_id AS matched, rank, known = 1 AS known FROM e")
def al08_entities(t: Tables) -> DataFrame:
    found = A.entities(A.scored(_candidates(t)), A.roots(_poi(t)))
    return found.select("mention_id", "root_id", "members", F.col("best.poi_id").alias("matched"), F.col("best.rank").alias("rank"), "known")


@query(f"WITH {_MERGED} SELECT mention_id, root_id, poi_id AS matched FROM k")
def al09_same_places_merged(t: Tables) -> DataFrame:
    found = A.same_places_merged(A.entities(A.scored(_candidates(t)), A.roots(_poi(t))))
    return found.select(F.col("mention_id").cast("long").alias("mention_id"), "root_id", F.col("poi_id").alias("matched"))


@query(f"WITH {_OUTCOMES} SELECT mention_id, outcome, entities FROM o")
def al10_outcomes(t: Tables) -> DataFrame:
    found = A.align(_mentions(t), _candidates(t), _poi(t))
    return found.select(F.col("mention_id").cast("long").alias("mention_id"), "outcome", "entities")


@query(f"WITH {_PLACES} SELECT poi_id, {_OWNER} AS owner_id FROM poi")
def al11_owners(t: Tables) -> DataFrame:
    return A.owners(_poi(t))


@query(f"WITH {_OUTCOMES} SELECT mention_id, poi_id AS matched_id, {_OWNER} AS resolved_id, {_OWNER} <> poi_id AS collapsed FROM o WHERE outcome = 'aligned'")
def al12_accepted(t: Tables) -> DataFrame:
    found = A.align(_mentions(t), _candidates(t), _poi(t)).where("outcome = 'aligned'")
    return found.select(F.col("mention_id").cast("long").alias("mention_id"), "matched_id", "resolved_id", "collapsed")


@query(f"WITH {_OUTCOMES} SELECT count(*) AS mentions, count_if(outcome = 'aligned')::BIGINT AS aligned, count_if(outcome = 'aligned' AND v IN (1, 3))::BIGINT AS collapsed, count_if(outcome IN ('ambiguous', 'no_candidate'))::BIGINT AS pending, count_if(outcome = 'unresolved')::BIGINT AS unresolved FROM o")
def al13_tally(t: Tables) -> DataFrame:
    return A.tally(A.align(_mentions(t), _candidates(t), _poi(t)))


@query(
    f"""WITH {_PLACES}, q AS (SELECT o_orderkey AS task_id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'resolved' ELSE 'discarded' END AS status, CASE WHEN o_orderstatus = 'F' THEN 'P0' END AS poi_id, CASE WHEN o_orderkey % 2 = 0 THEN '610100' END AS city FROM orders),
d AS (SELECT o_orderkey AS task_id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'P' || (o_custkey % (SELECT count(*) FROM part)) END AS chosen FROM orders WHERE o_orderkey % 5 < 3)
SELECT q.task_id, CASE WHEN status = 'pending' AND d.task_id IS NOT NULL THEN CASE WHEN chosen IS NULL THEN 'discarded' ELSE 'resolved' END ELSE status END AS status, CASE WHEN status = 'pending' AND chosen IS NOT NULL THEN chosen ELSE q.poi_id END AS poi_id,
 coalesce(city, CASE WHEN status = 'pending' AND chosen IS NOT NULL THEN left(adcode, 4) || '00' END) AS city FROM q LEFT JOIN d ON d.task_id = q.task_id LEFT JOIN poi ON poi.poi_id = chosen"""
)
def al14_resolved_by_hand(t: Tables) -> DataFrame:
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    tasks = t.orders.select(k.alias("task_id"), F.when(status == "O", "pending").when(status == "F", "resolved").otherwise("discarded").alias("status"), F.when(status == "F", "P0").alias("poi_id"), F.when(k % 2 == 0, "610100").alias("city"))
    chosen = F.when(k % 3 != 0, F.concat(F.lit("P"), (F.col("o_custkey") % t.part.count()).cast("string")))
    return A.resolved_by_hand(tasks, t.orders.where(k % 5 < 3).select(k.alias("task_id"), chosen.alias("chosen")), _poi(t))


@query(
    """WITH c AS (SELECT l_orderkey AS doc_id, l_partkey % 3 AS subject, l_returnflag AS subject_type, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos, l_partkey AS text FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')),
f AS (SELECT *, first_value(subject_type) OVER (PARTITION BY doc_id, subject ORDER BY pos) AS first FROM c) SELECT doc_id, subject, subject_type, list(text ORDER BY pos) AS texts FROM f WHERE subject_type = first GROUP BY 1, 2, 3"""
)
def al15_parked_claims(t: Tables) -> DataFrame:
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    claims = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_partkey") % 3).alias("subject"), F.col("l_returnflag").alias("subject_type"), place.alias("pos"), F.col("l_partkey").alias("text"))
    handled = t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("doc_id"), F.explode(F.array(*[F.lit(x).cast("long") for x in range(3)])).alias("subject"))
    return A.parked(claims, handled)


@query(
    f"""WITH {_OUTCOMES}, n AS (SELECT mention_id AS subject, 'P' || (mention_id * 8) AS old_id, {_OWNER} AS new_id FROM o WHERE outcome = 'aligned'),
r AS (SELECT o_orderkey AS id, o_custkey AS subject, 'P' || (o_custkey * 8) AS poi_id FROM orders) SELECT id, r.subject, coalesce(CASE WHEN n.new_id <> r.poi_id THEN n.new_id END, r.poi_id) AS poi_id, coalesce(n.new_id <> r.poi_id, false) AS moved FROM r LEFT JOIN n ON n.subject = r.subject AND n.old_id = r.poi_id"""
)
def al17_realigned(t: Tables) -> DataFrame:
    """Claims that move to another place after their subjects were aligned anew."""
    hall = lambda c: F.concat(F.lit("P"), (F.col(c) * 8).cast("string"))
    plan = A.align(_mentions(t), _candidates(t), _poi(t)).where("outcome = 'aligned'").select(F.col("mention_id").cast("long").alias("subject"), F.col("resolved_id").alias("new_id"))
    refs = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("subject"), hall("o_custkey").alias("poi_id"))
    return A.realigned(refs, plan.withColumn("old_id", hall("subject"))).select("id", "subject", "poi_id", "moved")


@query(
    f"""WITH {_PLACES}, n AS (SELECT 'P' || l_partkey AS poi_id, count(*) AS claims FROM lineitem GROUP BY 1)
SELECT x.poi_id, y.poi_id AS sibling, coalesce(n.claims, 0) AS claims FROM poi x JOIN poi y ON x.poi_id <> y.poi_id AND (contains(x.name, y.name) OR contains(y.name, x.name)) LEFT JOIN n ON n.poi_id = y.poi_id"""
)
def jn16_contained_names(t: Tables) -> DataFrame:
    """Other places whose names contain a place's name or are contained in it, with their claims."""
    claims = t.lineitem.groupBy(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("other")).agg(F.count(F.lit(1)).alias("claims"))
    found = naming.containing_each_other(_poi(t).select(F.col("poi_id").alias("id"), "name")).join(claims.hint("merge"), "other", "left")
    return found.select(F.col("id").alias("poi_id"), F.col("other").alias("sibling"), F.coalesce("claims", F.lit(0)).alias("claims"))


_ALIKE = rf"""{_PLACES}, a AS (SELECT mention_id, city, trim(mention, ' ' || chr(9) || chr(12288)) AS l FROM m), c AS (SELECT mention_id, city, l, v, b, poi_id, name AS r, kind, adcode, lat, lng FROM a, poi),
z AS (SELECT *, CASE WHEN l = r OR translate(l, '（）〔〕【】', '()()()') = translate(r, '（）〔〕【】', '()()()') THEN 1.0 WHEN regexp_replace(r, '公园$', '') = l THEN 0.95 WHEN contains(r, l) OR contains(l, r) THEN 0.90 END::DOUBLE AS score FROM c),
y AS (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY score DESC, poi_id) AS place FROM z WHERE score IS NOT NULL QUALIFY place <= 3)"""


@query(f"WITH {_ALIKE} SELECT mention_id, place::INT AS place, poi_id, score FROM y")
def al13_most_alike(t: Tables) -> DataFrame:
    """The places that rules find most like each mention, of all there are; names that only the letters tell apart are held against brute force by a test."""
    found = naming.most_alike(_mentions(t), _poi(t).select(F.col("poi_id").alias("place_id"), "name"), 3, 0.85)
    return found.select("mention_id", F.col("rank").alias("place"), F.col("place_id").alias("poi_id"), "score")


#: Columns that refer to places in the tables made below.
_CATALOGUE = {"claim": ["poi_id", "from_id", "to_id"], "item": ["poi_id"], "rule": ["poi_id"], "poi": ["parent_id"]}
_MERGE = """k AS (SELECT count(*) AS parts FROM part), poi AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'B' ELSE 'X' END || p_partkey AS poi_id, p_name || ' ' || p_type || ' ' || (p_size % 10) AS name, CASE WHEN p_partkey % 3 = 0 THEN '110000' END AS typecode, CASE WHEN p_size > 25 THEN p_brand END AS address, CASE WHEN p_retailprice > 1000 THEN p_retailprice END AS rating,
 CASE WHEN p_partkey % 5 = 0 THEN CASE WHEN p_partkey * 7 % parts % 2 = 0 THEN 'B' ELSE 'X' END || (p_partkey * 7 % parts) END AS parent_id FROM part, k),
id AS (SELECT poi_id, substr(poi_id, 2)::BIGINT AS n FROM poi), claim AS (SELECT l_orderkey, l_linenumber, a.poi_id, b.poi_id AS from_id, c.poi_id AS to_id FROM lineitem, k, id a, id b, id c WHERE a.n = l_partkey AND b.n = l_partkey * 3 % parts AND c.n = l_suppkey),
item AS (SELECT event_id, poi_id FROM events, k, id WHERE n = event_id % parts), rule AS (SELECT o_orderkey, poi_id FROM orders, k, id WHERE n = o_custkey % parts),
r AS (SELECT poi_id, 'claim.poi_id' AS reference FROM claim UNION ALL SELECT from_id, 'claim.from_id' FROM claim UNION ALL SELECT to_id, 'claim.to_id' FROM claim UNION ALL SELECT poi_id, 'item.poi_id' FROM item UNION ALL SELECT poi_id, 'rule.poi_id' FROM rule UNION ALL SELECT parent_id, 'poi.parent_id' FROM poi WHERE parent_id IS NOT NULL),
n AS (SELECT poi_id, count(*) AS refs FROM r GROUP BY 1), g AS (SELECT name, poi_id, coalesce(refs, 0) AS refs, count(*) OVER (PARTITION BY name) AS k, first_value(poi_id) OVER (PARTITION BY name ORDER BY typecode IS NULL, left(poi_id, 1) <> 'B', coalesce(refs, 0) DESC, poi_id) AS kept FROM poi LEFT JOIN n USING (poi_id)),
mv AS (SELECT poi_id AS old_id, kept AS new_id FROM g WHERE k > 1 AND poi_id <> kept)"""


def _to_merge(t: Tables) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Places, several of a name, and claims, items and rules that refer to them."""
    parts = t.part.count()
    id_ = lambda n: F.concat(F.when(n % 2 == 0, "B").otherwise("X"), n.cast("string"))
    k = F.col("p_partkey")
    poi = t.part.select(
        id_(k).alias("poi_id"), F.concat_ws(" ", "p_name", "p_type", F.col("p_size") % 10).alias("name"), F.when(k % 3 == 0, "110000").alias("typecode"), F.when(F.col("p_size") > 25, F.col("p_brand")).alias("address"),
        F.when(F.col("p_retailprice") > 1000, F.col("p_retailprice")).alias("rating"), F.when(k % 5 == 0, id_(k * 7 % parts)).alias("parent_id"),
    )
    known = poi.select(F.col("poi_id").alias("known"))
    claim = t.lineitem.select("l_orderkey", "l_linenumber", id_(F.col("l_partkey")).alias("poi_id"), id_(F.col("l_partkey") * 3 % parts).alias("from_id"), id_(F.col("l_suppkey")).alias("to_id"))
    claim = claim.join(known, F.col("poi_id") == F.col("known"), "left_semi").join(known, F.col("to_id") == F.col("known"), "left_semi")
    item = t.events.select("event_id", id_(F.col("event_id") % parts).alias("poi_id"))
    rule = t.orders.select("o_orderkey", id_(F.col("o_custkey") % parts).alias("poi_id"))
    return poi, {"claim": claim, "item": item, "rule": rule}


@query(f"WITH {_MERGE} SELECT poi_id, reference, count(*) AS n FROM r GROUP BY 1, 2")
def al18_reference_counts(t: Tables) -> DataFrame:
    poi, tables = _to_merge(t)
    return merging.reference_counts({**tables, "poi": poi}, _CATALOGUE)


@query(f"WITH {_MERGE} SELECT name, poi_id, refs AS references, kept AS survivor_id FROM g WHERE k > 1".replace("AS references", 'AS "references"'))
def al18_survivors(t: Tables) -> DataFrame:
    """Places of one name, and which of them stays."""
    poi, tables = _to_merge(t)
    return merging.duplicates(poi, merging.reference_counts({**tables, "poi": poi}, _CATALOGUE))


def _merged(t: Tables) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    poi, tables = _to_merge(t)
    empty = {c: F.lit(None).cast("string") for c in merging.FILLED if c not in poi.columns}
    return merging.merge_all(poi.withColumns(empty), tables, _CATALOGUE)


@query(
    f"""WITH {_MERGE}, gift AS (SELECT new_id, first(address ORDER BY old_id) FILTER (address IS NOT NULL) AS address, first(typecode ORDER BY old_id) FILTER (typecode IS NOT NULL) AS typecode, first(rating ORDER BY old_id) FILTER (rating IS NOT NULL) AS rating FROM mv JOIN poi ON poi_id = old_id GROUP BY 1)
SELECT p.poi_id, name, coalesce(p.typecode, gift.typecode) AS typecode, coalesce(p.address, gift.address) AS address, coalesce(p.rating, gift.rating) AS rating, nullif(coalesce(m.new_id, parent_id), p.poi_id) AS parent_id FROM poi p LEFT JOIN mv m ON m.old_id = parent_id LEFT JOIN gift ON gift.new_id = p.poi_id WHERE p.poi_id NOT IN (SELECT old_id FROM mv)"""
)
def al19_merged_places(t: Tables) -> DataFrame:
    """The places after the merge."""
    return _merged(t)[0].select("poi_id", "name", "typecode", "address", "rating", "parent_id")


@query(f"WITH {_MERGE} SELECT l_orderkey, l_linenumber, coalesce(a.new_id, poi_id) AS poi_id, coalesce(b.new_id, from_id) AS from_id, coalesce(c.new_id, to_id) AS to_id FROM claim LEFT JOIN mv a ON a.old_id = poi_id LEFT JOIN mv b ON b.old_id = from_id LEFT JOIN mv c ON c.old_id = to_id")
def al19_merged_claims(t: Tables) -> DataFrame:
    """The claims after the merge, with all three columns led to the places that stay."""
    return _merged(t)[1]["claim"]


@query(f"WITH {_MERGE} SELECT event_id, coalesce(new_id, poi_id) AS poi_id FROM item LEFT JOIN mv ON old_id = poi_id")
def al19_merged_items(t: Tables) -> DataFrame:
    return _merged(t)[1]["item"]


@query(f"WITH {_MERGE} SELECT o_orderkey, coalesce(new_id, poi_id) AS poi_id FROM rule LEFT JOIN mv ON old_id = poi_id")
def al19_merged_rules(t: Tables) -> DataFrame:
    return _merged(t)[1]["rule"]


@query(f"WITH {_MERGE} SELECT reference, count(*)::BIGINT AS rows FROM r JOIN mv ON old_id = poi_id GROUP BY 1 UNION ALL SELECT 'merged', count(*) FROM mv".replace("AS rows", 'AS "rows"'))
def al19_merge_report(t: Tables) -> DataFrame:
    return _merged(t)[2]


@query(
    """WITH e AS (SELECT user_id AS mention_id, epoch_us(ts) // 1000 AS at_ms, event_id, CASE event_id % 5 WHEN 0 THEN 'ask' WHEN 4 THEN CASE event_id % 25 WHEN 4 THEN 'attach' WHEN 9 THEN 'discard' ELSE 'place' END ELSE 'place' END AS what, 'P' || (event_id % 3) AS poi_id, (event_id % 11) / 10.0::DOUBLE AS rank FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY at_ms, event_id) AS k FROM e), a AS (SELECT mention_id, min(k) AS first, min(at_ms) AS asked FROM o WHERE what = 'ask' GROUP BY 1),
x AS (SELECT o.mention_id, o.k, o.at_ms, p.poi_id, max(p.rank) AS r FROM o JOIN a ON a.mention_id = o.mention_id JOIN o p ON p.mention_id = o.mention_id AND p.what = 'place' AND p.k <= o.k WHERE o.k >= first AND o.what IN ('ask', 'place') GROUP BY 1, 2, 3, 4),
y AS (SELECT mention_id, k, at_ms, list(r ORDER BY r DESC, poi_id) AS rs, list(poi_id ORDER BY r DESC, poi_id) AS ps FROM x GROUP BY 1, 2, 3),
s AS (SELECT mention_id, k, at_ms, 'aligned' AS status, ps[1] AS poi_id FROM y WHERE CASE WHEN rs[1] < 0.8::DOUBLE THEN len(rs) = 1 AND rs[1] >= 0.4::DOUBLE ELSE len(rs) = 1 OR round(rs[1] - rs[2], 10) >= 0.08::DOUBLE END
 UNION ALL SELECT o.mention_id, k, at_ms, CASE what WHEN 'attach' THEN 'resolved' ELSE 'discarded' END, CASE what WHEN 'attach' THEN poi_id END FROM o JOIN a ON a.mention_id = o.mention_id WHERE what IN ('attach', 'discard') AND k > first
 UNION ALL SELECT mention_id, NULL, asked + 30 * 86400000::BIGINT, 'expired', NULL FROM a),
f AS (SELECT s.*, first FROM s JOIN a ON a.mention_id = s.mention_id QUALIFY row_number() OVER (PARTITION BY s.mention_id ORDER BY at_ms, status <> 'expired', k) = 1)
SELECT mention_id, at_ms, status, poi_id FROM f WHERE at_ms <= epoch_ms(TIMESTAMP '2024-03-01') UNION ALL SELECT mention_id, asked, 'parked', NULL FROM a WHERE mention_id NOT IN (SELECT mention_id FROM f WHERE status = 'aligned' AND k = first)"""
)
def al13_queue(t: Tables) -> DataFrame:
    """What becomes of mentions that are asked for, found places for, and decided by hand, up to a day."""
    e = F.col("event_id")
    what = F.when(e % 5 == 0, "ask").when(e % 25 == 4, "attach").when(e % 25 == 9, "discard").otherwise("place")
    rows = t.events.select(F.col("user_id").alias("mention_id"), F.col("ts").cast("timestamp").alias("at"), e.alias("seq"), what.alias("what"), F.concat(F.lit("P"), (e % 3).cast("string")).alias("poi_id"), ((e % 11) / 10).alias("rank"))
    return replay(rows, "2024-03-01 00:00:00").select("mention_id", F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01', cast(at AS timestamp_ntz))").alias("at_ms"), "status", "poi_id")
