"""Evaluation against labels, and claims that are found again or taken in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import claims as C
from ..operators import evaluation as E
from ..storage import saved
from .registry import Tables, query

_LINES = """l AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq, l_partkey % 4 AS k, l_suppkey AS s, l_quantity::BIGINT AS q, l_returnflag AS f FROM lineitem),
g AS (SELECT doc_id, seq, CASE WHEN k = 3 THEN NULL ELSE 'hall ' || k END AS subject, f AS polarity, CASE WHEN s % 3 = 0 THEN NULL ELSE 'P' || k END AS poi_id, q AS a, q + 12 AS b FROM l),
p AS (SELECT doc_id, seq, 'hall ' || k || CASE WHEN s % 2 = 0 THEN '' ELSE '-gate' END AS subject, CASE WHEN seq % 5 = 0 THEN 'A' ELSE f END AS polarity, CASE s % 5 WHEN 0 THEN NULL WHEN 1 THEN 'P9' ELSE 'P' || k END AS poi_id, CASE WHEN s % 7 > 0 THEN q + s % 20 END AS a, q + s % 20 + 6 AS b FROM l),
v AS (SELECT p.doc_id, p.seq AS p, g.seq AS g, CASE WHEN p.polarity <> g.polarity THEN 'polarity' WHEN NOT coalesce(p.poi_id = g.poi_id, false) AND (g.subject IS NULL OR NOT contains(p.subject, g.subject)) THEN 'subject' WHEN coalesce(p.a < g.b AND g.a < p.b, false) THEN 'hit' ELSE 'fact' END AS verdict, p.poi_id AS pp, g.poi_id AS gp FROM p JOIN g ON p.doc_id = g.doc_id)"""


def _lines(t: Tables) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return t.lineitem.select(F.col("l_orderkey").alias("doc_id"), place.cast("long").alias("seq"), (F.col("l_partkey") % 4).alias("k"), F.col("l_suppkey").alias("s"), F.col("l_quantity").cast("long").alias("q"), F.col("l_returnflag").alias("f"))


def _golds(t: Tables) -> DataFrame:
    hall, k, s = F.concat(F.lit("hall "), F.col("k").cast("string")), F.col("k"), F.col("s")
    poi = F.when(s % 3 != 0, F.concat(F.lit("P"), k.cast("string")))
    return _lines(t).select("doc_id", "seq", F.when(k != 3, hall).alias("subject"), F.col("f").alias("polarity"), poi.alias("poi_id"), F.lit("").alias("quote"), F.col("q").alias("char_start"), (F.col("q") + 12).alias("char_end"))


def _predictions(t: Tables) -> DataFrame:
    k, s = F.col("k").cast("string"), F.col("s")
    subject = F.concat(F.lit("hall "), k, F.when(s % 2 == 0, "").otherwise("-gate"))
    poi = F.when(s % 5 == 1, "P9").when(s % 5 != 0, F.concat(F.lit("P"), k))
    start = F.col("q") + s % 20
    return _lines(t).select("doc_id", "seq", subject.alias("subject"), F.when(F.col("seq") % 5 == 0, "A").otherwise(F.col("f")).alias("polarity"), poi.alias("poi_id"), F.lit("").alias("quote"), F.lit("").alias("text"), F.when(s % 7 > 0, start).alias("char_start"), (start + 6).alias("char_end"))


@query(f"WITH {_LINES} SELECT doc_id, p, g, verdict <> 'polarity' AND verdict <> 'subject' AS same_subject FROM v WHERE verdict <> 'polarity'")
def ev01_same_subjects(t: Tables) -> DataFrame:
    found = E.compared(_predictions(t), _golds(t)).where("verdict <> 'polarity'")
    return found.select("doc_id", "p", "g", (F.col("verdict") != "subject").alias("same_subject"))


@query(f"WITH {_LINES} SELECT doc_id, p, g, verdict = 'hit' AS same_fact FROM v WHERE verdict IN ('hit', 'fact')")
def ev02_same_facts(t: Tables) -> DataFrame:
    return E.compared(_predictions(t), _golds(t)).where("verdict IN ('hit', 'fact')").select("doc_id", "p", "g", (F.col("verdict") == "hit").alias("same_fact"))


@query(f"WITH {_LINES} SELECT doc_id, p, g, verdict, CASE WHEN verdict = 'hit' AND gp IS NOT NULL THEN coalesce(pp = gp, false) END AS agrees FROM v")
def ev03_compare(t: Tables) -> DataFrame:
    return E.compared(_predictions(t), _golds(t))


@query()
def ev04_greedy_pairs(t: Tables) -> DataFrame:
    return E.paired(E.compared(_predictions(t), _golds(t)))


@query()
def ev05_spurious(t: Tables) -> DataFrame:
    found = saved(E.compared(_predictions(t), _golds(t)))
    return E.spurious(_predictions(t), found, saved(E.paired(found)))


@query()
def ev06_document_scores(t: Tables) -> DataFrame:
    return E.document_scores(_predictions(t), _golds(t))


@query()
def ev06_report(t: Tables) -> DataFrame:
    return E.metrics(E.document_scores(_predictions(t), _golds(t)))


@query("SELECT count(*) AS annotated, count_if(n > 0)::BIGINT AS labelled, coalesce(sum(n), 0)::BIGINT AS labels, count(*) >= 30 AS ready FROM (SELECT d.doc_id, count(l.doc_id) AS n FROM documents d JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) m USING (doc_id) LEFT JOIN labels l ON l.doc_id = d.doc_id AND l.toxic = 0 GROUP BY 1)")
def ev08_gold_documents(t: Tables) -> DataFrame:
    """Only annotated documents count, whether they have labels or not."""
    marked = t.documents.select("doc_id").join(t.labels.where("quality = 1"), "doc_id", "left_semi")
    n = t.labels.where("toxic = 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    rows = marked.join(n, "doc_id", "left").fillna(0, ["n"])
    return rows.agg(F.count(F.lit(1)).alias("annotated"), F.count_if(F.col("n") > 0).alias("labelled"), F.coalesce(F.sum("n"), F.lit(0)).alias("labels"), (F.count(F.lit(1)) >= E.READY_DOCS).alias("ready"))


@query(
    """WITH l AS (SELECT o_orderkey AS label_id, o_orderstatus AS polarity, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS note FROM orders),
e AS (SELECT o_orderkey AS label_id, o_orderkey % 9 = 0 AS gone, CASE WHEN o_orderkey % 2 = 0 THEN 'X' END AS polarity, CASE WHEN o_orderkey % 3 = 1 THEN 'new' END AS note, o_orderkey % 6 = 5 AS clear FROM orders WHERE o_custkey % 2 = 0)
SELECT l.label_id, coalesce(e.polarity, l.polarity) AS polarity, CASE WHEN coalesce(clear, false) THEN NULL ELSE coalesce(e.note, l.note) END AS note FROM l LEFT JOIN e USING (label_id) WHERE NOT coalesce(gone, false)"""
)
def ev10_edited_labels(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    labels = t.orders.select(k.alias("label_id"), F.col("o_orderstatus").alias("polarity"), F.when(k % 4 != 0, F.col("o_orderpriority")).alias("note"))
    cleared = F.when(k % 6 == 5, F.array(F.lit("note"))).otherwise(F.array().cast("array<string>"))
    edits = t.orders.where("o_custkey % 2 = 0").select(k.alias("label_id"), (k % 9 == 0).alias("gone"), F.when(k % 2 == 0, "X").alias("polarity"), F.when(k % 3 == 1, "new").alias("note"), cleared.alias("cleared"))
    return E.edited(labels, edits, ["polarity", "note"])


_CLAIMS = """c AS (SELECT o_orderkey AS id, o_custkey AS doc_id, 'poi' AS subject_type, o_orderstatus AS polarity, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE 'P' || (o_custkey % 20) END AS poi_id, CASE WHEN o_custkey % 5 = 0 THEN '6101' END AS city,
 CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority ELSE ' ' || o_orderpriority || chr(10) END AS text, regexp_replace(o_orderpriority, '\\s', '', 'g') AS form, o_orderkey % 4 = 0 AS held FROM orders),
h AS (SELECT subject_type, polarity, poi_id, city, form, min(id) AS claim_id FROM c WHERE held GROUP BY ALL)"""


def _claims(t: Tables) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = F.when(k % 3 == 0, F.col("o_orderpriority")).otherwise(F.concat(F.lit(" "), "o_orderpriority", F.lit("\n")))
    return t.orders.select(
        k.alias("id"), c.alias("doc_id"), F.lit("poi").alias("subject_type"), F.col("o_orderstatus").alias("polarity"), F.when(c % 5 != 0, F.concat(F.lit("P"), (c % 20).cast("string"))).alias("poi_id"),
        F.when(c % 5 == 0, "6101").alias("city"), text.alias("text"), (k % 4 == 0).alias("held"),
    )


@query(f"WITH {_CLAIMS} SELECT c.id AS new_id, h.claim_id FROM c LEFT JOIN h ON c.subject_type = h.subject_type AND c.polarity = h.polarity AND c.poi_id IS NOT DISTINCT FROM h.poi_id AND c.city IS NOT DISTINCT FROM h.city AND c.form = h.form WHERE NOT held")
def kb05_same_claims(t: Tables) -> DataFrame:
    rows = _claims(t)
    return C.same_claims(rows.where("NOT held"), rows.where("held"))


@query(
    f"""WITH {_CLAIMS}, a AS (SELECT subject_type, polarity, poi_id, city, form, min(id) AS claim_id FROM c GROUP BY ALL),
n AS (SELECT c.id, c.doc_id, a.claim_id FROM c JOIN a ON c.polarity = a.polarity AND c.poi_id IS NOT DISTINCT FROM a.poi_id AND c.city IS NOT DISTINCT FROM a.city AND c.form = a.form WHERE NOT held),
i AS (SELECT id AS claim_id, false AS created FROM c WHERE held UNION ALL SELECT DISTINCT claim_id, true FROM n WHERE claim_id NOT IN (SELECT id FROM c WHERE held)),
e AS (SELECT id AS claim_id, doc_id FROM c WHERE held UNION SELECT claim_id, doc_id FROM n), s AS (SELECT claim_id, count(*) AS documents, count(DISTINCT CASE WHEN doc_id % 2 = 0 THEN 'g' || (doc_id // 8) ELSE 'd' || doc_id END) AS sources FROM e GROUP BY 1)
SELECT i.claim_id, created, coalesce(documents, 0) AS documents, coalesce(sources, 0) AS sources, coalesce(sources, 0) >= 3 AS sure FROM i LEFT JOIN s USING (claim_id)"""
)
def kb07_materialized_claims(t: Tables) -> DataFrame:
    rows = _claims(t)
    held = rows.where("held").drop("doc_id", "held")
    groups = t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("doc_id"), F.floor(F.col("c_custkey") / 8).alias("group_id"))
    return C.materialized(rows.where("NOT held").drop("held"), held, rows.where("held").select(F.col("id").alias("claim_id"), "doc_id"), groups)


@query(
    """WITH r AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'poi' WHEN 1 THEN 'city' WHEN 2 THEN 'route' ELSE 'trip' END AS st, CASE WHEN o_custkey % 3 = 0 THEN 'P1' END AS poi, CASE WHEN o_custkey % 3 = 1 THEN '6101' END AS city, CASE WHEN o_custkey % 6 IN (2, 5) THEN 'P2' END AS f, CASE o_custkey % 6 WHEN 2 THEN 'P3' WHEN 5 THEN 'P2' END AS t FROM orders),
x AS (SELECT id, CASE WHEN st = 'poi' AND (poi IS NULL OR city IS NOT NULL OR f IS NOT NULL OR t IS NOT NULL) THEN 'not_one_place' WHEN st = 'city' AND (city IS NULL OR poi IS NOT NULL OR f IS NOT NULL OR t IS NOT NULL) THEN 'not_one_city'
 WHEN st = 'route' AND (f IS NULL OR t IS NULL OR poi IS NOT NULL OR city IS NOT NULL) THEN 'not_one_route' WHEN st = 'route' AND f = t THEN 'route_to_itself' WHEN st = 'trip' THEN 'unknown_type' END AS code FROM r) SELECT id, code FROM x WHERE code IS NOT NULL"""
)
def kb11_broken_subjects(t: Tables) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    kind = F.when(k % 4 == 0, "poi").when(k % 4 == 1, "city").when(k % 4 == 2, "route").otherwise("trip")
    code = C.broken_subject(kind, F.when(c % 3 == 0, "P1"), F.when(c % 3 == 1, "6101"), F.when((c % 6).isin(2, 5), "P2"), F.when(c % 6 == 2, "P3").when(c % 6 == 5, "P2"))
    return t.orders.select(k.alias("id"), code.alias("code")).where("code IS NOT NULL")


@query(
    """WITH n AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_suppkey % 4) AS s, bool_or(l_quantity = 7) AS blank FROM lineitem GROUP BY 1)
SELECT id, code FROM (SELECT o_orderkey AS id, CASE WHEN o_orderpriority = '5-LOW' AND o_custkey % 7 = 0 THEN 'blank_text' WHEN coalesce(n, 0) < 1 THEN 'no_evidence' WHEN coalesce(s, 0) < 1 THEN 'no_source' WHEN blank THEN 'blank_quote' END AS code FROM orders LEFT JOIN n ON l_orderkey = o_orderkey) WHERE code IS NOT NULL"""
)
def kb12_broken_claims(t: Tables) -> DataFrame:
    quote = F.when(F.col("l_quantity") == 7, " ").otherwise("quoted")
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.col("l_suppkey") % 4).alias("s"), F.collect_set(quote).alias("quotes"))
    text = F.when((F.col("o_orderpriority") == "5-LOW") & (F.col("o_custkey") % 7 == 0), " ").otherwise(F.col("o_orderpriority"))
    rows = t.orders.join(lines, "o_orderkey", "left")
    return rows.select(F.col("o_orderkey").alias("id"), C.broken_claim(text, F.col("quotes"), F.col("n"), F.col("s")).alias("code")).where("code IS NOT NULL")


def _runs(t: Tables) -> DataFrame:
    """Two runs of each document: lists with an element that is no object, malformed texts, texts that are no list, empty lists, and runs that failed."""
    d = F.col("doc_id")
    item = lambda i, quote: F.concat(F.lit(f'{{"subject_name":"s{i}","polarity":"avoid","text":"t{i}","quote":"{quote}","facet":"queue","char_start":'), (d % 50 + i).cast("string"), F.lit(',"char_end":'), (d % 50 + i + 5).cast("string"), F.lit("}"))
    good = F.concat(F.lit("["), item(0, "qa"), F.lit(',"x",'), item(1, "qb"), F.lit(',{"quote":"qc"}]'))
    second = F.when(d % 6 == 0, F.concat(good, F.lit("]"))).when(d % 6 == 1, '{"a":1}').when(d % 6 == 2, "[]").when(d % 6 == 3, good).otherwise("[1]")
    rows = t.documents.select("doc_id", F.explode(F.array(F.struct(F.lit(1).alias("run_id"), good.alias("accepted")), F.struct(F.lit(2).alias("run_id"), second.alias("accepted")))).alias("r")).select("doc_id", "r.*")
    return rows.select("run_id", "doc_id", F.when((F.col("run_id") == 2) & (d % 6 == 4), "failed").otherwise("ok").alias("status"), F.lit(0).alias("created_at"), "accepted", F.col("run_id").alias("accepted_count"))


_POOL = """g AS (SELECT doc_id, unnest([0, 2, 3]) AS pos FROM documents WHERE doc_id % 6 IN (3, 4)),
own AS (SELECT doc_id, pos, CASE pos WHEN 0 THEN 's0' WHEN 2 THEN 's1' ELSE '' END AS subject_name, CASE WHEN pos < 3 THEN 'avoid' ELSE '' END AS polarity, CASE pos WHEN 0 THEN 't0' WHEN 2 THEN 't1' ELSE '' END AS text, CASE pos WHEN 0 THEN 'qa' WHEN 2 THEN 'qb' ELSE 'qc' END AS quote, 'poi' AS subject_type, CASE WHEN pos < 3 THEN 'queue' ELSE 'other' END AS facet,
 CASE WHEN pos < 3 THEN doc_id % 50 + pos // 2 END AS char_start, CASE WHEN pos < 3 THEN doc_id % 50 + pos // 2 + 5 END AS char_end FROM g),
old AS (SELECT doc_id, i AS pos, 'o' || i AS subject_name, 'highlight' AS polarity, 'old' AS text, 'qb' AS quote, 'city' AS subject_type, 'hours' AS facet, i AS char_start, i + 2 AS char_end FROM documents, range(3) AS u(i) WHERE doc_id % 6 NOT IN (3, 4) AND (i > 0 OR doc_id % 2 = 0)),
p AS (SELECT * FROM own UNION ALL SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos = 2, pos) - 1, subject_name, polarity, text, quote, subject_type, facet, char_start, char_end FROM old)"""


@query(f"WITH {_POOL} SELECT doc_id, pos::INT AS pos, subject_name, polarity, text, quote, subject_type, facet, char_start::INT AS char_start, char_end::INT AS char_end, CASE WHEN char_start = doc_id % 50 AND char_end = doc_id % 50 + 5 THEN 'P' || (doc_id % 7) WHEN quote = 'qb' AND doc_id % 3 = 0 THEN 'Q' END AS poi_id FROM p")
def ev07_prediction_pool(t: Tables) -> DataFrame:
    """What was extracted from each document: by its latest good run, else from tasks (claims 0 and 1) and evidence (1 and 2), where both have claim 1."""
    d = F.col("doc_id")
    old = lambda a, b: t.documents.select("doc_id", F.explode(F.sequence(F.lit(a), F.lit(b))).alias("pos")).select(
        "doc_id", "pos", F.concat(F.lit("o"), F.col("pos").cast("string")).alias("subject_name"), F.lit("highlight").alias("polarity"), F.lit("old").alias("text"), F.lit("qb").alias("quote"), F.lit("city").alias("subject_type"), F.lit("hours").alias("facet"), F.col("pos").alias("char_start"), (F.col("pos") + 2).alias("char_end")
    )
    by_place = t.documents.select("doc_id", (d % 50).cast("int").alias("char_start"), (d % 50 + 5).cast("int").alias("char_end"), F.lit(None).cast("string").alias("quote"), F.concat(F.lit("P"), (d % 7).cast("string")).alias("poi_id"))
    by_quote = t.documents.where(d % 3 == 0).select("doc_id", F.lit(None).cast("int").alias("char_start"), F.lit(None).cast("int").alias("char_end"), F.lit("qb").alias("quote"), F.lit("Q").alias("poi_id"))
    return E.prediction_pool(_runs(t), old(0, 1).where((d % 2 == 0) | (F.col("pos") > 0)), old(1, 2), by_place.unionByName(by_quote))


@query(
    """WITH n AS (SELECT doc_id, count(*) AS labelled FROM labels GROUP BY 1), w AS (SELECT d.doc_id, coalesce(labelled, 0) AS labelled, CASE WHEN d.doc_id % 6 = 4 THEN 1 ELSE 2 END AS accepted, g.doc_id IS NOT NULL AS in_gold, n_chars FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) g ON g.doc_id = d.doc_id)
SELECT doc_id, labelled, accepted, in_gold, row_number() OVER (ORDER BY in_gold DESC, labelled DESC, n_chars, doc_id) AS place FROM w"""
)
def ev09_ordered_worklist(t: Tables) -> DataFrame:
    """Documents in the order in which they are to be labelled."""
    return E.worklist(t.documents.select("doc_id", F.col("n_chars").alias("imported_at")), t.labels, _runs(t), t.labels.where("quality = 1"))
