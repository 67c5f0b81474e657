"""Scans, joins, aggregates, orders and set operations over the relational tables.

Claims are orders, evidence is line items, documents are suppliers; a supplier's group is its
nation, missing for some and empty for others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.merge import delete_below, upsert
from ..operators.ordering import numbered
from .registry import Tables, query

#: Independent sources from which a claim counts as sure.
SURE = 3

_GROUP = "CASE WHEN s_nationkey % 5 = 0 THEN NULL WHEN s_nationkey % 5 = 1 THEN '' ELSE 'N' || s_nationkey END"


def source_group(nation: Column) -> Column:
    return F.when(nation % 5 == 0, F.lit(None).cast("string")).when(nation % 5 == 1, "").otherwise(F.concat(F.lit("N"), nation.cast("string")))


def independent_sources(group: Column, document: Column) -> Column:
    """Number of groups; a document without one, or with an empty one, stands for itself."""
    return F.count_distinct(F.coalesce(F.nullif(group, F.lit("")), F.concat(F.lit("D"), document.cast("string"))))


def confidence(sources: Column) -> Column:
    return F.when(sources >= SURE, "high").otherwise("single_source")


@query(
    f"""WITH s AS (SELECT s_suppkey, {_GROUP} AS g FROM supplier)
SELECT l_orderkey, count(DISTINCT coalesce(nullif(g, ''), 'D' || l_suppkey)) AS sources,
  CASE WHEN count(DISTINCT coalesce(nullif(g, ''), 'D' || l_suppkey)) >= 3 THEN 'high' ELSE 'single_source' END AS confidence
FROM lineitem LEFT JOIN s ON l_suppkey = s_suppkey GROUP BY l_orderkey"""
)
def kb01_independent_sources(t: Tables) -> DataFrame:
    groups = t.supplier.select("s_suppkey", source_group(F.col("s_nationkey")).alias("g"))
    joined = t.lineitem.select("l_orderkey", "l_suppkey").join(groups, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return joined.groupBy("l_orderkey").agg(independent_sources(F.col("g"), F.col("l_suppkey")).alias("sources")).withColumn("confidence", confidence(F.col("sources")))


@query(
    f"""WITH s AS (SELECT s_suppkey, {_GROUP} AS g FROM supplier), n AS (
SELECT l_orderkey, count(DISTINCT coalesce(nullif(g, ''), 'D' || l_suppkey)) AS sources FROM lineitem LEFT JOIN s ON l_suppkey = s_suppkey GROUP BY 1)
SELECT sources, CASE WHEN sources >= 3 THEN sources || ' 个独立来源' WHEN sources <= 1 THEN '待验证的个例（只有 1 个来源）'
  ELSE '待验证的个例（' || sources || ' 个来源，未达交叉验证门槛）' END AS wording, count(*) AS claims FROM n GROUP BY 1, 2"""
)
def kb02_confidence_wording(t: Tables) -> DataFrame:
    n = F.col("sources").cast("string")
    wording = (
        F.when(F.col("sources") >= SURE, F.concat(n, F.lit(" 个独立来源")))
        .when(F.col("sources") <= 1, "待验证的个例（只有 1 个来源）")
        .otherwise(F.concat(F.lit("待验证的个例（"), n, F.lit(" 个来源，未达交叉验证门槛）")))
    )
    return kb01_independent_sources(t).groupBy("sources", wording.alias("wording")).agg(F.count(F.lit(1)).alias("claims"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def fl01_optional_filters(t: Tables, status: str | None = "F", priority: str | None = "1-URGENT", customer: int | None = None, limit: int = 50) -> DataFrame:
    rows = t.orders
    for name, value in (("o_orderstatus", status), ("o_orderpriority", priority), ("o_custkey", customer)):
        if value is not None:
            rows = rows.where(F.col(name) == value)
    return rows.select("o_orderkey", "o_custkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(limit)


@query("SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey = 42")
def src02_point_lookup(t: Tables) -> DataFrame:
    return t.customer.where(F.col("c_custkey") == 42).select("c_custkey", "c_name", "c_nationkey")


@query("SELECT i - 1 AS pos, c_custkey, c_name FROM (SELECT unnest([30, 7, 99, 12]) AS k, generate_subscripts([30, 7, 99, 12], 1) AS i) JOIN customer ON c_custkey = k")
def src03_keys_in_order(t: Tables) -> DataFrame:
    keys = t.spark.range(1).select(F.posexplode(F.array(*map(F.lit, (30, 7, 99, 12)))).alias("pos", "k"))
    return t.customer.join(F.broadcast(keys), F.col("c_custkey") == F.col("k")).select(F.col("pos").cast("long").alias("pos"), "c_custkey", "c_name")


@query("SELECT o_orderkey, c_custkey, c_nationkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '5-LOW' AND (c_nationkey = 3 OR o_custkey % 100 = 7)")
def jn05_outer_join_either(t: Tables) -> DataFrame:
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.where((F.col("o_orderpriority") == "5-LOW") & ((F.col("c_nationkey") == 3) | (F.col("o_custkey") % 100 == 7))).select("o_orderkey", "c_custkey", "c_nationkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def jn06_not_yet_handled(t: Tables) -> DataFrame:
    done = t.orders.where(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.select("c_custkey").join(done, "c_custkey", "left_anti")


@query("SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM supplier s WHERE nullif(s.s_nationkey, 4) IS NOT DISTINCT FROM nullif(c.c_nationkey, 4) AND s.s_suppkey % 10 = c.c_custkey % 10)")
def jn07_null_safe_probe(t: Tables) -> DataFrame:
    left = t.customer.select("c_custkey", "c_name", F.nullif(F.col("c_nationkey"), F.lit(4)).alias("cn"), (F.col("c_custkey") % 10).alias("cd"))
    right = t.supplier.select(F.nullif(F.col("s_nationkey"), F.lit(4)).alias("sn"), (F.col("s_suppkey") % 10).alias("sd"))
    return left.join(right, F.col("cn").eqNullSafe(F.col("sn")) & (F.col("cd") == F.col("sd")), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders FROM customer")
def jn08_count_for_each(t: Tables) -> DataFrame:
    counts = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return t.customer.select("c_custkey").join(counts, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) ON c_custkey = o_custkey")
def jn09_latest_row(t: Tables) -> DataFrame:
    latest = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))
    return t.customer.select("c_custkey").join(latest, "c_custkey", "left")


@query("SELECT l_orderkey, l_linenumber, p_name, s_name, n_name, r_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE l_quantity > 48")
def jn02_join_chain(t: Tables) -> DataFrame:
    rows = t.lineitem.where(F.col("l_quantity") > 48).join(t.part, F.col("l_partkey") == F.col("p_partkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select("l_orderkey", "l_linenumber", "p_name", "s_name", "n_name", "r_name")


@query("SELECT a.l_orderkey, a.l_linenumber AS a_line, b.l_linenumber AS b_line FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND a.l_partkey < b.l_partkey + 20 AND b.l_partkey < a.l_partkey + 20")
def jn10_interval_overlap(t: Tables) -> DataFrame:
    a = t.lineitem.select("l_orderkey", F.col("l_linenumber").alias("a_line"), F.col("l_partkey").alias("a_from"))
    b = t.lineitem.select("l_orderkey", F.col("l_linenumber").alias("b_line"), F.col("l_partkey").alias("b_from"))
    near = (F.col("a_line") < F.col("b_line")) & (F.col("a_from") < F.col("b_from") + 20) & (F.col("b_from") < F.col("a_from") + 20)
    return a.join(b, "l_orderkey").where(near).select("l_orderkey", "a_line", "b_line")


@query(
    """WITH e AS (SELECT user_id, event_id, lag(event_id) OVER w AS before, lead(event_id) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id))
SELECT * FROM e"""
)
def jn14_neighbours(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    return t.events.select("user_id", "event_id", F.lag("event_id").over(w).alias("before"), F.lead("event_id").over(w).alias("after"))


@query(
    """WITH a AS (SELECT l_orderkey, l_partkey, min(l_suppkey) AS s FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1, 2), b AS (SELECT l_orderkey, l_suppkey, max(l_partkey) AS p FROM lineitem GROUP BY 1, 2)
SELECT l.l_orderkey, l.l_linenumber, coalesce(a.s, b.p) AS found FROM lineitem l LEFT JOIN a ON a.l_orderkey = l.l_orderkey AND a.l_partkey = l.l_partkey LEFT JOIN b ON b.l_orderkey = l.l_orderkey AND b.l_suppkey = l.l_suppkey"""
)
def jn15_fallback_key(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    first = rows.where("l_linenumber <= 3").groupBy("l_orderkey", "l_partkey").agg(F.min("l_suppkey").alias("s"))
    second = rows.groupBy("l_orderkey", "l_suppkey").agg(F.max("l_partkey").alias("p"))
    return rows.join(first, ["l_orderkey", "l_partkey"], "left").join(second, ["l_orderkey", "l_suppkey"], "left").select("l_orderkey", "l_linenumber", F.coalesce("s", "p").alias("found"))


@query("SELECT count(*) AS events, count(DISTINCT user_id) AS users, coalesce(sum(value), 0) > 0 AS any_value, coalesce(sum(CASE WHEN event_type = 'none' THEN 1 END), 0)::BIGINT AS of_no_kind FROM events")
def ag01_totals(t: Tables) -> DataFrame:
    return t.events.agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("user_id").alias("users"), (F.coalesce(F.sum("value"), F.lit(0)) > 0).alias("any_value"),
        F.coalesce(F.sum(F.when(F.col("event_type") == "none", 1)), F.lit(0)).cast("long").alias("of_no_kind"),
    )


@query("SELECT c_mktsegment, count_if(c_acctbal < 0)::BIGINT AS in_debt, count(*) AS n, round(count_if(c_acctbal < 0) / nullif(count(*), 0), 6) AS share FROM customer GROUP BY 1")
def ag02_conditional_counts(t: Tables) -> DataFrame:
    debt = F.count_if(F.col("c_acctbal") < 0)
    return t.customer.groupBy("c_mktsegment").agg(debt.alias("in_debt"), F.count(F.lit(1)).alias("n"), F.round(debt / F.nullif(F.count(F.lit(1)), F.lit(0)), 6).alias("share"))


@query("SELECT o_orderpriority, count_if(o_orderstatus = 'F')::BIGINT AS F, count_if(o_orderstatus = 'O')::BIGINT AS O, count_if(o_orderstatus = 'P')::BIGINT AS P FROM orders GROUP BY 1")
def ag03_pivot_status(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().fillna(0)


@query("SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM documents) AS documents, (SELECT count(DISTINCT doc_id) FROM labels) AS labelled")
def ag04_counts_in_a_row(t: Tables) -> DataFrame:
    counts = t.orders.agg(F.count(F.lit(1)).alias("orders"))
    for name, part in (("customers", t.customer.agg(F.count(F.lit(1)))), ("documents", t.documents.agg(F.count(F.lit(1)))), ("labelled", t.labels.agg(F.count_distinct("doc_id")))):
        counts = counts.withColumn(name, part.scalar())
    return counts


@query("SELECT user_id, event_type, min(ts::DATE)::VARCHAR AS first_day, count(DISTINCT ts::DATE) AS days FROM events GROUP BY 1, 2")
def ag05_first_day(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id", "event_type").agg(F.min(F.to_date("ts")).cast("string").alias("first_day"), F.count_distinct(F.to_date("ts")).alias("days"))


@query("SELECT n_regionkey, string_agg(n_name, '、' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1")
def ag07_ordered_list(t: Tables) -> DataFrame:
    names = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"])
    return t.nation.groupBy("n_regionkey").agg(F.array_join(names, "、").alias("names"))


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def ag08_distinct(t: Tables) -> DataFrame:
    return t.orders.select("o_orderstatus", "o_orderpriority").distinct()


@query("SELECT p_brand, median(p_retailprice) AS middle FROM part GROUP BY 1")
def ag09_median(t: Tables) -> DataFrame:
    return t.part.groupBy("p_brand").agg(F.median("p_retailprice").alias("middle"))


@query("SELECT user_id, round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END), 2) AS purchases, round(sum(CASE WHEN event_type <> 'purchase' THEN value ELSE 0 END), 2) AS others, bool_or(value > 90) AS any_large FROM events GROUP BY 1")
def ag10_sums_by_category(t: Tables) -> DataFrame:
    bought = F.col("event_type") == "purchase"
    part = lambda when: F.round(F.sum(F.when(when, F.col("value")).otherwise(0)), 2)
    return t.events.groupBy("user_id").agg(part(bought).alias("purchases"), part(~bought).alias("others"), F.bool_or(F.col("value") > 90).alias("any_large"))


@query("SELECT s_nationkey, arg_max(s_name, (s_acctbal, -s_suppkey)) AS richest, arg_min(s_name, (s_acctbal, s_suppkey)) AS poorest FROM supplier GROUP BY 1")
def ag11_largest_and_smallest(t: Tables) -> DataFrame:
    return t.supplier.groupBy("s_nationkey").agg(F.max_by("s_name", F.struct("s_acctbal", -F.col("s_suppkey"))).alias("richest"), F.min_by("s_name", F.struct("s_acctbal", "s_suppkey")).alias("poorest"))


@query("SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS priorities FROM orders GROUP BY 1")
def ag13_sets(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.sort_array(F.collect_set("o_orderpriority")).alias("priorities"))


@query("SELECT c_custkey, row_number() OVER (ORDER BY (c_acctbal < 0), c_name, c_custkey) AS place FROM customer")
def or02_flag_first(t: Tables) -> DataFrame:
    return numbered(t.customer.select("c_custkey", "c_name", "c_acctbal"), [F.col("c_acctbal") < 0, F.col("c_name"), F.col("c_custkey")]).select("c_custkey", "place")


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_quantity END NULLS LAST, l_linenumber) AS place FROM lineitem")
def or03_nulls_last(t: Tables) -> DataFrame:
    known = F.when(F.col("l_returnflag") != "N", F.col("l_quantity"))
    w = Window.partitionBy("l_orderkey").orderBy(known.asc_nulls_last(), "l_linenumber")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.row_number().over(w).cast("long").alias("place"))


@query("SELECT o_custkey, o_orderpriority, o_orderkey, place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 8")
def or06_top_of_each_kind(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey", "o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t.orders.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 8").select("o_custkey", "o_orderpriority", "o_orderkey", "place")


@query("WITH u AS (SELECT c_nationkey AS k, 1 AS rank, 'customer' AS origin FROM customer WHERE c_acctbal > 9900 UNION ALL SELECT s_nationkey, 2, 'supplier' FROM supplier UNION ALL SELECT n_nationkey, 3, 'none' FROM nation) SELECT k, arg_min(origin, rank) AS origin FROM u GROUP BY 1")
def so01_first_source_that_has_it(t: Tables) -> DataFrame:
    part = lambda rows, key, rank, name: rows.select(F.col(key).alias("k"), F.lit(rank).alias("rank"), F.lit(name).alias("origin"))
    rows = part(t.customer.where("c_acctbal > 9900"), "c_nationkey", 1, "customer").unionByName(part(t.supplier, "s_nationkey", 2, "supplier")).unionByName(part(t.nation, "n_nationkey", 3, "none"))
    return rows.groupBy("k").agg(F.min_by("origin", "rank").alias("origin"))


@query("SELECT 'claim' AS kind, s_suppkey AS ref, s_name AS name FROM supplier WHERE s_acctbal < 0 UNION ALL SELECT 'task', c_custkey, c_name FROM customer WHERE c_acctbal < -900")
def so02_union_all(t: Tables) -> DataFrame:
    one = t.supplier.where("s_acctbal < 0").select(F.lit("claim").alias("kind"), F.col("s_suppkey").alias("ref"), F.col("s_name").alias("name"))
    return one.unionByName(t.customer.where("c_acctbal < -900").select(F.lit("task").alias("kind"), F.col("c_custkey").alias("ref"), F.col("c_name").alias("name")))


@query("WITH u AS (SELECT o_custkey AS k, o_orderpriority AS p, 1 AS rank, o_orderkey AS v FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, o_orderpriority, 2, o_orderkey FROM orders) SELECT k, p, v FROM u QUALIFY row_number() OVER (PARTITION BY k, p ORDER BY rank, v) = 1")
def so03_union_by_key(t: Tables) -> DataFrame:
    row = lambda rows, rank: rows.select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("p"), F.lit(rank).alias("rank"), F.col("o_orderkey").alias("v"))
    both = row(t.orders.where("o_orderstatus = 'F'"), 1).unionByName(row(t.orders, 2))
    return both.groupBy("k", "p").agg(F.min_by("v", F.struct("rank", "v")).alias("v"))


@query("WITH a AS (SELECT c_nationkey AS k, count(*) AS customers FROM customer WHERE c_acctbal > 5000 GROUP BY 1), b AS (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, coalesce(customers, 0) AS customers, coalesce(suppliers, 0) AS suppliers FROM a FULL JOIN b ON a.k = b.k")
def so04_merge_counts(t: Tables) -> DataFrame:
    a = t.customer.where("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("customers"))
    b = t.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("suppliers"))
    return a.join(b, "k", "full").fillna(0, ["customers", "suppliers"])


@query("WITH new AS (SELECT * FROM customer WHERE c_custkey % 7 = 0), old AS (SELECT * FROM customer WHERE c_custkey % 2 = 0) SELECT coalesce(new.c_custkey, old.c_custkey) AS c_custkey, CASE WHEN new.c_custkey IS NOT NULL THEN upper(new.c_name) ELSE old.c_name END AS c_name, new.c_custkey IS NOT NULL AS written FROM new FULL JOIN old ON new.c_custkey = old.c_custkey")
def snk02_upsert_overwrite(t: Tables) -> DataFrame:
    new = t.customer.where("c_custkey % 7 = 0").select("c_custkey", F.upper("c_name").alias("c_name"))
    old = t.customer.where("c_custkey % 2 = 0").select("c_custkey", "c_name")
    return upsert(old.withColumn("written", F.lit(False)), new.withColumn("written", F.lit(True)), "c_custkey", ("c_name", "written"))


@query("WITH new AS (SELECT c_custkey, c_name, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer WHERE c_custkey % 3 = 0), old AS (SELECT c_custkey, lower(c_name) AS c_name, c_mktsegment AS seg FROM customer WHERE c_custkey % 2 = 0) SELECT coalesce(new.c_custkey, old.c_custkey) AS c_custkey, coalesce(new.c_name, old.c_name) AS c_name, coalesce(new.seg, old.seg) AS seg FROM new FULL JOIN old ON new.c_custkey = old.c_custkey")
def snk03_upsert_fill(t: Tables) -> DataFrame:
    new = t.customer.where("c_custkey % 3 = 0").select("c_custkey", F.col("c_name").alias("a"), F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("b"))
    old = t.customer.where("c_custkey % 2 = 0").select("c_custkey", F.lower("c_name").alias("c"), F.col("c_mktsegment").alias("d"))
    return new.join(old, "c_custkey", "full").select("c_custkey", F.coalesce("a", "c").alias("c_name"), F.coalesce("b", "d").alias("seg"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 5))")
def snk04_delete_cascade(t: Tables) -> DataFrame:
    gone = t.orders.join(t.customer.where("c_nationkey = 5").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select(F.col("o_orderkey").alias("l_orderkey"))
    return delete_below(t.lineitem.select("l_orderkey", "l_linenumber"), gone, "l_orderkey")


@query("SELECT o_orderkey, 'no_lines' AS code FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT o_orderkey, 'no_customer' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT l_orderkey, 'bad_discount' FROM lineitem WHERE l_discount < 0 OR l_discount > 1 UNION ALL SELECT o_orderkey, 'not_unique' FROM orders GROUP BY 1 HAVING count(*) > 1")
def kb12_constraints(t: Tables) -> DataFrame:
    orders, lines = t.orders, t.lineitem
    found = [
        orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", F.lit("no_lines").alias("code")),
        orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("o_orderkey", F.lit("no_customer").alias("code")),
        lines.where("l_discount < 0 OR l_discount > 1").select(F.col("l_orderkey").alias("o_orderkey"), F.lit("bad_discount").alias("code")),
        orders.groupBy("o_orderkey").count().where("count > 1").select("o_orderkey", F.lit("not_unique").alias("code")),
    ]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


@query("WITH e AS (SELECT l_orderkey % 500 AS claim, l_suppkey AS doc, l_orderkey, l_linenumber FROM lineitem) SELECT claim, doc, l_orderkey, l_linenumber FROM e QUALIFY row_number() OVER (PARTITION BY claim, doc ORDER BY l_orderkey, l_linenumber) = 1")
def kb06_one_evidence_each(t: Tables) -> DataFrame:
    rows = t.lineitem.select((F.col("l_orderkey") % 500).alias("claim"), F.col("l_suppkey").alias("doc"), F.struct("l_orderkey", "l_linenumber").alias("first"))
    return rows.groupBy("claim", "doc").agg(F.min("first").alias("first")).select("claim", "doc", "first.l_orderkey", "first.l_linenumber")


@query(
    f"""WITH c AS (SELECT o_orderkey, first_value(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS kept FROM orders),
e AS (SELECT DISTINCT kept, l_suppkey FROM lineitem JOIN c ON l_orderkey = o_orderkey),
s AS (SELECT s_suppkey, {_GROUP} AS g FROM supplier)
SELECT kept, count(*) AS evidence, count(DISTINCT coalesce(nullif(g, ''), 'D' || l_suppkey)) AS sources FROM e LEFT JOIN s ON l_suppkey = s_suppkey GROUP BY 1"""
)
def kb08_merge_claims(t: Tables) -> DataFrame:
    kept = F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey"))
    claims = t.orders.groupBy("o_custkey", "o_orderpriority").agg(kept.alias("kept"))
    mapped = t.orders.join(claims, ["o_custkey", "o_orderpriority"]).select(F.col("o_orderkey").alias("l_orderkey"), "kept")
    evidence = t.lineitem.select("l_orderkey", "l_suppkey").join(mapped, "l_orderkey").select("kept", "l_suppkey").distinct()
    groups = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), source_group(F.col("s_nationkey")).alias("g"))
    return evidence.join(groups, "l_suppkey", "left").groupBy("kept").agg(F.count(F.lit(1)).alias("evidence"), independent_sources(F.col("g"), F.col("l_suppkey")).alias("sources"))


@query("SELECT o_orderkey, o_custkey, n_lines, o_totalprice FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey ORDER BY n_lines DESC NULLS LAST, o_orderdate DESC, o_orderkey LIMIT 200")
def kb09_list_claims(t: Tables) -> DataFrame:
    counts = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_lines"))
    rows = t.orders.join(counts, "o_orderkey", "left")
    return rows.orderBy(F.desc_nulls_last("n_lines"), F.desc("o_orderdate"), "o_orderkey").limit(200).select("o_orderkey", "o_custkey", "n_lines", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber, l_suppkey, s_name, l_shipdate::DATE::VARCHAR AS shipped FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")
def kb10_evidence_of_claims(t: Tables) -> DataFrame:
    return t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "l_linenumber", "l_suppkey", "s_name", F.to_date("l_shipdate").cast("string").alias("shipped"))
