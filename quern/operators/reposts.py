"""Copies and reposts among documents, and the groups of documents that have one source.

Texts are compared without white space. A repost shares runs of MIN_RUN characters with an earlier
document that cover COPY_SHARE of the shorter of the two. A covered place lies in a gram of MIN_RUN
characters that both have; pairs whose grams in common cover so much are found block by block of texts. A common run of DECISIVE_RUN characters,
which decides alone for a duplicate, has a gram that both texts choose as an anchor, and begins
somewhere: there the characters before differ, so it is met once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.runs import COPY_SHARE, DECISIVE_RUN, MIN_RUN, measures
from ..storage import saved
from .blocks import MEASURES, measured_pairs
from .grams import anchored_pairs

#: Conclusions that a document needs to be compared, and the share of them that another one must have.
LEAST_KEYS, KEY_SHARE = 4, 0.80


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, body and original: the text without white space, and the smallest id with the same one. Null texts count as empty, null ids are left out."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), T.squash(F.coalesce(F.col(text_col), F.lit(""))).alias("body"))
    keyed = rows.withColumn("key", F.sha2("body", 256))
    return keyed.join(keyed.groupBy("key").agg(F.min("id").alias("original")), "key").drop("key")


def cover_candidates(items: DataFrame) -> DataFrame:
    """Pairs (id, other) whose grams of MIN_RUN characters in common cover COPY_SHARE of id: the shorter text, or the later of two of one length. items has id, a whole number, and body, all bodies different."""
    return covered_pairs(items, ()).select("id", "other")


def decisive_runs(items: DataFrame) -> DataFrame:
    """Pairs (id, other), the shorter or later first, that have a run of DECISIVE_RUN characters in common, however little of them it covers."""
    return anchored_pairs(items, MIN_RUN, DECISIVE_RUN).select("id", "other")


def measured(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """The pairs (id, other) with n, m (their characters), bound, coverage, longest, letters, jaccard and containment of their bodies, null but for the first if the bound rules a repost out; see measure()."""
    both = pairs.join(items, "id").join(items.select(F.col("id").alias("other"), F.col("body").alias("other_body")), "other")
    both = both.sortWithinPartitions("other", "id")  # what is known of a text serves all its pairs
    rows = both.select("id", "other", F.length("body").alias("n"), F.length("other_body").alias("m"), measures("body", "other_body").alias("o"))
    return rows.select("id", "other", "n", "m", "o.*")


def covered_pairs(items: DataFrame, wanted: tuple[str, ...] = tuple(MEASURES)) -> DataFrame:
    """The pairs whose bound allows for a repost, and what is wanted of them: see measured_pairs(). No coverage by matching runs is larger than the bound."""
    return measured_pairs(items, round(COPY_SHARE * 100), wanted=wanted)


def duplicates(items: DataFrame) -> DataFrame:
    """id, other, by_cover, by_run: pairs of one source, by coverage, by a decisive run, or by both."""
    return anchored_pairs(items, MIN_RUN, DECISIVE_RUN, covered_pairs(items, ("runs",)).where(F.col("coverage") >= COPY_SHARE))


def best_originals(found: DataFrame) -> DataFrame:
    """id, original, coverage: for each document the earlier one of the pairs that covers most, of equals the first."""
    pairs = found.where(F.col("coverage") >= COPY_SHARE).select(F.greatest("id", "other").alias("id"), F.least("id", "other").alias("original"), "coverage")
    return pairs.groupBy("id").agg(F.min_by("original", F.struct(-F.col("coverage"), "original")).alias("original"), F.max("coverage").alias("coverage"))


def roots_of(parents: DataFrame) -> DataFrame:
    """id and root of each row (id, parent) of a forest, in as many rounds as the binary logarithm of its depth."""
    rows, before = saved(parents.select("id", F.col("parent").alias("root"))), None
    while True:
        up = rows.select(F.col("id").alias("root"), F.col("root").alias("next"))
        rows = saved(rows.join(up, "root", "left").select("id", F.coalesce("next", "root").alias("root")))
        state = rows.agg(F.bit_xor(F.xxhash64("id", "root")), F.count(F.lit(1))).first()
        if state == before:
            return rows
        before = state


def repost_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, kind, original, coverage, group_id: documents in the order of their ids, as if imported one after another.

    An exact copy is not compared further: its original is the first one with its text, its group that
    one's. A repost joins the group of its original, which is named by the first document that the
    originals lead to. A new document has a group only if reposts of it follow. Empty texts are copies
    of one another. Coverage is rounded to four places.
    """
    rows = saved(copies(docs, id_col, text_col))
    items = rows.where("id = original").select("id", "body")
    best = saved(best_originals(covered_pairs(items, ("runs",))))
    groups = roots_of(best.select("id", F.col("original").alias("parent"))).withColumnRenamed("root", "group_id")
    groups = groups.unionByName(groups.select(F.col("group_id").alias("id"), "group_id").distinct())
    first = rows.join(groups.select(F.col("id").alias("original"), "group_id"), "original", "left").select("id", F.col("original").alias("first"), "group_id")
    joined = first.join(best, "id", "left")
    copy = F.col("id") != F.col("first")
    kind = F.when(copy, "exact").when(F.col("original").isNotNull(), "repost").otherwise("new")
    return joined.select(
        F.col("id").alias("doc_id"), kind.alias("kind"), F.when(copy, F.col("first")).otherwise(F.col("original")).alias("original"),
        F.when(copy, 1.0).otherwise(F.bround("coverage", 4)).alias("coverage"), "group_id",
    )


def first_matches(keys: DataFrame) -> DataFrame:
    """doc, other, share: for each document of LEAST_KEYS different keys the first other one, by id, that has KEY_SHARE of its keys. keys has doc and key.

    A document may leave out its most frequent keys, one fewer than the other must have. Keys may be long, so half of their SHA-256 stands for them from the start.
    """
    keys = saved(keys.select("doc", F.substring(F.unhex(F.sha2("key", 256)), 1, 16).alias("key")).distinct())
    heat = keys.groupBy("key").agg(F.count(F.lit(1)).alias("heat")).where("heat > 1")
    sizes = keys.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_KEYS)
    must = F.ceil(F.col("n") * F.lit(str(KEY_SHARE)).cast("decimal(3,2)"))
    shared = saved(keys.join(heat, "key"))
    asked = shared.join(sizes, "doc").withColumn("place", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("heat"), "key")))
    rare = asked.where(F.col("place") >= must).select("doc", "n", "key")
    pairs = rare.join(shared.select(F.col("doc").alias("other"), "key"), "key").where("doc <> other").select("doc", "n", "other").distinct()
    counted = pairs.join(shared.select("doc", "key"), "doc").join(shared.select(F.col("doc").alias("other"), "key"), ["other", "key"]).groupBy("doc", "n", "other").agg(F.count(F.lit(1)).alias("shared"))
    enough = counted.where(F.col("shared") >= must)
    return enough.groupBy("doc").agg(F.min("other").alias("other"), F.bround(F.min_by(F.col("shared") / F.col("n"), "other"), 4).alias("share"))


def conclusion_groups(matches: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """id, group_id, share: the groups that documents come to, each joining in the order of ids the group that its first match has at that time.

    matches are those of first_matches(), known (id, group_id) documents that had a group before; they join no other.
    A first match without a group gets one, named by it. If its own turn comes later, it leaves that group for that of its own first match, as
    its turn decides; who joined it before stays. share is null for those that were only joined.
    """
    own = matches.select(F.col("doc").alias("id"), "other", "share")
    if known is not None:
        own = own.join(known.select("id"), "id", "left_anti")
    own = saved(own)
    turn = own.select(F.col("id").alias("other"), F.lit(True).alias("has_turn"))
    rows = own.join(turn, "other", "left")
    # who has had its turn leads on to where it went; else the group is the other's own
    leads = F.coalesce("has_turn", F.lit(False)) & (F.col("other") < F.col("id"))
    rows = rows.withColumns({"up": F.when(leads, F.col("other")).otherwise(F.col("id")), "ends": F.when(~leads, F.col("other"))})
    found = roots_of(rows.select("id", F.col("up").alias("parent"))).join(rows.select(F.col("id").alias("root"), "ends"), "root").select("id", F.col("ends").alias("group"))
    joined = found.select(F.col("group").alias("id")).distinct().join(own.select("id"), "id", "left_anti").select("id", F.col("id").alias("group"))
    every = found.unionByName(joined)
    if known is not None:
        every = every.join(known.select(F.col("id").alias("group"), F.col("group_id").alias("held")), "group", "left").select("id", F.coalesce("held", "group").alias("group"))
        every = every.join(known.select("id"), "id", "left_anti").unionByName(known.select("id", F.col("group_id").alias("group")))
    return every.join(own.select("id", "share"), "id", "left").select("id", F.col("group").alias("group_id"), "share")
