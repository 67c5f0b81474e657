"""Import of documents as they arrive, with their copies and reposts told at once.

The store keeps an index of all grams, in buckets of hashes, beside the documents. A batch adds its
grams, meets those stored in its buckets, and compares only pairs that share enough of them. All that a batch
writes bears its number, and it reads nothing of its own number or later ones, so a batch that is run
again replaces what it wrote and comes to the same. Its documents are written last; until
they are, nothing of it counts.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.runs import COPY_SHARE, MIN_RUN
from ..operators.grams import packed, sharing_pairs
from ..operators.reposts import copies, measured, roots_of
from ..storage import saved

#: Bits of a bucket's number; a store keeps those it began with.
BUCKET_BITS = 8

_GRAMS = "bucket int, new boolean, keys binary, ids binary, nexts binary, places binary, batch int"
_GROUPS = "id long, group_id long, batch int"
_DOCUMENTS = "id long, kind string, original long, coverage double, group_id long, key string, n long, body string, batch int"


def _part(spark: SparkSession, store: str, name: str, schema: str, which: Column) -> DataFrame:
    """The rows of a part of the store whose batch fits."""
    try:
        return spark.read.schema(schema).parquet(f"{store}/{name}").where(which)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":  # nothing stored yet
            raise
        return spark.createDataFrame([], schema)


def absorb(batch: DataFrame, store: str, number: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Takes batch `number` into the store.

    Its documents follow those stored, and one another by their ids, which are whole numbers that no other
    document has. Null ids are left out, null texts count as empty; an empty batch changes nothing.
    """
    spark = batch.sparkSession
    before = F.col("batch") < number
    stored = _part(spark, store, "documents", _DOCUMENTS, before).where("kind <> 'exact'")
    rows = copies(batch, id_col, text_col).select(F.col("id").cast("long").alias("id"), "body", F.col("original").cast("long").alias("first"), F.sha2("body", 256).alias("key"))
    held = stored.groupBy("key").agg(F.min_by("id", F.struct("batch", "id")).alias("held"))
    rows = saved(rows.join(held, "key", "left").withColumn("first", F.coalesce("held", "first")).withColumn("exact", F.col("id") != F.col("first")))
    items = saved(rows.where("NOT exact").select("id", "body"))
    packed(items, MIN_RUN, BUCKET_BITS).sortWithinPartitions("bucket").write.mode("overwrite").parquet(f"{store}/grams/batch={number}")
    own = _part(spark, store, "grams", _GRAMS, F.col("batch") == number)
    buckets = [row["bucket"] for row in own.select("bucket").distinct().collect()]  # 2^BUCKET_BITS at most
    known = _part(spark, store, "grams", _GRAMS, before).where(F.col("bucket").isin(buckets)).withColumn("new", F.lit(False))
    sizes = stored.select("id", "n", F.lit(False).alias("new")).unionByName(items.select("id", F.length("body").cast("long").alias("n"), F.lit(True).alias("new")))
    pairs = saved(sharing_pairs(own.unionByName(known).drop("batch"), sizes, round(COPY_SHARE * 100), MIN_RUN))
    bodies = stored.select("id", "body").unionByName(items)
    close = measured(pairs, bodies).where(F.col("coverage") >= COPY_SHARE).select("id", "other", "coverage")
    turn = stored.select("id", "batch").unionByName(items.select("id", F.lit(number).alias("batch")))
    side = lambda c: turn.select(F.col("id").alias(c), F.struct("batch", "id").alias(f"{c}_turn"))
    close = close.join(side("id"), "id").join(side("other"), "other").select(F.greatest("id_turn", "other_turn").alias("later"), F.least("id_turn", "other_turn").alias("earlier"), "coverage")
    best = close.groupBy(F.col("later.id").alias("id")).agg(F.min_by("earlier", F.struct(-F.col("coverage"), "earlier")).alias("o"), F.max("coverage").alias("coverage"))
    best = saved(best.select("id", F.col("o.id").alias("original"), "coverage"))
    roots = roots_of(best.select("id", F.col("original").alias("parent")))
    groups = stored.select("id", "group_id").join(_part(spark, store, "groups", _GROUPS, before).select("id", F.col("group_id").alias("joined")), "id", "left")
    groups = groups.select(F.col("id").alias("root"), F.coalesce("group_id", "joined").alias("held_group"), F.lit(True).alias("old"))
    placed = saved(roots.join(groups, "root", "left").select("id", "root", "old", F.coalesce("held_group", "root").alias("group_id"), F.col("held_group").isNull().alias("begins")))
    begun = placed.where("begins").select(F.col("root").alias("id"), "group_id", "old").distinct()
    begun.where("old").select("id", "group_id").write.mode("overwrite").parquet(f"{store}/groups/batch={number}")
    every = placed.select("id", "group_id").unionByName(begun.where("old IS NULL").select("id", "group_id"))
    joined = rows.join(best, "id", "left").join(every, "id", "left")
    exact = F.col("exact")
    kind = F.when(exact, "exact").when(F.col("original").isNotNull(), "repost").otherwise("new")
    out = joined.select(
        "id", kind.alias("kind"), F.when(exact, F.col("first")).otherwise(F.col("original")).alias("original"), F.when(exact, 1.0).otherwise(F.bround("coverage", 4)).alias("coverage"),
        "group_id", "key", F.length("body").cast("long").alias("n"), F.when(~exact, F.col("body")).alias("body"),
    )
    out.write.mode("overwrite").parquet(f"{store}/documents/batch={number}")


def imported(spark: SparkSession, store: str) -> DataFrame:
    """doc_id, kind, original, coverage, group_id of all documents whose batch was taken in whole, as repost_groups() gives them for all at once."""
    rows = _part(spark, store, "documents", _DOCUMENTS, F.lit(True))
    last = rows.agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0]
    joined = _part(spark, store, "groups", _GROUPS, F.col("batch") <= last).select("id", F.col("group_id").alias("joined"))
    now = rows.join(joined, "id", "left").withColumn("group_id", F.coalesce("group_id", "joined"))
    firsts = now.where("kind <> 'exact'").select(F.col("id").alias("original"), F.col("group_id").alias("first_group"))
    now = now.select("id", "kind", "original", "coverage", "group_id").join(firsts, "original", "left")
    group = F.when(F.col("kind") == "exact", F.col("first_group")).otherwise(F.col("group_id"))
    return now.select(F.col("id").alias("doc_id"), "kind", "original", "coverage", group.alias("group_id"))


def import_reposts(arriving: DataFrame, store: str, checkpoint: str, id_col: str = "doc_id", text_col: str = "text") -> StreamingQuery:
    """Takes the documents of a stream into the store, batch by batch."""

    def take(batch: DataFrame, number: int) -> None:
        absorb(batch, store, number, id_col, text_col)

    return arriving.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
