"""Search for phrases in texts by an index of their grams, whatever the case of ASCII letters.

The index holds, for each gram of GRAM characters, the ids of the texts that have it, in folders by the gram's hash
and in its order within, a row for each batch of texts, and how many they are. A search looks at the counts of the phrase's grams, reads the
folders of its rarest ones only, and compares the phrase itself with the texts that have all of these.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.runs import gram_hashes
from ..storage import shared_folder, small_batches

#: Characters in a gram, folders of an index, grams of a phrase that are looked up, and texts that are asked for by their ids.
GRAM, BUCKETS, RAREST, FEW_TEXTS = 3, 64, 4, 1000


def _folded(text: str | None) -> str:
    """The text with A to Z in lower case; other letters stay as they are."""
    return (text or "").encode().lower().decode()


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each gram of a batch of texts with the ids of those that have it."""
    for batch in batches:
        texts = zip(*[column.to_pylist() for column in batch.columns[1:]])
        found = [np.unique(np.concatenate([gram_hashes(_folded(x), GRAM) for x in row])) for row in texts]
        rows = np.repeat(np.arange(len(found)), [len(x) for x in found])
        every = np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64)
        order = np.argsort(every, kind="stable")
        grams, first = np.unique(every[order], return_index=True)
        ids = pa.ListArray.from_arrays(pa.array(np.append(first, len(every)), pa.int32()), batch.column(0).take(pa.array(rows[order])))
        yield pa.RecordBatch.from_arrays([pa.array((grams >> 40) % BUCKETS, pa.int32()), pa.array(grams), ids], names=["bucket", "gram", "ids"])


@dataclass
class PhraseIndex:
    """A written index and the columns that it covers."""

    path: str
    id_col: str
    text_cols: list[str]


def build_index(docs: DataFrame, id_col: str, text_cols: list[str], path: str | None = None) -> PhraseIndex:
    """Writes the index of the texts in some columns, null ones without grams; to a new folder of the shared storage if no path is given."""
    spark = docs.sparkSession
    small_batches(spark)
    path = path or shared_folder(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), *[F.col(c).alias(f"text{n}") for n, c in enumerate(text_cols)])
    found = rows.mapInArrow(_grams, f"bucket int, gram long, ids array<{kind}>")
    found.repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/postings")
    counts = spark.read.parquet(f"{path}/postings").groupBy("bucket", "gram").agg(F.sum(F.size("ids")).alias("texts"))
    counts.sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/counts")
    return PhraseIndex(path, id_col, text_cols)


def _has(docs: DataFrame, index: PhraseIndex, phrase: str) -> Column:
    # such a pattern takes ASCII letters alone as equal in either case, and the text needn't be written anew
    pattern = "(?i)" + "".join(c if c.isalnum() or not c.isascii() else "\\" + c for c in phrase)
    found = F.lit(False)
    for c in index.text_cols:
        found = found | F.coalesce(F.col(c).rlike(pattern), F.lit(False))
    return found


def candidate_ids(index: PhraseIndex, docs: DataFrame, phrase: str) -> DataFrame | None:
    """Ids of texts that have the phrase's rarest grams, all that hold the phrase among them; None if it is shorter than a gram."""
    spark = docs.sparkSession
    grams = np.unique(gram_hashes(_folded(phrase), GRAM)).view(np.int64).tolist()
    if not grams:
        return None

    def some(name: str, wanted: list[int]) -> DataFrame:
        rows = spark.read.parquet(f"{index.path}/{name}")
        buckets = sorted({(g >> 40) % BUCKETS for g in wanted})
        return rows.where(F.col("bucket").isin(buckets) & F.col("gram").isin(wanted))

    counts = {row["gram"]: row["texts"] for row in some("counts", grams).select("gram", "texts").collect()}  # one for each of the phrase's grams
    rarest = sorted(grams, key=lambda g: counts.get(g, 0))[:RAREST]
    return some("postings", rarest).select("gram", F.explode("ids").alias("id")).groupBy("id").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(rarest)).select("id")


def containing(index: PhraseIndex, docs: DataFrame, phrase: str, limit: int = 50) -> DataFrame:
    """The `limit` rows of docs with the highest ids whose indexed texts contain the phrase without the white space around it, and at: where the phrase stands in the first of these columns as it is written, 0 if nowhere.

    A blank phrase is nowhere. Texts may be null.
    """
    phrase = phrase.strip()
    if not phrase:
        return docs.where(F.lit(False)).withColumn("at", F.lit(0))
    ids = candidate_ids(index, docs, phrase)
    rows = docs
    if ids is not None:
        some = ids.limit(FEW_TEXTS + 1).collect()
        if len(some) <= FEW_TEXTS:
            rows = docs.where(F.col(index.id_col).isin([row["id"] for row in some]))  # reaches the scan
        else:
            rows = docs.join(ids, docs[index.id_col] == ids["id"], "left_semi")
    found = rows.where(_has(docs, index, phrase)).orderBy(F.desc(index.id_col)).limit(limit)
    return found.withColumn("at", F.greatest(F.lit(0), F.coalesce(F.instr(F.col(index.text_cols[0]), phrase) - 1, F.lit(0))))
