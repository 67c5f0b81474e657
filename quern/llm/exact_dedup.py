"""Exact de-duplication by a two-pass Bloom filter.

Pass one counts hashes, saturating at two, in a Bloom filter of two bits a slot; pass two keeps
aside each row whose slots were not all hit twice. Such a row has no copy and passes straight
through; only the others are shuffled and grouped. The filter has a fixed largest size. Rows beyond
its capacity are dealt into rounds by their hash, and each round has a filter of its own, so that it
never fills up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .workspace import join_groups, materialize, shared_dir, tidy

#: ASCII white space, which does not count when texts are compared.
SPACES = " \t\n\x0b\x0c\r"
PROBES = 4
BITS_A_ROW = 16
MAX_BITS = 1 << 28
SHARD_BITS = 1 << 20
LANES = 64
#: Slots after which a task sends what it has.
HELD_SLOTS = 1 << 22


def _slots(first: np.ndarray, second: np.ndarray, bits: int) -> np.ndarray:
    steps = second.astype(np.uint64) | np.uint64(1)
    return (first.astype(np.uint64)[:, None] + np.arange(PROBES, dtype=np.uint64) * steps[:, None]) & np.uint64(bits - 1)


def _partial_filters(bits: int):
    """The slots that a part of the rows hits, and those that it hits again, by shard; as numbers, since a part hits few of them."""
    shard_bits = min(bits, SHARD_BITS)

    def counted(held: list[np.ndarray], lane: int) -> pd.DataFrame:
        slot, hits = np.unique(np.concatenate(held), return_counts=True)
        shard = (slot // np.uint64(shard_bits)).astype(np.int64)
        cuts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
        rows = [(n, lane, (x % np.uint64(shard_bits)).astype(np.uint32).tobytes(), (x[h > 1] % np.uint64(shard_bits)).astype(np.uint32).tobytes()) for n, x, h in zip(shard[cuts].tolist(), np.split(slot, cuts[1:]), np.split(hits, cuts[1:]))]
        return pd.DataFrame(rows, columns=["shard", "lane", "once", "twice"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, lane = [], 0
        for batch in batches:
            if len(batch):
                lane = int(batch["h1"].iloc[0]) % LANES
                held.append(_slots(batch["h1"].to_numpy(), batch["h2"].to_numpy(), bits).ravel())
                if sum(map(len, held)) >= HELD_SLOTS:
                    yield counted(held, lane)
                    held = []
        if held:
            yield counted(held, lane)

    return tidy(run)


def _merged_slots(shard_bits: int):
    """A shard's bits of what a lane's parts hit once, and twice in one part or in several."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        once, twice = np.zeros(shard_bits, bool), np.zeros(shard_bits, bool)
        for a, b in zip(group["once"], group["twice"]):
            hit = np.frombuffer(a, np.uint32)
            twice[hit[once[hit]]] = True
            twice[np.frombuffer(b, np.uint32)] = True
            once[hit] = True
        return _shard_row(group, np.packbits(once, bitorder="little"), np.packbits(twice, bitorder="little"))

    return run


def _shard_row(group: pd.DataFrame, once: np.ndarray, twice: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"shard": [int(group["shard"].iloc[0])], "lane": [int(group["lane"].iloc[0])], "once": [once.tobytes()], "twice": [twice.tobytes()]})


def _merged(group: pd.DataFrame) -> pd.DataFrame:
    once = twice = None
    for a, b in zip(group["once"], group["twice"]):
        a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
        once, twice = (a, b) if once is None else (once | a, twice | b | (once & a))
    return _shard_row(group, once, twice)


def repeat_filter(hashes: DataFrame, rows: int, max_bits: int = MAX_BITS) -> bytes:
    """The slots hit at least twice, of a filter of at most max_bits bits over the columns h1 and h2."""
    bits = 1 << 10
    while bits < min(rows * BITS_A_ROW, max_bits):
        bits *= 2
    schema = "shard int, lane int, once binary, twice binary"
    parts = hashes.select("h1", "h2").mapInPandas(_partial_filters(bits), schema)
    by_lane = parts.groupBy("shard", "lane").applyInPandas(_merged_slots(min(bits, SHARD_BITS)), schema)
    shards = by_lane.groupBy("shard").applyInPandas(_merged, schema).select("shard", "twice")
    out = bytearray(bits // 8)
    size = min(bits, SHARD_BITS) // 8
    for row in shards.collect():  # max_bits / 8 bytes at most
        out[row["shard"] * size : (row["shard"] + 1) * size] = row["twice"]
    return bytes(out)


def _with_maybe(hashed: DataFrame, found: Broadcast[bytes]) -> DataFrame:
    """Adds `maybe`: whether all slots of a row were hit twice."""

    @pandas_udf("boolean")
    def maybe_repeated(h1: pd.Series, h2: pd.Series) -> pd.Series:
        twice = np.frombuffer(found.value, np.uint64)
        slots = _slots(h1.to_numpy(), h2.to_numpy(), len(twice) * 64)
        return pd.Series(((twice[(slots >> np.uint64(6)).astype(np.int64)] >> (slots & np.uint64(63))) & np.uint64(1)).all(axis=1))

    return hashed.withColumn("maybe", maybe_repeated("h1", "h2"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they agree without ASCII white space; a null text counts as empty, and
    empty texts equal one another. Of equal texts the one with the most code points stays, then
    the smallest id; a null id comes last and, as rows with the same id can't be told apart, each
    of them is marked like the one that stays. An empty table gives an empty result. Other
    columns are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.sha2(F.translate(text, SPACES, ""), 256).alias("text_sha256"),
            F.length(text).cast("long").alias("n_points"),
        )
    )
    total = rows.count()
    rounds = max(1, -(-total * BITS_A_ROW // max_bits))
    hashed = rows.withColumns({"h1": F.xxhash64("text_sha256"), "h2": F.xxhash64("text_sha256", F.lit(1))})
    if rounds > 1:
        path = shared_dir(spark)
        hashed.withColumn("round", F.pmod(F.xxhash64("h1", F.lit(2)), F.lit(rounds)).cast("int")).write.partitionBy("round").parquet(path)
        table = spark.read.parquet(path)
        parts = [table.where(F.col("round") == n).select(hashed.columns) for n in range(rounds)]
    if rounds > 1:  # each round's filter is given back before the next one is made
        done = shared_dir(spark)
        for n, part in enumerate(parts):
            found = spark.sparkContext.broadcast(repeat_filter(part, -(-total // rounds), max_bits))
            _with_maybe(part, found).drop("h1", "h2").write.parquet(f"{done}/done={n}")
            found.destroy()
        marked = spark.read.parquet(done).drop("done")
    else:
        marked = _with_maybe(hashed, spark.sparkContext.broadcast(repeat_filter(hashed, total, max_bits))).drop("h1", "h2")
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    single = marked.where(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    again = materialize(marked.where("maybe").drop("maybe"))
    order = F.struct(-F.col("n_points"), F.col("doc_id").isNull(), F.col("doc_id"))
    groups = materialize(again.groupBy("text_sha256").agg(F.min_by("doc_id", order).alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    joined = join_groups(again, groups, "text_sha256", "group_size", total)
    return single.unionByName(joined.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(columns))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay by exact_duplicates(), with all their columns; rows that repeat an id stay or go together, and null ids go by the text of the row that stays.

    An empty table stays empty.
    """
    kept = exact_duplicates(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["kept_id"]), "left_semi")
