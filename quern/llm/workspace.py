"""Shared storage for intermediate tables, joins that stay even under hot keys, and bounds on what Python workers hold."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with at least 1/HEAVY_SHARE of all rows counts as heavy, so there are at most HEAVY_SHARE such keys.
HEAVY_SHARE = 1000
#: Tables of one row per key with at most so many rows are broadcast whole.
SMALL_ROWS = 10_000
#: Rows and bytes that one Arrow batch to a Python worker holds at most, so that a batch of long texts stays small.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def small_batches(spark: SparkSession) -> None:
    """Bounds this session's Arrow batches by BATCH_ROWS and BATCH_BYTES; smaller settings stay."""
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    size = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    size = int(size.rstrip("b")) if size.rstrip("b").lstrip("-").isdigit() else -1
    if size <= 0 or size > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")


def give_back() -> None:
    """Returns what this Python worker has freed to the system, as it may wait beside others for its next task."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def tidy(run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A function of batches that gives memory back when it ends."""

    @functools.wraps(run)
    def tidied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from run(batches)
        give_back()

    return tidied


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one machine, and so share its folders."""
    return spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"


def shared_dir(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir, which all executors share. Where it is unset, a local session gets one of its own; a cluster must set it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/quern-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Writes a table to shared storage and reads it back: computed once, and no lineage to replay if an executor is lost."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, weight: str, total: int, keys: int | None = None) -> DataFrame:
    """Joins rows to a table with one row for each key, whose column `weight` is the key's number of rows.

    A table of at most SMALL_ROWS keys is broadcast; `keys` is their number, if it is known. Else heavy keys are: at most HEAVY_SHARE keys can each hold 1/HEAVY_SHARE of `total`
    rows. All others are joined by a shuffle in which no key can be hot.
    """
    if (groups.limit(SMALL_ROWS + 1).count() if keys is None else keys) <= SMALL_ROWS:
        return rows.join(F.broadcast(groups), key)
    heavy = F.col(weight) * HEAVY_SHARE >= total
    hot, rest = groups.where(heavy), groups.where(~heavy)
    at_hot = rows.join(F.broadcast(hot), key)
    elsewhere = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key)
    return at_hot.unionByName(elsewhere)
