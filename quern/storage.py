"""Tables that are written once and read several times, in storage that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir. Where that is unset, a local session gets one of its own; a cluster must set it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/quern-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """The table, written to shared storage and read back: computed once, and nothing to replay if an executor is lost."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows and bytes that one Arrow batch to a Python worker holds at most, so that a batch of long texts stays small.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds this session's Arrow batches, until it ends, by BATCH_ROWS and BATCH_BYTES; smaller settings stay."""
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    size = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")
    if not size.lstrip("-").isdigit() or not 0 < int(size) <= BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")
