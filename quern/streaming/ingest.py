"""Incremental import of documents: each text is stored once, whenever its copies arrive."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T


def import_new(arriving: DataFrame, store: str, checkpoint: str, id_col: str = "doc_id", text_col: str = "text") -> StreamingQuery:
    """Appends the documents of a stream that have new text to the Parquet table `store`.

    In a batch, of equal texts the smallest id stays; texts already stored are left out. Equal
    means without white space. The batch's number names its folder, so a batch that is run again
    overwrites its own rows and no others.
    """

    def append(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        keyed = batch.withColumn("content_sha256", T.fingerprint(F.coalesce(F.col(text_col), F.lit(""))))
        first = keyed.groupBy("content_sha256").agg(F.min_by(F.struct(*batch.columns), F.col(id_col)).alias("row")).select("content_sha256", "row.*")
        try:
            held = spark.read.parquet(store).where(F.col("batch") < number).select("content_sha256")
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):  # nothing stored yet
                raise
        else:
            first = first.join(held, "content_sha256", "left_anti")
        first.write.mode("overwrite").parquet(f"{store}/batch={number}")

    return arriving.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
