"""Files and directories of documents as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: Endings of files that hold documents.
ENDINGS = r"(?i)\.(md|markdown|txt|html|htm)$"


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """path, title, body and content_sha256 of each text, Markdown or HTML file below a folder, in the order of paths; files without text are left out, bytes that aren't UTF-8 are replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where(F.col("path").rlike(ENDINGS))
    raw = F.make_valid_utf8(F.col("content").cast("string"))
    body = F.when(F.lower("path").rlike(r"\.html?$"), T.html_to_text(raw)).otherwise(T.normal_body(raw))
    title = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return files.select("path", title.alias("title"), body.alias("body")).where("body <> ''").withColumn("content_sha256", T.fingerprint(F.col("body"))).orderBy("path")
