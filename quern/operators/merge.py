"""Merging a batch of rows into a table by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str, overwrite: tuple[str, ...], fill: tuple[str, ...] = ()) -> DataFrame:
    """Rows of both tables: new values win in `overwrite` columns, and in `fill` columns unless they are null. new has one row per key."""
    fresh = new.select(key, *[F.col(c).alias(f"new_{c}") for c in overwrite + fill], F.lit(True).alias("is_new"))
    joined = old.join(fresh, key, "full")
    columns = [F.when(F.col("is_new"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in overwrite]
    columns += [F.coalesce(f"new_{c}", c).alias(c) for c in fill]
    return joined.select(key, *columns)


def delete_below(rows: DataFrame, gone: DataFrame, parent: str) -> DataFrame:
    """Rows whose parent is not among the deleted ones."""
    return rows.join(gone.select(parent).distinct(), parent, "left_anti")
