"""Merging rows that stand for one place, over all tables that refer to places.

A catalogue names the columns that hold place ids, by table. Of places with one name one stays; what refers
to the others refers to it afterwards, through chains of merges too, and what it lacks is filled from them.
Every step is a plan over whole tables, so a merge is whole or doesn't happen: nothing is
changed where it stands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import saved
from .reposts import roots_of

#: Columns of a place that are filled from the places merged into it, and how ids of the map service begin.
FILLED = ("address", "typecode", "type_name", "rating", "open_time", "photo_url", "raw")
SERVICE_ID = "B"

#: Columns that hold place ids, by table.
Catalogue = dict[str, list[str]]


def reference_counts(tables: dict[str, DataFrame], catalogue: Catalogue) -> DataFrame:
    """poi_id, reference ("table.column") and n: how many rows of each column refer to each place; those that any does."""
    out = None
    for table, columns in catalogue.items():
        for column in columns:
            rows = tables[table].where(F.col(column).isNotNull()).groupBy(F.col(column).alias("poi_id")).agg(F.count(F.lit(1)).alias("n"))
            rows = rows.select("poi_id", F.lit(f"{table}.{column}").alias("reference"), "n")
            out = rows if out is None else out.unionByName(rows)
    return out


def duplicates(poi: DataFrame, counts: DataFrame) -> DataFrame:
    """name, poi_id, references, survivor_id: places of which another one has the same name, and which of them stays.

    One that was looked up stays, then one with an id of the service, the one with most references, and the first
    id. poi has poi_id, name and typecode, counts are those of reference_counts(). Null names are no one's.
    """
    total = counts.groupBy("poi_id").agg(F.sum("n").alias("references"))
    rows = poi.where("name IS NOT NULL").select("poi_id", "name", "typecode").join(total, "poi_id", "left").withColumn("references", F.coalesce("references", F.lit(0)))
    better = F.struct(F.trim(F.coalesce("typecode", F.lit(""))) == "", ~F.col("poi_id").startswith(SERVICE_ID), -F.col("references"), F.col("poi_id"))
    kept = rows.groupBy("name").agg(F.min_by("poi_id", better).alias("survivor_id"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    return rows.join(kept, "name").select("name", "poi_id", "references", "survivor_id")


def remap(found: DataFrame) -> DataFrame:
    """old_id and new_id of every place that is merged away, through chains of merges to the one that stays. found has poi_id and survivor_id."""
    steps = found.where("poi_id <> survivor_id").select(F.col("poi_id").alias("id"), F.col("survivor_id").alias("parent"))
    return roots_of(steps).select(F.col("id").alias("old_id"), F.col("root").alias("new_id")).where("old_id <> new_id")


def repointed(rows: DataFrame, columns: list[str], moves: DataFrame) -> DataFrame:
    """The rows of a table with the given columns led to the places that stay, and moved: an array that tells of each column whether it was."""
    names, flags = rows.columns, []
    for n, column in enumerate(columns):
        step = moves.select(F.col("old_id").alias(f"__old{n}"), F.col("new_id").alias(f"__new{n}"))
        rows = rows.join(step, rows[column] == step[f"__old{n}"], "left")
        flags.append(F.col(f"__new{n}").isNotNull())
        rows = rows.withColumn(column, F.coalesce(f"__new{n}", column))
    return rows.select(*names, F.array(*flags).alias("moved"))


def merged_places(poi: DataFrame, moves: DataFrame, parent: str = "parent_id", filled: tuple[str, ...] = FILLED) -> DataFrame:
    """The places that stay, their parents among them or null where one would be its own, and what they lack from those merged into them, the first id first."""
    gone = poi.join(moves, poi["poi_id"] == moves["old_id"])
    gifts = gone.groupBy(F.col("new_id").alias("__id")).agg(*[F.min(F.when(F.col(c).isNotNull(), F.struct("poi_id", c)))[c].alias(f"__{c}") for c in filled])
    stay = poi.join(moves.select(F.col("old_id").alias("poi_id")), "poi_id", "left_anti")
    stay = repointed(stay, [parent], moves).drop("moved").join(gifts, F.col("poi_id") == F.col("__id"), "left")
    stay = stay.withColumn(parent, F.when(F.col(parent) != F.col("poi_id"), F.col(parent)))
    return stay.withColumns({c: F.coalesce(c, f"__{c}") for c in filled}).select(*poi.columns)


def merge_report(tables: dict[str, DataFrame], catalogue: Catalogue, moves: DataFrame) -> DataFrame:
    """reference and rows: how many rows of each column a merge changes, and how many places go, as "merged"."""
    counts = reference_counts(tables, catalogue).join(moves.select(F.col("old_id").alias("poi_id")), "poi_id", "left_semi")
    report = counts.groupBy("reference").agg(F.sum("n").alias("rows"))
    return report.unionByName(moves.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("merged").alias("reference"), "rows"))


def merge_all(poi: DataFrame, tables: dict[str, DataFrame], catalogue: Catalogue) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """The places, the other tables and the report after all places of one name were merged. catalogue has the column of parents as that of `poi`."""
    every = {**tables, "poi": poi}
    moves = saved(remap(duplicates(poi, reference_counts(every, catalogue))))
    places = merged_places(poi, moves, *catalogue.get("poi", []))
    done = {name: repointed(rows, catalogue[name], moves).drop("moved") if name in catalogue else rows for name, rows in tables.items()}
    return places, done, merge_report(every, catalogue, moves)

