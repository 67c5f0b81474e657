"""Connected components of a link table, by rounds of large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import join_groups, materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def _with_least(edges: DataFrame) -> DataFrame:
    """Adds the smallest neighbour of a."""
    least = materialize(edges.groupBy("a").agg(F.min("b").alias("least"), F.count(F.lit(1)).alias("degree")))
    total, nodes = least.agg(F.sum("degree"), F.count(F.lit(1))).first()
    return join_groups(edges, least, "a", "degree", total or 0, nodes)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    found = _with_least(both).where(F.col("b") > F.col("a"))
    return found.select(F.col("b").alias("a"), F.least("a", "least").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges go from the larger to the smaller end."""
    found = _with_least(edges)
    moved = found.where(F.col("b") != F.col("least")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    kept = found.where(F.col("b") == F.col("least")).select("a", "b")
    return moved.unionByName(kept).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component for each end of the links (a, b): the smallest node that can be reached.

    Repeated links, links in both directions and links of a node to itself do no harm; links with
    a null end count for nothing. Every round writes its links to shared storage, so a lost
    executor costs one round at most.
    """
    edges = materialize(
        edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    state = _state(edges)
    while state[0]:
        edges = materialize(_small_star(materialize(_large_star(edges))))
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
