"""Claims and their evidence: finding the same claim, taking in new ones, and what a claim must be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Independent sources that make a claim certain.
MIN_SOURCES = 3
_KEY = ("subject_type", "polarity", "poi_id", "city")


def _same(a: str, b: str) -> Column:
    out = F.lit(True)
    for c in (*_KEY, "form"):
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def same_claims(new: DataFrame, held: DataFrame) -> DataFrame:
    """new_id and claim_id of the first held claim with a new one's subject type, polarity, place, city and text without white space, or null. Both have id, these, and text."""
    form = lambda df: df.withColumn("form", T.squash(F.col("text")))
    firsts = form(held).groupBy(*_KEY, "form").agg(F.min("id").alias("claim_id"))
    return form(new).alias("n").join(firsts.alias("h"), _same("n", "h"), "left").select(F.col("n.id").alias("new_id"), F.col("h.claim_id"))


def materialized(new: DataFrame, held: DataFrame, evidence: DataFrame, groups: DataFrame) -> DataFrame:
    """claim_id, created, documents, sources, sure: every claim after the new ones were taken in.

    new has id, doc_id and a claim's columns; equal new claims are one, which has the smallest id. evidence is
    (claim_id, doc_id), of which a document counts once for a claim; groups (doc_id, group_id) tells which
    documents have one source.
    """
    found = same_claims(new, held.unionByName(new.select(held.columns)))  # a new claim finds itself at last
    old = held.select(F.col("id").alias("claim_id"), F.lit(False).alias("created"))
    born = found.select("claim_id").distinct().join(old.select("claim_id"), "claim_id", "left_anti").withColumn("created", F.lit(True))
    cited = found.join(new.select(F.col("id").alias("new_id"), "doc_id"), "new_id").select("claim_id", "doc_id")
    cited = evidence.select("claim_id", "doc_id").unionByName(cited).distinct().join(groups, "doc_id", "left")
    source = F.coalesce(F.concat(F.lit("g"), F.nullif(F.col("group_id").cast("string"), F.lit(""))), F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    counts = cited.groupBy("claim_id").agg(F.count(F.lit(1)).alias("documents"), F.count_distinct(source).alias("sources"))
    rows = old.unionByName(born).join(counts, "claim_id", "left").fillna(0, ["documents", "sources"])
    return rows.withColumn("sure", F.col("sources") >= MIN_SOURCES)


def broken_subject(subject_type: Column, poi: Column, city: Column, from_poi: Column, to_poi: Column) -> Column:
    """What is wrong with a claim's subject, or null: it is one place, one city, or a route between two different places, and nothing else."""
    there = lambda c: F.coalesce(c, F.lit("")) != ""
    ends = there(from_poi) | there(to_poi)
    return (
        F.when((subject_type == "poi") & (~there(poi) | there(city) | ends), "not_one_place").when((subject_type == "city") & (~there(city) | there(poi) | ends), "not_one_city")
        .when((subject_type == "route") & (~there(from_poi) | ~there(to_poi) | there(poi) | there(city)), "not_one_route").when((subject_type == "route") & (from_poi == to_poi), "route_to_itself")
        .when(~subject_type.isin("poi", "city", "route"), "unknown_type")
    )


def broken_claim(text: Column, quotes: Column, evidence: Column, sources: Column) -> Column:
    """What is wrong with a claim itself, or null: it has text, evidence, as many sources at least as one, and no blank quote."""
    return (
        F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "blank_text").when(F.coalesce(evidence, F.lit(0)) < 1, "no_evidence").when(F.coalesce(sources, F.lit(0)) < 1, "no_source")
        .when(F.exists(quotes, lambda q: F.trim(F.coalesce(q, F.lit(""))) == ""), "blank_quote")
    )
