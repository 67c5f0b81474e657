"""Mixes sources to target weights by Pareto order sampling, in DataFrame operations only.

A source whose target is at least its size gives whole copies of every document; what is then
missing comes from a sample of a fixed number of words. Documents are ranked by their random odds
divided by the odds of their inclusion, and taken in that order until the words are reached; the
last one is taken in part. The place where a source's sample ends is found from word counts in
bins of the rank, and inside that one bin by a running sum, so no source is ever sorted whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .workspace import join_groups, materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code point order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: Words in the mix for each word of the input, and the most copies of a source.
SHARE = 1.5
MOST_COPIES = 2
#: Bins of a source's ranks: at least so many, and one for each so many documents.
LEAST_BINS, BIN_DOCS = 1024, 10_000
SEED = 20


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("-"))


def _draw(id_col: Column) -> Column:
    """A number between 0 and 1 that depends on the id alone, so that reruns agree."""
    return (F.pmod(F.xxhash64(id_col.cast("string"), F.lit(SEED)), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def _weight(size: Column) -> Column:
    """Longer documents are less likely, by the root of their length, so that a sample holds more different documents."""
    return 1.0 / F.sqrt(F.greatest(size, F.lit(1)))


def _level(sources: DataFrame, total: float) -> float:
    """The level at which least(most, level x weight) adds up to total; a few aggregates over one row per source."""
    level = 0.0
    while True:
        capped = F.col("most") <= level * F.col("weight")
        held, free = sources.agg(F.sum(F.when(capped, F.col("most")).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("weight")))).first()
        if not free:
            return float("inf")
        raised = (total - held) / free
        if raised <= level:
            return level
        level = raised


def _with_chances(sizes: DataFrame, targets: DataFrame, docs: int) -> DataFrame:
    """Adds to targets `scale`, by which a document's weight is its chance: documents whose chance would be 1 or more are certain, and the others share what is then missing.

    A source's certain documents are its smallest ones, so each round raises their largest size, and ends when it no longer grows.
    """
    missing = F.col("missing").cast("double")
    found = targets.withColumn("scale", F.when(missing > 0, missing / F.greatest(F.col("weighted"), F.lit(1e-9))).otherwise(0.0))
    while True:
        found = materialize(found)
        rows = join_groups(sizes.where("size > 0"), found.where("missing > 0").select("source_key", "source_docs", "scale", "missing"), "source_key", "source_docs", docs)
        certain = F.col("scale") * _weight(F.col("size")) >= 1
        again = rows.groupBy("source_key").agg(
            F.sum(F.when(certain, F.col("size")).otherwise(0)).alias("certain_words"), F.sum(F.when(certain, 0.0).otherwise(_weight(F.col("size")) * F.col("size"))).alias("rest")
        )
        raised = (missing - F.col("certain_words")) / F.col("rest")
        moved = found.join(again, "source_key", "left").withColumn("raised", F.when((F.col("rest") > 0) & (raised > F.col("scale") * (1 + 1e-9)), raised))
        if moved.where("raised IS NOT NULL").isEmpty():
            return found
        found = moved.withColumn("scale", F.coalesce("raised", "scale")).drop("raised", "certain_words", "rest")


def _place(rows: DataFrame) -> DataFrame:
    """Adds the rank of a document in its source's sample: below 0 if it is certain, else from 0 to 1."""
    chance = F.col("scale") * _weight(F.col("size"))
    draw = _draw(F.col("doc_id"))
    odds = (draw / (1 - draw)) / (chance / (1 - chance))
    return rows.withColumn("place", F.when(chance >= 1, draw - 2).when(chance > 0, odds / (1 + odds)).otherwise(1.0))


def plan_mix(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most_copies: int = MOST_COPIES) -> DataFrame:
    """One row per source: its size, target, whole copies, and where its sample ends.

    sizes has doc_id, size and source_key, of which "-" stands for a null source.
    """
    per_source = sizes.groupBy("source_key").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs"), F.sum(_weight(F.col("size")) * F.col("size")).alias("weighted")
    )
    place = F.row_number().over(Window.orderBy(F.col("source_key") == "-", "source_key"))  # one row per source
    sources = materialize(
        per_source.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(place - 1, F.lit(len(weights))) + 1)).withColumn("most", F.col("source_size") * float(most_copies))
    )
    size, docs = sources.agg(F.sum("source_size"), F.sum("source_docs")).first()
    level = _level(sources, share * (size or 0))
    missing = F.round("target").cast("long") - F.col("copies") * F.col("source_size")
    targets = materialize(
        sources.withColumn("target", F.least(F.col("most"), F.lit(level) * F.col("weight")))
        .withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("missing", F.greatest(F.lit(0), missing).cast("long"))
        .drop("weight", "most")
    )
    targets = _with_chances(sizes, targets, docs or 0)
    placed = _place(join_groups(sizes, targets, "source_key", "source_docs", docs or 0)).where((F.col("missing") > 0) & (F.col("size") > 0))
    bins = F.greatest(F.lit(LEAST_BINS), F.ceil(F.col("source_docs") / BIN_DOCS))
    placed = placed.withColumn("bin", F.floor(F.col("place") * bins).cast("long"))
    bins = placed.groupBy("source_key", "source_docs", "missing", "bin").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("source_key").orderBy("bin"))  # a row for each bin of a source
    ends = bins.withColumn("before", upto - F.col("words")).where((F.col("before") < F.col("missing")) & (F.col("before") + F.col("words") >= F.col("missing")))
    ends = materialize(ends.select("source_key", F.col("source_docs").alias("end_docs"), F.col("bin").alias("end_bin"), "before"))
    inside = join_groups(placed, ends, "source_key", "end_docs", docs or 0).where(F.col("bin") == F.col("end_bin"))
    run = F.sum("size").over(Window.partitionBy("source_key").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    last = inside.withColumn("short", F.col("missing") - F.col("before") - (run - F.col("size"))).where((F.col("short") > 0) & (F.col("short") <= F.col("size")))
    last = last.select("source_key", F.struct("place", "doc_id", "size").alias("last"), F.col("short").alias("last_words"))
    return materialize(targets.join(last, "source_key", "left"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken.

    size counts words, 0 for a null or empty text; taken counts the words that the mix takes of
    the document, repeats included: whole copies, and one more, or the first words of one more
    for the document at which the sample ends. A null source is a source of its own, the last.
    Draws depend on the id alone; documents with the same id stand together, ordered by size, and
    rows that also agree in size are treated alike. An empty table gives an empty result. Other
    columns are not read.
    """
    sizes = materialize(docs.select(F.col(id_col).alias("doc_id"), word_count(F.col(text_col)).alias("size"), _source_key(F.col(source_col)).alias("source_key")))
    return take(sizes, plan_mix(sizes, **how)).select("doc_id", "size", "source_size", "target", "taken")


def take(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds to rows with doc_id, size and source_key what the plan takes of each."""
    docs = plan.agg(F.sum("source_docs")).first()[0] or 0
    rows = _place(join_groups(sizes, plan, "source_key", "source_docs", docs))
    here = F.struct("place", "doc_id", "size")
    more = F.when(F.col("missing") == 0, 0).when(F.col("last").isNull() | (here < F.col("last")), F.col("size")).when(here == F.col("last"), F.col("last_words")).otherwise(0)
    return rows.withColumn("taken", (F.col("copies") * F.col("size") + more).cast("long"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself, with the columns of docs, by the rules of mix(): every whole copy is a row, and the document at which a source's sample ends is in if half of it or more is.

    A text without words comes in as many whole copies as its source's others. A null source is one of its own. An empty table stays empty.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), word_count(F.col(text_col)).alias("size"), _source_key(F.col(source_col)).alias("source_key"), F.struct(*docs.columns).alias("row"))
    plan = plan_mix(materialize(rows.drop("row")), **how)
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(F.col("copies")).cast("int")
    return take(rows, plan).withColumn("copy", F.explode(F.array_repeat(F.lit(1), copies))).select("row.*")
