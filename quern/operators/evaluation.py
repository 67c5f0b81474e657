"""Compares extracted claims with labels: subjects, facts, one-to-one pairs, and what they amount to.

predictions and golds have doc_id, seq (their order in the document), subject, polarity, poi_id, quote,
char_start and char_end; predictions also text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import names as N
from ..functions import text as T
from ..functions.runs import FACT_RUN, FACT_SHARE, overlap
from ..sources.feeds import is_object, json_objects
from ..storage import saved
from .ordering import numbered

#: Likeness of names from which they are one subject, and documents from which metrics mean something.
SUBJECT_SCORE, READY_DOCS = 0.85, 30


def ranges_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Whether half-open ranges have a place in common; not if an end is unknown."""
    return F.coalesce((a0 < b1) & (b0 < a1), F.lit(False))


def _named(rows: DataFrame) -> DataFrame:
    """Adds name, the subject without white space at either end, empty if it is null, and its stem."""
    return rows.withColumn("name", T.strip(F.coalesce("subject", F.lit("")))).withColumn("stem", N.stem(F.col("name")))


def _same_subject() -> Column:
    """Equal places that are known, or names that a rule finds alike; letters alone never reach the score."""
    poi, gold_poi = F.col("poi_id"), F.col("g_poi_id")
    known = F.coalesce((poi != "") & (poi == gold_poi), F.lit(False))
    named = F.coalesce(F.col("g_subject"), F.lit("")) != ""
    score = N.stripped_score(F.col("name"), F.col("g_name"), F.col("stem"), F.col("g_stem"))
    return known | (named & (F.coalesce(score, F.lit(0.0)) >= SUBJECT_SCORE))


def compared(predictions: DataFrame, golds: DataFrame) -> DataFrame:
    """doc_id, p, g, verdict, agrees, for each prediction and gold of a document: polarity, subject or fact, whichever differs first, or hit.

    A fact is the same if its ranges overlap, or if runs of FACT_RUN characters of the prediction's quote or
    text cover FACT_SHARE of the shorter side. agrees is null if the gold has no place.
    """
    gold = _named(golds).select("doc_id", *[F.col(c).alias(f"g_{c}") for c in ("name", "stem", "seq", "subject", "polarity", "poi_id", "quote", "char_start", "char_end")])
    rows = _named(predictions).join(gold, "doc_id")
    subject = _same_subject()
    ranges = ranges_overlap(F.col("char_start"), F.col("char_end"), F.col("g_char_start"), F.col("g_char_end"))
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    worded = filled("g_quote") & (filled("quote") | filled("text"))
    early = F.when(F.col("polarity") != F.col("g_polarity"), "polarity").when(~subject, "subject").when(ranges, "hit").when(~worded, "fact")
    rows = saved(rows.withColumn("verdict", early).drop("name", "stem", "g_name", "g_stem"))
    open_ = rows.where("verdict IS NULL")
    like = lambda c: F.when(filled(c), F.col(f"{c}_o.coverage") >= FACT_SHARE).otherwise(False)
    worded = open_.withColumn("quote_o", overlap(FACT_RUN)("quote", "g_quote")).withColumn("text_o", overlap(FACT_RUN)("text", "g_quote"))
    worded = worded.withColumn("verdict", F.when(like("quote") | like("text"), "hit").otherwise("fact")).drop("quote_o", "text_o")
    gold_poi = F.nullif(F.col("g_poi_id"), F.lit(""))
    agrees = F.when((F.col("verdict") == "hit") & gold_poi.isNotNull(), F.coalesce(F.col("poi_id") == gold_poi, F.lit(False)))
    return rows.where("verdict IS NOT NULL").unionByName(worded).select("doc_id", F.col("seq").alias("p"), F.col("g_seq").alias("g"), "verdict", agrees.alias("agrees"))


def _greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    doc, taken, used = None, None, set()
    for batch in batches:
        kept = []
        for at, (d, p, g) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(3)))):
            if d != doc:
                doc, taken, used = d, None, set()
            if g != taken and p not in used:
                taken = g
                used.add(p)
                kept.append(at)
        yield batch.take(pa.array(kept, pa.int64()))


def paired(found: DataFrame) -> DataFrame:
    """doc_id, p, g, agrees: golds in their order, each with the first prediction that hits it and is still free. Hits pass in order, so that documents of a few hits cost no more than their rows."""
    hits = found.where("verdict = 'hit'").select(F.col("doc_id"), F.col("p").cast("long"), F.col("g").cast("long"), "agrees")
    hits = hits.repartition("doc_id").sortWithinPartitions("doc_id", "g", "p")
    return hits.mapInArrow(_greedy, f"doc_id {found.schema['doc_id'].dataType.simpleString()}, p long, g long, agrees boolean")


def spurious(predictions: DataFrame, found: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc_id, p, poi_id, reason of predictions without a pair: duplicate if one was a hit, else what the first gold differs in, or no_gold."""
    reasons = found.groupBy("doc_id", F.col("p").cast("long").alias("p")).agg(F.max(F.col("verdict") == "hit").alias("hit"), F.min_by("verdict", "g").alias("first"))
    rest = predictions.select("doc_id", F.col("seq").cast("long").alias("p"), "poi_id").join(pairs.select("doc_id", "p"), ["doc_id", "p"], "left_anti").join(reasons, ["doc_id", "p"], "left")
    return rest.select("doc_id", "p", "poi_id", F.when(F.col("hit").isNull(), "no_gold").when(F.col("hit"), "duplicate").otherwise(F.col("first")).alias("reason"))


def document_scores(predictions: DataFrame, golds: DataFrame, marked: DataFrame | None = None) -> DataFrame:
    """doc_id, gold, predicted, hits, judged, misaligned, unaligned of each document with golds, or of those marked as annotated."""
    found = saved(compared(predictions, golds))
    pairs = saved(paired(found))
    docs = (marked if marked is not None else golds).select("doc_id").distinct()
    counts = lambda rows, *aggs: rows.groupBy("doc_id").agg(*aggs)
    n = F.count(F.lit(1))
    placed = pairs.join(predictions.select("doc_id", F.col("seq").cast("long").alias("p"), "poi_id"), ["doc_id", "p"])
    bare = F.count_if(F.coalesce(F.col("poi_id"), F.lit("")) == "")
    rows = docs.join(counts(golds, n.alias("gold")), "doc_id", "left").join(counts(predictions, n.alias("predicted")), "doc_id", "left")
    rows = rows.join(counts(placed, n.alias("hits"), F.count("agrees").alias("judged"), F.count_if(~F.col("agrees")).alias("misaligned"), bare.alias("a")), "doc_id", "left")
    rows = rows.join(counts(spurious(predictions, found, pairs), bare.alias("b")), "doc_id", "left").fillna(0)
    return rows.select("doc_id", "gold", "predicted", "hits", "judged", "misaligned", (F.col("a") + F.col("b")).alias("unaligned"))


def metrics(scores: DataFrame) -> DataFrame:
    """One row of micro-averaged recall, precision and alignment accuracy, null where nothing was judged, with the documents and whether they suffice."""
    total = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("gold", "predicted", "hits", "judged", "misaligned", "unaligned")]
    rows = scores.agg(F.count(F.lit(1)).alias("documents"), *total)
    ratio = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 6)
    return rows.select(
        "*", ratio(F.col("hits"), F.col("gold")).alias("recall"), ratio(F.col("hits"), F.col("predicted")).alias("precision"),
        ratio(F.col("judged") - F.col("misaligned"), F.col("judged")).alias("alignment"), (F.col("documents") >= READY_DOCS).alias("ready"),
    )


def edited(labels: DataFrame, edits: DataFrame, columns: list[str]) -> DataFrame:
    """labels (label_id and columns) after edits (label_id, gone, columns, and cleared, an array of names): deleted where gone, a column cleared where named, else overwritten where the edit has a value."""
    new = edits.select("label_id", "gone", "cleared", *[F.col(c).alias(f"new_{c}") for c in columns])
    rows = labels.join(new, "label_id", "left").where(~F.coalesce("gone", F.lit(False)))
    value = lambda c: F.when(F.coalesce(F.array_contains("cleared", c), F.lit(False)), F.lit(None)).otherwise(F.coalesce(f"new_{c}", c)).alias(c)
    return rows.select("label_id", *map(value, columns))


#: Fields of a claim in a run's list of accepted ones.
FIELDS = ("subject_name", "polarity", "text", "quote", "subject_type", "facet")


def accepted_items(runs: DataFrame) -> DataFrame:
    """doc_id, pos and the fields of each claim in the accepted list of a document's latest run that went well.

    runs has run_id, doc_id, status, created_at and accepted, a JSON text. A text that is malformed or no list counts as an
    empty list, an element that is no object is left out.
    """
    latest = runs.where("status = 'ok'").groupBy("doc_id").agg(F.max_by("accepted", F.struct("created_at", "run_id")).alias("accepted"))
    rows = json_objects(latest, "accepted").where(is_object(F.col("item")))
    text = lambda name: F.try_variant_get("item", f"$.{name}", "string").alias(name)
    number = lambda name: F.try_variant_get("item", f"$.{name}", "int").alias(name)
    return rows.select("doc_id", "pos", *map(text, FIELDS), number("char_start"), number("char_end"))


def prediction_pool(runs: DataFrame, tasks: DataFrame, evidence: DataFrame, aligned: DataFrame) -> DataFrame:
    """doc_id, pos, the fields, char_start, char_end and poi_id of all that was extracted from each document.

    Documents whose latest run lists nothing have what their tasks, then their evidence hold (doc_id, pos, the fields, char_start, char_end), of
    equal subject, text and place the first. aligned has doc_id, char_start, char_end, quote and poi_id: a claim's place is that
    of its characters, else that of its quote; of several the first id.
    """
    own = accepted_items(runs)
    columns = ["pos", *FIELDS, "char_start", "char_end"]
    old = tasks.select("doc_id", F.lit(0).alias("part"), *columns).unionByName(evidence.select("doc_id", F.lit(1).alias("part"), *columns))
    old = old.join(own.select("doc_id").distinct(), "doc_id", "left_anti")
    first = F.row_number().over(Window.partitionBy("doc_id", "subject_name", "text", "char_start", "char_end").orderBy("part", "pos"))
    old = old.withColumn("n", first).where("n = 1").withColumn("pos", (F.row_number().over(Window.partitionBy("doc_id").orderBy("part", "pos")) - 1).cast("int"))
    rows = own.unionByName(old.select("doc_id", *columns))
    rows = rows.withColumns({c: F.coalesce(c, F.lit(default)) for c, default in zip(FIELDS, ("", "", "", "", "poi", "other"))})
    by_place = aligned.where("char_start IS NOT NULL AND char_end IS NOT NULL").groupBy("doc_id", "char_start", "char_end").agg(F.min("poi_id").alias("by_place"))
    by_quote = aligned.where("quote IS NOT NULL").groupBy("doc_id", "quote").agg(F.min("poi_id").alias("by_quote"))
    rows = rows.join(by_place, ["doc_id", "char_start", "char_end"], "left").join(by_quote, ["doc_id", "quote"], "left")
    return rows.select("doc_id", *columns, F.coalesce("by_place", "by_quote").alias("poi_id"))


def worklist(docs: DataFrame, labels: DataFrame, runs: DataFrame, gold: DataFrame) -> DataFrame:
    """doc_id, labelled, accepted, in_gold, place: every document (doc_id, imported_at) with its labels, the claims that its latest good run accepted, null without one, and its turn: those of the gold set first, then by labels, most first, then as imported."""
    n = labels.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    latest = runs.where("status = 'ok'").groupBy("doc_id").agg(F.max_by("accepted_count", F.struct("created_at", "run_id")).alias("accepted"))
    marked = gold.select("doc_id").distinct().withColumn("marked", F.lit(True))
    rows = docs.join(n, "doc_id", "left").join(latest, "doc_id", "left").join(marked, "doc_id", "left")
    rows = rows.select("doc_id", "imported_at", F.coalesce("n", F.lit(0)).alias("labelled"), "accepted", F.coalesce("marked", F.lit(False)).alias("in_gold"))
    return numbered(rows, [F.desc("in_gold"), F.desc("labelled"), F.col("imported_at"), F.col("doc_id")]).drop("imported_at")
