"""Finds quotes in documents, and checks extracted claims by their quotes.

A quote is found by a gram of its own, taken where a hash decides, so that a document that holds the quote
sends that gram, too, though it sends few: of the longest size of gram of which the quote has a
sampled one, the smallest. A quote that has none at all is found by all grams of its own length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import text as T
from ..functions.runs import gram_hashes
from ..storage import saved, small_batches

#: Characters in a gram, and grams for each that is sent.
SAMPLED = ((12, 16), (6, 4))


def _sample(text: str, size: int, of: int) -> np.ndarray:
    grams = gram_hashes(text, size)
    return np.unique(grams[grams % np.uint64(of) == 0])


def _quote_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The size and hash by which each quote is looked for."""
    for batch in batches:
        sizes, keys = [], []
        for form in batch.column(1).to_pylist():
            found = next(((size, x[0]) for size, of in SAMPLED for x in [_sample(form, size, of)] if len(x)), None)
            size, key = found or (len(form), gram_hashes(form, len(form))[0])
            sizes.append(size)
            keys.append(int(np.uint64(key).astype(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(keys, pa.int64())], names=["quote_id", "size", "key"])


def _document_keys(sampled: list[tuple[int, int]], whole: list[int]):
    """The sizes and hashes by which a document may be found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, body in enumerate(batch.column(1).to_pylist()):
                found = [(size, _sample(body, size, of)) for size, of in sampled] + [(size, np.unique(gram_hashes(body, size))) for size in whole]
                keys = np.concatenate([np.empty(0, np.uint64), *[x for _, x in found]])
                sizes = np.repeat(np.array([n for n, _ in found], np.int32), [len(x) for _, x in found])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(keys), row))), pa.array(sizes), pa.array(keys.view(np.int64))], names=["doc_id", "size", "key"])

    return run


def candidates(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (quote_id, doc_id), among which are all of a quote and a document that contains it. quotes has quote_id and form, docs doc_id and body, in one form; null and empty ones are nowhere."""
    small_batches(docs.sparkSession)
    kinds = (x.schema[c].dataType.simpleString() for x, c in ((quotes, "quote_id"), (docs, "doc_id")))
    quote_kind, doc_kind = kinds
    keyed = saved(quotes.where("form <> ''").select("quote_id", "form").mapInArrow(_quote_keys, f"quote_id {quote_kind}, size int, key long"))
    used = {row["size"] for row in keyed.select("size").distinct().collect()}  # the sampled sizes, and lengths of quotes without a sampled gram, which are short
    sampled = [x for x in SAMPLED if x[0] in used]
    whole = sorted(used - {size for size, _ in SAMPLED})
    sent = docs.where("body <> ''").select("doc_id", "body").mapInArrow(_document_keys(sampled, whole), f"doc_id {doc_kind}, size int, key long")
    return sent.join(keyed, ["size", "key"]).select("quote_id", "doc_id").distinct()


def holders(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (quote_id, doc_id) of quotes (quote_id, form) and documents (doc_id, body) that contain them."""
    both = candidates(quotes, docs).join(quotes.select("quote_id", "form"), "quote_id").join(docs.select("doc_id", "body"), "doc_id")
    return both.where(F.col("body").contains(F.col("form"))).select("quote_id", "doc_id")


@F.pandas_udf(StructType([StructField("char_start", IntegerType()), StructField("char_end", IntegerType())]))
def _loose_places(rows: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """The range in a text of so many characters that count, from the one with this number on; -1 where the text is null."""
    marks = np.array([ord(c) for c in T.LOOSE], np.uint32)
    for bodies, at, size in rows:
        out = np.full((len(bodies), 2), -1, np.int32)
        for row, (body, first, n) in enumerate(zip(bodies, at, size)):
            if body is not None:
                kept = np.flatnonzero(~np.isin(np.frombuffer(body.encode("utf-32-le"), np.uint32), marks))
                out[row] = kept[int(first) - 1], kept[int(first + n) - 2] + 1
        yield pd.DataFrame(out, columns=["char_start", "char_end"])


def located(rows: DataFrame, quote: str, body: str, plain: str) -> DataFrame:
    """The rows without body and plain, with verdict, char_start and char_end: exact, loose, too_short or missing, and the half-open range of characters, -1 where there is none.

    A loose match leaves white space and punctuation out of account; its range is that of the text as it stands. plain is the body without these:
    it is made once for each document, before the join with its quotes. Only texts of loose matches are taken apart.
    """
    small_batches(rows.sparkSession)
    text = T.strip(F.col(quote))
    loose = T.without(text, T.LOOSE)
    verdict = (
        F.when(F.length(text) < T.MIN_QUOTE_CHARS, "too_short").when(F.col(body).contains(text), "exact")
        .when((loose != "") & F.col(plain).contains(loose), "loose").otherwise("missing")
    )
    rest = [c for c in rows.columns if c not in (body, plain)]
    at = F.when(F.col("verdict") == "exact", F.instr(F.col(body), text)).when(F.col("verdict") == "loose", F.instr(F.col(plain), loose))
    found = rows.withColumn("verdict", verdict)
    found = found.select(*rest, "verdict", at.alias("__at"), F.length(text).alias("__chars"), F.length(loose).alias("__size"), F.when(F.col("verdict") == "loose", F.col(body)).alias("__text"))
    found = found.withColumn("__place", _loose_places("__text", "__at", "__size"))
    exact = F.col("verdict") == "exact"
    start = F.when(exact, F.col("__at") - 1).otherwise(F.col("__place.char_start"))
    end = F.when(exact, F.col("__at") - 1 + F.col("__chars")).otherwise(F.col("__place.char_end"))
    return found.select(*rest, "verdict", start.cast("int").alias("char_start"), end.cast("int").alias("char_end"))


def quote_places(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """quote_id, doc_id, verdict, char_start, char_end: every document that holds a quote, exactly or loosely; a quote that none holds has one row without a document.

    quotes has quote_id and quote, docs doc_id and body. A quote of fewer than MIN_QUOTE_CHARS characters is too short.
    """
    asked = quotes.where(F.length(T.strip(F.col("quote"))) >= T.MIN_QUOTE_CHARS)
    form = T.without(T.strip(F.col("quote")), T.LOOSE)
    loose = asked.select("quote_id", form.alias("form"))
    plain = docs.select("doc_id", T.without(F.col("body"), T.LOOSE).alias("body"))
    marks = asked.where(form == "").select("quote_id", T.strip(F.col("quote")).alias("form"))  # nothing but marks: exact or missing
    pairs = candidates(loose, plain)
    if not marks.isEmpty():
        pairs = pairs.unionByName(candidates(marks, docs))
    both = docs.select("doc_id", "body").withColumn("__plain", T.without(F.col("body"), T.LOOSE))
    placed = located(pairs.join(quotes, "quote_id").join(both, "doc_id"), "quote", "body", "__plain").where(usable(F.col("verdict")))
    found = saved(placed.select("quote_id", "doc_id", "verdict", "char_start", "char_end"))
    rest = quotes.join(found.select("quote_id").distinct(), "quote_id", "left_anti")
    none = F.when(F.length(T.strip(F.col("quote"))) < T.MIN_QUOTE_CHARS, "too_short").otherwise("missing")
    return found.unionByName(rest.select("quote_id", F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), none.alias("verdict"), F.lit(-1).alias("char_start"), F.lit(-1).alias("char_end")))


def usable(verdict: Column) -> Column:
    """Whether a quote with this verdict grounds a claim."""
    return verdict.isin("exact", "loose")


def verified(claims: DataFrame, docs: DataFrame) -> DataFrame:
    """The claims (doc_id, quote and others) with verdict, char_start and char_end in the normal body of their own document, and accepted; a missing document accepts none."""
    bodies = docs.select("doc_id", T.normal_body(F.col("text")).alias("__body")).withColumn("__plain", T.without(F.col("__body"), T.LOOSE))
    rows = located(claims.join(bodies, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit("")) for c in ("__body", "__plain")}), "quote", "__body", "__plain")
    return rows.withColumn("accepted", usable(F.col("verdict")))


def verification_counts(checked: DataFrame) -> DataFrame:
    """doc_id, candidates, accepted, loose, dropped and drop_ratio of verified claims; the ratio is null without candidates."""
    n = F.count("verdict")
    return checked.groupBy("doc_id").agg(
        n.alias("candidates"), F.count_if("accepted").alias("accepted"), F.count_if(F.col("verdict") == "loose").alias("loose"),
        F.count_if(~F.col("accepted")).alias("dropped"), F.round(F.count_if(~F.col("accepted")) / F.nullif(n, F.lit(0)), 6).alias("drop_ratio"),
    )


def segments(rows: DataFrame, spans: DataFrame, key: list[str], text: str) -> DataFrame:
    """key, part, piece, covering: each text cut at all ends of its spans, which are clamped to the text, with the sorted ids of the spans that cover each piece.

    spans has the key, span_id, char_start and char_end; empty pieces are left out.
    """
    sized = rows.select(*key, text, F.length(text).alias("n"))
    clamp = lambda c: F.least(F.greatest(F.col(c), F.lit(0)), F.col("n"))
    inside = spans.join(sized.select(*key, "n"), key).select(*key, "span_id", clamp("char_start").alias("a"), clamp("char_end").alias("b")).where("a < b")
    held = inside.groupBy(*key).agg(F.collect_list(F.struct("a", "b", "span_id")).alias("spans"))
    joined = sized.join(held, key, "left").withColumn("spans", F.coalesce("spans", F.array().cast(held.schema["spans"].dataType)))
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0), F.col("n")), F.transform("spans", lambda s: s["a"]), F.transform("spans", lambda s: s["b"]))))
    joined = joined.withColumn("cuts", cuts).where(F.size("cuts") > 1).withColumn("part", F.explode(F.sequence(F.lit(0), F.size("cuts") - 2)))
    a, b = F.col("cuts")[F.col("part")], F.col("cuts")[F.col("part") + 1]
    joined = joined.withColumns({"from": a, "upto": b})
    covering = F.array_sort(F.transform(F.filter("spans", lambda s: (s["a"] <= F.col("from")) & (s["b"] >= F.col("upto"))), lambda s: s["span_id"]))
    return joined.select(*key, "part", F.substring(F.col(text), F.col("from") + 1, F.col("upto") - F.col("from")).alias("piece"), covering.alias("covering"))
