"""I-Match document fingerprints, in DataFrame operations only.

Terms are hashed to a fixed number of slots, and slots whose document frequency lies in a chosen
band make the lexicon: a bit for each slot, of the same size for any corpus. A document's distinct
lexicon terms, sorted, are hashed once whole and once for each of several randomised subsets of the
lexicon. The subsets come in levels, each a quarter of the one before, so that some of them hold
one or two terms of a document whether it is short or long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .workspace import materialize

SPLIT = r"[^\p{L}\p{N}]"
SLOTS = 1 << 22
#: Share of the documents that a lexicon term occurs in.
BAND = (0.001, 0.2)
#: Random subsets of each level; five share a hash, of which each has twelve bits.
SEEDS = 10
LEVELS = 6
#: Documents in a range of ids, about, and how often ranges with many more are cut again.
RANGE_DOCS, LEVELS_OF_RANGES = 1000, 4


def term_slots(text: Column) -> Column:
    """The slots of a text's terms, with repeats. What stands between two marks next to each other is a term, too, but far too frequent for a lexicon."""
    return F.transform(F.split(F.lower(text), SPLIT), lambda x: F.xxhash64(x).bitwiseAND(F.lit(SLOTS - 1)))


def lexicon(texts: DataFrame, documents: int, band: tuple[float, float] = BAND) -> Column:
    """A constant array of SLOTS bits, in longs, of the terms in the band. texts has the column `text`."""
    counts = texts.select(F.explode(F.array_distinct(term_slots(F.col("text")))).alias("slot")).groupBy("slot").count()
    inside = counts.where((F.col("count") >= band[0] * documents) & (F.col("count") <= band[1] * documents))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("slot").bitwiseAND(63).cast("int"))
    words = inside.groupBy(F.shiftright("slot", 6).alias("id")).agg(F.bit_or(one).alias("word"))
    bits = [0] * (SLOTS // 64)
    for row in words.collect():  # SLOTS / 64 rows at most
        bits[row["id"]] = row["word"]
    return F.split(F.lit(",".join(map(str, bits))), ",").cast("array<bigint>")


def _in_lexicon(bits: Column):
    def test(slot: Column) -> Column:
        word = F.element_at(bits, (F.shiftright(slot, 6) + 1).cast("int"))
        return F.call_function("shiftright", word, slot.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1

    return test


def _in_subset(seed: int, level: int):
    """The subset of a level and seed: terms whose bits at the seed's place are zero, two for each level."""
    mask = (4**level - 1) << (12 * (seed % 5))
    return lambda term: term.bitwiseAND(F.lit(mask)) == 0


def with_fingerprint(rows: DataFrame, text_col: str, bits: Column, out: str) -> DataFrame:
    """Adds the array `out` of hashes: of all lexicon terms, then of each subset by level and seed; null for a subset that has none of the text's terms."""
    terms = f"{out}_terms"
    rows = rows.withColumn(terms, F.sort_array(F.array_distinct(F.filter(term_slots(F.col(text_col)), _in_lexicon(bits)))))
    bases = {f"{out}_{n}": _hashed(terms, n) for n in range(-(-SEEDS // 5))}
    rows = rows.withColumns(bases)
    every = F.xxhash64(F.sort_array(F.array_distinct(term_slots(F.col(text_col)))), F.lit(1))
    hashed = [F.when(F.size(terms) > 0, F.xxhash64(terms)).otherwise(every)]  # a text without lexicon terms goes by all its terms
    names = []
    for level in range(1, LEVELS + 1):
        added = {}
        for seed in range(SEEDS):
            before = f"{out}_{seed // 5}" if level == 1 else f"{out}_{seed}_{level - 1}"
            added[f"{out}_{seed}_{level}"] = F.filter(before, _in_subset(seed, level))
        rows = rows.withColumns(added)
        names += added
    hashed += [F.when(F.size(x) > 0, F.xxhash64(x)) for x in names]
    return rows.withColumn(out, F.array(*hashed)).drop(terms, *bases, *names)


def _hashed(terms: str, seed: int) -> Column:
    return F.transform(terms, lambda x: F.xxhash64(x, F.lit(seed)))


def printed(hashes: Column) -> Column:
    """A fingerprint as text."""
    return F.array_join(F.transform(hashes, lambda x: F.coalesce(F.lower(F.hex(x)), F.lit(""))), ".")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among those that either document has, from 0 to 1; smaller subsets, which tell more of part of a text, weigh more."""
    weights = F.array(F.lit(1.0), *[F.lit(float(2**level)) for level in range(1, LEVELS + 1) for _ in range(SEEDS)])
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"), weights.alias("w"))
    total = lambda pick: F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + F.when(pick(x), x["w"]).otherwise(0.0))
    return total(lambda x: x["a"] == x["b"]) / total(lambda x: x["a"].isNotNull() | x["b"].isNotNull())


def _position(id_col: Column, kind: str) -> Column:
    """A number in the order of ids: the id itself, or the beginning of a string's bytes. Different ids may have equal ones."""
    if kind == "string":
        return F.conv(F.substring(F.rpad(F.hex(F.encode(id_col, "utf-8")), 14, "0"), 1, 14), 16, 10).cast("double")
    return id_col.cast("double")


def _ranges(docs: DataFrame) -> DataFrame:
    """Adds `range`, which follows the order of doc_id, with RANGE_DOCS documents or a few times more in each, as far as ids differ.

    All ids are cut into ranges of equal width; what holds too many is cut again between its own ends, so
    that ids may crowd anywhere. Null ids are a range of their own.
    """
    at = _position(F.col("doc_id"), docs.schema["doc_id"].dataType.simpleString())
    low, high, count = docs.agg(F.min(at), F.max(at), F.count(F.lit(1))).first()
    width = max((high - low) / -(-count // RANGE_DOCS), 1e-300) if count and low is not None and high > low else 1.0
    place = F.coalesce(F.floor((F.col("at") - (low or 0.0)) / width), F.lit(-1)).cast("long")
    rows, columns = docs.withColumn("at", at).withColumn("range0", place), ["range0"]
    for level in range(1, LEVELS_OF_RANGES):
        spans = rows.groupBy(*columns).agg(F.min("at").alias("low"), F.max("at").alias("high"), F.count(F.lit(1)).alias("n"))
        spans = materialize(spans.where((F.col("n") > 4 * RANGE_DOCS) & (F.col("high") > F.col("low"))))
        if spans.isEmpty():
            break
        cut = spans.select(*columns, "low", ((F.col("high") - F.col("low")) / F.ceil(F.col("n") / RANGE_DOCS)).alias("width"))  # a row for 4 x RANGE_DOCS documents at most
        place = F.coalesce(F.floor((F.col("at") - F.col("low")) / F.col("width")), F.lit(-1)).cast("long")
        rows = rows.join(F.broadcast(cut), columns, "left").withColumn(f"range{level}", place).drop("low", "width")
        columns.append(f"range{level}")
    return rows.withColumn("range", F.struct(*columns) if len(columns) > 1 else F.col("range0")).drop("at", *columns)


def with_next(docs: DataFrame) -> tuple[DataFrame, Window]:
    """Puts each document of (doc_id, text) into a range of ids, with a guest at each range's end: the document that follows its last one in descending order.

    The second value is the window in which lead() gives the next document.
    """
    rows = _ranges(docs).withColumn("digest", F.xxhash64("text"))
    order = [F.desc_nulls_last("doc_id"), "digest"]
    firsts = rows.select("range", "doc_id", "digest").withColumn("n", F.row_number().over(Window.partitionBy("range").orderBy(*order))).where("n = 1").drop("n")
    below = firsts.select("doc_id", "digest", F.lead("range").over(Window.orderBy("range")).alias("to"), F.min("range").over(Window.partitionBy()).alias("first"))  # a row for each range
    below = materialize(below.select(F.col("doc_id").alias("id"), F.col("digest").alias("d"), F.coalesce("to", "first").alias("to")))
    guests = rows.join(F.broadcast(below), rows["doc_id"].eqNullSafe(below["id"]) & (rows["digest"] == below["d"]))  # repeated rows make a guest each, which does no harm
    guests = guests.select("doc_id", "text", F.col("to").alias("range"), "digest", F.lit(True).alias("guest"))
    window = Window.partitionBy("range").orderBy("guest", *order)
    return rows.select("doc_id", "text", "range", "digest", F.lit(False).alias("guest")).unionByName(guests), window


def fingerprints_of_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", band: tuple[float, float] = BAND) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last third replaced by the beginning of the next document
    in descending order of id; the first follows the last, and a sole document itself. A null text
    counts as empty; empty texts have equal fingerprints. Null ids come last, and documents with
    the same id follow one another by the hash of their text. Ids may be of any whole-number type or strings,
    which follow one another by their bytes. An empty table gives an empty result. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bits = lexicon(rows, rows.count(), band)
    placed, window = with_next(rows)
    third = F.floor(F.col("n_chars") / 3).cast("int")
    placed = placed.withColumns({"n_chars": F.length("text").cast("long"), "next_text": F.coalesce(F.lead("text").over(window), F.lit(""))})
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - third).cast("int")), F.substring(F.col("next_text"), F.lit(1), third))
    placed = placed.withColumn("edited", edited).drop("next_text")
    marked = with_fingerprint(with_fingerprint(placed, "text", bits, "own"), "edited", bits, "other")
    marked = marked.withColumn("edited_sha256", F.sha2("edited", 256)).drop("text", "edited").withColumn("next", F.lead("own").over(window))
    return marked.where(~F.col("guest")).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        printed(F.col("own")).alias("fingerprint"),
        printed(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
