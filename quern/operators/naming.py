"""Names in names, names in texts, and the names most like a mention, all by indexes.

A name holds another only if it has the other's rarest gram, so each name looks for its rarest gram
alone, of half its own characters at least where it has fewer than 48. Names in texts are found all at once, by hashes of their beginnings. The likeness of names comes in two tiers: what
rules decide is found by equal keys, sections and containment; what the letters decide is bounded by the
letters that both have, and only as many pairs are compared as the bounds leave open.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import names as N
from ..functions import text as T
from ..storage import saved, small_batches

#: Characters from which a name may decide by being in another one, characters in grams of names, and names of a frequent gram in one cell.
GRAM, SIZES, CELL = 3, (1, 2, 3, 6, 12, 24), 4096
#: Names, and characters of names, that are looked for in one pass, characters of texts that are searched together, and the base of hashes of their parts.
BLOCK_NAMES, BLOCK_CHARS, SEARCHED_CHARS, BASE = 1_000_000, 10_000_000, 500_000, np.uint64(0x5851F42D4C957F2D)
#: Pairs of a mention that are compared by letters for each place wanted at first, and the growth of that number.
TRIED, GROWTH = 16, 8
#: Least likeness of a candidate: that at which a sole one is still accepted.
LEAST = 0.40


def _grams(name: str, size: int) -> Column:
    """Hashes of the different grams of a name; pairs that they lead to are compared, so equal hashes do no harm."""
    last = F.length(name) - (size - 1)
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.xxhash64(F.substring(F.col(name), i, F.lit(size)))))).otherwise(F.array().cast("array<bigint>"))


def held_names(parts: DataFrame, wholes: DataFrame, least: int = 1) -> DataFrame:
    """Pairs (part, whole) of names, equal ones among them, of which the whole contains the part, of at least so many characters. Both have `name`, null and empty ones are in nothing.

    A part is looked for by grams of the largest size it has, as short ones grow frequent with the number of names. Tables are sent to one another by key: names that
    are small in a file are large when they are read, so none of them may be judged by its file and gathered in the driver.
    """
    parts, wholes = (x.where("name <> ''").select("name").distinct() for x in (parts, wholes))
    size = F.lit(SIZES[0])
    for larger in SIZES[1:]:
        size = F.when(F.length("name") >= larger, larger).otherwise(size)
    parts = saved(parts.where(F.length("name") >= least).withColumn("size", size))
    sizes = sorted(row["size"] for row in parts.select("size").distinct().collect())  # of those in SIZES

    def grams(rows: DataFrame, name: str, size: Column) -> DataFrame:
        each = [F.transform(_grams("name", n), lambda g: F.struct(F.lit(n).alias("size"), g.alias("gram"))) for n in sizes]
        empty = F.array().cast("array<struct<size:int,gram:bigint>>")
        found = F.concat(empty, *[F.when(size == n, x).otherwise(empty) if size is not None else x for n, x in zip(sizes, each)])
        return rows.select(F.col("name").alias(name), F.explode(found).alias("g")).select(name, "g.size", "g.gram")

    held = grams(wholes, "whole", None)
    heat = held.groupBy("size", "gram").agg(F.count(F.lit(1)).alias("heat"))
    own = grams(parts, "part", F.col("size"))
    # a gram that no whole has rules the part out
    rarest = own.join(heat.hint("merge"), ["size", "gram"], "left").groupBy("part", "size").agg(F.min(F.struct(F.coalesce("heat", F.lit(0)).alias("heat"), "gram")).alias("r")).select("part", "size", "r.gram", "r.heat").where("heat > 0")
    rarest = saved(rarest.withColumn("cells", F.ceil(F.col("heat") / CELL).cast("int")))
    asked = rarest.select("part", "size", "gram", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"))
    # only grams that a part is looked for by go on
    dealt = held.join(rarest.select("size", "gram", "cells").distinct().hint("merge"), ["size", "gram"]).select("whole", "size", "gram", F.pmod(F.xxhash64("whole"), F.col("cells")).cast("int").alias("cell"))
    return asked.join(dealt.hint("merge"), ["size", "gram", "cell"]).where(F.col("whole").contains(F.col("part"))).select("part", "whole")


def containing_each_other(names: DataFrame) -> DataFrame:
    """Pairs (id, other) of different ids of which one's name contains the other's. names has id and name."""
    pairs = held_names(names, names)
    both = pairs.select(F.col("part").alias("a"), F.col("whole").alias("b")).union(pairs.select("whole", "part")).distinct()
    own = names.select(F.col("id"), F.col("name").alias("a"))
    return own.join(both.hint("merge"), "a").join(names.select(F.col("id").alias("other"), F.col("name").alias("b")).hint("merge"), "b").where("id <> other").select("id", "other")


def _at(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Places of hashes in a table of bits, whose size is a power of two."""
    return (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (8 * len(bits)).bit_length() + 1)


def _bits(h: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << max(3, (2 * len(h)).bit_length()), np.uint8)  # 16 bits or more for each hash
    at = _at(h, bits)
    np.bitwise_or.at(bits, at >> np.uint64(3), np.left_shift(1, at & np.uint64(7)).astype(np.uint8))
    return bits


def _may(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = _at(h, bits)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _levels(names: list[str]):
    """The names, longest first, their sizes, characters and where these begin, for each number of characters: bits of the beginnings of longer names, bits, hashes and numbers of the names of this length, and the names' places in order."""
    names = sorted(names, key=len, reverse=True)
    sizes = np.array([len(n) for n in names], np.int64)
    codes, first = _codes("".join(names)), np.cumsum(sizes) - sizes
    h, levels = np.zeros(len(names), np.uint64), []
    for size in range(1, int(sizes[0]) + 1):
        n, longer = (int(np.searchsorted(-sizes, -x, "right")) for x in (size, size + 1))
        h = h[:n] * BASE + codes[first[:n] + size - 1]
        order = longer + np.argsort(h[longer:])
        more = _bits(np.unique(h[:longer])) if size >= 4 else None  # most texts have all beginnings that are shorter
        levels.append((more, _bits(h[order]) if len(order) else None, h[order], order))
    place = np.empty(len(names), np.int64)
    place[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
    return pa.array(names, pa.string()), sizes, codes, first, levels, place


def _occurrences(codes: np.ndarray, known) -> tuple[np.ndarray, np.ndarray]:
    """The places in a text at which names stand, and the numbers of these: all places go on together, a character at a time, while a name may begin there."""
    own, first, levels = known[2:5]
    places, numbers = [], []
    at, h = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
    for size, (more, ends, hashes, order) in enumerate(levels, 1):
        n = int(np.searchsorted(at, len(codes) - size, "right"))
        at, h = at[:n], h[:n]
        if not n:
            break
        h = h * BASE + codes[at + (size - 1)]
        if ends is not None:
            some = np.flatnonzero(_may(h, ends))
            met = np.searchsorted(hashes, h[some])
            same = hashes[np.minimum(met, len(hashes) - 1)] == h[some]
            place, number = at[some[same]], order[met[same]]
            for i in range(size):
                same = codes[place + i] == own[first[number] + i]
                place, number = place[same], number[same]
            places.append(place)
            numbers.append(number)
        if more is not None:
            going = _may(h, more)
            at, h = at[going], h[going]
    empty = np.empty(0, np.int64)
    return np.concatenate([empty, *places]), np.concatenate([empty, *numbers])


def _counted(texts: list[str], known) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, number of the name, and count. Texts are searched as one, with a mark between them that no name has."""
    names, sizes = known[:2]
    lengths = np.array([len(t) + 1 for t in texts])
    mark = np.array([0x110000], np.uint32)
    places, numbers = _occurrences(np.concatenate([x for t in texts for x in (_codes(t), mark)]), known)
    rows = np.searchsorted(np.cumsum(lengths), places, "right")
    key = rows * len(names) + numbers
    order = np.lexsort((places, key))
    key, places = key[order], places[order]
    found, counts = np.unique(key, return_counts=True)
    overlap = (key[1:] == key[:-1]) & (np.diff(places) < sizes[key[1:] % len(names)])
    for k in np.unique(key[1:][overlap]):
        counts[np.searchsorted(found, k)] = texts[k // len(names)].count(names[int(k % len(names))].as_py())
    return found // len(names), found % len(names), counts


def _counter(packed, best: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = packed.value
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            part = np.cumsum([len(t) for t in texts]) // SEARCHED_CHARS
            for n in np.unique(part):
                own = np.flatnonzero(part == n)
                rows, numbers, counts = _counted([texts[i] for i in own], known)
                if best:
                    order = np.lexsort((known[5][numbers], -counts, rows))
                    order = order[np.unique(rows[order], return_index=True)[1]]
                    rows, numbers, counts = rows[order], numbers[order], counts[order]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own[rows])), known[0].take(pa.array(numbers)), pa.array(counts, pa.int64())], names=["id", "name", "n"])

    return run


def names_in_texts(texts: DataFrame, names: DataFrame, best: bool = False) -> DataFrame:
    """id, name, n: how often each name occurs in each text, occurrences that overlap counted once, from the left; those that occur. texts has id and text, names name.

    Empty and null names are nowhere. With best, only the most frequent name of each pass is given for a text, of equals the first in order. Names are taken in blocks of bounded size, each with a pass over the texts.
    """
    spark = texts.sparkSession
    small_batches(spark)
    known = saved(names.where("name <> ''").select("name").distinct())
    count, chars = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("name")), F.lit(0))).first()
    blocks = max(1, -(-count // BLOCK_NAMES), -(-chars // BLOCK_CHARS))
    kind = texts.schema["id"].dataType.simpleString()
    out = None
    for block in range(blocks):
        own = [row["name"] for row in known.where(F.pmod(F.xxhash64("name"), F.lit(blocks)) == block).toLocalIterator()]
        if not own:
            continue
        found = texts.select("id", "text").mapInArrow(_counter(spark.sparkContext.broadcast(_levels(own)), best), f"id {kind}, name string, n long")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], f"id {kind}, name string, n long")


def most_named(texts: DataFrame, names: DataFrame) -> DataFrame:
    """id, name, n: the name that occurs most often in each text, of equals the first in order; texts that have none are left out."""
    best = F.min_by(F.struct("name", "n"), F.struct(-F.col("n"), "name")).alias("best")
    return names_in_texts(texts, names, best=True).groupBy("id").agg(best).select("id", "best.name", "best.n")


def _sections(name: Column) -> Column:
    """What stands in a name between a separator and another one, or the end."""
    marks = "".join(sorted(N.SEPARATORS))
    places = F.filter(F.transform(F.split(name, ""), lambda c, i: F.when((c != "") & F.lit(marks).contains(c), i + 1)), lambda i: i.isNotNull())
    ends = F.concat(places, F.array(F.length(name) + 1))
    cut = lambda a: F.transform(F.filter(ends, lambda b: b > a + 1), lambda b: F.substring(name, a + 1, b - a - 1))
    return F.array_distinct(F.flatten(F.transform(places, cut)))


def _pairs_by_rules(asked: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs (a, b) of names that a rule may decide; asked has a, known b."""
    keys = lambda x: F.array(F.concat(F.lit("f"), F.translate(x, *N.BRACKETS)), F.concat(F.lit("s"), N.stem(x)))
    equal = asked.select("a", F.explode(keys(F.col("a"))).alias("key")).join(known.select("b", F.explode(keys(F.col("b"))).alias("key")), "key").select("a", "b")
    ahead = asked.select("a", F.explode(_sections(F.col("a"))).alias("b")).join(known, "b").select("a", "b")
    behind = known.select("b", F.explode(_sections(F.col("b"))).alias("a")).join(asked, "a").select("a", "b")
    mentions, places = asked.select(F.col("a").alias("name")), known.select(F.col("b").alias("name"))
    inside = held_names(mentions, places, GRAM).select(F.col("part").alias("a"), F.col("whole").alias("b"))
    around = held_names(places, mentions, GRAM).select(F.col("whole").alias("a"), F.col("part").alias("b"))
    return equal.union(ahead).union(behind).union(inside).union(around).distinct()


def _letters(rows: DataFrame, name: str) -> DataFrame:
    """name and t: each character with its number among the equal ones before it, so that names share as many t as characters."""
    counted = rows.select(name, F.explode(F.filter(F.split(name, ""), lambda c: c != "")).alias("c")).groupBy(name, "c").agg(F.count(F.lit(1)).alias("k"))
    return counted.select(name, F.explode(F.transform(F.sequence(F.lit(1), F.col("k").cast("int")), lambda i: F.concat("c", i.cast("string")))).alias("t"))


def _pairs_by_letters(asked: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """a, b, bound: pairs of names that may be alike by `least` or more by their letters, and how much at most.

    Likeness is 1.6 m / (|a| + |b|) for m characters in matching runs, of which there are no more than both have. A name needs
    the share r = least / 1.6 of both lengths, so at least r / (1 - r) of its own characters, and pairs
    that share enough meet in the rarer ones.
    """
    share = least / 1.6
    own, other = saved(_letters(asked, "a")), saved(_letters(known, "b"))
    heat = own.select("t").unionByName(other.select("t")).groupBy("t").agg(F.count(F.lit(1)).alias("heat"))

    def rare(rows: DataFrame, name: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(name).orderBy("heat", "t"))
        must = F.ceil(F.length(name) * (share / (1 - share)) - 1e-9)
        return rows.join(heat, "t").withColumn("place", place).where(F.col("place") <= F.length(name) - must + 1).select(name, "t")

    met = rare(own, "a").join(rare(other, "b"), "t").select("a", "b").distinct()
    near = lambda x, y: F.length(x) >= F.length(y) * (share / (1 - share)) - 1e-9
    met = met.where(near("a", "b") & near("b", "a"))
    both = met.join(own, "a").join(other, ["b", "t"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("m"))
    bound = F.round(1.6 * F.col("m") / (F.length("a") + F.length("b")), 4)
    return both.withColumn("bound", bound).where(F.col("bound") >= least).select("a", "b", "bound")


def most_alike(mentions: DataFrame, places: DataFrame, k: int = 10, least: float = LEAST) -> DataFrame:
    """mention_id, rank, place_id, name, score: the k places of each mention whose names are most like it, by name score, equal ones by place_id, of those with a score of `least` or more.

    mentions has mention_id and mention, places place_id and name, both ids unique. Blank and null names are like none. The table of
    places is an index of its own keys and grams: no mention is compared with all.
    """
    asked = saved(mentions.select("mention_id", T.strip(F.col("mention")).alias("a")).where("a <> ''"))
    known = saved(places.select("place_id", "name", T.strip(F.col("name")).alias("b")).where("b <> ''"))
    a, b = asked.select("a").distinct(), known.select("b").distinct()
    score = N.stripped_score(F.col("a"), F.col("b"), N.stem(F.col("a")), N.stem(F.col("b")))
    found = saved(_pairs_by_rules(a, b).withColumn("score", score).where(F.col("score") >= least))
    left = None
    if least <= 0.8:  # letters alone give no more than that
        sizes = known.groupBy("b").agg(F.count(F.lit(1)).alias("places"))
        enough = found.join(sizes, "b").groupBy("a").agg(F.sum("places").alias("places")).where(F.col("places") >= k)
        left = saved(a.join(enough, "a", "left_anti"))  # rules score more than letters ever do
    if left is not None and not left.isEmpty():
        open_ = _pairs_by_letters(left, b, least).join(found.select("a", "b"), ["a", "b"], "left_anti")
        order = Window.partitionBy("a").orderBy(F.desc("bound"), "b")
        open_ = saved(open_.withColumns({"place": F.row_number().over(order), "next": F.lead("bound").over(order)}))
        low, high = 0, TRIED * k
        while True:
            part = open_.where((F.col("place") > low) & (F.col("place") <= high))
            if part.isEmpty():
                break
            scored = saved(part.withColumn("score", N.letter_score("a", "b")))
            found = saved(found.unionByName(scored.where(F.col("score") >= least).select("a", "b", "score")))
            # done are those whose k-th score no bound ahead can reach
            kth = found.join(left, "a", "left_semi").withColumn("n", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b"))).where(F.col("n") == k).select("a", F.col("score").alias("kth"))
            ahead = scored.where(F.col("place") == high).select("a", "next").where("next IS NOT NULL").join(kth, "a", "left").where("kth IS NULL OR next >= kth").select("a")
            open_ = saved(open_.join(ahead, "a", "left_semi"))
            low, high = high, high * GROWTH
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "place_id"))
    best = found.join(known, "b").withColumn("rank", rank).where(F.col("rank") <= k)  # the same for all mentions of one name
    return asked.join(best, "a").select("mention_id", "rank", "place_id", "name", "score")
