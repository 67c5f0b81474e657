"""Line de-duplication with a segment-partition edit join.

A line goes if an equal line, or one within a few edits, occurs earlier in the corpus. For edits,
a line is cut into one segment more than edits are allowed, so that lines within the threshold
share a segment; each line's segments are indexed by length, place and content, and each line
probes the lengths at or below its own with those substrings that a match must have. Candidates
are verified by banded bit-parallel edit distance, many pairs side by side. A key that very many lines
have is dealt out over cells of index and probe lines; a cell has the lines themselves, and ends its
search for a line with the first one that decides that it goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import join_groups, materialize, small_batches, tidy

#: Edits allowed, and code points from which lines take part: in the exact comparison (blank lines never do), and in that with so many edits, or with one.
EDITS = 2
MIN_CHARS = 1
MIN_EDIT_CHARS = 40
MIN_ONE_EDIT_CHARS = 20
#: Characters whose substrings are hashed at once.
CHUNK = 1 << 19
#: Lines whose keys a task sends at once, keys in a bucket on average, buckets at most, and pairs made at once.
SEND_LINES, BUCKET_KEYS, MOST_BUCKETS, PAIRS_AT_ONCE = 1 << 15, 1 << 20, 1 << 14, 1 << 20
#: A key counts as hot from so many lines, if HOT_HERE or more of one sending have it, but at most MOST_HOT keys do; and lines on each side of a cell.
#: One document in HOT_SHARE, by a hash of its id, tells which keys are hot. That decides how lines meet, not which do.
HOT_LINES, HOT_HERE, MOST_HOT, CELL_LINES, HOT_SHARE = 4096, 8, 50_000, 4096, 8
#: Line ids, and documents with lines that go, up to this number are broadcast.
FEW_LINES, FEW_DOCS = 200_000, 200_000

_P = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def allowed(length: int) -> int:
    """Edits within which a line goes, by the length of the shorter of two."""
    return EDITS if length >= MIN_EDIT_CHARS else min(1, EDITS) if length >= MIN_ONE_EDIT_CHARS else 0


def segments(length: int, edits: int = EDITS) -> list[tuple[int, int]]:
    """Start and length of the segments of a line."""
    count = edits + 1
    short, longer = divmod(length, count)
    sizes = [short + (n >= count - longer) for n in range(count)]
    starts = np.cumsum([0, *sizes[:-1]]).tolist()
    return list(zip(starts, sizes))


def probes(length: int, edits: int = EDITS) -> list[tuple[int, int, int, int]]:
    """(indexed length, segment, start, size) of the substrings by which a line looks for lines of its own length or less."""
    out = []
    for other in range(max(0, length - edits), length + 1):
        more = length - other
        for n, (start, size) in enumerate(segments(other, edits)):
            low = max(start - n, start + more - (edits - n), 0)
            high = min(start + n, start + more + (edits - n), length - size)
            out += [(other, n, at, size) for at in range(low, high + 1)]
    return out


class _Powers:
    """Powers of the hash's base and of its inverse."""

    def __init__(self, size: int):
        self.up = np.cumprod(np.full(size, _P, np.uint64))
        self.down = np.cumprod(np.full(size, pow(_P, -1, 1 << 64), np.uint64))


_powers: list[_Powers] = []
_plans: dict[int, np.ndarray] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def _plan(length: int) -> np.ndarray:
    """Rows (is probe, indexed length, segment, start, size) of a line's keys."""
    if length not in _plans:
        if len(_plans) > 20_000:
            _plans.clear()
        index = [(0, length, n, a, b) for n, (a, b) in enumerate(segments(length, allowed(length)))]
        found = [x for edits in {allowed(length), allowed(length - EDITS)} - {0} for x in probes(length, edits) if allowed(x[0]) == edits]
        _plans[length] = np.array(index + [(1, *x) for x in found], np.int64)
    return _plans[length]


def line_keys(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the lines' segments and probes: line number, whether it is a probe, and the key; and the sketch of each line.

    A sketch has the counts, up to sixteen, of characters in sixteen classes.
    """
    if not _powers:
        _powers.append(_Powers(CHUNK))
    chars = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32).astype(np.uint64)
    powers = _powers[0] if len(chars) < CHUNK else _Powers(len(chars) + 1)
    sums = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum((chars + np.uint64(1)) * powers.up[: len(chars)], out=sums[1:])
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    plans = [_plan(x) for x in lengths.tolist()]
    each = np.fromiter(map(len, plans), np.int64, len(plans))
    number = np.repeat(np.arange(len(lines)), each)
    plan = np.concatenate(plans)
    start = (np.cumsum(lengths) - lengths)[number] + plan[:, 3]
    found = (sums[start + plan[:, 4]] - sums[start]) * powers.down[start]
    kinds = (_mixed(chars) & np.uint64(15)).astype(np.int64) + np.repeat(16 * np.arange(len(lines)), lengths)
    counts = np.bincount(kinds, minlength=16 * len(lines)).reshape(-1, 16).astype(np.uint64) & np.uint64(15)
    sketch = np.bitwise_or.reduce(counts << np.arange(0, 64, 4, dtype=np.uint64), axis=1)
    return number, plan[:, 0].astype(bool), _mixed(found ^ _mixed((plan[:, 1] * (EDITS + 1) + plan[:, 2]).astype(np.uint64))), sketch


def _may_be_near(a: np.ndarray, b: np.ndarray, edits: int) -> np.ndarray:
    """Whether sketches allow for so few edits: each changes two counts at most."""
    total = np.zeros(len(a), np.int64)
    for place in range(0, 64, 4):
        differ = ((a >> np.uint64(place)) - (b >> np.uint64(place))) & np.uint64(15)
        total += np.minimum(differ, np.uint64(16) - differ).astype(np.int64)
    return total <= 2 * edits


def edit_distances(left: list[str], right: list[str], edits: int = EDITS) -> np.ndarray:
    """Edit distance of each pair, exact up to `edits` and above it beyond, by bit vectors over the band of diagonals."""
    if not left:
        return np.empty(0, np.int64)
    m, n = np.fromiter(map(len, left), np.int64, len(left)), np.fromiter(map(len, right), np.int64, len(right))
    far = np.abs(m - n) > edits
    band, wide = 2 * edits + 1, np.uint64((1 << (2 * edits + 1)) - 1)
    one = np.uint64(1)
    rows = np.zeros((len(left), int(m.max()) + 2 * edits + int(n.max()) + 2), np.uint32)  # row i of the pattern is at i - 1 + edits
    cols = np.zeros((len(left), int(n.max()) + 1), np.uint32)
    for k, (a, b) in enumerate(zip(left, right)):
        rows[k, edits : edits + len(a)] = np.frombuffer(a.encode("utf-32-le"), np.uint32) + 1
        cols[k, : len(b)] = np.frombuffer(b.encode("utf-32-le"), np.uint32) + 1
    diagonal = np.where(far, 0, m - n)
    at = (diagonal + edits).astype(np.uint64)
    plus = np.full(len(left), int(wide) & ~((1 << edits) - 1), np.uint64)
    minus = np.zeros(len(left), np.uint64)
    score = np.abs(diagonal)
    for j in range(1, int(n.max()) + 1):
        char = cols[:, j - 1]
        same = np.zeros(len(left), np.uint64)
        for b in range(band):
            same |= (rows[:, j - 1 + b] == char).astype(np.uint64) << np.uint64(b)
        down = ((((same & plus) + plus) ^ plus) | same | minus) & wide
        right_plus = (minus | ~(down | plus)) & wide
        right_minus = down & plus
        counts = (j <= n) & (j > np.maximum(0, -diagonal))
        score += counts & (((down >> at) & one) == 0)
        plus = (right_minus | ~((down >> one) | right_plus)) & wide
        minus = (down >> one) & right_plus
    return np.where(far, edits + 1, score)


def _sendings(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple[list[str], list[int]]]]:
    """The different lines of a task with their names, SEND_LINES of them at a time, in lists of CHUNK characters about."""
    seen: set[tuple[int, int]] = set()  # names may meet by chance; with this process's own hash they don't
    held, lines, names, size, count = [], [], [], 0, 0
    for batch in batches:
        for line, name in zip(batch["line"], batch["h"]):
            same = name, hash(line)
            if same in seen:
                continue
            seen.add(same)
            if lines and size + len(line) >= CHUNK:
                held.append((lines, names))
                lines, names, size = [], [], 0
            lines.append(line)
            names.append(name)
            size, count = size + len(line), count + 1
            if count >= SEND_LINES:
                yield [*held, (lines, names)]
                held, lines, names, size, count = [], [], [], 0, 0
                seen.clear()
    if lines:
        held.append((lines, names))
    if held:
        yield held


def _counted_keys(least: int):
    """Keys that so many lines of one sending have, and how many do."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for held in _sendings(batches):
            key, count = np.unique(np.concatenate([line_keys(lines)[2] for lines, _ in held]), return_counts=True)
            often = count >= least
            yield pd.DataFrame({"key": key[often].view(np.int64), "count": count[often]})

    return tidy(run)


def _is_hot(key: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Whether keys are among the sorted ones in hot."""
    if not len(hot):
        return np.zeros(len(key), bool)
    return hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key


def _key_rows(bucket_bits: int, hot: np.ndarray):
    """For each bucket of keys that aren't hot, packed: 32 bits of the keys, whose lowest bit tells a probe, and ids and sketches of their lines."""

    def packed(held: list[tuple[list[str], list[int]]]) -> pd.DataFrame:
        keys, ids, sketches = [], [], []
        for lines, names in held:
            number, probe, key, sketch = line_keys(lines)
            cool = ~_is_hot(key, hot)
            number, probe, key = number[cool], probe[cool], key[cool]
            low = np.uint64(32 - bucket_bits)
            keys.append(((key >> low | np.uint64(1)) ^ np.uint64(1) | probe.astype(np.uint64)) << low)
            ids.append(np.array(names, np.int64)[number])
            sketches.append(sketch[number])
        key = np.concatenate(keys)
        order = np.argsort(key)
        key, name, sketch = key[order], np.concatenate(ids)[order], np.concatenate(sketches)[order]
        bucket = (key >> np.uint64(64 - bucket_bits)).astype(np.int64)
        cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(key) else np.empty(0, np.int64)
        key = (key >> np.uint64(32 - bucket_bits)).astype(np.uint32)
        rows = zip(bucket[cuts].tolist(), *(np.split(x, cuts[1:]) for x in (key, name, sketch)))
        return pd.DataFrame([(n, k.tobytes(), v.tobytes(), x.tobytes()) for n, k, v, x in rows], columns=["bucket", "keys", "ids", "sketches"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for held in _sendings(batches):
            yield packed(held)

    return tidy(run)


def _hot_rows(hot: np.ndarray):
    """The lines that have hot keys, once for each of these and each side."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for held in _sendings(batches):
            for lines, names in held:
                number, probe, key, sketch = line_keys(lines)
                at = np.flatnonzero(_is_hot(key, hot))
                rows = pd.DataFrame({"key": key[at].view(np.int64), "probe": probe[at], "h": np.array(names, np.int64)[number[at]], "sketch": sketch[number[at]].view(np.int64), "line": [lines[n] for n in number[at]]})
                yield rows.drop_duplicates(["key", "probe", "line"])

    return tidy(run)


def _cell_links(group: pd.DataFrame) -> pd.DataFrame:
    """For lines of a cell that go by an earlier line of its other side, one such line each."""
    group = group.drop_duplicates(["probe", "h", "h2"])
    index, probe = group[~group["probe"]], group[group["probe"]]
    lines = [*index["line"], *probe["line"]]
    names, others = (np.concatenate([index[x].to_numpy(), probe[x].to_numpy()]) for x in ("h", "h2"))
    first = pd.concat([index, probe])[["doc", "digest", "pos"]].apply(tuple, axis=1).tolist() if len(group) else []
    rank = np.empty(len(lines), np.int64)
    rank[sorted(range(len(lines)), key=first.__getitem__)] = np.arange(len(lines))
    sketch, sizes = index["sketch"].to_numpy().view(np.uint64), np.fromiter(map(len, lines), np.int64, len(lines))
    by = np.full(len(lines), -1)  # the line by which a line goes

    for start in range(0, len(probe), 256):
        own = np.arange(len(index) + start, min(len(index) + start + 256, len(lines)))
        asked = probe["sketch"].to_numpy()[start : start + 256].view(np.uint64)
        p, x = np.nonzero(_may_be_near(np.repeat(asked, len(index)), np.tile(sketch, len(own)), EDITS).reshape(len(own), len(index)))
        p = own[p]
        differ = (names[p] != names[x]) | (others[p] != others[x])
        p, x = p[differ], x[differ]
        later, earlier = np.where(rank[p] > rank[x], p, x), np.where(rank[p] > rank[x], x, p)
        step = 1
        while True:  # one candidate of each line, then two more, then four
            left = by[later] < 0
            later, earlier = later[left], earlier[left]
            if not len(later):
                break
            order = np.argsort(later, kind="stable")
            later, earlier = later[order], earlier[order]
            begin = np.flatnonzero(np.append(True, later[1:] != later[:-1]))
            turn = np.arange(len(later)) - np.repeat(begin, np.diff(np.append(begin, len(later))))
            now = np.flatnonzero(turn < step)
            for i in range(0, len(now), 4096):
                some = now[i : i + 4096]
                found = edit_distances([lines[k] for k in later[some]], [lines[k] for k in earlier[some]], EDITS)
                fits = np.array([allowed(n) for n in np.minimum(sizes[later[some]], sizes[earlier[some]])])
                near = some[found <= fits]
                by[later[near]] = earlier[near]
            keep = turn >= step
            later, earlier, step = later[keep], earlier[keep], 2 * step
    gone = np.flatnonzero(by >= 0)
    return pd.DataFrame({"a": names[gone], "a2": others[gone], "b": names[by[gone]], "b2": others[by[gone]]})


def _bucket_pairs(group: pd.DataFrame) -> pd.DataFrame:
    """Pairs of lines of which one has a segment that the other probes."""
    keys = np.concatenate([np.frombuffer(x, np.uint32) for x in group["keys"]])
    ids = np.concatenate([np.frombuffer(x, np.int64) for x in group["ids"]])
    sketches = np.concatenate([np.frombuffer(x, np.uint64) for x in group["sketches"]])
    probe = (keys & 1).astype(bool)
    order = np.lexsort((ids[~probe], keys[~probe]))
    key, name, sketch = keys[~probe][order], ids[~probe][order], sketches[~probe][order]
    first = np.append(True, (key[1:] != key[:-1]) | (name[1:] != name[:-1])) if len(key) else np.empty(0, bool)
    key, name, sketch = key[first], name[first], sketch[first]
    wanted, who, what = keys[probe] & ~np.uint32(1), ids[probe], sketches[probe]
    low = np.searchsorted(key, wanted)
    count = np.searchsorted(key, wanted, side="right") - low
    out = pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
    upto = np.cumsum(count)
    at = 0
    while at < len(count):  # so many pairs at a time, but each is kept once
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS_AT_ONCE)))
        own = count[at:end]
        a = np.repeat(who[at:end], own)
        place = np.repeat(low[at:end] - (np.cumsum(own) - own), own) + np.arange(own.sum())
        b = name[place]
        near = (a != b) & _may_be_near(np.repeat(what[at:end], own), sketch[place], EDITS)
        pairs = pd.DataFrame({"a": np.minimum(a, b)[near], "b": np.maximum(a, b)[near]})
        out = pd.concat([out, pairs]).drop_duplicates()
        at = end
    return out


def _verify(edits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            size = batch["a_line"].map(len).to_numpy()
            for _, rows in batch.groupby(np.frexp(size)[1]):  # lengths of about the same size side by side
                step = max(1, (1 << 22) // int(rows["a_line"].map(len).max() + 1))
                for i in range(0, len(rows), step):
                    part = rows.iloc[i : i + step]
                    a, b = part["a_line"].tolist(), part["b_line"].tolist()
                    near = edit_distances(a, b, edits) <= np.array([allowed(min(len(x), len(y))) for x, y in zip(a, b)])
                    yield part.loc[near, ["a", "a2", "b", "b2"]]

    return tidy(run)


_LINK = "a long, a2 long, b long, b2 long"


def _hot_links(lines: DataFrame, hot: dict[int, int], firsts: DataFrame) -> DataFrame:
    """Links of lines with hot keys, whose numbers of lines hot gives."""
    spark = lines.sparkSession
    keys = np.sort(np.array(list(hot), np.int64).view(np.uint64))
    parts = spark.createDataFrame([(k, -(-n // CELL_LINES)) for k, n in hot.items()], "key long, parts int")  # MOST_HOT rows at most
    rows = lines.mapInPandas(_hot_rows(keys), "key long, probe boolean, h long, sketch long, line string")
    rows = rows.withColumn("h2", F.xxhash64("line", F.lit(1))).dropDuplicates(["key", "probe", "h", "h2"])
    rows = rows.join(firsts, ["h", "h2"]).join(F.broadcast(parts), "key").withColumn("part", F.pmod(F.xxhash64("h", "h2"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    cells = rows.withColumn("other", other).withColumns({"i": F.when(F.col("probe"), F.col("other")).otherwise(F.col("part")), "j": F.when(F.col("probe"), F.col("part")).otherwise(F.col("other"))})
    return cells.select("key", "i", "j", "probe", "h", "h2", "sketch", "line", "doc", "digest", "pos").groupBy("key", "i", "j").applyInPandas(_cell_links, _LINK)


def near_lines(lines: DataFrame, count: int, firsts: DataFrame, some: DataFrame, share: int) -> DataFrame:
    """Links (a, a2, b, b2) between different lines within the edits allowed, by both hashes of each; enough to tell of every line whether an earlier one is near.

    lines has about `count` rows with h and line, firsts h, h2, doc, digest and pos of the first place of each; some
    are the lines of one document in `share`.
    """
    small_batches(lines.sparkSession)
    bucket_bits = 4
    while 1 << bucket_bits < min(MOST_BUCKETS, count * 15 / BUCKET_KEYS):
        bucket_bits += 1
    least = max(HOT_LINES, count * 15 // MOST_HOT)
    often = some.mapInPandas(_counted_keys(HOT_HERE), "key long, count long").groupBy("key").agg((F.sum("count") * share).alias("count")).where(F.col("count") >= least)
    hot = {row["key"]: row["count"] for row in often.orderBy(F.desc("count"), "key").limit(MOST_HOT).collect()}
    keys = lines.mapInPandas(_key_rows(bucket_bits, np.sort(np.array(list(hot), np.int64).view(np.uint64))), "bucket int, keys binary, ids binary, sketches binary")
    pairs = materialize(keys.groupBy("bucket").applyInPandas(_bucket_pairs, "a long, b long").distinct())
    wanted = materialize(pairs.select(F.col("a").alias("h")).union(pairs.select(F.col("b").alias("h"))).distinct())
    few = wanted.count() <= FEW_LINES
    texts = lines.join(F.broadcast(wanted) if few else wanted, "h").withColumn("h2", F.xxhash64("line", F.lit(1))).groupBy("h", "h2").agg(F.first("line").alias("line"))
    texts = materialize(texts)
    sides = [texts.select(F.col("h").alias(x), F.col("h2").alias(f"{x}2"), F.col("line").alias(f"{x}_line")) for x in "ab"]
    found = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "a2", "b", "b2", "a_line", "b_line").mapInPandas(_verify(EDITS), _LINK)
    return found.unionByName(_hot_links(lines, hot, firsts)) if hot else found


def _exploded(docs: DataFrame) -> DataFrame:
    """doc_id, digest, pos and line of every line that takes part."""
    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("digest"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return rows.where((F.length("line") >= MIN_CHARS) & F.col("line").rlike(r"[^\s]"))


def removed_lines(docs: DataFrame) -> DataFrame:
    """doc_id, digest and the array `removed` of the places of lines that go, for documents that lose any. docs has doc_id and text; rows that repeat an id are told apart by the text's hash."""
    line = _exploded(docs)
    places = materialize(line.select("doc_id", "digest", "pos", F.struct(F.xxhash64("line").alias("h"), F.xxhash64("line", F.lit(1)).alias("h2")).alias("key")))
    total = places.count()
    groups = materialize(places.groupBy("key").agg(F.min(F.struct("doc_id", "digest", "pos")).alias("first"), F.count(F.lit(1)).alias("times")))
    long = line.where(F.length("line") >= MIN_ONE_EDIT_CHARS).select(F.xxhash64("line").alias("h"), "line")
    some = _exploded(docs.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(HOT_SHARE)) == 0)).where(F.length("line") >= MIN_ONE_EDIT_CHARS).select(F.xxhash64("line").alias("h"), "line")
    pairs = materialize(near_lines(long, total, groups.select("key.h", "key.h2", F.col("first.doc_id").alias("doc"), F.col("first.digest").alias("digest"), F.col("first.pos").alias("pos")), some, HOT_SHARE))
    a, b = F.struct(F.col("a").alias("h"), F.col("a2").alias("h2")), F.struct(F.col("b").alias("h"), F.col("b2").alias("h2"))
    ends = materialize(pairs.select(a.alias("key")).union(pairs.select(b.alias("key"))).distinct())
    few = ends.count() <= FEW_LINES
    firsts = materialize(groups.select("key", "first").join(F.broadcast(ends) if few else ends, "key"))
    sides = pairs.select(a.alias("a_key"), b.alias("b_key")).join(firsts.select(F.col("key").alias("a_key"), F.col("first").alias("a_first")), "a_key").join(firsts.select(F.col("key").alias("b_key"), F.col("first").alias("b_first")), "b_key")
    later = materialize(sides.select(F.when(F.col("a_first") > F.col("b_first"), F.col("a_key")).otherwise(F.col("b_key")).alias("key")).distinct().withColumn("near", F.lit(True)))
    marked = groups.join(F.broadcast(later) if few else later, "key", "left")
    doubtful = materialize(marked.where((F.col("times") > 1) | F.col("near")))
    gone = join_groups(places, doubtful, "key", "times", total).where(F.coalesce("near", F.lit(False)) | (F.struct("doc_id", "digest", "pos") != F.col("first")))
    return gone.groupBy("doc_id", "digest").agg(F.collect_set("pos").alias("removed"))


def _unused(docs: DataFrame, name: str) -> str:
    """The name, lengthened until no column has it."""
    taken = {x.lower() for x in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def without_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str = "removed_lines") -> DataFrame:
    """docs with the lines that go cut from their texts, and count_col, which docs must not have, with their number."""
    found = materialize(removed_lines(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))))
    few = found.agg(F.count(F.lit(1)), F.sum(F.size("removed"))).first()
    if few[0] <= FEW_DOCS and (few[1] or 0) <= 10 * FEW_DOCS:
        found = F.broadcast(found)
    key, mark, cut = (_unused(docs, x) for x in ("cut_id", "cut_digest", "cut_places"))
    found = found.select(F.col("doc_id").alias(key), F.col("digest").alias(mark), F.col("removed").alias(cut))
    gone = F.col(cut)
    kept = F.filter(F.split(F.col(text_col), "\n"), lambda line, i: ~F.array_contains(gone, i))  # the text is split once
    text = F.when(gone.isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    joined = docs.join(found, (docs[id_col] == found[key]) & (F.xxhash64(docs[text_col]) == found[mark]), "left").withColumn(text_col, text)
    return joined.withColumn(count_col, F.when(gone.isNull(), 0).otherwise(F.size(gone)).cast("long")).drop(key, mark, cut)


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, kept_sha256.

    Lines end at line feeds. A line that isn't blank goes if an equal line occurs earlier, by
    document id and place, in the input; also if a line within EDITS edits of it does and both have
    MIN_EDIT_CHARS code points, or one within one edit and both have MIN_ONE_EDIT_CHARS. Lines are judged on the input, not on what is left. A null
    text counts as empty, with no lines. Rows that repeat an id with another text are documents of their own, which follow
    one another by the hash of their texts; rows that repeat both are one document. Those with a
    null id are kept as they are and count for nothing. An empty table gives an empty result. Long
    lines and texts count whole; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counted = rows.withColumn("n_lines", F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).cast("long"))
    return without_lines(counted, count_col="n_removed").select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, without the lines that go by the rules of line_report(); a document that loses all its text goes too.

    Documents that lose no line stay as they are, null and blank texts included. An empty table stays empty.
    """
    count = _unused(docs, "removed_lines")
    left = without_lines(docs, id_col, text_col, count)
    return left.where((F.col(count) == 0) | (F.trim(F.translate(F.col(text_col), "\n\t\r", "   ")) != "")).drop(count)
