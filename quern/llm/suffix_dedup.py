"""Removal of repeated byte strings with suffix arrays, sorted in two stages.

Every string of `span` bytes has an anchor: of the k-grams inside it, the first with the smallest
hash. Neighbouring strings with one anchor make a segment, and equal strings, wherever they occur,
lie in segments with equal anchors. So segments are dealt out by anchor, and each bucket is solved
alone. An anchor found in one document only can't repeat; a first pass finds the others, and only
their segments are dealt out. Of equal segments in a part of the corpus one is sent, with the
smallest document that has it. In a bucket the segments' bytes are joined and their suffixes sorted
in two stages: those smaller than their successors directly, all others induced by scans over the
buckets of first bytes. Where neighbours in that order have `span` bytes in common, the strings are
equal, and the smallest document of each run of equal ones decides which go.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import materialize, small_batches, tidy

SPAN = 50
GRAM = 16
#: String beginnings handled at once, and segments after which a task sends what it has.
PIECE, SEND = 1 << 16, 1 << 20
#: Anchors in a bucket, on average.
BUCKET_ANCHORS, MOST_BUCKETS = 1 << 16, 1 << 14
#: Bits of the filter of repeated anchors: for each of them, and at most.
BITS_EACH, MAX_BITS, PROBES = 12, 1 << 28, 4

_PLACE_BITS = np.uint64(20)
_ONE = np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Pieces:
    """Joins documents' bytes to pieces of about PIECE string beginnings; a long document is cut, with span - 1 bytes repeated."""

    def __init__(self, span: int = SPAN):
        self.span, self.held, self.size = span, [], 0

    def add(self, doc: int, data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for at in range(0, max(0, len(data) - self.span + 1), PIECE):
            part = data[at : at + PIECE + self.span - 1]
            self.held.append((doc, at, part))
            self.size += len(part)
            if self.size >= PIECE:
                yield self.take()

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes, and for each part of a document where it begins here, its document and its place there."""
        parts, self.held, self.size = self.held, [], 0
        sizes = np.array([len(x[2]) for x in parts])
        return np.frombuffer(b"".join(x[2] for x in parts), np.uint8), np.cumsum(sizes) - sizes, np.array([x[0] for x in parts], np.int64), np.array([x[1] for x in parts], np.int64)


def segments_of(data: np.ndarray, starts: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First beginning, number of beginnings and anchor hash, whose lowest bit is 0, of each segment of a piece."""
    count = len(data) - span + 1
    if count <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    h, width, factor = data.astype(np.uint64) + np.uint64(1), 1, int(_ODD)
    while width < gram:
        h = h[:-width] * np.uint64(factor) + h[width:]
        factor, width = factor * factor & ((1 << 64) - 1), 2 * width
    h = _mixed(h)
    least = (h & ~((np.uint64(1) << _PLACE_BITS) - np.uint64(1))) | np.arange(len(h), dtype=np.uint64)
    reach, width = span - gram + 1, 1
    while 2 * width <= reach:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    least = np.minimum(least[: len(least) - (reach - width)], least[reach - width :])[:count]
    anchor = (least & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)
    ends = np.append(starts[1:], len(data))
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, np.maximum(ends - span + 1, starts), -1)
    inside = np.cumsum(inside[:count], dtype=np.int8).astype(bool)
    new = np.empty(count, bool)
    new[0] = True
    new[1:] = anchor[1:] != anchor[:-1]
    new[starts[starts < count]] = True
    places = np.flatnonzero(inside)
    first = places[new[places]]
    # places inside a document and segment follow one another
    number = np.cumsum(new[places]) - 1
    return first, np.bincount(number, minlength=len(first)), _mixed(h[anchor[first]] ^ _ODD) & ~_ONE  # mixed once more, as the smallest hashes are all alike in their upper bits


def _packed(x: np.ndarray) -> bytes:
    """Numbers as compressed bytes, with the bytes of one place together."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), 1)


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def _pieces(batches: Iterator[pd.DataFrame], span: int, gram: int, take, send) -> Iterator[pd.DataFrame]:
    """Runs take() on the segments of each piece, and yields from send(), with the documents so far, between documents."""
    pieces, ids, digests, count = Pieces(span), [], [], 0

    def handle(piece: tuple) -> int:
        data, starts, docs, places = piece
        first, sizes, anchors = segments_of(data, starts, span, gram)
        part = np.searchsorted(starts, first, side="right") - 1
        take(data, first, sizes, anchors, docs[part], first - starts[part] + places[part])
        return len(first)

    for batch in batches:
        for name, digest, text in zip(batch["id"], batch["digest"], batch["text"]):
            for piece in pieces.add(len(ids), text.encode()):
                count += handle(piece)
            ids.append(name)
            digests.append(digest)
            if count >= SEND:
                if pieces.held:
                    handle(pieces.take())
                yield from send(np.array(ids, np.int64), np.array(digests, np.int64))
                ids, digests, count = [], [], 0
    if pieces.held:
        handle(pieces.take())
    if ids:
        yield from send(np.array(ids, np.int64), np.array(digests, np.int64))


def _anchor_rows(bucket_bits: int, span: int, gram: int):
    """For each bucket the distinct anchors of a part of the corpus; the lowest bit tells those of several documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def take(data, first, sizes, anchors, docs, places) -> None:
            held.append((anchors, docs))

        def send(ids: np.ndarray, digests: np.ndarray) -> Iterator[pd.DataFrame]:
            if held:
                anchors, docs = (np.concatenate(x) for x in zip(*held))
                held.clear()
                order = np.argsort(anchors)
                anchors, docs = anchors[order], ids[docs[order]]
                at = np.flatnonzero(np.append(True, anchors[1:] != anchors[:-1])) if len(anchors) else np.empty(0, np.int64)
                if len(at):
                    several = np.minimum.reduceat(docs, at) != np.maximum.reduceat(docs, at)
                    anchors = anchors[at] | several.astype(np.uint64)
                    bucket = (anchors >> np.uint64(64 - bucket_bits)).astype(np.int64)
                    cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                    parts = [_packed(np.diff(x, prepend=np.uint64(0))) for x in np.split(anchors, cuts[1:])]
                    yield pd.DataFrame({"bucket": bucket[cuts], "anchors": parts})

        yield from _pieces(batches, span, gram, take, send)

    return run


def _slots(anchors: np.ndarray, bits: np.ndarray | int) -> np.ndarray:
    first, step = _mixed(anchors ^ _ODD), _mixed(anchors + _ODD) | _ONE
    return (first[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) % np.asarray(bits, np.uint64).reshape(-1, 1)


def _repeated(most_bits: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """A Bloom filter of a bucket's anchors that lie in several documents."""
        anchors = np.sort(np.concatenate([np.cumsum(_unpacked(x, np.uint64)) for x in group["anchors"]]))
        plain = anchors & ~_ONE
        at = np.flatnonzero(np.append(True, plain[1:] != plain[:-1]))
        again = plain[at][(np.diff(np.append(at, len(plain))) > 1) | (np.bitwise_or.reduceat(anchors & _ONE, at) > 0)]
        bits = max(64, min(most_bits, BITS_EACH * len(again)) // 64 * 64)
        found = np.zeros(bits, bool)
        found[_slots(again, bits).ravel().astype(np.int64)] = True
        return pd.DataFrame({"bucket": [int(group["bucket"].iloc[0])], "filter": [np.packbits(found, bitorder="little").tobytes()]})

    return run


class RepeatFilter:
    """Tells anchors that may lie in several documents."""

    def __init__(self, parts: dict[int, bytes], bucket_bits: int):
        self.bucket_bits = bucket_bits
        sizes = np.array([len(parts.get(x, b"\0" * 8)) for x in range(1 << bucket_bits)])
        self.starts, self.bits = np.cumsum(sizes) - sizes, sizes * 8
        self.bytes = np.frombuffer(b"".join(parts.get(x, b"\0" * 8) for x in range(1 << bucket_bits)), np.uint8)

    def __call__(self, anchors: np.ndarray) -> np.ndarray:
        bucket = (anchors >> np.uint64(64 - self.bucket_bits)).astype(np.int64)
        slots = _slots(anchors, self.bits[bucket]).astype(np.int64)
        return ((self.bytes[self.starts[bucket][:, None] + (slots >> 3)] >> (slots & 7)) & 1).all(axis=1)


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of ranges, one after another."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(first - before, sizes) + np.arange(sizes.sum())


_SEGMENTS = "unit string, bucket int, sizes binary, least binary, data binary, places binary"


def _segment_rows(held, bucket_bits: int, span: int, gram: int):
    """For each part of the corpus and bucket: the distinct segments with their smallest document, and where each occurs. A row with bucket -1 has the part's documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        may_repeat, kept = held.value, []

        def take(data, first, sizes, anchors, docs, places) -> None:
            own = may_repeat(anchors)
            first, sizes, anchors = first[own], sizes[own], anchors[own]
            lengths = sizes + span - 1
            text = data[_ranges(first, lengths)]
            kept.append((anchors, sizes, docs[own], places[own], _content(text, lengths), text))

        def send(ids: np.ndarray, digests: np.ndarray) -> Iterator[pd.DataFrame]:
            if not sum(len(x[0]) for x in kept):
                kept.clear()
                return
            anchors, sizes, docs, places, content, text = (np.concatenate(x) for x in zip(*kept))
            kept.clear()
            low = np.uint64(64 - bucket_bits)
            name = (anchors >> low << low) | (_mixed(anchors ^ _mixed(content)) >> np.uint64(bucket_bits))
            order = np.argsort(name, kind="stable")
            at = np.flatnonzero(np.append(True, name[order][1:] != name[order][:-1]))
            least = np.minimum.reduceat(ids[docs[order]], at)
            first = order[at]
            lengths = sizes + span - 1
            starts = np.cumsum(lengths) - lengths
            number = np.cumsum(np.append(False, name[order][1:] != name[order][:-1]))
            bucket = (name[first] >> low).astype(np.int64)
            cuts = [*np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(first)]
            unit = uuid.uuid4().hex
            rows = []
            for a, b in zip(cuts, cuts[1:]):
                own = order[at[a] : at[b] if b < len(at) else len(order)]
                where = np.lexsort((places[own], docs[own]))
                local = (number[at[a] : at[b] if b < len(at) else len(order)] - a)[where]
                own = own[where]
                rows.append((unit, bucket[a], _packed(sizes[first[a:b]].astype(np.uint8)), _packed(least[a:b]), zstandard.compress(text[_ranges(starts[first[a:b]], lengths[first[a:b]])].tobytes(), 1), _packed(np.concatenate([local, docs[own], places[own]]).astype(np.uint32))))
            rows.append((unit, -1, _packed(digests), _packed(ids), b"", b""))
            yield pd.DataFrame(rows, columns=["unit", "bucket", "sizes", "least", "data", "places"])

        yield from _pieces(batches, span, gram, take, send)

    return run


_powers: list[np.ndarray] = []


def _content(text: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of each of the strings that text joins."""
    if not _powers or len(_powers[0]) <= len(text):
        size, base = max(1 << 20, 2 * len(text)), int(_ODD)
        _powers[:] = [np.cumprod(np.full(size, x, np.uint64)) for x in (base, pow(base, -1, 1 << 64))]
    up, down = _powers
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + _ONE) * up[: len(text)], out=sums[1:])
    ends = np.cumsum(lengths)
    starts = ends - lengths
    return (sums[ends] - sums[starts]) * down[starts] + lengths.astype(np.uint64)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of a byte array in order, by `depth` bytes at least, sorted in two stages."""
    n = len(text)
    if n == 0:
        return np.empty(0, np.int64)
    words = _words(text)
    change = np.flatnonzero(text[1:] != text[:-1])
    rises = np.append(text[change + 1] > text[change], False)  # of each run of one byte; the last suffix is larger than what follows it
    smaller = np.repeat(rises, np.diff(np.concatenate([[-1], change, [n - 1]])))
    direct = np.flatnonzero(smaller)
    direct = direct[np.argsort(words[direct], kind="stable")]
    first = words[direct]
    tied = np.append(True, first[1:] != first[:-1]) if len(direct) else np.empty(0, bool)
    group = np.cumsum(tied)
    for deep in range(8, depth, 8):
        size = np.bincount(group, minlength=group[-1] + 1 if len(group) else 0)
        again = np.flatnonzero(size[group] > 1) if len(group) else np.empty(0, np.int64)
        if not len(again):
            break
        part = direct[again]
        word = words[np.minimum(part + deep, n)]
        order = np.lexsort((word, group[again]))
        direct[again] = part[order]
        word, old = word[order], group[again]
        new = np.ones(len(again), bool)
        new[1:] = (word[1:] != word[:-1]) | (old[1:] != old[:-1])
        marks = np.zeros(len(group), bool)
        marks[0] = True
        marks[1:] = group[1:] != group[:-1]
        marks[again] |= new
        group = np.cumsum(marks)
    out = np.empty(n, np.int64)
    counts = np.bincount(text, minlength=256)
    starts = np.cumsum(counts) - counts
    sorted_counts = np.bincount(text[direct], minlength=256)
    tails = starts + counts - sorted_counts
    out[_ranges(tails, sorted_counts)] = direct
    heads = starts.copy()

    def induce(found: np.ndarray) -> None:
        before = found[found > 0] - 1
        before = before[~smaller[before]]
        byte = text[before]
        order = np.argsort(byte, kind="stable")
        before, byte = before[order], byte[order]
        cuts = np.flatnonzero(np.append(True, byte[1:] != byte[:-1])) if len(byte) else []
        for a, b in zip(cuts, [*cuts[1:], len(byte)]):
            head = heads[byte[a]]
            out[head : head + b - a] = before[a:b]
            heads[byte[a]] += b - a

    out[heads[text[-1]]] = n - 1
    heads[text[-1]] += 1
    for c in range(256):
        at = starts[c]
        while at < heads[c]:
            at, begin = heads[c], at
            induce(out[begin:at])
        induce(out[tails[c] : tails[c] + sorted_counts[c]])
    return out


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as a number in the order of bytes; zeros follow the text."""
    padded = np.append(text, np.zeros(8, np.uint8))
    out = np.zeros(len(text) + 1, np.uint64)
    for k in range(8):
        out = out << np.uint64(8) | padded[k : k + len(out)].astype(np.uint64)
    return out


def common_prefixes(text: np.ndarray, order: np.ndarray, span: int) -> np.ndarray:
    """Bytes that each suffix of order has in common with the one before it, up to span; all must have span bytes."""
    if not len(order):
        return np.empty(0, np.int64)
    common = np.zeros(len(order), np.int64)
    open_ = np.arange(1, len(order))
    words = _words(text)
    for at in range(0, span, 8):
        a, b = order[open_ - 1] + at, order[open_] + at
        differ = words[a] ^ words[b]
        same = np.full(len(open_), 8)
        for k in range(8):
            same[(differ >> np.uint64(8 * (7 - k)) > 0) & (same == 8)] = k
        common[open_] += same
        open_ = open_[same == 8]
    return np.minimum(common, span)


def least_documents(text: np.ndarray, lengths: np.ndarray, least: np.ndarray, span: int) -> np.ndarray:
    """For each string of span bytes in distinct segments, one after another, the smallest document that has it."""
    sizes = lengths - span + 1
    starts = np.cumsum(lengths) - lengths
    begins = _ranges(starts, sizes)
    number = np.full(len(text), -1, np.int64)
    number[begins] = np.arange(len(begins))
    order = suffix_array(text, span)
    order = order[number[order] >= 0]
    runs = np.flatnonzero(common_prefixes(text, order, span) < span)
    owner = np.repeat(least, sizes)
    at = number[order]
    out = np.empty(len(begins), np.int64)
    if len(at):
        out[at] = np.repeat(np.minimum.reduceat(owner[at], runs), np.diff(np.append(runs, len(at))))
    return out


def _solved(span: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """For each part of the corpus and segment, bits of the strings that a smaller document than its smallest one has."""
        sizes = [_unpacked(x, np.uint8).astype(np.int64) for x in group["sizes"]]
        least = np.concatenate([_unpacked(x, np.int64) for x in group["least"]])
        text = np.frombuffer(b"".join(map(zstandard.decompress, group["data"])), np.uint8)
        counts, size = list(map(len, sizes)), np.concatenate(sizes)
        lengths = size + span - 1
        _, first, same = np.unique(_content(text, lengths), return_index=True, return_inverse=True)
        starts = np.cumsum(lengths) - lengths
        lowest = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(lowest, same, least)
        found = least_documents(text[_ranges(starts[first], lengths[first])], lengths[first], lowest, span)
        offsets = np.cumsum(size[first]) - size[first]
        gone = found[_ranges(offsets[same], size)] < np.repeat(least, size)
        place = np.arange(len(gone)) - np.repeat(np.cumsum(size) - size, size)
        bits = np.add.reduceat(gone.astype(np.uint64) << place.astype(np.uint64), np.cumsum(size) - size)
        parts = np.split(bits, np.cumsum(counts)[:-1])
        return pd.DataFrame({"unit": group["unit"].to_numpy(), "bucket": group["bucket"].to_numpy(), "bits": [_packed(x) for x in parts]})

    return run


def _united(span: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """The removed runs of the documents of one part of the corpus."""
        about = group[group["bucket"] < 0].iloc[0]
        digests, ids = _unpacked(about["sizes"], np.int64), _unpacked(about["least"], np.int64)
        begins, ends, owners = [], [], []
        for row in group[group["bucket"] >= 0].itertuples():
            size, least, bits = _unpacked(row.sizes, np.uint8).astype(np.int64), _unpacked(row.least, np.int64), _unpacked(row.bits, np.uint64)
            local, docs, places = _unpacked(row.places, np.uint32).astype(np.int64).reshape(3, -1)
            whole = ids[docs] > least[local]
            begins.append(places[whole])
            ends.append(places[whole] + size[local[whole]] + span - 1)
            owners.append(docs[whole])
            part = np.flatnonzero(~whole & (bits[local] > 0))
            for k in range(int(size.max())):
                on = part[(bits[local[part]] >> np.uint64(k)) & _ONE > 0]
                begins.append(places[on] + k)
                ends.append(places[on] + k + span)
                owners.append(docs[on])
        columns = ["id", "digest", "runs"]
        begin, end, owner = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (begins, ends, owners))
        if not len(begin):
            return pd.DataFrame({x: [] for x in columns})
        order = np.lexsort((begin, owner))
        far = np.int64(1) << 33
        begin, end, owner = begin[order] + owner[order] * far, end[order] + owner[order] * far, owner[order]
        reach = np.maximum.accumulate(end)
        new = np.append(True, begin[1:] > reach[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(begin)) - 1
        runs = np.stack([begin[first] - owner[first] * far, reach[last] - owner[first] * far], axis=1)
        cuts = np.flatnonzero(np.append(True, owner[first][1:] != owner[first][:-1]))
        docs = owner[first][cuts]
        return pd.DataFrame({"id": ids[docs], "digest": digests[docs], "runs": [x.tobytes() for x in np.split(runs, cuts[1:])]})

    return run


def removed_runs(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """id, digest and the removed runs, pairs of beginning and end as bytes, of each document that loses any. docs has id, digest and text, none null."""
    spark = docs.sparkSession
    small_batches(spark)
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bucket_bits = 4
    while 1 << bucket_bits < min(MOST_BUCKETS, size // 16 / BUCKET_ANCHORS):
        bucket_bits += 1
    anchors = docs.mapInPandas(tidy(_anchor_rows(bucket_bits, span, gram)), "bucket int, anchors binary")
    filters = materialize(anchors.groupBy("bucket").applyInPandas(_repeated(MAX_BITS >> bucket_bits), "bucket int, filter binary"))
    parts = {row["bucket"]: bytes(row["filter"]) for row in filters.collect()}  # MAX_BITS bits at most
    held = spark.sparkContext.broadcast(RepeatFilter(parts, bucket_bits))
    segments = materialize(docs.mapInPandas(tidy(_segment_rows(held, bucket_bits, span, gram)), _SEGMENTS))
    solved = segments.where("bucket >= 0").select("unit", "bucket", "sizes", "least", "data").groupBy("bucket").applyInPandas(_solved(span), "unit string, bucket int, bits binary")
    places = segments.select("unit", "bucket", "sizes", "least", "places").join(solved, ["unit", "bucket"], "left")
    return places.groupBy("unit").applyInPandas(_united(span), "id long, digest long, runs binary").groupBy("id", "digest").agg(F.first("runs").alias("runs"))


#: Documents with removed runs, and bytes of these, up to which they are broadcast.
FEW_DOCS, FEW_BYTES = 200_000, 32 << 20


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        removed, kept = [], []
        for text, runs in zip(batch["text"], batch["runs"]):
            data, at, parts, gone = text.encode(), 0, [], 0
            for a, b in np.frombuffer(runs, np.int64).reshape(-1, 2).tolist():
                parts.append(data[at:a])
                gone += b - a
                at = b
            kept.append(b"".join([*parts, data[at:]]))
            removed.append(gone)
        yield pd.DataFrame({"doc_id": batch["doc_id"], "n_bytes": batch["n_bytes"], "n_removed": removed, "n_spans": batch["runs"].map(len).to_numpy() // 16, "kept": kept})


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, and `kept`, the bytes that are left.

    A byte goes if a string of `span` bytes that covers it also begins in a document with a smaller
    id; strings are judged on the input. A null text counts as empty. A null id is larger than any
    other, and documents with the same id take nothing from one another. An empty table gives an
    empty result. Very long texts are cut into pieces that overlap, and count whole. Other columns
    are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col), F.lit((1 << 63) - 1)).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("digest"))
    found = materialize(removed_runs(rows.select("id", "digest", "text"), span))
    count, size = found.agg(F.count(F.lit(1)), F.sum(F.octet_length("runs"))).first()
    if count <= FEW_DOCS and (size or 0) <= FEW_BYTES:
        found = F.broadcast(found)
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    kind = docs.schema[id_col].dataType.simpleString()
    joined = rows.join(found, ["id", "digest"], "left")
    cut = joined.where(F.col("runs").isNotNull()).select("doc_id", "n_bytes", "text", "runs").mapInPandas(tidy(_cut), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
    whole = joined.where(F.col("runs").isNull()).select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("text").cast("binary").alias("kept"))
    return cut.unionByName(whole)


def repeat_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return without_repeats(docs, id_col, text_col, span).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
