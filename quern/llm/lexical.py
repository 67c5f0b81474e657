"""Ranked lexical search over an inverted index.

The index is cut into shards of some thousand documents. A task numbers the documents of a shard by
their ids and writes, for each term, the gaps between these numbers and the term's counts as bytes of
variable length. A search sends the postings of the terms asked for to one task for each shard
and block of items. There the lists of an item's terms are merged document at a time by a heap of
their next documents; a second, bounded heap, by score and then id, holds the best so far. Lists
whose greatest shares together can't reach the worst of these leave the merge and are only asked
for documents that the others bring, which changes no result. The shards' best are merged at the end.
"""

from __future__ import annotations

import heapq
from array import array
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate, count
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .workspace import give_back, materialize, small_batches

#: Documents and terms (with repeats) from which a shard is closed.
SHARD_DOCS, SHARD_TERMS = 16_384, 1 << 23
#: Bytes of a text that are cut into terms at once, and rows of the index sent at once.
PIECE, SEND = 1 << 20, 10_000
#: Items that are searched for together.
BLOCK_ITEMS = 1000
#: Parts in which the shards' results for an item are merged first.
MERGE_PARTS = 64

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TABLE = bytes(ord(chr(c).lower()) if chr(c).isalnum() or c > 127 else 32 for c in range(128)) + bytes(range(128, 256))


def terms_of(text: Column) -> Column:
    """The terms of a text: maximal stretches of ASCII letters and digits and of all characters beyond ASCII, A to Z in lower case."""
    return F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), _SEPARATORS), "")


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    plain, start = text.translate(_TABLE), 0
    while start < len(plain):
        end = plain.find(b" ", start + PIECE)
        end = len(plain) if end < 0 else end
        yield plain[start:end].split()
        start = end


def pack(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers from 0 as bytes of seven bits each, the last with its high bit clear, and where each begins (one place more at the end)."""
    size = np.ones(len(numbers), np.int64)
    for bits in range(7, 63, 7):
        size += numbers >> bits > 0
    starts = np.append(0, np.cumsum(size))
    out = np.empty(starts[-1], np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[starts[:-1][has] + k] = (numbers[has] >> (7 * k) & 127) | (size[has] > k + 1) * 128
    return out, starts


def unpack(data: bytes) -> np.ndarray:
    """The numbers that pack() made these bytes of."""
    if not data:
        return np.empty(0, np.int64)
    byte = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(byte < 128)
    first = np.append(0, last[:-1] + 1)
    place = np.arange(len(byte)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((byte & 127).astype(np.int64) << (7 * place), first)


class _Shard:
    """Documents of a task until they are written as a shard."""

    def __init__(self, kind: pa.DataType):
        self.kind, self.ids, self.rows, self.terms = kind, [], [], 0
        self.vocabulary = defaultdict(count().__next__)

    def add(self, doc_id, text: bytes | None) -> None:
        found = [np.fromiter(map(self.vocabulary.__getitem__, words), np.int32, len(words)) for words in _pieces(text or b"")]
        number, times = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.int32), np.empty(0, np.int64))
        if not len(number):
            return
        self.ids.append(doc_id)
        self.rows.append((number, times.astype(np.int32)))
        self.terms += int(times.sum())

    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCS or self.terms >= SHARD_TERMS

    def batches(self, name: str) -> Iterator[pa.RecordBatch]:
        order = sorted(range(len(self.ids)), key=lambda n: (self.ids[n] is None, self.ids[n]))
        rows = [self.rows[n] for n in order]
        lengths = np.array([int(times.sum()) for _, times in rows], np.int64)
        term, times = (np.concatenate(x).astype(np.int64) for x in zip(*rows))
        doc = np.repeat(np.arange(len(rows)), [len(x) for x, _ in rows])
        by_term = np.argsort(term, kind="stable")
        term, times, doc = term[by_term], times[by_term], doc[by_term]
        begin = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
        gap = np.diff(doc, prepend=0)
        gap[begin] = doc[begin]
        data, starts = pack(np.stack([gap, times], axis=1).ravel())
        cuts = np.append(starts[2 * begin], starts[-1])
        words = list(self.vocabulary)
        step = max(1, SEND)
        for at in range(0, len(begin), step):
            some = cuts[at : at + step + 1]
            n = len(some) - 1
            offsets = (some - some[0]).astype(np.int32)
            postings = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[some[0] : some[-1]].tobytes())])
            holders = np.diff(np.append(begin, len(term)))[at : at + step]
            yield self._batch(name, pa.array([words[x] for x in term[begin[at : at + step]].tolist()], pa.binary()), pa.array(holders, pa.int64()), postings, [None] * n, [None] * n)
        packed = pack(lengths)[0].tobytes()
        yield self._batch(name, pa.array([None], pa.binary()), pa.array([len(rows)], pa.int64()), pa.array([packed], pa.binary()), [[self.ids[n] for n in order]], [int(lengths.sum())])

    def _batch(self, name, term, holders, data, ids, total) -> pa.RecordBatch:
        columns = [pa.array([name] * len(term), pa.string()), term, holders, data, pa.array(ids, pa.list_(self.kind)), pa.array(total, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["shard", "term", "holders", "data", "ids", "total"])


def _index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number, shard = TaskContext.get().partitionId(), 0, None
    for batch in batches:
        shard = shard or _Shard(batch.column(0).type)
        for doc_id, text in zip(batch.column(0), batch.column(1)):
            shard.add(doc_id.as_py(), text.as_py())
            if shard.full():
                yield from shard.batches(f"{part}-{number}")
                number, shard = number + 1, _Shard(batch.column(0).type)
    if shard and shard.ids:
        yield from shard.batches(f"{part}-{number}")
    give_back()


@dataclass
class Index:
    """A written index: its rows, the documents that have a term, and all their terms with repeats.

    A row with a term has the number of documents of the shard that hold it and their postings; one without has the number of the shard's documents, their lengths, ids and the sum of lengths.
    """

    rows: DataFrame
    documents: int
    terms: int


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Writes the index of all rows and whole texts of docs.

    A row is a document, one with a repeated or null id too; rows without a term (null and empty texts)
    are not in the index. Ids may be of any type that can be put in order. Shards are made where the rows are read, without a shuffle.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    made = rows.mapInArrow(_index_rows, f"shard string, term binary, holders long, data binary, ids array<{kind}>, total long")
    rows = materialize(made.withColumn("term", F.col("term").cast("string")))
    found = rows.where(F.col("term").isNull()).agg(F.sum("holders"), F.sum("total")).first()
    return Index(rows, found[0] or 0, found[1] or 0)


def best_of(lists: list[tuple[Sequence[int], Sequence[int], int]], k: int) -> list[tuple[int, int]]:
    """(score, document) of the k documents with the highest sums above 0, equal ones by the smaller number; lists have ascending documents, their shares, and the greatest of these."""
    lists = sorted(lists, key=itemgetter(2))
    docs, shares, bounds = ([x[n] for x in lists] for n in range(3))
    bounds = list(accumulate(bounds))
    at, aside = [0] * len(lists), 0  # the first `aside` lists have left the merge
    heads = [(x[0], n) for n, x in enumerate(docs)]
    heapq.heapify(heads)
    best: list[tuple[int, int]] = []
    worst = 0
    while heads:
        doc, score = heads[0][0], 0
        while heads and heads[0][0] == doc:
            n = heads[0][1]
            score += shares[n][at[n]]
            at[n] += 1
            if at[n] < len(docs[n]):
                heapq.heapreplace(heads, (docs[n][at[n]], n))
            else:
                heapq.heappop(heads)
        for n in range(aside - 1, -1, -1):
            if score + bounds[n] <= worst:
                break
            at[n] = bisect_left(docs[n], doc, at[n])
            if at[n] < len(docs[n]) and docs[n][at[n]] == doc:
                score += shares[n][at[n]]
        if score > worst:
            if len(best) < k:
                heapq.heappush(best, (score, -doc))
            else:
                heapq.heapreplace(best, (score, -doc))
            if len(best) == k and best[0][0] > worst:
                worst, before = best[0][0], aside
                while aside < len(lists) and bounds[aside] <= worst:
                    aside += 1
                if aside > before:
                    heads = [x for x in heads if x[1] >= aside]
                    heapq.heapify(heads)
    return [(score, -doc) for score, doc in sorted(best, reverse=True)]


def _searcher(k: int, documents: int, terms: int):
    def search(table: pa.Table) -> pa.Table:
        names = table.column("term").to_pylist()
        data = table.column("data")
        head = names.index(None)
        ids = table.column("ids")[head].values
        level = 10 + 90 * unpack(data[head].as_py()) * documents // terms
        lists = defaultdict(list)
        for row, name in enumerate(names):
            if name is None:
                continue
            numbers = unpack(data[row].as_py())
            doc, times = np.cumsum(numbers[::2]), numbers[1::2]
            share = 1_000_000_000 * times // (1000 * times + 8 * level[doc])
            items = table.column("items")[row].as_py()
            share = items[0]["weight"] * share  # a term has one weight
            found = array("q", doc.tobytes()), array("q", share.tobytes()), int(share.max())
            for item in items:
                lists[item["item"]].append(found)
        out = [(item, score, doc) for item, found in lists.items() for score, doc in best_of(found, k)]
        kinds = table.schema.field("items").type.value_type.field("item").type
        return pa.table([pa.array([x for x, _, _ in out], kinds), ids.take(pa.array([x for _, _, x in out], pa.int64())), pa.array([x for _, x, _ in out], pa.int64())], names=["item_id", "doc_id", "score"])

    return search


def search(index: Index, items: DataFrame, k: int = 10, item_id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: for each item the k documents with the highest scores above 0, equal scores by ascending id, null ids last.

    A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))). It adds to a document's score
    weight * (10^9 tf div (1000 tf + 8 m)), where m = 10 + 90 n N div L, for its tf occurrences among the
    document's n terms. Rows of items with the same id are one item with all their terms, once each; items without a term
    have no result, nor has an empty index. Other columns are not read.
    """
    spark = items.sparkSession
    item_kind, doc_kind = items.schema[item_id_col].dataType.simpleString(), index.rows.schema["ids"].dataType.elementType.simpleString()
    schema = f"item_id {item_kind}, doc_id {doc_kind}, score long"
    if not index.documents:
        return spark.createDataFrame([], schema).select("item_id", F.lit(0).alias("rank"), "doc_id", "score")
    asked = items.select(F.col(item_id_col).alias("item"), F.explode(terms_of(F.col(text_col))).alias("term")).distinct()
    blocks = -(-items.count() // BLOCK_ITEMS) or 1
    asked = materialize(asked.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int")))
    few = asked.count() <= 100_000  # rows of a number and a word each
    side = (lambda x: F.broadcast(x)) if few else (lambda x: x)
    held = index.rows.where(F.col("term").isNotNull())
    df = held.join(side(asked.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.sum("holders").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * index.documents + 2) / (2 * F.col("df") + 1))).cast("long")
    weighed = asked.join(df, "term").groupBy("block", "term").agg(F.collect_list(F.struct("item", weight.alias("weight"))).alias("items"))  # BLOCK_ITEMS at most, about
    weighed = materialize(weighed)
    postings = held.select("shard", "term", "data").join(side(weighed), "term").select("shard", "block", "term", "data", F.lit(None).cast(index.rows.schema["ids"].dataType).alias("ids"), "items")
    heads = index.rows.where(F.col("term").isNull()).select("shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "term", "data", "ids", F.lit(None).cast(weighed.schema["items"].dataType).alias("items"))
    found = postings.unionByName(heads).groupBy("shard", "block").applyInArrow(_searcher(k, index.documents, index.terms), schema)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(MERGE_PARTS))
    first = found.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*order))).where(F.col("rank") <= k)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
