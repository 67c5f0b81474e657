"""Near-duplicates by SimHash: exact comparison of fingerprints in tiles.

Fingerprints are cut into blocks. Two of them that differ in at most `radius` bits agree in all
but `radius` blocks, so each choice of the blocks that agree deals the fingerprints into buckets,
and together the buckets hold every pair within the radius. Inside a bucket, fingerprints are
sorted by their number of set bits and compared tile by tile with exclusive-or and bit counts;
pairs of tiles whose bit counts lie further apart than the radius are skipped. A task keeps no
list of pairs, but a forest that connects the linked fingerprints.

Near copies by similarity go the same way with a wider radius. No choice of blocks serves there, so
buckets come from bits drawn at random from a longer fingerprint, in as many tables as a pair at the
least similarity needs to share a bucket. What such links reach is a candidate group, whose documents
are compared by the exact similarity of their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import acos, ceil, comb, log, log2, pi

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .workspace import join_groups, materialize, small_batches, tidy

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
TILE = 1024
#: A bucket of more fingerprints is dealt out over several tasks; one of at most so many is compared in one go with others.
BUCKET, FEW = 20_000, 128

#: Words in a shingle of near copies, and their least similarity, as a fraction so that it is compared in whole numbers.
NEAR_WORDS, LEAST = 5, (4, 5)
#: Words of 64 bits of a fingerprint that near copies draw their buckets from; the first two are compared.
NEAR_PRINTS = 8
#: Bits in which the first words, and the first two together, of candidates differ at most. At the least similarity
#: 9.7 and 19.4 are expected to differ; more do for 4 pairs in 10,000 and 1 in 1,000.
NEAR_RADII = (20, 32)
#: Share of pairs at the least similarity that may lie in no common bucket, and fingerprints in a bucket on average.
MISSED, BUCKET_PRINTS = 0.005, 64
#: Documents in a part of a group, up to FEW_PARTS parts and beyond, and shingles in a part.
SMALL_PART, FEW_PARTS, PART, PART_SHINGLES = 256, 8, 2048, 1_000_000
#: Ids up to which these are broadcast.
FEW_IDS = 200_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def _majority(hashes: np.ndarray) -> int:
    """Each bit that is set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    for i in range(0, len(bits), 255):
        counts += bits[i : i + 255].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def shingle_hashes(text: str | None, words_each: int) -> np.ndarray:
    """Hashes of a text's word shingles, one for the whole of a shorter text, none for a text without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= words_each:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts = [0, *[x + 1 for x in ends]]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[words_each - 1 :])), np.uint64, len(words) - words_each + 1)


def fingerprint(text: str | None, words_each: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles, repeats included; 0 for a text without words."""
    hashes = shingle_hashes(text, words_each)
    return _majority(hashes) if len(hashes) > 1 else int(hashes.sum())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id and the fingerprint `fp` as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.array([fingerprint(x, words_each) for x in batch["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": found.view(np.int64)})

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(tidy(run), f"doc_id {kind}, fp long")


def block_masks(rows: int, radius: int = RADIUS) -> list[int]:
    """Masks of the bits that agree, one for each choice of blocks; more and narrower choices for more rows."""

    def cost(blocks: int) -> float:
        return comb(blocks, radius) * (3000 + rows / 2 ** (64 * (blocks - radius) / blocks))

    blocks = min(range(radius + 1, radius + 6), key=cost)
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    each = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [sum(x) for x in combinations(each, blocks - radius)]


def _joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merges the classes of linked items; a class is named by its smallest index."""
    while True:
        x, y = labels[a], labels[b]
        if (x == y).all():
            return labels
        low = np.minimum(x, y)
        np.minimum.at(labels, x, low)
        np.minimum.at(labels, y, low)
        while not (labels == (up := labels[labels])).all():
            labels = up


def linked_classes(prints: np.ndarray, radius: int = RADIUS, others: np.ndarray | None = None, total: int = 128, tile: int = TILE) -> np.ndarray:
    """For each fingerprint the index of the first one, in order of set bits, that links reach; with other words of the fingerprints, both words may differ in `total` bits."""
    weight = np.bitwise_count(prints)
    order = np.argsort(weight, kind="stable")
    prints, weight = prints[order], weight[order].astype(np.int64)
    others = None if others is None else others[order]
    labels = np.arange(len(prints))
    for i in range(0, len(prints), tile):
        left = prints[i : i + tile]
        for j in range(i, len(prints), tile):
            if weight[j] - weight[min(i + tile, len(prints)) - 1] > radius:
                break
            differ = np.bitwise_count(left[:, None] ^ prints[None, j : j + tile])
            a, b = np.nonzero(differ <= radius)
            if others is not None:
                near = differ[a, b] + np.bitwise_count(others[a + i] ^ others[b + j]) <= total
                a, b = a[near], b[near]
            labels = _joined(labels, a + i, b + j)
    out = np.empty(len(prints), np.int64)
    out[order] = order[labels]
    return out


def _close_in_runs(prints: np.ndarray, others: np.ndarray | None, ends: np.ndarray, radius: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked places of fingerprints whose bucket, which ends at `ends`, is small: each is compared with the next, the one after it, and so on."""
    at, ahead, left, right = np.arange(len(prints)), 1, [], []
    while len(at := at[at + ahead < ends[at]]):
        differ = np.bitwise_count(prints[at] ^ prints[at + ahead])
        near = at[differ <= radius]
        if others is not None and len(near):
            near = near[np.bitwise_count(prints[near] ^ prints[near + ahead]) + np.bitwise_count(others[near] ^ others[near + ahead]) <= total]
        left.append(near)
        right.append(near + ahead)
        ahead += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (at, at)


def _forest(radius: int, total: int):
    """Links between rows sorted by bucket, and not more of them than rows."""

    def links(rows: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
        nodes, prints = rows["doc"].to_numpy(), rows["fp"].to_numpy().view(np.uint64)
        others = rows["fp2"].to_numpy().view(np.uint64) if "fp2" in rows else None
        sizes = np.diff(cuts)
        labels = np.arange(len(rows))
        for k in np.flatnonzero(sizes > FEW):
            own = slice(cuts[k], cuts[k + 1])
            labels[own] = cuts[k] + linked_classes(prints[own], radius, None if others is None else others[own], total)
        ends = np.repeat(np.where(sizes > FEW, 0, cuts[1:]), sizes)
        labels = _joined(labels, *_close_in_runs(prints, others, ends, radius, total))
        own = labels != np.arange(len(labels))
        return pd.DataFrame({"a": nodes[own], "b": nodes[labels[own]]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # the last bucket may go on in the next batch
        for batch in batches:
            if not len(batch):
                continue
            at = batch[["bucket", "i", "j"]].to_numpy()
            changes = np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1
            if held and (held[-1][["bucket", "i", "j"]].iloc[-1].to_numpy() == at[0]).all() and not len(changes):
                held.append(batch)
                continue
            rows = pd.concat([*held, batch], ignore_index=True) if held else batch
            at = rows[["bucket", "i", "j"]].to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1])
            if len(cuts) > 1:
                yield links(rows.iloc[: cuts[-1]], cuts)
            held = [rows.iloc[cuts[-1] :]]
        if held:
            rows = pd.concat(held, ignore_index=True)
            yield links(rows, np.array([0, len(rows)]))

    return tidy(run)


def _linked(keyed: DataFrame, radius: int, total: int = 128, bucket: int | None = None) -> DataFrame:
    """Links (a, b) between documents of the table (bucket, doc, fp, perhaps fp2), enough to connect all in a bucket that are within the radius."""
    bucket = bucket or BUCKET
    large = materialize(keyed.groupBy("bucket").count().where(F.col("count") > bucket).withColumn("parts", F.ceil(F.col("count") / bucket).cast("int")).drop("count"))
    if large.isEmpty():
        cells = keyed.withColumns({"i": F.lit(0), "j": F.lit(0)})
    else:
        few = large.count() <= FEW_IDS
        dealt = keyed.join(F.broadcast(large) if few else large, "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        dealt = dealt.withColumn("part", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        cells = dealt.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")}).drop("parts", "part", "other")
    order = ["bucket", "i", "j"]
    small_batches(keyed.sparkSession)
    return cells.repartition(*order).sortWithinPartitions(*order).mapInPandas(_forest(radius, total), "a long, b long")


def near_links(prints: DataFrame, rows: int, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between documents of the table (fp, doc) of distinct fingerprints, enough to connect all within the radius."""
    masks = [x - (1 << 64) if x >> 63 else x for x in block_masks(rows, radius)]
    bucket = F.explode(F.array(*[F.xxhash64(F.lit(n), F.col("fp").bitwiseAND(F.lit(x))) for n, x in enumerate(masks)]))
    return _linked(prints.select("fp", "doc", bucket.alias("bucket")), radius)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id.

    Fingerprints link when at most `radius` bits differ; a component is named by the smallest id
    that links reach. Null and empty texts have fingerprint zero and link like any other. A row
    with a null id links nothing and gets the component of its fingerprint, null if it has no other
    document. Repeated rows are kept. An empty table gives an empty result. Ids are of a whole-number
    type. Whole texts count, and other columns are not read.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, words_each))
    prints = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("copies")))
    count, total = prints.agg(F.count(F.lit(1)), F.sum("copies")).first()
    links = near_links(prints.where(F.col("doc").isNotNull()).select("fp", "doc"), count, radius)
    found = components(links)
    named = prints.join(found, prints["doc"] == found["node"], "left").select("fp", "copies", F.coalesce("component", "doc").alias("component_id"))
    joined = join_groups(rows, materialize(named), "fp", "copies", total or 0)
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def bits_and_tables(rows: int) -> tuple[int, int]:
    """Bits of a bucket's key, by the number of fingerprints, and the tables by which a pair at the least similarity shares a bucket but for MISSED."""
    bits = min(28, max(8, round(log2(max(1, rows) / BUCKET_PRINTS))))
    alike = 2 * LEAST[0] / (LEAST[0] + LEAST[1])  # the cosine of two sets of one size at that similarity
    return bits, ceil(log(MISSED) / log(1 - (1 - acos(alike) / pi) ** bits))


def long_fingerprint(found: np.ndarray) -> np.ndarray:
    """NEAR_PRINTS words of SimHash, each from other hashes of the same shingles."""
    return np.array([_majority(_mixed(found + np.uint64(n))) for n in range(NEAR_PRINTS)], np.uint64)


def shingle_set(text: str | None, words_each: int = NEAR_WORDS) -> np.ndarray:
    """Different hashes of a text's shingles, in order; none for a text without words."""
    return np.unique(shingle_hashes(text, words_each))


def _described(words_each: int, bits: int, tables: int):
    drawn = np.array([np.random.default_rng(n).choice(64 * NEAR_PRINTS, bits, replace=False) for n in range(tables)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                found = shingle_set(text, words_each)
                k1, k2 = (np.bitwise_xor.reduce(_mixed(found + np.uint64(x)), initial=np.uint64(len(found))) for x in (101, 102))
                prints = long_fingerprint(found)
                keys = np.unpackbits(prints.view(np.uint8), bitorder="little")[drawn] @ (1 << np.arange(bits))
                first, second = prints[:2].view(np.int64).tolist()
                rows.append((k1.view(np.int64), k2.view(np.int64), len(found), first, second, keys.astype(np.int32) if len(found) else []))
            yield pd.DataFrame(rows, columns=["k1", "k2", "n", "fp", "fp2", "buckets"]).assign(doc_id=batch["doc_id"].to_numpy())

    return tidy(run)


def similar_classes(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the index of the first one that links reach; every pair that may link is compared exactly."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    order = np.argsort(size, kind="stable")
    size, start = size[order], np.append(0, np.cumsum(size[order]))
    code = np.unique(np.concatenate([sets[x] for x in order]), return_inverse=True)[1]
    held = np.zeros(int(code.max()) + 1 if len(code) else 1, bool)
    labels = np.arange(len(sets))
    for i in range(len(sets)):
        end = int(np.searchsorted(size, size[i] * LEAST[1] // LEAST[0], side="right"))  # larger ones are less alike
        if end <= i + 1 or (labels[i:end] == labels[i]).all():
            continue
        held[code[start[i] : start[i + 1]]] = True
        common = np.add.reduceat(held[code[start[i + 1] : start[end]]], start[i + 1 : end] - start[i + 1], dtype=np.int64)
        held[code[start[i] : start[i + 1]]] = False
        near = np.flatnonzero(LEAST[1] * common >= LEAST[0] * (size[i] + size[i + 1 : end] - common)) + i + 1
        labels = _joined(labels, np.full(len(near), i), near)
    out = np.empty(len(sets), np.int64)
    out[order] = order[labels]
    return out


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    keys = ["component", "i", "j"]

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        nodes = rows["doc"].to_numpy()
        root = similar_classes([np.frombuffer(x, np.uint64) for x in rows["shingles"]])
        own = root != np.arange(len(root))
        return pd.DataFrame({"a": nodes[own], "b": nodes[root[own]]})

    held = None
    for batch in batches:  # sorted by cell; the last cell may go on in the next batch
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        at = rows[keys].to_numpy()
        cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1), len(rows)]
        for a, b in zip(cuts, cuts[1:-1]):
            if b - a > 1:
                yield links(rows.iloc[a:b])
        held = rows.iloc[cuts[-2] :]
    if held is not None and len(held) > 1:
        yield links(held)


def _candidates(groups: DataFrame) -> DataFrame:
    """node, component of the documents that a link within NEAR_RADII connects, directly or over others."""
    keyed = groups.where("n > 0").select("doc", "fp", "fp2", F.posexplode("buckets").alias("table", "key"))
    keyed = keyed.select("doc", "fp", "fp2", (F.shiftleft(F.col("table").cast("long"), 32) + F.col("key")).alias("bucket"))
    return components(_linked(keyed, *NEAR_RADII))


def _hashed(words_each: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.drop(columns="text").assign(shingles=[shingle_set(x, words_each).tobytes() for x in batch["text"]]).query("shingles != b''")

    return run


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = NEAR_WORDS) -> DataFrame:
    """doc_id, component_id of the documents that have a near copy; a component is named by the smallest id that links reach.

    Two documents link if their sets of lower-case word shingles have a Jaccard similarity of LEAST
    or more; texts of fewer words are one shingle, and texts without words, null ones included, are
    alike. By calculation a pair at 0.8 is looked at but for 7 in 1,000, a more alike one more
    surely. A null id has no near copy. Rows that repeat an id are kept. Ids are of a whole-number
    type. An empty table gives an empty result. Whole texts count, and other columns are not read.
    """
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    small_batches(docs.sparkSession)
    described = texts.mapInPandas(_described(words_each, *bits_and_tables(texts.count())), "doc_id long, k1 long, k2 long, n long, fp long, fp2 long, buckets array<int>")
    rows = materialize(described.withColumn("key", F.struct("k1", "k2")).drop("k1", "k2"))
    groups = materialize(rows.groupBy("key").agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("copies"), *[F.first(x).alias(x) for x in ("n", "fp", "fp2", "buckets")]))
    found = materialize(_candidates(groups))
    sized = found.join(groups.select(F.col("doc").alias("node"), "n"), "node").groupBy("component").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n"))
    parts = F.greatest(F.least(F.ceil(F.col("docs") / SMALL_PART), F.lit(FEW_PARTS)), F.ceil(F.col("docs") / PART), F.ceil(F.col("n") / PART_SHINGLES)).cast("int")
    sized = materialize(sized.select("component", parts.alias("parts"), "docs"))
    placed = materialize(join_groups(found, sized, "component", "docs", found.count()).select(F.col("node").alias("doc"), "component", "parts"))
    few = placed.count() <= FEW_IDS
    sent = texts.withColumnRenamed("doc_id", "doc").join(F.broadcast(placed) if few else placed, "doc")
    sent = sent.mapInPandas(tidy(_hashed(words_each)), "doc long, component long, parts int, shingles binary")
    sent = sent.withColumn("part", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    order = ["component", "i", "j"]
    cells = sent.select("doc", "component", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "shingles")
    cells = cells.repartition(*order).sortWithinPartitions(*order)
    linked = components(cells.mapInPandas(tidy(_verified), "a long, b long"))
    named = groups.join(linked, groups["doc"] == linked["node"], "left").where((F.col("copies") > 1) | F.col("component").isNotNull())
    named = materialize(named.select("key", "copies", F.coalesce("component", "doc").alias("component_id")))
    total = named.agg(F.sum("copies")).first()[0] or 0
    return join_groups(rows.select("doc_id", "key"), named, "key", "copies", total).select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one, of the smallest id, of each component of near_copies(), with all their columns.

    A document with a null id stays, as do all rows that repeat the id that stays. Texts without
    words are copies of one another. An empty table gives an empty result.
    """
    found = near_copies(docs, id_col, text_col)
    dropped = materialize(found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(id_col)).distinct())
    return docs.join(F.broadcast(dropped) if dropped.count() <= FEW_IDS else dropped, id_col, "left_anti").select(docs.columns)
