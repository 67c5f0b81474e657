"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word comes in as an embedding of its own, if it is in the vocabulary, beside the mean of the
embeddings of its character n-grams. Two gated recurrent layers read a window of words forwards and
backwards, attention pools their states, and a logistic unit scores the window. A text's score is
that of its highest window, of overlapping windows over the whole text. The network is fitted on a
bounded sample of labelled documents; as labels are of documents, each round learns from the window
of a document that the network then ranks highest.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import small_batches, tidy

WINDOW, STRIDE = 64, 48
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 12, 12, 8, 8
CHAR_BUCKETS = 1 << 13
GRAMS = (3, 4)
#: Largest vocabulary, and in how many documents of the sample a word or a bucket of n-grams must occur to have an embedding of its own.
VOCABULARY, LEAST_DOCS = 20_000, 3
#: Documents of label 0 and 1 that the network is fitted on, whole, and characters of all of a label together.
SAMPLE_DOCS, SAMPLE_CHARS = (1600, 600), (8_000_000, 6_000_000)
ROUNDS, STEPS, BATCH, RATE, DECAY, DROPPED = 6, 300, 64, 0.01, 0.02, 0.15
#: Share of the sample by which scores are set so that THRESHOLD parts the labels best.
HELD_BACK = 0.2
#: Words whose inputs are remembered, and windows scored at once.
REMEMBERED, AT_ONCE = 200_000, 1024
THRESHOLD = 0.3

#: Bytes that part words.
_BREAKS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint64)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words; ASCII punctuation and spaces part them. Digits belong to them, but digits alone are no word."""
    return [w for w in (text or "").lower().encode().translate(_BREAKS).split() if not w.isdigit()]


def gram_buckets(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of all words, and the number of n-grams of each."""
    marked = [b"^" + w + b"$" for w in words]
    chars = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64) + np.uint64(1)
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    starts = np.cumsum(sizes) - sizes
    counts = sum(np.maximum(sizes - n + 1, 1 if n == GRAMS[0] else 0) for n in GRAMS)
    owner = np.repeat(np.arange(len(words)), counts)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    first = np.maximum(sizes - GRAMS[0] + 1, 1)[owner]
    longer = place >= first
    at = starts[owner] + np.where(longer, place - first, place)
    found = np.full(len(owner), 17, np.uint64)
    for k in range(GRAMS[1]):
        used = longer | (k < GRAMS[0])
        char = chars[np.minimum(at + k, len(chars) - 1)] if len(chars) else np.zeros(0, np.uint64)
        found += np.where(used, char * _MULTIPLIERS[k], np.uint64(0))
    found = (found ^ (found >> np.uint64(15))) * np.uint64(0x2C1B3C6D)
    return ((found >> np.uint64(12)) % np.uint64(CHAR_BUCKETS)).astype(np.int64), counts


def windows_of(count: int) -> list[tuple[int, int]]:
    """Beginning and end of each window over so many words; the last one ends with the text."""
    if count <= WINDOW:
        return [(0, count)] if count else []
    starts = list(range(0, count - WINDOW, STRIDE)) + [count - WINDOW]
    return [(x, x + WINDOW) for x in starts]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters, forward and backward pass."""

    def __init__(self, vocabulary: dict[bytes, int], known: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.vocabulary = vocabulary
        self.known = known  # for each bucket of n-grams itself, or 0 for one that is too rare

        def drawn(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(shape[0] if len(shape) > 1 else 1)).astype(np.float32)

        wide = WORD_DIM + CHAR_DIM
        self.p = {"word": drawn(len(vocabulary) + 1, WORD_DIM) * np.float32(np.sqrt(len(vocabulary) + 1) * 0.1), "char": drawn(CHAR_BUCKETS, CHAR_DIM) * np.float32(np.sqrt(CHAR_BUCKETS) * 0.1)}
        for way in ("f", "b"):
            self.p |= {f"W{way}": drawn(wide, 3 * HIDDEN), f"U{way}": drawn(HIDDEN, 3 * HIDDEN), f"c{way}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"A": drawn(2 * HIDDEN, ATTENTION), "a": np.zeros(ATTENTION, np.float32), "v": drawn(ATTENTION), "o": drawn(2 * HIDDEN) * np.float32(0.3), "k": np.zeros(1, np.float32)}

    def vectors(self, index: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Input vectors of words, by their places in the vocabulary and their buckets of n-grams."""
        if not len(index):
            return np.zeros((0, WORD_DIM + CHAR_DIM), np.float32)
        chars = np.add.reduceat(self.p["char"][grams], np.cumsum(counts) - counts, axis=0) / counts[:, None].astype(np.float32)
        return np.concatenate([self.p["word"][index], chars], axis=1).astype(np.float32)

    def looked_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        grams, counts = gram_buckets(words)
        return np.fromiter((self.vocabulary.get(w, 0) for w in words), np.int64, len(words)), self.known[grams], counts

    def inputs(self, words: list[bytes]) -> np.ndarray:
        """What distinct words put into the gates of both layers."""
        x = self.vectors(*self.looked_up(words))
        return np.concatenate([x @ self.p["Wf"] + self.p["cf"], x @ self.p["Wb"] + self.p["cb"]], axis=1)

    def _layer(self, gates: np.ndarray, mask: np.ndarray, u: np.ndarray, backwards: bool, keep: bool) -> tuple[np.ndarray, list]:
        count, length = mask.shape
        h, states, saved = np.zeros((count, HIDDEN), np.float32), np.empty((length, count, HIDDEN), np.float32), []
        for t in range(length - 1, -1, -1) if backwards else range(length):
            inner = h @ u
            zr = _sigmoid(gates[t][:, : 2 * HIDDEN] + inner[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(gates[t][:, 2 * HIDDEN :] + r * inner[:, 2 * HIDDEN :])
            new = (n + z * (h - n)) * mask[:, t, None]
            if keep:
                saved.append((t, h, z, r, n, inner[:, 2 * HIDDEN :]))
            h = states[t] = new
        return states, saved

    def forward(self, gates: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """Logits of windows; gates is by place, window and gate."""
        p = self.p
        ahead, back = np.ascontiguousarray(gates[:, :, : 3 * HIDDEN]), np.ascontiguousarray(gates[:, :, 3 * HIDDEN :])
        left, saved_left = self._layer(ahead, mask, p["Uf"], False, keep)
        right, saved_right = self._layer(back, mask, p["Ub"], True, keep)
        out = np.concatenate([left, right], axis=2)
        look = np.tanh(out @ p["A"] + p["a"])
        weight = look @ p["v"] + np.where(mask.T > 0, 0, -1e9).astype(np.float32)
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = (weight[:, :, None] * out).sum(axis=0)
        return pooled @ p["o"] + p["k"], (saved_left, saved_right, out, look, weight, pooled)

    def _layer_back(self, d_states: np.ndarray, saved: list, mask: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d_gates, d_u = np.empty((len(d_states), mask.shape[0], 3 * HIDDEN), np.float32), np.zeros_like(u)
        d_h = np.zeros((mask.shape[0], HIDDEN), np.float32)
        for t, h, z, r, n, inner in reversed(saved):
            d = (d_states[t] + d_h) * mask[:, t, None]
            d_n = d * (1 - z) * (1 - n * n)
            d_z = d * (h - n) * z * (1 - z)
            d_r = d_n * inner * r * (1 - r)
            d_inner = np.concatenate([d_z, d_r, d_n * r], axis=1)
            d_gates[t] = np.concatenate([d_z, d_r, d_n], axis=1)
            d_u += h.T @ d_inner
            d_h = d * z + d_inner @ u.T
        return d_gates, d_u

    def gradients(self, index: np.ndarray, grams: np.ndarray, counts: np.ndarray, ids: np.ndarray, mask: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weighted logistic loss; ids are places in the words looked up, by window and place."""
        p = self.p
        x = self.vectors(index, grams, counts)
        proj = np.concatenate([x @ p["Wf"] + p["cf"], x @ p["Wb"] + p["cb"]], axis=1)
        logits, (left, right, out, look, weight, pooled) = self.forward(proj[ids.T], mask, keep=True)
        d = ((_sigmoid(logits) - labels) * weights / len(labels)).astype(np.float32)
        g = {"o": pooled.T @ d, "k": d.sum(keepdims=True)}
        d_pooled = d[:, None] * p["o"]
        d_out = weight[:, :, None] * d_pooled
        d_weight = (out * d_pooled).sum(axis=2)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["v"] = np.einsum("tba,tb->a", look, d_score)
        d_look = d_score[:, :, None] * p["v"] * (1 - look * look)
        g["A"], g["a"] = np.einsum("tbo,tba->oa", out, d_look), d_look.sum(axis=(0, 1))
        d_out = d_out + d_look @ p["A"].T
        d_left, g["Uf"] = self._layer_back(d_out[:, :, :HIDDEN], left, mask, p["Uf"])
        d_right, g["Ub"] = self._layer_back(d_out[:, :, HIDDEN:], right, mask, p["Ub"])
        d_proj = _summed(np.concatenate([d_left, d_right], axis=2).reshape(-1, 6 * HIDDEN), ids.T.ravel(), len(proj))
        d_f, d_b = d_proj[:, : 3 * HIDDEN], d_proj[:, 3 * HIDDEN :]
        g |= {"Wf": x.T @ d_f, "Wb": x.T @ d_b, "cf": d_f.sum(axis=0), "cb": d_b.sum(axis=0)}
        d_x = d_f @ p["Wf"].T + d_b @ p["Wb"].T
        g["word"] = _summed(d_x[:, :WORD_DIM], index, len(p["word"]))
        g["char"] = _summed(np.repeat(d_x[:, WORD_DIM:] / counts[:, None].astype(np.float32), counts, axis=0), grams, len(p["char"]))
        return g


def _summed(rows: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows by their place."""
    out = np.zeros((size, rows.shape[1]), np.float32)
    order = np.argsort(at, kind="stable")
    place, first = np.unique(at[order], return_index=True)
    out[place] = np.add.reduceat(rows[order], first, axis=0)
    return out


class Scorer:
    """Scores texts, and remembers the inputs of words."""

    def __init__(self, network: Network):
        self.network = network
        self.places: dict[bytes, int] = {}
        self.inputs = np.empty((0, 6 * HIDDEN), np.float32)

    def ids(self, words: list[bytes]) -> np.ndarray:
        try:
            return np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))
        except KeyError:
            new = list(set(words).difference(self.places))
            self.places.update(zip(new, range(len(self.places), len(self.places) + len(new))))
            if len(self.places) > len(self.inputs):
                grown = np.empty((max(2 * len(self.inputs), len(self.places) + 1024), 6 * HIDDEN), np.float32)
                grown[: len(self.inputs)] = self.inputs
                self.inputs = grown
            self.inputs[len(self.places) - len(new) : len(self.places)] = self.network.inputs(new)
            return np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))

    def windows(self, parts: list[np.ndarray]) -> np.ndarray:
        """Scores of windows, each given by the ids of its words."""
        out = np.empty(len(parts), np.float64)
        order = sorted(range(len(parts)), key=lambda i: len(parts[i]))
        for i in range(0, len(order), AT_ONCE):
            some = order[i : i + AT_ONCE]
            length = len(parts[some[-1]])
            ids, mask = np.zeros((len(some), length), np.int64), np.zeros((len(some), length), np.float32)
            for row, k in enumerate(some):
                ids[row, : len(parts[k])] = parts[k]
                mask[row, : len(parts[k])] = 1
            logits, _ = self.network.forward(self.inputs[ids.T], mask)
            out[some] = _sigmoid(logits)
        return out

    def texts(self, texts: list[str | None]) -> np.ndarray:
        """The score of each text: its highest window; 0 for one without words."""
        out, parts, owners = np.zeros(len(texts)), [], []

        def settle() -> None:
            np.maximum.at(out, owners, self.windows(parts))
            parts.clear()
            owners.clear()

        for n, text in enumerate(texts):
            if len(self.places) > REMEMBERED:
                settle()
                self.places.clear()
            ids = self.ids(words_of(text))
            for a, b in windows_of(len(ids)):
                parts.append(ids[a:b])
                owners.append(n)
                if len(parts) >= 8 * AT_ONCE:
                    settle()
        settle()
        return out


def _telling(doc_ids: list[np.ndarray], y: np.ndarray, words: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """A first rank of windows: by their word that most tells documents of label 1 from the others."""
    counts = np.zeros((2, words))
    for ids, label in zip(doc_ids, y):
        counts[int(label), np.unique(ids)] += 1
    share = y.sum() / len(y)
    excess = (counts[1] - share * counts.sum(axis=0)) / np.sqrt(counts.sum(axis=0) + 1)
    return np.array([excess[doc_ids[n][a:b]].max() for n, a, b in spans])


def fit(texts: list[str], labels: list[int], seed: int = 7) -> Network | float:
    """A network for these labelled texts, or the share of label 1 if there is but one label.

    Part of the sample is held back, and the scores are shifted so that THRESHOLD parts its labels best.
    """
    y = np.array(labels)
    if len(y) == 0 or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.0
    back = np.zeros(len(y), bool)
    for label in (0, 1):
        own = np.random.default_rng(seed).permutation(np.flatnonzero(y == label))
        back[own[: int(HELD_BACK * len(own))]] = True
    network = _fitted([x for x, b in zip(texts, back) if not b], y[~back].tolist(), seed)
    found = Scorer(network).texts([x for x, b in zip(texts, back) if b])
    logits = np.log(np.clip(found, 1e-7, 1 - 1e-7) / (1 - np.clip(found, 1e-7, 1 - 1e-7)))
    ranked = np.sort(logits)
    cuts = (ranked[1:] + ranked[:-1]) / 2
    if len(cuts) and y[back].min() != y[back].max():
        errors = np.array([((logits >= c) != (y[back] == 1)).sum() for c in cuts])
        best = cuts[errors == errors.min()]
        network.p["k"] += np.float32(np.log(THRESHOLD / (1 - THRESHOLD)) - (0.3 * best.min() + 0.7 * best.max()))
    return network


def _fitted(texts: list[str], labels: list[int], seed: int) -> Network:
    y = np.array(labels, np.float32)
    split = [words_of(x) for x in texts]
    docs_of = Counter(w for x in split for w in dict.fromkeys(x))  # in the order of texts, so that reruns agree
    common = [w for w, n in docs_of.most_common(VOCABULARY) if n >= LEAST_DOCS]
    words = list(docs_of)
    place = {w: n for n, w in enumerate(words)}
    grams, counts = gram_buckets(words)
    starts = np.cumsum(counts) - counts
    doc_ids = [np.fromiter(map(place.__getitem__, x), np.int64, len(x)) for x in split]
    seen = np.zeros(CHAR_BUCKETS, np.int64)
    for ids in doc_ids:
        at, _ = _members(np.unique(ids), starts, counts)
        seen[np.unique(grams[at])] += 1
    network = Network({w: n for n, w in enumerate(common, 1)}, np.where(seen >= LEAST_DOCS, np.arange(CHAR_BUCKETS), 0), seed)
    grams = network.known[grams]
    index = np.fromiter((network.vocabulary.get(w, 0) for w in words), np.int64, len(words))
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in network.p.items()}
    second = {k: np.zeros_like(v) for k, v in network.p.items()}
    weight = np.where(y > 0, 2.0, 1.0)
    spans = [(n, a, b) for n, x in enumerate(split) for a, b in windows_of(len(x))]
    owner = np.array([n for n, _, _ in spans])
    step = 0
    rounds = max(ROUNDS, -(-STEPS * BATCH // max(1, 3 * len(texts))))
    for turn in range(rounds):
        scorer = Scorer(network)
        scorer.inputs = network.inputs(words)
        rank = _telling(doc_ids, y, len(words), spans) if turn == 0 else scorer.windows([doc_ids[n][a:b] for n, a, b in spans])
        order = np.lexsort((-rank, owner))
        best = order[np.unique(owner[order], return_index=True)[1]]
        clean = np.flatnonzero(y[owner] == 0)
        hard = clean[np.argsort(-rank[clean])[: len(best)]]
        others = np.concatenate([hard, rng.permutation(clean)[: len(best)]])
        examples = rng.permutation(np.concatenate([best, others]))
        for i in range(0, len(examples), BATCH):
            batch = [spans[k] for k in examples[i : i + BATCH]]
            length = max(b - a for _, a, b in batch)
            ids, mask = np.zeros((len(batch), length), np.int64), np.zeros((len(batch), length), np.float32)
            for row, (n, a, b) in enumerate(batch):
                ids[row, : b - a] = doc_ids[n][a:b]
                mask[row, : b - a] = rng.random(b - a) >= DROPPED  # words left out, so that no single one is learned by heart
            mask[:, 0] = 1
            some, local = np.unique(ids, return_inverse=True)
            at, each = _members(some, starts, counts)
            owners = [n for n, _, _ in batch]
            step += 1
            rate = RATE * (1 - 0.9 * turn / rounds) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, g in network.gradients(index[some], grams[at], each, local.reshape(ids.shape), mask, y[owners], weight[owners]).items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                network.p[k] -= (rate * (first[k] / (np.sqrt(second[k]) + 1e-7) + DECAY * network.p[k])).astype(np.float32)
    return network


def _members(groups: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the members of these groups, one group after another, and the groups' sizes."""
    each = counts[groups]
    first = np.cumsum(each) - each
    return np.repeat(starts[groups] - first, each) + np.arange(each.sum()), each


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Network | float:
    """Fits the network on at most SAMPLE_DOCS labelled documents of each label, drawn by a hash of their id.

    Documents count whole: in the order of the draw those are taken that still fit into SAMPLE_CHARS, so
    one longer than that is never in the sample. Of rows with one id one is drawn. Null texts, labels and ids have no part in
    it; without any label every score is 0.
    """
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.when(F.col(label_col) > 0, 1).otherwise(0)).alias("label"))
    marked = marked.withColumn("draw", F.xxhash64(F.col("doc_id").cast("string")))
    sizes = {row["label"]: row["count"] for row in marked.groupBy("label").count().collect()}
    drawn = None
    for label, size in sorted(sizes.items()):
        some = marked.where((F.col("label") == label) & (F.pmod("draw", F.lit(max(1, size // (3 * SAMPLE_DOCS[label])))) == 0)).orderBy("draw").limit(2 * SAMPLE_DOCS[label])
        drawn = some if drawn is None else drawn.unionByName(some)
    if drawn is None:
        return 0.0
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("digest"))
    one = texts.join(F.broadcast(drawn), "doc_id").groupBy("label", "draw", "doc_id").agg(F.min(F.struct("digest", F.length("text").alias("chars"))).alias("t"))
    chosen, taken, chars = [], Counter(), Counter()
    for row in one.select("label", "draw", "doc_id", "t.digest", "t.chars").orderBy("draw", "digest").collect():  # twice SAMPLE_DOCS rows at most
        label, more = row["label"], row["chars"]
        if taken[label] < SAMPLE_DOCS[label] and chars[label] + more <= SAMPLE_CHARS[label]:
            chosen.append((row["doc_id"], row["digest"], label, len(chosen)))
            taken[label] += 1
            chars[label] += more
    if not chosen:
        return 0.0
    kind = docs.schema[id_col].dataType.simpleString()
    wanted = docs.sparkSession.createDataFrame(chosen, f"doc_id {kind}, digest long, label int, n int")
    found = texts.join(F.broadcast(wanted), ["doc_id", "digest"]).dropDuplicates(["n"]).orderBy("n").collect()  # SAMPLE_DOCS texts of SAMPLE_CHARS in all
    return fit([row["text"] for row in found], [row["label"] for row in found])


def score(docs: DataFrame, network: Network | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, score, predicted.

    The score, from 0 to 1, is that of the highest of all overlapping windows of the whole text; a
    text that is null, empty or without words has none and scores 0. If only one label was learned,
    every score is the share of label 1. predicted is 1 from THRESHOLD. Repeated rows are kept, an
    empty table gives an empty result, and other columns are not read.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = None if isinstance(held.value, float) else Scorer(held.value)
        for batch in batches:
            found = np.full(len(batch), held.value) if scorer is None else scorer.texts(batch["text"].tolist())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": found, "predicted": (found >= THRESHOLD).astype(np.int32)})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(tidy(run), f"doc_id {kind}, score double, predicted int")
