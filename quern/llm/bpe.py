"""Byte-pair encoding by a tokenization automaton.

The automaton reads tokens. It begins with one state and an arc for each byte, and takes in the
merges one after another: the gadget of a merge (u, v) -> w gives w the arcs into it that u has,
lets w lead to a copy of v's state, and takes the arc v from u's state, which from then on is a
state of its own. What it accepts in the end are exactly the sequences that the merges produce, and
every text has one such sequence. States are held as bit rows over classes of arcs that no state
tells apart. To encode, arcs are spelt out in bytes and the result made deterministic as far as
words need it: a configuration holds the arcs under way, each with the state that it left, and the
arc that has just ended. A word runs forward through the table of configurations, one step a byte,
and the arcs that ended along its way are its tokens. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import os
import pickle
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import BYTE_PIECES, PieceMemory, is_plain
from .workspace import small_batches, tidy

#: Configurations, and encoded words, that a Python worker remembers; beyond, it begins anew.
MOST_CONFIGURATIONS, MOST_WORDS = 1 << 17, 150_000

_compiled: dict[str, dict] = {}


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(rest)}


def _classes(columns: np.ndarray) -> np.ndarray:
    """The first of the equal columns of each column, found by hashes and then compared bit by bit."""
    rng = np.random.default_rng(1)
    found = np.zeros(columns.shape[1], np.uint64)
    for row, odd in zip(columns, rng.integers(0, 1 << 63, len(columns), np.uint64) * np.uint64(2) + np.uint64(1)):
        mixed = (row ^ (row >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        found += (mixed ^ (mixed >> np.uint64(29))) * odd
    _, first, group = np.unique(found, return_index=True, return_inverse=True)
    first = first[group]
    if not all((row == row[first]).all() for row in columns):
        raise ValueError("columns that differ have equal hashes")
    return first


def compile_merges(merges: list[tuple[int, int]], bytes_first: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """States, arc classes and the packed table of allowed arcs by state and class.

    Tokens are numbered: the bytes, then one for each merge. The first two arrays give the state
    that each token leads to, and its class of arcs.
    """
    count = bytes_first + len(merges)
    allowed = np.zeros((count // 64 + 1, count), np.uint64)  # bit p of column t: the state after p has arc t
    allowed[: bytes_first // 64, :bytes_first] = ~np.uint64(0)
    one, held = np.uint64(1), np.empty(count, np.uint64)
    for w, (u, v) in enumerate(merges, bytes_first):
        group, bit = w >> 6, np.uint64(w & 63)
        copied = np.bitwise_and(np.right_shift(allowed[v >> 6, :w], np.uint64(v & 63), out=held[:w]), one, out=held[:w])
        allowed[group, :w] |= np.left_shift(copied, bit, out=copied)
        allowed[u >> 6, v] &= ~(one << np.uint64(u & 63))
        allowed[: group + 1, w] = allowed[: group + 1, u]
    first, arc_class = np.unique(_classes(allowed), return_inverse=True)
    allowed = np.ascontiguousarray(allowed[:, first])
    states: dict[bytes, int] = {}
    state = np.empty(count, np.int32)
    for group in range(len(allowed)):
        rows = np.packbits((allowed[group][None, :] >> np.arange(64, dtype=np.uint64)[:, None]).astype(np.uint8) & 1, axis=1, bitorder="little")
        for p in range(64 * group, min(64 * group + 64, count)):
            state[p] = states.setdefault(rows[p - 64 * group].tobytes(), len(states))
    return state, arc_class.astype(np.int32), np.frombuffer(b"".join(states), np.uint8).reshape(len(states), -1)


def compile_vocabulary(path: str) -> dict:
    """The automaton of a vocabulary file of the tokenizers library, with byte-level symbols; its size depends on the vocabulary alone."""
    if path not in _compiled:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocabulary, symbols = spec["model"]["vocab"], byte_symbols()
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in spec["model"]["merges"]]
        names = [c for c, _ in sorted(symbols.items(), key=lambda x: x[1])] + ["".join(x) for x in pairs]
        number = {name: n for n, name in enumerate(names)}
        if len(number) != len(names):
            raise ValueError("each merge must make a token of its own")
        state, arc_class, table = compile_merges([(number[a], number[b]) for a, b in pairs])
        _compiled[path] = {
            "path": path,
            "labels": [bytes(symbols[c] for c in name) for name in names],
            "ids": [vocabulary[name] for name in names],
            "state": state,
            "arc_class": arc_class,
            "width": table.shape[1],
            "table": table.tobytes(),
            "special": {x["content"]: x["id"] for x in spec["added_tokens"]},
        }
    return _compiled[path]


class Transitions:
    """The automaton over bytes, made deterministic as words need it.

    Configuration 0 is the beginning. Another one is the token that has just ended, and the pairs of
    a node in the tree of labels and the state from which that label is being read.
    """

    def __init__(self, automaton: dict, most: int = MOST_CONFIGURATIONS):
        self.table, self.width, self.most = automaton["table"], automaton["width"], most
        self.state, self.arc_class = automaton["state"].tolist(), automaton["arc_class"].tolist()
        self.sizes = [len(x) for x in automaton["labels"]]
        self.child: dict[int, int] = {}
        self.ends, self.inner = [-1], bytearray(1)
        for number, label in enumerate(automaton["labels"]):
            at = 0
            for b in label:
                self.inner[at] = 1
                below = self.child.get(at << 8 | b)
                if below is None:
                    below = self.child[at << 8 | b] = len(self.ends)
                    self.ends.append(-1)
                    self.inner.append(0)
                at = below
            self.ends[at] = number
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.reading: list[bytes] = [array("Q", [0]).tobytes()]  # node and state in one number, after the token; state 0 stands for the beginning, which has all arcs
        self.ended = [-1]
        self.next: dict[int, int] = {}

    def _step(self, at: int, byte: int) -> int:
        token, reading = -1, [0]
        for pair in array("Q", self.reading[at])[1 if at else 0 :]:
            node = self.child.get((pair >> 32) << 8 | byte)
            if node is None:
                continue
            left, number = pair & 0xFFFFFFFF, self.ends[node]
            if number >= 0 and token < 0:
                arc = self.arc_class[number]
                if left == 0 or self.table[(left - 1) * self.width + (arc >> 3)] >> (arc & 7) & 1:
                    token = number
            if self.inner[node]:
                reading.append(node << 32 | left)
        reading.append(self.state[token] + 1)
        reading[0] = token
        key = array("Q", reading).tobytes()
        found = self.known.get(key)
        if found is None:
            found = self.known[key] = len(self.reading)
            self.reading.append(key)
            self.ended.append(token)
        self.next[at << 8 | byte] = found
        return found

    def tokens(self, word: bytes) -> list[int]:
        """The token numbers of one pre-split word."""
        if len(self.reading) > self.most:
            self.clear()
        at, following, path = 0, self.next.get, []
        for byte in word:
            before, at = at, following(at << 8 | byte)
            if at is None:
                at = self._step(before, byte)
            path.append(at)
        out, i = [], len(word) - 1
        while i >= 0:
            out.append(self.ended[path[i]])
            i -= self.sizes[out[-1]]
        return out[::-1]


class BpeEncoder:
    """Encodes and decodes with a compiled automaton."""

    def __init__(self, automaton: dict):
        self.transitions = Transitions(automaton)
        self.ids = automaton["ids"]
        self.kind = "H" if max(self.ids) < 1 << 16 else "I"
        self.label = dict(zip(self.ids, automaton["labels"])) | {n: x.encode() for x, n in automaton["special"].items()}
        self.digits = {n: b"%d" % n for n in self.label}
        self.special, self.path = automaton["special"], automaton["path"]
        self.divider = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.symbols, self.tokenizer = byte_symbols(), None
        self.memory = PieceMemory(self._learn, MOST_WORDS)

    def word(self, word: bytes) -> list[int]:
        """The token numbers of one pre-split word."""
        return self.transitions.tokens(word)

    def _learn(self, pieces: list[str]) -> Iterator[bytes]:
        for piece in pieces:
            yield array(self.kind, [self.ids[n] for n in self.transitions.tokens(piece.encode())]).tobytes()

    def _split(self, text: str) -> list[str]:
        if is_plain(text):
            return BYTE_PIECES.findall(text)
        if self.tokenizer is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
        return [bytes(map(self.symbols.__getitem__, x)).decode() for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def encode(self, text: str) -> list[int]:
        """The ids of a text."""
        found = []
        for n, part in enumerate(self.divider.split(text) if any(x in text for x in self.special) else [text]):
            if n % 2:
                found.append(array(self.kind, [self.special[part]]).tobytes())
            elif part:
                found += self.memory(self._split(part))
        return array(self.kind, b"".join(found)).tolist()

    def emitted(self, ids: list[int]) -> bytes:
        """Decodes: the labels of the arcs, one after another."""
        return b"".join(map(self.label.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.emitted(ids).decode(errors="replace")


def _mapped(docs: DataFrame, tokenizer_path: str, columns: dict[str, str], row, schema: str) -> DataFrame:
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(zstandard.compress(pickle.dumps(compile_vocabulary(tokenizer_path)), 3))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = BpeEncoder(pickle.loads(zstandard.decompress(held.value)))  # ends with the task, as the worker may wait beside others for its next one
        last, found = None, None
        for batch in batches:
            rows = []
            for name, value in zip(batch["doc_id"], batch["value"]):
                if not isinstance(value, str) or value != last:  # copies follow one another in a mix, and are encoded once
                    last, found = value, row(coder, value)
                rows.append((name, *found))
            yield pd.DataFrame(rows, columns=["doc_id", *columns])

    return docs.mapInPandas(tidy(run), schema)


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the array `ids` of each text, whole, however long.

    A null or empty text has no ids; special tokens' strings become their ids. Repeated rows and
    null document ids are kept, an empty table gives an empty result, and other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("value"))
    return _mapped(rows, tokenizer_path, {"ids": "array<int>"}, lambda coder, text: (coder.encode(text),), f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and the `text` of the array `ids`.

    Null ids count as none and give an empty text; bytes that aren't UTF-8 become replacement
    characters. Repeated rows and null document ids are kept, an empty table gives an empty result,
    and other columns are not read.
    """
    kind = encoded.schema["doc_id"].dataType.simpleString()
    rows = encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("value"))
    return _mapped(rows, tokenizer_path, {"text": "string"}, lambda coder, ids: (coder.decode(ids.tolist()),), f"doc_id {kind}, text string")


def _digests(coder: BpeEncoder, text: str) -> tuple[int, str, str]:
    ids = coder.encode(text)
    printed = b",".join(map(coder.digits.__getitem__, ids))
    return len(ids), hashlib.sha256(printed).hexdigest(), hashlib.sha256(coder.decode(ids).encode()).hexdigest()


def round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, from its whole text encoded and decoded again.

    A null text counts as empty, without ids. Repeated rows are kept, an empty table gives an empty
    result, and other columns are not read. tokenizer_path must exist on every executor.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("value"))
    columns = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    return _mapped(rows, tokenizer_path, columns, _digests, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
