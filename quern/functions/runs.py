"""Matching runs of two texts: the longest common run, then the longest ones on either side of it, and so on."""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

#: Characters in a run that counts as copied, the share of the shorter text that makes a copy, and the run that decides alone.
MIN_RUN, COPY_SHARE, DECISIVE_RUN = 12, 0.60, 40
#: The same for two quotes of one fact.
FACT_RUN, FACT_SHARE = 5, 0.50
#: Characters in a gram by whose sets texts are compared.
SHORT_GRAM = 4

_BASE = np.uint64(0x9E3779B97F4A7C15)


def _grams(text: str, size: int) -> np.ndarray:
    """A hash of each run of so many characters."""
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    count = len(chars) - size + 1
    found = np.zeros(max(0, count), np.uint64)
    for k in range(size if count > 0 else 0):
        found = found * _BASE + chars[k : k + count]
    return found


def gram_hashes(text: str, size: int) -> np.ndarray:
    """A hash of each run of so many characters, even in all its bits."""
    x = _grams(text, size)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def next_chars(text: str, size: int) -> np.ndarray:
    """The code point behind each run of so many characters, plus one; 0 at the end of the text."""
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.append(chars[size:] + np.uint32(1), np.uint32(0)).astype(np.uint32) if len(chars) >= size else np.empty(0, np.uint32)


@functools.lru_cache(maxsize=64)
def _sorted_grams(text: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a text's runs in their order, and the places of them."""
    grams = _grams(text, size)
    order = np.argsort(grams, kind="stable")
    return grams[order], order


@functools.lru_cache(maxsize=64)
def _gram_set(text: str, size: int) -> np.ndarray:
    return np.unique(_grams(text, size))


@functools.lru_cache(maxsize=64)
def _letters(text: str) -> Counter[str]:
    return Counter(text)


def common_runs(a: str, b: str, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Beginning in a, beginning in b and length of every common run that can't be made longer, of `least` characters at least."""
    left, (right, order) = _grams(a, least), _sorted_grams(b, least)
    low = np.searchsorted(right, left)
    count = np.searchsorted(right, left, side="right") - low
    i = np.repeat(np.arange(len(left)), count)
    j = order[np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())]
    order = np.lexsort((i, j - i))
    i, j = i[order], j[order]
    first = np.flatnonzero(np.append(True, (i[1:] != i[:-1] + 1) | (j[1:] != j[:-1] + 1))) if len(i) else np.empty(0, np.int64)
    return i[first], j[first], np.diff(np.append(first, len(i))) + least - 1


def _matching(i: np.ndarray, j: np.ndarray, size: np.ndarray, a_end: int, b_end: int, least: int) -> list[tuple[int, int, int]]:
    """Of common runs those that match: the longest, of equally long ones the earliest in a, then in b, and so on at either side of it."""
    found, todo = [], [(0, a_end, 0, b_end)]
    while todo and len(i):
        a0, a1, b0, b1 = todo.pop()
        skip = np.maximum(np.maximum(a0 - i, b0 - j), 0)
        inside = np.minimum(np.minimum(size, a1 - i), b1 - j) - skip
        longest = int(inside.max())
        if longest < least:
            continue
        best = np.flatnonzero(inside == longest)
        best = best[np.lexsort(((j + skip)[best], (i + skip)[best]))[0]]
        x, y = int(i[best] + skip[best]), int(j[best] + skip[best])
        found.append((x, y, longest))
        todo += [(a0, x, b0, y), (x + longest, a1, y + longest, b1)]
    return sorted(found)


def matching_runs(a: str, b: str, least: int) -> list[tuple[int, int, int]]:
    """The matching runs of `least` characters or more; of equally long ones the earliest in a, then in b, comes first."""
    return _matching(*common_runs(a, b, least), len(a), len(b), least)


def match_sizes(i: np.ndarray, j: np.ndarray, size: np.ndarray, least: int) -> list[int]:
    """The sizes of the matching runs of two texts with these common runs."""
    return [n for _, _, n in _matching(i, j, size, int((i + size).max()), int((j + size).max()), least)]


def overlap_of(a: str | None, b: str | None, least: int = MIN_RUN) -> tuple[float, int]:
    """Share of the shorter text, or of a if both are of one length, that matching runs cover, and the longest of them."""
    a, b = a or "", b or ""
    a, b = (b, a) if len(a) > len(b) else (a, b)
    sizes = [n for _, _, n in matching_runs(a, b, least)]
    return (sum(sizes) / len(a) if a else 0.0), max(sizes, default=0)


def cover_bound(a: str, b: str) -> float:
    """Share of a inside grams of MIN_RUN characters that b has, too."""
    own, known = _grams(a, MIN_RUN), _sorted_grams(b, MIN_RUN)[0]
    if not len(own) or not len(known):
        return 0.0
    at = np.flatnonzero(known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own)
    return float(np.minimum(np.diff(at, append=at[-1] + MIN_RUN), MIN_RUN).sum() / len(a)) if len(at) else 0.0


def measure(a: str | None, b: str | None, least: float = COPY_SHARE) -> tuple[float, float | None, int | None, int | None, float | None, float | None]:
    """Of a, the shorter text, and b: cover_bound(), coverage and longest run, characters that both have, and Jaccard likeness and containment of grams of SHORT_GRAM; only the first if it is under `least`."""
    a, b = a or "", b or ""
    bound = cover_bound(a, b)
    if bound < least:
        return bound, None, None, None, None, None
    x, y = _gram_set(a, SHORT_GRAM), _gram_set(b, SHORT_GRAM)
    shared = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(y) else 0
    left, right = _letters(a), _letters(b)
    return bound, *overlap_of(a, b), sum(min(n, right[c]) for c, n in left.items()), shared / max(1, len(x) + len(y) - shared), shared / max(1, min(len(x), len(y)))


_MEASURES = StructType([StructField("bound", DoubleType()), StructField("coverage", DoubleType()), StructField("longest", IntegerType()), StructField("letters", LongType()), StructField("jaccard", DoubleType()), StructField("containment", DoubleType())])


@F.pandas_udf(_MEASURES)
def measures(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """measure() of two text columns."""
    for left, right in parts:
        found = pd.DataFrame([measure(a, b) for a, b in zip(left, right)], columns=_MEASURES.names)
        yield found.astype({"longest": "Int32", "letters": "Int64"})


def overlap(least: int = MIN_RUN):
    """A function of two text columns that gives coverage and longest."""

    @F.pandas_udf(StructType([StructField("coverage", DoubleType()), StructField("longest", IntegerType())]))
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for left, right in parts:
            yield pd.DataFrame([overlap_of(a, b, least) for a, b in zip(left, right)], columns=["coverage", "longest"])

    return run
