"""Periodic runs of words, found by counting lags.

How often words are the same at a distance q decides whether q is looked at: frequent words are counted
for all distances at once by an exact autocorrelation (fast Fourier transform, rounded to whole
numbers), rare ones by the differences of their places. Only a distance with as many matches as the
shortest run of that period has is scanned for islands of matches. A short distance is compared
along the whole text; for a long one, every island holds a whole block that begins at a multiple of
the distance, so only these beginnings are tried, and blocks inside runs that are known are left out.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import give_back, small_batches

#: Words that a run has at least, and periods.
MIN_WORDS, MIN_PERIODS = 24, 3
#: Distances up to which islands are sought along the whole text, and places at which a block is tried before it is compared whole.
SHORT_LAG, TRIES = 48, 8
#: Differences of places that are held before they are counted.
HELD_GAPS = 1 << 20

_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def lag_counts(words: np.ndarray, most: int) -> np.ndarray:
    """For each distance up to `most`, the number of places whose word is the same so many words on. words are numbers from 0."""
    n = len(words)
    times = np.bincount(words)
    rare = times[words] <= np.sqrt(n * np.log2(n + 1))
    counts = np.zeros(most + 1, np.int64)
    frequent = np.unique(words[~rare])
    if len(frequent):
        size = 1 << int(n + most).bit_length()  # long enough that no distance meets another by going round
        power = np.zeros(size // 2 + 1)
        for word in frequent:
            seen = np.fft.rfft(words == word, size)
            power += seen.real**2 + seen.imag**2
        counts += np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)
    place = np.flatnonzero(rare)
    place = place[np.argsort(words[place], kind="stable")]
    word, left, step, held, size = words[place], np.arange(len(place)), 1, [], 0
    while len(left):
        left = left[left < len(place) - step]
        gap = place[left + step] - place[left]
        near = (word[left + step] == word[left]) & (gap <= most)  # gaps only grow with the step
        left, gap = left[near], gap[near]
        held.append(gap)
        size, step = size + len(gap), step + 1
        if size > HELD_GAPS or not len(left):
            counts += np.bincount(np.concatenate(held), minlength=most + 1)
            held, size = [], 0
    return counts


def _reach(a: np.ndarray, b: np.ndarray) -> int:
    """For how long two sequences are the same from their beginning."""
    most, done, step = min(len(a), len(b)), 0, 64
    while done < most:
        differ = np.flatnonzero(a[done : min(most, done + step)] != b[done : min(most, done + step)])
        if len(differ):
            return done + int(differ[0])
        done, step = done + step, 2 * step
    return most


def _islands(words: np.ndarray, lag: int, least: int, known: np.ndarray) -> Iterator[tuple[int, int]]:
    """Maximal stretches [start, end) of at least so many places whose word is the same `lag` words on; those inside known runs (start, end, period) may be left out."""
    n = len(words)
    if lag <= SHORT_LAG:
        same = np.zeros(n - lag + 2, np.int8)
        same[1:-1] = words[:-lag] == words[lag:]
        edges = np.flatnonzero(np.diff(same))
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= least
        yield from zip(starts[long].tolist(), ends[long].tolist())
        return
    blocks = np.arange(0, n - 2 * lag + 1, lag)
    for k in range(TRIES):
        at = blocks + k * (lag - 1) // (TRIES - 1)
        blocks = blocks[words[at] == words[at + lag]]
    for start, end, period in known[(known[:, 1] - known[:, 0] >= 2 * lag) & (lag % known[:, 2] == 0)] if len(blocks) else ():
        blocks = blocks[(blocks < start) | (blocks + 2 * lag > end)]
    done = -1
    for at in blocks.tolist():
        if at < done:
            continue
        ahead = _reach(words[at:], words[at + lag :])
        if ahead < lag:
            continue
        back = _reach(words[:at][::-1], words[: at + lag][::-1])
        done = at + ahead
        if ahead + back >= least:
            yield at - back, done


def find_runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period.

    A run is a stretch with smallest period q, at least MIN_WORDS words and MIN_PERIODS periods long,
    that no neighbouring word extends.
    """
    n = len(words)
    most = n // MIN_PERIODS
    if n < MIN_WORDS or most < 1:
        return []
    lags = np.arange(most + 1)
    least = np.maximum(MIN_WORDS, MIN_PERIODS * lags) - lags
    wanted = np.flatnonzero(lag_counts(words, most) >= least)
    known = np.empty((0, 3), np.int64)
    for lag in wanted[wanted > 0].tolist():
        for start, end in _islands(words, lag, int(least[lag]), known):
            # a stretch with a smaller period lies inside the run of that period, which was found before
            if not ((known[:, 0] <= start) & (known[:, 1] >= end + lag)).any():
                known = np.append(known, [(start, end + lag, lag)], axis=0)
    return sorted((s, e - s, q) for s, e, q in known.tolist())


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, joined by one space, without those that any run holds after its first period."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join(words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist())


def _row(text: bytes | None) -> tuple[int, list[dict], bytes]:
    words = (text or b"").split()
    numbers = defaultdict(count().__next__)
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    runs = find_runs(ids)
    return len(words), [dict(zip(("start", "length", "period"), x)) for x in runs], collapsed(words, runs)


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_row(text.as_py()) for text in batch.column(1)]
        n, runs, kept = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(runs, _RUNS), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "runs", "collapsed"])
    give_back()


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, the array `runs` of (start, length, period), and the text `collapsed`, whose runs are cut to their first period.

    Words are what stands between spaces and the characters 9 to 13. A run has a smallest period, at least
    MIN_WORDS words and MIN_PERIODS periods, and can't be extended. A null or blank text has no words,
    no runs and an empty collapsed text. Ids may be of any type, null or repeated: each row is
    judged alone. Whole texts are read. An empty table gives an empty result; other columns are not read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    found = rows.mapInArrow(_run_rows, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def strongest(runs: str = "runs") -> F.Column:
    """The run with the most periods, the first of equal ones; null if there are none."""

    def order(x, y):
        more, less = x["length"] * y["period"], y["length"] * x["period"]
        earlier = F.struct(x["start"], x["period"]) < F.struct(y["start"], y["period"])
        return F.when(more > less, -1).when(more < less, 1).when(earlier, -1).otherwise(1)

    return F.get(F.array_sort(runs, order), 0)
