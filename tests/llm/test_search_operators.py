"""Periodic runs, ranked search and license scans against brute force, on tables with nulls, empty and very long texts, ties, repeats, no rows and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from quern.llm import lexical, licenses, periodic, queries

SCHEMA = "doc_id long, text string, lang string, shard string, term string, digest string, words string, runs string, size int"
WORDS = "the river old mill stone grinds corn until evening light falls over quiet fields where cattle rest".split()
NOTICES = ["Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "this work is licenced under the GNU General Public License, version 3", "licensed under the apache LICENSE version 2.0", "mit  license\nMIT\tlicense general public license"]


def build():
    rng = random.Random(11)
    some = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    texts = [None, "", " \t\n", "...", "a", "İstanbul ÄÖ 北京 river", "x" * 5000, " ".join(["corn"] * 3000)]
    texts += [some(rng.randint(1, 90)) for _ in range(40)]
    texts += [f"{some(8)} {notice} {some(5)}" for notice in NOTICES for _ in range(2)]
    texts += [" ".join([some(p)] * 5) for p in (1, 2, 7, 12, 31, 60)] + [some(20_000)]
    texts += [" ".join(["mit license"] * 500), texts[20], texts[20], texts[21] + " river"]
    rows = [(i * 7, t, "en", "s", "t", "d", "w", "r", 1) for i, t in enumerate(texts)]
    return rows + [(7 * 20, "another text of a repeated id river mill", *rows[0][2:]), (None, "no id river stone", *rows[0][2:]), (None, texts[21], *rows[0][2:])]


ROWS = build()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def slow_runs(words):
    """Every run, by definition: islands at each distance, none of which a smaller period has."""
    n, found = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(24, 3 * q):
                inside = words[i : j + q]
                if not any(all(inside[k] == inside[k + p] for k in range(len(inside) - p)) for p in range(1, q)):
                    found.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(found)


@pytest.mark.parametrize("short", [periodic.SHORT_LAG, 1])
def test_find_runs(short, monkeypatch):
    monkeypatch.setattr(periodic, "SHORT_LAG", short)
    rng = random.Random(5)
    for _ in range(250):
        letters = rng.choice([1, 2, 3, 30])
        words = [rng.randrange(letters) for _ in range(rng.randint(0, 150))]
        for _ in range(rng.randint(0, 3)):
            unit = [rng.randrange(letters) for _ in range(rng.randint(1, 50))]
            at = rng.randint(0, len(words))
            words[at : at + 3] = (unit * rng.randint(2, 5))[rng.randint(0, 3) :]
        ids = np.unique(np.array(words, np.int64), return_inverse=True)[1]
        assert periodic.find_runs(ids) == slow_runs(words)
        if len(words) >= 3:
            counts = periodic.lag_counts(ids, len(words) // 3)
            assert counts[1:].tolist() == [sum(words[i] == words[i + q] for i in range(len(words) - q)) for q in range(1, len(counts))]


def test_lag_counts_of_frequent_words():
    words = np.random.default_rng(2).zipf(1.4, 30_000) % 900
    ids = np.unique(words, return_inverse=True)[1]
    counts = periodic.lag_counts(ids, 10_000)
    for lag in (1, 2, 77, 4096, 10_000):
        assert counts[lag] == (words[:-lag] == words[lag:]).sum()


def split(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def test_periodic_runs(docs, empty):
    found = Counter((r["doc_id"], r["n_words"], tuple((x["start"], x["length"], x["period"]) for x in r["runs"]), r["collapsed"]) for r in periodic.periodic_runs(docs).collect())
    want = Counter()
    for i, text, *_ in ROWS:
        words = split(text)
        ids = np.unique(np.array(words, object), return_inverse=True)[1] if words else np.empty(0, np.int64)
        runs = slow_runs(words) if len(words) < 2500 else periodic.find_runs(ids)  # the rest is too long to go by definition
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        want[(i, len(words), tuple(runs), " ".join(w for k, w in enumerate(words) if k not in gone))] += 1
    assert found == want
    assert sum(bool(runs) for _, _, runs, _ in found) > 5
    assert periodic.periodic_runs(empty).count() == 0


def test_periodic_query(spark, tmp_path):
    rows = [(i, t) for i, t, *_ in ROWS if i is not None and (t is None or len(t) < 9000)]
    rows = list({i: (i, t) for i, t in rows}.values())
    rows += [(i, rows[20][1]) for i in range(1000, 1100)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(found) == len(rows)
    planted = 0
    for i, text in rows:
        words, h = split(text), zlib.crc32(str(i).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
            planted += 1
        runs = slow_runs(words)
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        row = found[i]
        assert row["n_runs"] == len(runs)
        assert (row["start"], row["length"], row["period"], row["exponent_milli"]) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert row["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in gone).encode()).hexdigest()
    assert planted > 5


def test_pack():
    rng = np.random.default_rng(4)
    numbers = np.concatenate([[0, 127, 128, 16383, 16384, 2**40], rng.integers(0, 1 << 20, 500)])
    data, starts = lexical.pack(numbers)
    assert (lexical.unpack(data.tobytes()) == numbers).all()
    assert starts[0] == 0 and starts[-1] == len(data)
    assert len(lexical.unpack(b"")) == 0


def slow_search(rows, items, k):
    def terms(text):
        return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    counted = [(i, Counter(terms(t))) for i, t, *_ in rows]
    counted = [(i, c) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = set()
    for item, text in items:
        scored = []
        for i, c in counted:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out |= {(item, rank, i, -score) for rank, (score, _, _, i) in enumerate(sorted(scored)[:k], 1)}
    return out


@pytest.mark.parametrize("shard", [lexical.SHARD_DOCS, 3])
def test_search(spark, docs, empty, shard, monkeypatch):
    monkeypatch.setattr(lexical, "SHARD_DOCS", shard)
    monkeypatch.setattr(lexical, "PIECE", 50)
    items = [(1, "River stone"), (2, "the the the old mill"), (3, None), (4, "nothing of this zzz"), (5, "北京 istanbul x"), (6, "ÄÖ corn MIT licence light"), (7, " ".join(WORDS))]
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    for k in (1, 10):
        found = lexical.search(lexical.build_index(docs), asked, k).collect()
        assert {tuple(r) for r in found} == slow_search(ROWS, items, k)
        assert len(found) == len({(r["item_id"], r["rank"]) for r in found})
    assert lexical.search(lexical.build_index(empty), asked).count() == 0
    assert lexical.search(lexical.build_index(docs), asked.limit(0)).count() == 0


def test_search_of_string_ids_in_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 2)
    rows = [(None if i is None else f"d{i:04}", t) for i, t, *_ in ROWS]
    items = [(f"q{n}", f"{WORDS[n]} {WORDS[n + 1]} mill") for n in range(9)]
    found = lexical.search(lexical.build_index(spark.createDataFrame(rows, "k string, body string"), "k", "body"), spark.createDataFrame(items, "q string, words string"), 5, "q", "words").collect()
    numbered = slow_search([(i, t) for i, t, *_ in ROWS], items, 5)
    assert {tuple(r) for r in found} == {(q, rank, None if i is None else f"d{i:04}", s) for q, rank, i, s in numbered}


def slow_licenses(text):
    """The columns of the report by counting over all pairs of grams."""
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, places, likes = cut(text), [], {}
    for phrase, label in licenses.PHRASES:
        parts = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(parts)] == parts]
    for label, license_text in licenses.TEXTS:
        known = cut(license_text)
        at = {}
        for i in range(len(words) - 2):
            for j in range(len(known) - 2):
                if words[i : i + 3] == known[j : j + 3]:
                    at.setdefault(i - j, set()).add(j)
        session, begin, last = [], None, None
        for diagonal in sorted(at):
            if last is None or diagonal - last > licenses.NEIGHBOUR:
                begin = diagonal
            session.append((begin, (diagonal - begin) // len(known), diagonal))
            last = diagonal
        for part in {x[:2] for x in session}:
            lines = [d for *p, d in session if tuple(p) == part]
            votes = set().union(*(at[d] for d in lines))
            covered = {j + n for j in votes for n in range(3)}
            stood = [d + j + n for d in lines for j in at[d] for n in range(3)]
            if len(votes) >= math.ceil(licenses.VOTES * (len(known) - 2)):
                like = min(1.0, 2 * len(covered) / (len(known) + max(max(stood) - min(stood) + 1, len(covered))))
                if like >= licenses.LIKENESS:
                    likes[label] = max(like, likes.get(label, 0))
    own = sorted({label for _, label in places})
    score = 1.0 if places else max(likes.values(), default=0.0)
    return (len(words), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(own), ",".join(sorted({*own, *likes})), round(score, 9))


def test_licenses(docs, empty):
    columns = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels"]
    found = Counter((r["doc_id"], *(r[c] for c in columns), round(r["score"], 9)) for r in licenses.license_report(docs).collect())
    assert found == Counter((i, *slow_licenses(t)) for i, t, *_ in ROWS)
    labels = {x for row in found for x in row[6].split(",")}
    assert {"mit", "gpl", "apache", "cc-by-nc"} <= labels
    assert licenses.license_report(empty).count() == 0
    assert licenses.license_spans(empty).count() == 0


def test_license_texts_with_edits(spark):
    rng = random.Random(8)
    rows, want = [], []
    for n, (label, text) in enumerate(licenses.TEXTS):
        words = text.split()
        if len(words) >= 20:
            words[10] = "altered"
            words.insert(15, "inserted words")
            del words[-1]
        rows.append((n, " ".join(rng.choice(WORDS) for _ in range(30)) + " " + " ".join(words) + " " + rng.choice(WORDS)))
        want.append(label)
    found = {r["doc_id"]: r["labels"].split(",") for r in licenses.license_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(want[i] in found[i] for i in found)
    plan = licenses.license_report(spark.createDataFrame(rows, "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
