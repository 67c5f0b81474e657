"""Reposts, decisive runs and conclusion groups against brute force, in one go and as they arrive."""

import random

import pytest
from pyspark.sql import functions as F

from quern.functions.runs import DECISIVE_RUN, measure
from quern.operators import blocks, grams, reposts
from quern.streaming.reposts import absorb, import_reposts, imported


def texts(seed, bases=6):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    out, boilerplate = [], " ".join(word() for _ in range(12))
    for n in range(bases):
        base = [word() for _ in range(60)]
        out += [" ".join(base), " ".join(base[: rng.randint(25, 60)] + [word() for _ in range(30)]), "\n".join(base), " ".join(base[20:45])]
        out.append(" ".join(word() for _ in range(80)) + boilerplate + " ".join(word() for _ in range(40)))
        if n % 3 == 0:
            out.append(" ".join(base[:30]) + " " + out[0][:200])
    rng.shuffle(out)
    return [*out, "", " ", None, "too short"]


def rows_of(df):
    return sorted((r["doc_id"], r["kind"], r["original"], r["coverage"], r["group_id"]) for r in df.collect())


def squashed(text):
    return "".join((text or "").split())


def common_run(a, b, size):
    return any(a[i : i + size] in b for i in range(len(a) - size + 1))


@pytest.mark.parametrize("cell", [2048, 2])
def test_decisive_runs(spark, cell, monkeypatch):
    monkeypatch.setattr(grams, "CELL", cell)
    bodies = list({squashed(t): i for i, t in enumerate(texts(3))}.items())
    # one run of 100 in 400 letters, the same at either end, and runs one too short
    rng = random.Random(9)
    own = lambda n: "".join(rng.choice("ijklmnop") for _ in range(n))
    run = own(100)
    bodies += [(own(200) + run + own(100), 901), (own(50) + run + own(250), 902), (run[:39] + own(80), 903), (own(80) + run[60:], 904), (run[:40], 905)]
    items = spark.createDataFrame([(i, b) for b, i in bodies], "id long, body string")
    want = {frozenset((i, j)) for a, i in bodies for b, j in bodies if i != j and common_run(a, b, DECISIVE_RUN)}
    found = [(r["id"], r["other"]) for r in reposts.decisive_runs(items).collect()]
    assert {frozenset(x) for x in found} == want and len(found) == len(want)
    assert {901, 902} in want
    size = {i: len(b) for b, i in bodies}
    assert all((size[i], -i) < (size[j], -j) for i, j in found)
    both = {(r["id"], r["other"]): (r["by_cover"], r["by_run"]) for r in reposts.duplicates(items).collect()}
    assert both[max(x for x in both if set(x) == {901, 902})] == (False, True)
    assert reposts.duplicates(items.limit(0)).count() == 0


def test_a_common_line_is_met_once(spark, monkeypatch):
    rng = random.Random(4)
    own = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    line = own(400)
    bodies = [own(60) + line + own(60) for _ in range(20)] + ["ab" * 90, "zab" + "ab" * 60, line, line + own(50)]
    items = spark.createDataFrame(list(enumerate(bodies)), "id long, body string")
    want = {frozenset((i, j)) for i, a in enumerate(bodies) for j, b in enumerate(bodies) if i != j and common_run(a, b, DECISIVE_RUN)}
    tables, write = [], grams.saved
    monkeypatch.setattr(grams, "saved", lambda df: tables.append(write(df)) or tables[-1])
    found = [(r["id"], r["other"]) for r in grams.anchored_pairs(items, 12, DECISIVE_RUN).collect()]
    assert {frozenset(x) for x in found} == want and len(found) == len(want)
    assert tables[0].count() < 200  # not a row for each of the line's anchors in each text


@pytest.mark.parametrize("heat", [64, 2])
def test_cover_candidates_lose_no_pair(spark, heat, monkeypatch):
    monkeypatch.setattr(grams, "HEAT", heat)
    monkeypatch.setattr(grams, "CELL", 3)
    bodies = list({squashed(t): i for i, t in enumerate(texts(5, 9))}.items())
    want = set()
    for a, i in bodies:
        for b, j in bodies:
            if i != j and (len(a), -i) < (len(b), -j) and len(a):
                covered = {p + k for p in range(len(a) - 11) if a[p : p + 12] in b for k in range(12)}
                if len(covered) >= 0.6 * len(a):
                    want.add((i, j, round(len(covered) / len(a), 9)))
    items = spark.createDataFrame([(i, b) for b, i in bodies], "id long, body string")
    assert {(r["id"], r["other"], round(r["bound"], 9)) for r in reposts.covered_pairs(items).collect()} == want and len(want) > 10


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_come_to_the_same(spark, tmp_path, seed, monkeypatch):
    monkeypatch.setattr("quern.streaming.reposts.BUCKET_BITS", 2)
    rows = list(enumerate(texts(seed, 4)))
    rng = random.Random(seed)
    cuts = sorted(rng.sample(range(1, len(rows)), 3))
    parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
    frame = lambda part: spark.createDataFrame(part, "doc_id long, text string")
    want = rows_of(reposts.repost_groups(frame(rows)))
    assert {k for _, k, *_ in want} == {"new", "repost", "exact"}
    store = str(tmp_path / "store")
    for number, part in enumerate(parts):
        absorb(frame(part), store, number)
        if number == 1:  # the batch is run again, in whole and after a failure before its documents were written
            done = rows_of(imported(spark, store))
            absorb(frame(part), store, number)
            assert rows_of(imported(spark, store)) == done
            monkeypatch.setattr("quern.streaming.reposts.roots_of", lambda _: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                absorb(frame(parts[2]), store, 2)
            monkeypatch.undo()
            monkeypatch.setattr("quern.streaming.reposts.BUCKET_BITS", 2)
            assert rows_of(imported(spark, store)) == done
    assert rows_of(imported(spark, store)) == want
    absorb(frame([]), store, len(parts))
    assert rows_of(imported(spark, store)) == want


def test_stream_of_reposts(spark, tmp_path):
    rows = list(enumerate(texts(7, 2)))
    arriving, store = str(tmp_path / "arriving"), str(tmp_path / "store")
    for part in (rows[:7], rows[7:]):
        spark.createDataFrame(part, "doc_id long, text string").coalesce(1).write.mode("append").parquet(arriving)
        stream = spark.readStream.schema("doc_id long, text string").parquet(arriving)
        import_reposts(stream, store, str(tmp_path / "checkpoint")).awaitTermination()
    assert rows_of(imported(spark, store)) == rows_of(reposts.repost_groups(spark.createDataFrame(rows, "doc_id long, text string")))


def slow_groups(first, known=None):
    """The groups by taking each document's turn in the order of ids."""
    known = known or {}
    group = dict(known)
    for doc in sorted(first):
        if doc in known:
            continue
        other = first[doc]
        if other in known:
            group[doc] = known[other]
        else:
            group.setdefault(other, other)
            group[doc] = group[other]
    return group


def test_conclusion_groups(spark):
    keys = {2: [f"k{i}" for i in range(8)], 9: [*(f"k{i}" for i in range(8)), "x1", "x2"], 4: ["x1", "x2", "k0", "k1"]}
    rows = spark.createDataFrame([(d, k) for d, ks in keys.items() for k in ks], "doc long, key string")
    found = {r["id"]: r["group_id"] for r in reposts.conclusion_groups(reposts.first_matches(rows)).collect()}
    assert found == slow_groups({2: 9, 4: 9, 9: 2}) and set(found) == {2, 4, 9}
    rng = random.Random(2)
    for turn in range(4):
        first = {d: rng.choice([x for x in range(30) if x != d]) for d in rng.sample(range(30), 18)}
        known = {d: 100 + d % 3 for d in rng.sample(range(30), 4)} if turn % 2 else None
        matches = spark.createDataFrame([(d, o, 0.9) for d, o in first.items()], "doc long, other long, share double")
        held = spark.createDataFrame(list(known.items()), "id long, group_id long") if known else None
        assert {r["id"]: r["group_id"] for r in reposts.conclusion_groups(matches, held).collect()} == slow_groups(first, known)
    assert reposts.conclusion_groups(reposts.first_matches(rows.where(F.lit(False)))).count() == 0


def test_long_keys_are_not_sent(spark, monkeypatch):
    kept, inner = [], reposts.saved
    monkeypatch.setattr(reposts, "saved", lambda df: kept.append(inner(df)) or kept[-1])
    rows = [(d, f"{'k' * 2000}{i}") for d, n in ((1, 5), (2, 5), (3, 4), (4, 3)) for i in range(n)] + [(5, f"k{i}") for i in range(5)] + [(6, None)]
    found = reposts.first_matches(spark.createDataFrame(rows + rows[:7], "doc long, key string"))
    assert {tuple(r) for r in found.collect()} == {(1, 2, 1.0), (2, 1, 1.0), (3, 1, 1.0)}
    assert kept and all(df.where(F.length("key") > 16).isEmpty() for df in kept)


def test_short_shares_of_a_common_line_are_no_candidates(spark, monkeypatch):
    """A line of 80 characters has 69 grams, but covers 80 places of texts of 500, be its grams few or frequent."""
    rng = random.Random(4)
    own = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    line = own(80)
    rows = [(i, own(200) + line + own(220)) for i in range(20)] + [(20, own(90) + line), (21, own(20) + line)]
    items = spark.createDataFrame(rows, "id long, body string")
    for heat in (64, 2):
        monkeypatch.setattr(grams, "HEAT", heat)
        found = {(r["id"], r["other"]) for r in reposts.cover_candidates(items).collect()}
        assert found == {(21, i) for i in range(21)}


@pytest.mark.parametrize("told", [64, 1])
def test_pairs_by_blocks(spark, told, monkeypatch):
    """Blocks against blocks give what each pair gives by itself; what is saved and sent has a row for a text or a block, not for a pair."""
    monkeypatch.setattr(blocks, "BLOCK_CHARS", 1500)
    monkeypatch.setattr(blocks, "BUCKET_GRAMS", 4000)
    monkeypatch.setattr(blocks, "TOLD", told)
    kept, inner = [], blocks.saved
    monkeypatch.setattr(blocks, "saved", lambda df: kept.append(inner(df)) or kept[-1])
    rng = random.Random(6)
    own = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    line = own(70)
    made = [squashed(t) for t in texts(8, 3)] + [own(200) + line + own(k) for k in range(30)] + [own(9) + line, line + own(9) + line, line[40:] + own(4) + line[:36], "x" * 90, "x" * 200, own(12), "é" + line + "𝔘"]
    bodies = {b: i for i, b in enumerate(made)}
    want = {}
    for a, i in bodies.items():
        for b, j in bodies.items():
            if len(a) >= 12 and (len(a), -i) < (len(b), -j):
                found = measure(a, b)
                if found[0] >= 0.6:
                    want[i, j] = (len(a), len(b), *found)
    items = spark.createDataFrame([(i, b) for b, i in bodies.items()], "id long, body string")
    found = reposts.covered_pairs(items).collect()
    assert {(r["id"], r["other"]): tuple(r)[2:] for r in found} == want and len(found) == len(want) > 100
    assert len(kept) == 1 and kept[0].count() <= len(bodies) and kept[0].where("size(blocks) > 1").count() > 3
    assert reposts.covered_pairs(items.limit(0)).count() == 0


@pytest.mark.parametrize("few, room", [(4096, 1 << 26), (2, 40)])
def test_pairs_of_runs_and_cover_meet_in_cells(spark, few, room, monkeypatch):
    """A pair is made in one cell, whatever it was found by: pairs are neither joined nor told apart by a shuffle."""
    for name, value in (("CELL", 8), ("MOST_GROUPS", 5), ("FEW_PAIRS", few), ("CELL_BYTES", room)):
        monkeypatch.setattr(grams, name, value)
    rng = random.Random(12)
    own = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    line, other = own(60), own(45)
    made = [squashed(t) for t in texts(11, 3)] + [own(rng.choice((0, 60))) + line + own(60) for _ in range(25)] + [other + own(9), "x" + other, line + own(5), own(20), own(25)]
    bodies = {b: i for i, b in enumerate(made)}
    items = spark.createDataFrame([(i, b) for b, i in bodies.items()], "id long, body string")
    ordered = [(i, len(a), j, len(b)) for a, i in bodies.items() for b, j in bodies.items() if (len(a), -i) < (len(b), -j)]
    covered = rng.sample(ordered, 60)
    named = {i: b for b, i in bodies.items()}
    cover = {(i, j) for i, _, j, _ in covered}
    want = {(i, j, (i, j) in cover, common_run(named[i], named[j], DECISIVE_RUN)) for i, _, j, _ in ordered}
    found = grams.anchored_pairs(items, 12, DECISIVE_RUN, spark.createDataFrame(covered, "id long, n long, other long, m long"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    rows = [tuple(r) for r in found.collect()]
    assert set(rows) == {x for x in want if x[2] or x[3]} and len(rows) == len(set(rows))
    assert {x[2:] for x in rows} == {(True, True), (True, False), (False, True)}
