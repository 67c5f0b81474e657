"""Names in names and texts, names most alike, nearest places and phrases, against brute force."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quern.functions import geo as G
from quern.functions import names as N
from quern.operators import merging, naming, nearest, phrases


def made_names(rng, n):
    syllable = lambda: "".join(rng.choice("故宫中山陵大唐不夜城公园古镇北ab") for _ in range(rng.randint(1, 3)))
    out = []
    for _ in range(n):
        name = "".join(syllable() for _ in range(rng.randint(1, 3)))
        out.append(rng.choice([name, name, name + "公园", f"{name}（{syllable()}）", f"{name}({syllable()})", f"{syllable()}-{name}", f" {name}　", f"{name}·{syllable()}-{syllable()}"]))
    return out


def test_names_that_contain_each_other(spark, monkeypatch):
    monkeypatch.setattr(naming, "CELL", 3)
    rows = list(enumerate([*made_names(random.Random(1), 60), "故", "故宫", "", None, "故宫"]))
    found = sorted(map(tuple, naming.containing_each_other(spark.createDataFrame(rows, "id long, name string")).collect()))
    assert found == sorted((i, j) for i, a in rows for j, b in rows if a and b and i != j and (a in b or b in a))


def test_names_are_compared_with_few(spark, monkeypatch):
    """Numbered names have short grams in common, more of them the more names there are; the pairs that are compared are about those that there are."""
    kept, inner = [], naming.saved
    monkeypatch.setattr(naming, "saved", lambda df: kept.append(inner(df)) or kept[-1])
    names = [f"hall {i}" for i in range(3000)] + [f"hall {i}-gate" for i in range(0, 3000, 2)] + ["ha", "l", "hall 7" * 9]
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    found = naming.held_names(rows, rows).count()
    assert found == sum(a in b for a in names for b in names)
    compared = [df.agg(F.sum("heat")).first()[0] for df in kept if "heat" in df.columns]
    assert len(compared) == 1 and compared[0] < 2 * found


@pytest.mark.parametrize("block", [100_000, 7])
def test_names_in_texts(spark, block, monkeypatch):
    monkeypatch.setattr(naming, "BLOCK_NAMES", block)
    rng = random.Random(2)
    names = [*made_names(rng, 40), "aa", "aaa", "a", "", None, "aa"]
    texts = [(i, "".join(rng.choice([*filter(None, names), "a", "x "]) for _ in range(rng.randint(0, 40)))) for i in range(30)] + [(99, None), (100, "")]
    frames = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(n,) for n in names], "name string")
    want = {(i, n, t.count(n)) for i, t in texts if t for n in names if n and n in t}
    assert {tuple(r) for r in naming.names_in_texts(*frames).collect()} == want
    best = {i: min((-c, n) for j, n, c in want if j == i) for i, *_ in want}
    assert {r["id"]: (-r["n"], r["name"]) for r in naming.most_named(*frames).collect()} == best
    assert naming.names_in_texts(frames[0], frames[1].limit(0)).count() == 0


def test_many_names_take_one_pass(spark, monkeypatch):
    """The texts are read once, however the names grow, and only the best name of a text leaves a task."""
    names = spark.range(150_000).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"))
    texts = spark.createDataFrame([(1, "n12 n149999 n149999n149999"), (2, "𝒜n7𝒜n6"), (3, "none"), (4, None)], "id long, text string")
    found = naming.most_named(texts, names)
    assert {tuple(r) for r in found.collect()} == {(1, "n1", 4), (2, "n6", 1)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert naming.names_in_texts(texts, names).where("id = 1").count() == 7
    assert naming.names_in_texts(texts, names, best=True).count() == 2


def test_most_alike(spark, monkeypatch):
    monkeypatch.setattr(naming, "TRIED", 1)
    monkeypatch.setattr(naming, "GROWTH", 2)
    rng = random.Random(3)
    names = made_names(rng, 120)
    mentions = [*made_names(rng, 40), "", "  ", None, "zzz"]
    frames = spark.createDataFrame(list(enumerate(mentions)), "mention_id long, mention string"), spark.createDataFrame(list(enumerate(names)), "place_id long, name string")
    every = frames[0].crossJoin(frames[1]).withColumn("rule", N.rule_score(F.col("mention"), F.col("name")))
    every = every.where("mention IS NOT NULL").withColumn("score", F.when(F.col("rule").isNotNull(), F.col("rule")).otherwise(N.letter_score("mention", "name"))).where("score >= 0.4").collect()
    for k in (1, 4):
        want = set()
        for m in range(len(mentions)):
            own = sorted((-r["score"], r["place_id"]) for r in every if r["mention_id"] == m)[:k]
            want |= {(m, rank, p, -s) for rank, (s, p) in enumerate(own, 1)}
        found = {(r["mention_id"], r["rank"], r["place_id"], r["score"]) for r in naming.most_alike(*frames, k).collect()}
        assert found == want
    assert len({s for *_, s in want}) > 5
    assert naming.most_alike(frames[0], frames[1].limit(0)).count() == 0


@pytest.mark.parametrize("k", [1, 3])
def test_nearest_places(spark, k):
    rng = random.Random(4)
    spots = lambda n, first: [(first + i, rng.choice("ab"), *rng.choice([(rng.uniform(-90, 90), rng.uniform(-180, 180)), (rng.uniform(88, 90) * rng.choice([-1, 1]), rng.uniform(-180, 180)), (rng.uniform(-1, 1), rng.choice([-1, 1]) * rng.uniform(179.9, 180.0)), (30.0, 100.0)])) for i in range(n)]
    asked = [*spots(60, 0), (97, "a", None, 1.0), (98, "c", 1.0, 1.0), (99, "a", 90.0, 0.0), (96, "b", -90.0, 12.0), (95, "a", 0.0, 180.0)]
    places = [*spots(50, 1000), (2000, "a", None, None), (2001, "b", 0.0, -180.0), (2002, "b", 0.0, 180.0)]
    frames = (spark.createDataFrame(asked, "asked_id long, city string, lat double, lng double"), spark.createDataFrame(places, "place_id long, city string, lat double, lng double"))
    far = {(i, j): G.metres_between(a, b, c, d) for i, _, a, b in asked for j, _, c, d in places if a is not None and c is not None}
    city = {i: c for i, c, *_ in asked} | {j: c for j, c, *_ in places}
    for on in ([], ["city"]):
        want = {}
        for i, *_ in asked:
            own = sorted((round(m, 3), j) for (x, j), m in far.items() if x == i and (not on or city[i] == city[j]))[:k]
            want[i] = [m for m, _ in own]
        found = {}
        for r in sorted(nearest.nearest(*frames, k, on).collect(), key=lambda r: (r["asked_id"], r["rank"])):
            found.setdefault(r["asked_id"], []).append(round(r["metres"], 3))
        assert found == {i: pytest.approx(x, abs=0.01) for i, x in want.items() if x}
    for metres in (300.0, 250_000.0, 12_000_000.0):
        met = {(r["asked_id"], r["place_id"]) for r in nearest.within(*frames, metres).collect()}
        assert met == {x for x, m in far.items() if m <= metres}
    assert nearest.nearest(frames[0], frames[1].limit(0)).count() == 0 and nearest.nearest(frames[0].limit(0), frames[1]).count() == 0
    assert math.isclose(far[99, 2001], far[99, 2002])


def test_points_that_coincide_are_measured_once(spark, monkeypatch):
    asked = [(i, 30.0 + i % 2, 100.0) for i in range(40)]
    places = [(1000 + i, 30.0 + i % 3, 100.0) for i in range(60)]
    frames = (spark.createDataFrame(asked, "asked_id long, lat double, lng double"), spark.createDataFrame(places, "place_id long, lat double, lng double"))
    met, inner = [], nearest._met
    monkeypatch.setattr(nearest, "_met", lambda *x: met.append(inner(*x).count()) or inner(*x))
    want = {(i, j, round(G.metres_between(a, b, c, d), 1)) for i, a, b in asked for j, c, d in places if G.metres_between(a, b, c, d) <= 120_000}
    assert {tuple(r) for r in nearest.within(*frames, 120_000.0, digits=1).collect()} == want and len(want) == 40 * 60 - 20 * 20
    found = {tuple(r)[:3] for r in nearest.nearest(*frames, 2).collect()}
    assert found == {(i, n + 1, 1000 + i % 2 + 3 * n) for i, *_ in asked for n in range(2)}
    assert max(met) <= 2 * 3 * 2


def test_phrases(spark, monkeypatch):
    monkeypatch.setattr(phrases, "FEW_TEXTS", 3)
    rng = random.Random(5)
    words = ["Old", "old", "MILL", "mill", "é", "É", "100%", "a_b", "北京", "x"]
    rows = [(i, rng.choice([None, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))]), rng.choice(["Old Mill", "none", None])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, title string")
    index = phrases.build_index(docs, "doc_id", ["text", "title"])
    fold = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x or "")
    for phrase, limit in ((" old MILL ", 50), ("É mill", 50), ("0%", 5), ("a_b", 50), ("x", 7), ("  ", 5), ("nowhere", 5), ("京 old", 50)):
        p = phrase.strip()
        want = [(i, max(0, (t or "").find(p))) for i, t, title in sorted(rows, reverse=True) if p and (fold(p) in fold(t) or fold(p) in fold(title))][:limit]
        assert [(r["doc_id"], r["at"]) for r in phrases.containing(index, docs, phrase, limit).collect()] == want
    ids = phrases.candidate_ids(index, docs, "old mill")
    scan = ids._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in scan or "PartitionFilters: [bucket" in scan  # a share of the folders is read


def test_an_index_has_a_row_for_a_gram_of_many_texts(spark):
    rows = [(i, "Old mill ÀK \u212a" if i % 2 else "old.*\\E[mill] àk" if i % 4 else None) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    index = phrases.build_index(docs, "doc_id", ["text"])
    grams = {t.encode().lower().decode()[i : i + 3] for _, t in rows if t for i in range(len(t) - 2)}
    assert spark.read.parquet(f"{index.path}/postings").count() == len(grams)
    assert spark.read.parquet(f"{index.path}/counts").agg(F.max("texts")).first()[0] == 150
    for phrase, count in ((".*\\e[M", 50), ("LL àk", 0), ("ll Àk", 100), ("k k", 0), ("k \u212a", 100), ("d.*m", 0), ("MILL", 150), ("_", 0)):
        assert phrases.containing(index, docs, phrase, 1000).count() == count, phrase


def test_merges_follow_chains(spark):
    kind = "poi_id string, name string, typecode string, type_name string, address string, rating double, open_time string, photo_url string, raw string, parent_id string"
    rows = [("X1", "gate", None, None, "a1", 4.0, None, None, None, "B9"), ("B2", "gate", None, None, None, None, "late", None, None, "X1"), ("B3", "gate", "11", None, None, None, None, None, None, "X1"), ("B9", "hall", None, None, None, None, None, None, None, "B2"), ("B8", None, None, None, None, None, None, None, None, "B8")]
    poi = spark.createDataFrame(rows, kind)
    claims = spark.createDataFrame([(1, "X1", "B9"), (2, "B2", None), (3, None, "X1"), (4, "B3", "zz")], "id long, poi_id string, to_id string")
    places, tables, report = merging.merge_all(poi, {"claim": claims}, {"claim": ["poi_id", "to_id"], "poi": ["parent_id"]})
    found = {r["poi_id"]: (r["address"], r["rating"], r["open_time"], r["parent_id"]) for r in places.collect()}
    assert found == {"B3": ("a1", 4.0, "late", None), "B9": (None, None, None, "B3"), "B8": (None, None, None, None)}
    assert {tuple(r) for r in tables["claim"].collect()} == {(1, "B3", "B9"), (2, "B3", None), (3, None, "B3"), (4, "B3", "zz")}
    assert {r["reference"]: r["rows"] for r in report.collect()} == {"claim.poi_id": 2, "claim.to_id": 1, "poi.parent_id": 3, "merged": 2}
    chain = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "c"), ("d", "a")], "poi_id string, survivor_id string")
    assert {tuple(r) for r in merging.remap(chain).collect()} == {("a", "c"), ("b", "c"), ("d", "c")}


def test_names_are_not_gathered_in_the_driver(spark):
    """A table of names that is small in a file may be large in the driver, so none is broadcast."""
    names = spark.createDataFrame([(f"P{n}", f"hall {n // 3}" + "-annex" * (n % 3)) for n in range(300)], "id string, name string")
    found = naming.containing_each_other(names)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    rows = [(r["id"], r["name"]) for r in names.collect()]
    want = {(a, b) for a, x in rows for b, y in rows if a != b and (x in y or y in x)}
    got = [tuple(r) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)
