"""Every query with SQL against DuckDB on the smallest tables, and the parts that SQL cannot state."""

import math
import os
import random
from difflib import SequenceMatcher

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quern.functions import text as T
from quern.operators.merge import upsert
from quern.plans import rules
from quern.plans.registry import ORACLE_SQL, QUERIES
from quern.functions.runs import overlap, overlap_of
from quern.operators import alignment, booking, evaluation, legs, ordering, quotes, reposts
from quern.sources.readers import read_documents
from quern.streaming.ingest import import_new

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(FOLDER):
        connection.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{FOLDER}/{name}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value if value is None or isinstance(value, (str, bool, int)) else str(value)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_duckdb(spark, duck, name):
    found, wanted = QUERIES[name](spark, FOLDER), duck.execute(ORACLE_SQL[name])
    columns = [x[0] for x in wanted.description]
    assert sorted(found.columns) == sorted(columns)
    key = lambda row: tuple(map(str, row))
    rows = sorted((tuple(plain(row[c]) for c in sorted(columns)) for row in found.collect()), key=key)
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    assert rows == sorted((tuple(plain(row[i]) for i in order) for row in wanted.fetchall()), key=key)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def blocks(a, b, least):
    """Coverage and longest run by the standard library."""
    a, b = (b, a) if len(a) > len(b) else (a, b)
    runs = [m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size >= least]
    return (sum(runs) / len(a) if a else 0.0), max(runs, default=0)


def test_overlap_is_that_of_matching_blocks(spark):
    pairs = [("abcdefghijklmnop", "xxabcdefghijklmnopyy"), ("short", "text"), ("", "a" * 20), ("a" * 30, "a" * 30), ("abcdefghijklm123", "123abcdefghijklm")]
    rng = random.Random(1)
    for _ in range(300):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))
        b = "".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))
        cut = rng.randint(0, len(a))
        pairs.append((a, b[:cut] + a[cut:] + b[cut:]))
    for least in (1, 2, 5, 12):
        assert [overlap_of(a, b, least) for a, b in pairs] == [blocks(a, b, least) for a, b in pairs]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", overlap()("a", "b").alias("o")).collect()
    assert [tuple(r["o"]) for r in rows] == [blocks(r["a"], r["b"], 12) for r in rows]


def test_repost_groups_by_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    texts = []
    for n in range(8):
        base = [word() for _ in range(60)]
        texts += [" ".join(base), " ".join(base[: rng.randint(25, 60)] + [word() for _ in range(30)]), "\n".join(base), " ".join(base[20:45])]
        if n % 3 == 0:
            texts.append(" ".join(base[:30]) + " " + texts[0][:200])
    texts += ["", " ", None, "too short"]
    rows = list(enumerate(texts))
    bodies, kept, want = {}, [], {}
    group = {}
    for i, text in rows:
        body = "".join((text or "").split())
        if body in bodies:
            want[i] = ("exact", bodies[body], 1.0)
            continue
        bodies[body] = i
        best = min(((-blocks(body, b, 12)[0], j) for j, b in kept if blocks(body, b, 12)[0] >= 0.6), default=None)
        want[i] = ("new", None, None) if best is None else ("repost", best[1], round(-best[0], 4))
        if best is not None:
            group.setdefault(best[1], best[1])
            group[i] = group[best[1]]
        kept.append((i, body))
    found = {r["doc_id"]: r for r in reposts.repost_groups(spark.createDataFrame([(None, "x"), *rows], "doc_id long, text string")).collect()}
    assert {i: (r["kind"], r["original"] if r["kind"] != "new" else None, r["coverage"]) for i, r in found.items()} == want
    assert {i: r["group_id"] for i, r in found.items() if r["group_id"] is not None and r["kind"] != "exact"} == group
    assert sum(x[0] == "repost" for x in want.values()) > 8
    assert reposts.repost_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_numbered(spark):
    rows = spark.createDataFrame([(i * 7 % 31, i) for i in range(31)], "a long, b long").repartition(3)
    assert sorted((r["place"], r["a"]) for r in ordering.numbered(rows, [F.col("a")]).collect()) == [(i + 1, i) for i in range(31)]


def test_letters_decide_where_no_rule_does(spark):
    rows = [("m", "abcdef", "6101", 0, "P0", "abcxyz", "110000", "", "6101", 1.0, 1.0), ("n", "q", "6101", 0, "P0", "abcxyz", "110000", "", "6101", 1.0, 1.0)]
    kind = "mention_id string, mention string, city string, pos long, poi_id string, name string, typecode string, type_name string, adcode string, lat double, lng double"
    candidates, poi = spark.createDataFrame(rows, kind), spark.createDataFrame([("P0", "abcxyz", None)], "poi_id string, name string, parent_id string")
    mentions = candidates.select("mention_id", "city").unionByName(spark.createDataFrame([("z", None)], "mention_id string, city string"))
    found = {r["mention_id"]: r["outcome"] for r in alignment.align(mentions, candidates, poi).collect()}
    assert found == {"m": "aligned", "n": "no_candidate", "z": "unresolved"}  # 0.8 x 0.5 is just enough for a sole entity


def test_loose_quotes_are_placed(spark):
    docs = spark.createDataFrame([(1, "Go early, before nine; queues grow."), (2, "nothing")], "doc_id long, body string")
    asked = spark.createDataFrame([(1, " early before nine "), (2, "Go early, before"), (3, "abc"), (4, "not there at all")], "quote_id long, quote string")
    found = {r["quote_id"]: tuple(r)[1:] for r in quotes.quote_places(asked, docs).collect()}
    assert found == {1: (1, "loose", 3, 21), 2: (1, "exact", 0, 16), 3: (None, "too_short", -1, -1), 4: (None, "missing", -1, -1)}


def test_bodies_are_prepared_once_a_document(spark):
    docs = spark.createDataFrame([(1, "𝒜 early, before\nnine; queues 𝒜 grow. Go"), (2, None)], "doc_id long, text string")
    claims = spark.createDataFrame([(1, 0, "queues grow"), (1, 1, "early before nine"), (1, 2, "\tqueues 𝒜 grow\n"), (1, 3, "nine queues 𝒜 grow Go"), (2, 4, "not in it"), (9, 5, "no document"), (1, 6, "Go"), (1, 7, None)], "doc_id long, i long, quote string")
    checked = quotes.verified(claims, docs)
    found = {r["i"]: (r["verdict"], r["char_start"], r["char_end"], r["accepted"]) for r in checked.collect()}
    assert found == {0: ("missing", -1, -1, False), 1: ("loose", 2, 20, True), 2: ("exact", 22, 35, True), 3: ("loose", 16, 39, True), 4: ("missing", -1, -1, False), 5: ("missing", -1, -1, False), 6: ("too_short", -1, -1, False), 7: ("missing", -1, -1, False)}
    above, _, below = checked.where("accepted")._jdf.queryExecution().optimizedPlan().toString().partition("Join")
    assert "lambda" not in above and "translate(__body" not in above and "translate(__body" in below
    above, _, below = QUERIES["ql04_gold_quotes"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString().partition("Generate explode")
    assert "regexp_replace" in below.split("Relation")[0]  # the normal body is made before there are five claims of it


def test_roots_of_chains_and_cycles(spark):
    chain = [(f"c{i}", f"c{i + 1}") for i in range(12)] + [("c12", None)]
    rows = [*chain, ("x", "y"), ("y", "x"), ("t", "x"), ("m", "missing"), ("s", "s")]
    found = {r["id"]: r["root"] for r in rules.resolve_roots(spark.createDataFrame(rows, "id string, parent string")).collect()}
    assert found["c0"] == "c8" and found["c5"] == "c12" and found["m"] == "missing"
    assert found["x"] == "x" and found["t"] == "x" and found["s"] == "s"


def test_ancestors_step_by_step(spark):
    chain = [(f"c{i}", f"hall {i % 3 if i < 3 else ''}", f"c{i + 1}") for i in range(12)] + [("c12", "hall", None)]
    rows = [*chain, ("x", "a", "y"), ("y", "ab", "x"), ("t", "b", " x "), ("m", "m", "missing"), ("s", "s", "s"), ("e", "e", "")]
    poi = spark.createDataFrame(rows, "poi_id string, name string, parent_id string")
    root = alignment.roots(poi)
    found = {r["poi_id"]: r["root_id"] for r in root.collect()}
    assert len(found) == len(rows) and found["c0"] == "c8" and found["c5"] == "c12" and found["m"] == "missing"
    assert found["x"] == "x" and found["t"] == "x" and found["s"] == "s" and found["e"] == "e"
    owner = alignment.owners(poi)
    owned = {r["poi_id"]: r["owner_id"] for r in owner.collect()}
    assert len(owned) == len(rows) and owned["c0"] == "c0" and owned["c2"] == "c10" and owned["c6"] == "c12" and owned["x"] == "x" and owned["t"] == "t" and owned["m"] == "m"
    for plan in (root, owner):  # no task holds the joins of several steps
        assert "Join" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_body_and_html(spark):
    rows = [("  a \r\nb\t\n\n\n\nc\n\n",), ("",), ("\n\n",), ("a\rb",)]
    got = [r[0] for r in spark.createDataFrame(rows, "x string").select(T.normal_body(F.col("x"))).collect()]
    assert got == ["  a\nb\n\nc", "", "", "a\nb"]
    page = "<html><style>p{}</style><p>A &amp;lt; B</p><div>x<br/>y</div><script>1<2</script>&#x27;&apos;</html>"
    assert spark.createDataFrame([(page,)], "x string").select(T.html_to_text(F.col("x"))).first()[0] == "A &lt; B\nx\ny\n'&apos;"


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", "p"), (2, "b", "q")], "k int, x string, y string")
    new = spark.createDataFrame([(2, None, None), (3, "c", "r")], "k int, x string, y string")
    got = {r["k"]: (r["x"], r["y"]) for r in upsert(old, new, "k", ("x",), ("y",)).collect()}
    assert got == {1: ("a", "p"), 2: (None, "q"), 3: ("c", "r")}


def test_reader_and_stream(spark, tmp_path):
    folder = tmp_path / "in" / "deep"
    folder.mkdir(parents=True)
    (folder / "a.md").write_text("one\r\ntwo \n")
    (folder / "b.html").write_text("<p>three</p>")
    (folder / "c.bin").write_text("no")
    (folder / "d.txt").write_text(" \n")
    (folder / "e.TXT").write_bytes(b"caf\xe9 open")
    assert sorted(r["body"] for r in read_documents(spark, str(tmp_path / "in")).collect()) == ["caf\ufffd open", "one\ntwo", "three"]
    arriving, store = tmp_path / "arriving", str(tmp_path / "store")
    for part in ([(1, "x y"), (2, "xy"), (3, None)], [(4, "x  y"), (5, "new")]):
        spark.createDataFrame(part, "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(arriving))
        stream = spark.readStream.schema("doc_id long, text string").parquet(str(arriving))
        import_new(stream, store, str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted(r["doc_id"] for r in spark.read.parquet(store).collect()) == [1, 3, 5]


def test_evaluation_by_brute_force(spark):
    rng = random.Random(6)
    kind = "doc_id long, seq long, subject string, polarity string, poi_id string, quote string, text string, char_start long, char_end long"

    def rows(n):
        out = []
        for seq in range(n):
            start = rng.choice([None, rng.randint(0, 30)])
            quote = rng.choice(["", "queues are long at noon", "queues are short at night", "tickets online"])
            out.append((rng.randint(0, 6), seq, rng.choice(["gate", "gate", "old gate", ""]), rng.choice("ab"), rng.choice([None, "", "P1", "P2"]), quote, quote[:12], start, None if start is None else start + 8))
        return out

    predictions, golds = rows(40), rows(40)

    def verdict(p, g):
        if p[3] != g[3]:
            return "polarity", None
        alike = bool(g[2]) and (p[2] == g[2] or (len(p[2]) >= 3 and (p[2] in g[2] or g[2] in p[2])))
        if not (p[4] and p[4] == g[4]) and not alike:
            return "subject", None
        near = None not in (p[7], g[7]) and p[7] < g[8] and g[7] < p[8]
        if not near and not any(x and blocks(x, g[5], 5)[0] >= 0.5 for x in (p[5], p[6])):
            return "fact", None
        return "hit", (p[4] == g[4]) if g[4] else None

    want, lost = set(), {}
    for doc in range(7):
        own, labels = ([x for x in y if x[0] == doc] for y in (predictions, golds))
        used = set()
        for g in labels:
            hit = next((p for p in own if p[1] not in used and verdict(p, g)[0] == "hit"), None)
            if hit:
                used.add(hit[1])
                want.add((doc, hit[1], g[1], verdict(hit, g)[1]))
        for p in own:
            if p[1] not in used:
                reasons = [verdict(p, g)[0] for g in labels]
                lost[doc, p[1]] = "no_gold" if not reasons else "duplicate" if "hit" in reasons else reasons[0]
    a, b = spark.createDataFrame(predictions, kind), spark.createDataFrame(golds, kind)
    found = evaluation.compared(a, b).cache()
    pairs = evaluation.paired(found).cache()
    assert {tuple(r) for r in pairs.collect()} == want and want
    assert {(r["doc_id"], r["p"]): r["reason"] for r in evaluation.spurious(a, found, pairs).collect()} == lost
    report = evaluation.metrics(evaluation.document_scores(a, b)).first()
    assert (report["hits"], report["recall"]) == (len(want), round(len(want) / 40, 6)) and not report["ready"]
    empty = evaluation.metrics(evaluation.document_scores(a, b.limit(0))).first()
    assert (empty["documents"], empty["recall"], empty["precision"]) == (0, None, None)


def test_legs_hold_until_a_place_moves(spark):
    kind = "trip long, day string, item_id long, seq long, start_time string, title string, kind string, poi_id string, lat double, lng double, leg_mode string, leg_key string, address string"
    rows = [(1, "d", i, i, None, "x", "poi", "P1" if i == 2 else None, 30 + i / 100, 100.0, None, None, None) for i in range(3)] + [(1, "d", 9, 9, None, "x", "meal", None, None, None, None, None, "here")]
    items = spark.createDataFrame(rows, kind)
    poi = spark.createDataFrame([("P1", 30.5, 100.5)], "poi_id string, lat double, lng double")
    pending = legs.pending_legs(items, poi)
    routes = pending.select("key", F.when(F.col("metres") <= 1500, "walk").otherwise("drive").alias("how"), F.lit(900).alias("distance_m"), F.lit(20).alias("seconds"))
    done = legs.with_legs(items, legs.planned_legs(pending, routes)).cache()
    assert {r["item_id"]: r["leg_minutes"] for r in done.collect()} == {0: 1, 1: 1, 2: None, 9: None}
    assert legs.pending_legs(done, poi).count() == 0
    moved = poi.withColumn("lat", F.lit(31.0))
    assert [r["item_id"] for r in legs.pending_legs(done, moved).collect()] == [1]
    chosen = spark.createDataFrame([(9, 1.0, 2.0, "there"), (0, 5.0, 5.0, "no")], "item_id long, lat double, lng double, address string")
    got = {r["item_id"]: (r["lat"], r["address"]) for r in legs.with_meals(items, chosen).collect()}
    assert got[9] == (1.0, "here") and got[0] == (30.0, None)


def test_seed_with_an_error_is_not_taken_in(spark):
    from quern.sources.feeds import checked_rules

    good = '{"poi_id":"P1","booking_required":true,"advance_days":3}'
    assert checked_rules(spark.createDataFrame([(good,)], "raw string")).count() == 1
    with pytest.raises(ValueError, match="negative_days"):
        checked_rules(spark.createDataFrame([(good,), (good.replace("3", "-3"),)], "raw string"))


def test_review_is_refused_while_an_error_stands(spark):
    kind = "poi_id string, required boolean, status string, advance_days int, release_time string, channels array<string>, real_name boolean, evidence_url string, reviewed_at date"
    rules = spark.createDataFrame([("a", True, "draft", None, None, ["web"], True, "u", None), ("b", True, "draft", None, None, [], True, "u", None), ("c", False, "reviewed", None, None, [], None, "u", None), ("d", True, "draft", 1, "25:00", ["web"], True, "u", None)], kind)
    asked = spark.createDataFrame([("a", False), ("b", False), ("c", True), ("d", False)], "poi_id string, revoke boolean")
    found = {r["poi_id"]: (r["status"], r["accepted"]) for r in booking.reviewed(rules, asked, F.lit("2026-01-01").cast("date")).collect()}
    assert found == {"a": ("reviewed", True), "b": ("draft", False), "c": ("draft", True), "d": ("draft", False)}
