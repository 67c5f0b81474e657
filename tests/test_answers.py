"""Answers and runs as JSON texts that can't be relied on, and alerts."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quern.operators import evaluation
from quern.sources import feeds as S

TEXTS = ["[1]", '{"a":1}', "[1]]", "[1]}", '{"a":1}}', '{"a":1}]', "", " ", "x", "null", "3", "1,2", "[1][2]", '"s"', "[1", None, '[{"a":"]"}]', ' [1] ']


def loads(text):
    try:
        return json.loads(text)
    except (ValueError, TypeError):
        return ()


def test_whole_json(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, raw string").select("i", S.whole_json(F.col("raw")).isNotNull().alias("ok")).collect()
    assert {r["i"]: r["ok"] for r in rows} == {i: loads(t) != () for i, t in enumerate(TEXTS)}
    found = S.json_objects(spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, raw string"), "raw").groupBy("i").count().collect()
    assert {r["i"]: r["count"] for r in found} == {i: len(loads(t)) for i, t in enumerate(TEXTS) if isinstance(loads(t), list)}


@pytest.mark.parametrize("name, want", [("[closed] hall", "[closed] hall"), (["a", "b"], "ab"), ([], "P1"), ("", "P1"), (5, "5")])
def test_names_of_places_as_they_come(spark, name, want):
    raw = json.dumps({"id": "P1", "name": name, "location": "100.5,30.5", "parent": [], "photos": [{"url": "u"}]})
    row = S.places(spark.createDataFrame([(raw,)], "raw string")).first()
    assert (row["name"], row["parent_id"], row["photo_url"], row["lat"]) == (want, None, "u", 30.5)


def test_claims_one_by_one(spark):
    good = {"subject_name": " gate ", "subject_type": "poi", "polarity": "avoid", "facet": "nothing", "text": "　t ", "quote": " q "}
    claims = [good, {**good, "subject_type": "shop"}, {**good, "polarity": None}, "x", 3, None, [good], {}]
    rows = S.extracted_claims(spark.createDataFrame([(1, json.dumps({"claims": claims})), (2, "{}"), (3, "nonsense"), (4, None)], "doc_id long, raw string")).collect()
    assert {r["doc_id"] for r in rows} == {1}
    assert [r["reason"] for r in sorted(rows, key=lambda r: r["pos"])] == [None, "subject_type", "polarity", "no_object", "no_object", "no_object", "no_object", "subject_type"]
    first = min(rows, key=lambda r: r["pos"])
    assert (first["subject_name"], first["facet"], first["text"], first["quote"]) == ("gate", "other", "t", " q ")


def test_pairs_of_many_documents_pass_in_order(spark):
    """Hits go through no group a document, and are paired as golds and predictions follow one another."""
    rng = random.Random(3)
    hits = [(d, p, g) for d in range(40) for p in range(6) for g in range(6) if rng.random() < 0.4]
    want = set()
    for d in range(40):
        used = set()
        for g in range(6):
            free = [p for x, p, y in hits if (x, y) == (d, g) and p not in used]
            if free:
                used.add(min(free))
                want.add((d, min(free), g))
    found = spark.createDataFrame([(*x, "hit", True) for x in hits], "doc_id long, p long, g long, verdict string, agrees boolean").repartition(7)
    out = evaluation.paired(found)
    assert "InPandas" not in out._jdf.queryExecution().toString()
    assert {(r["doc_id"], r["p"], r["g"]) for r in out.collect()} == want


def test_answers_are_parsed_once(spark):
    raw = ['{"id":"B1","name":"","location":"100.5,30.25","address":["a","b"],"biz_ext":{"rating":"4.5","opentime":"9"},"photos":[{"url":"u"}]}', "{not json", '{"id":"B2","location":[]}', None]
    found = S.places(spark.createDataFrame([(x,) for x in raw], "raw string"))
    assert [(r.poi_id, r.name, r.lat, r.lng, r.rating, r.address, r.open_time, r.photo_url) for r in found.collect()] == [("B1", "B1", 30.25, 100.5, 4.5, "ab", "9", "u")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parse_json") + plan.count("parseJson") == 1
