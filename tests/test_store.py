"""Saves over several tables that fail in between, are run again, replace and delete."""

import pytest

from quern.operators.store import TableStore

SCHEMAS = {"stay": "stay long, city string", "day": "day string, stay long", "item": "item long, day string", "transfer": "price double", "budget": "category string, amount double"}


def plan(spark, trips, mark):
    rows = {"stay": [], "day": [], "item": [], "transfer": [], "budget": []}
    for trip in trips:
        for stay in range(trip % 3):
            rows["stay"].append((trip, stay, f"{mark}{stay}"))
            rows["day"].append((trip, f"{mark}d{stay}", stay))
            rows["item"] += [(trip, i, f"{mark}d{stay}") for i in range(2)]
        rows["transfer"].append((trip, 10.0 * trip))
        rows["budget"].append((trip, mark, 1.0))
    return {name: spark.createDataFrame(rows[name], f"owner long, {SCHEMAS[name]}") for name in rows}


def seen(store):
    return {name: sorted(map(tuple, store.read(name).collect())) for name in SCHEMAS}


def wanted(spark, **marks):
    """What is to be seen if each trip was last saved with the given mark."""
    out = {name: [] for name in SCHEMAS}
    for trip, mark in marks.items():
        for name, part in plan(spark, [int(trip[1:])], mark).items():
            out[name] += map(tuple, part.collect())
    return {name: sorted(rows) for name, rows in out.items()}


def test_saves_are_whole(spark, tmp_path, monkeypatch):
    store = TableStore(spark, str(tmp_path / "store"), "long", SCHEMAS)
    assert seen(store) == wanted(spark)
    store.save(1, plan(spark, [1, 2, 3], "a"))
    first = wanted(spark, t1="a", t2="a", t3="a")
    assert seen(store) == first
    write, done = TableStore._write, []

    def failing(self, rows, table, number):
        if len(done) == stop:
            raise OSError("disk")
        done.append(table)
        write(self, rows, table, number)

    monkeypatch.setattr(TableStore, "_write", failing)
    for stop in range(len(SCHEMAS) + 1):  # stops before each of the tables, and before the last word
        done.clear()
        with pytest.raises(OSError):
            store.save(2, plan(spark, [2, 4], "b"))
        assert seen(store) == first
    monkeypatch.undo()
    both = wanted(spark, t1="a", t2="b", t3="a", t4="b")
    for _ in range(2):
        store.save(2, plan(spark, [2, 4], "b"))
        assert seen(store) == both
    assert {r["name"]: r["rows"] for r in store.removed_by(2).collect()} == {"stay": 2, "day": 2, "item": 4, "transfer": 1, "budget": 1}
    # only one table is replaced, by nothing for one of the trips
    owners = spark.createDataFrame([(1,), (2,)], "owner long")
    store.save(3, {"transfer": spark.createDataFrame([(2, 7.0), (2, 8.0), (9, 1.0)], "owner long, price double")}, owners)
    now = seen(store)
    assert now["transfer"] == [(2, 7.0), (2, 8.0), (3, 30.0), (4, 40.0)] and {**now, "transfer": both["transfer"]} == both
    store.save(4, {"transfer": spark.createDataFrame([(3, 5.0)], "owner long, price double")})
    store.save(4, {"transfer": spark.createDataFrame([], "owner long, price double")}, spark.createDataFrame([(4,)], "owner long"))  # another save under the same number
    assert seen(store)["transfer"] == [(2, 7.0), (2, 8.0), (3, 30.0)]
    now["transfer"] = [(2, 7.0), (2, 8.0), (3, 30.0)]
    store.delete(5, spark.createDataFrame([(2,), (77,)], "owner long"))
    left = {name: [row for row in rows if row[0] != 2] for name, rows in now.items()}
    assert seen(store) == left
    assert seen(store.compacted(str(tmp_path / "new"))) == left
    with pytest.raises(ValueError, match="without owner"):
        store.save(6, {"budget": spark.createDataFrame([(None, "x", 1.0)], f"owner long, {SCHEMAS['budget']}")})
    assert seen(store) == left
