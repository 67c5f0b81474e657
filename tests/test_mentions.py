"""The queue of mentions: what becomes of them, one by one, all at once and in batches of a stream."""

import datetime as dt
import random

from quern.streaming import mentions as M

DAY = 86_400_000


def outcome(*events, until=100 * DAY):
    rows = [M.Event(at, n, what, poi, rank) for n, (at, what, poi, rank) in enumerate(events)]
    return M.settle(M.Mention(), rows, until)[1]


def test_what_settles_a_mention():
    ask, place = lambda at: (at, "ask", None, None), lambda at, p, r: (at, "place", p, r)
    assert outcome(ask(0)) == [(0, "parked", None), (30 * DAY, "expired", None)]
    assert outcome(ask(0), until=30 * DAY - 1) == [(0, "parked", None)]
    assert outcome(ask(0), place(5, "p", 0.3)) == [(0, "parked", None), (30 * DAY, "expired", None)]
    assert outcome(ask(0), place(5, "p", 0.5)) == [(0, "parked", None), (5, "aligned", "p")]  # a sole one is enough
    assert outcome(place(0, "p", 0.5), place(1, "q", 0.5), ask(2), place(3, "q", 0.85)) == [(2, "parked", None), (3, "aligned", "q")]
    assert outcome(place(0, "p", 0.9), place(1, "q", 0.85), ask(2), (9, "attach", "z", None)) == [(2, "parked", None), (9, "resolved", "z")]
    assert outcome(ask(0), (1, "discard", None, None), place(2, "p", 1.0)) == [(0, "parked", None), (1, "discarded", None)]
    assert outcome(ask(0), place(30 * DAY, "p", 1.0)) == [(0, "parked", None), (30 * DAY, "expired", None)]  # too late
    assert outcome(place(0, "p", 1.0)) == [] and outcome((0, "attach", "p", None)) == []
    assert outcome(place(0, "p", 0.9), place(1, "p", 0.95), ask(2)) == [(2, "aligned", "p")]


def made_events(seed):
    rng = random.Random(seed)
    rows = []
    for mention in range(25):
        for seq in range(rng.randint(1, 7)):
            what = rng.choice(["ask", "ask", "place", "place", "place", "attach", "discard"])
            at = dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randint(0, 24 * 60))
            rows.append((mention, at, seq, what, rng.choice("pqr") if what in ("place", "attach") else None, rng.choice([0.3, 0.5, 0.8, 0.85, 0.95]) if what == "place" else None))
    return sorted(rows, key=lambda r: r[1])


def changes(df):
    return sorted((r["mention_id"], r["at"], r["status"], r["poi_id"] or "") for r in df.collect())


def test_stream_comes_to_the_same_as_all_at_once(spark, tmp_path):
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = made_events(3)
        rng = random.Random(1)
        cuts = sorted(rng.sample(range(1, len(rows)), 3))
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
        parts[0], parts[1] = parts[0][:-1], [parts[0][-1], *parts[1]]  # a neighbour comes a batch later
        flush = [(999, dt.datetime(2024, 6, 1), 0, "place", "x", 0.1)], [(999, dt.datetime(2024, 6, 2), 1, "place", "x", 0.1)]
        arriving, out = str(tmp_path / "arriving"), str(tmp_path / "out")
        for part in [*parts, *flush]:
            spark.createDataFrame(part, M.EVENTS).coalesce(1).write.mode("append").parquet(arriving)
            found = M.queue(spark.readStream.schema(M.EVENTS).parquet(arriving), "2 days")
            found.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
        want = changes(M.replay(spark.createDataFrame(rows, M.EVENTS), "2024-05-01 00:00:00"))
        assert changes(spark.read.parquet(out)) == want
        assert {s for *_, s, _ in want} == {"parked", "aligned", "resolved", "discarded", "expired"}
    finally:
        spark.conf.set(provider, before)
