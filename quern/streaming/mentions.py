"""Mentions that wait to be aligned, as a queue with state.

A mention is asked for, places that may be meant are found for it, now or later, and a person may decide. It is parked until
the places found so far align it, a decision attaches or discards it, or WAIT_DAYS have passed. Whatever comes first is final.
Events count in the order of their times: they wait in the mention's state until the watermark has passed
them, so that any cut into batches comes to the same as replay() over all events at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.alignment import LEAD, MATCH, SOLE

#: Fixed value: days after which a mention that nothing has settled is given up.
WAIT_DAYS = 30
_WAIT_MS = WAIT_DAYS * 86_400_000

#: Events: ask, place (poi_id and its rank), attach (poi_id), discard.
EVENTS = "mention_id long, at timestamp, seq long, what string, poi_id string, rank double"
CHANGES = "mention_id long, at long, status string, poi_id string"


class Event(NamedTuple):
    at: int  # milliseconds
    seq: int
    what: str
    poi_id: str | None
    rank: float | None


class Mention(NamedTuple):
    """asked is when it was first asked for, best and second the likeliest two places so far."""

    status: str = ""
    asked: int = -1
    best: str | None = None
    best_rank: float = -1.0
    second: str | None = None
    second_rank: float = -1.0


def _with_place(m: Mention, poi_id: str, rank: float) -> Mention:
    ranks = {p: r for p, r in ((m.best, m.best_rank), (m.second, m.second_rank)) if p is not None}
    ranks[poi_id] = max(rank, ranks.get(poi_id, rank))
    first, *more = sorted(ranks.items(), key=lambda x: (-x[1], x[0]))
    second = more[0] if more else (None, -1.0)
    return m._replace(best=first[0], best_rank=first[1], second=second[0], second_rank=second[1])


def _aligned(m: Mention) -> bool:
    """Whether the two likeliest places settle it: a likely one well ahead of the next, or a sole one that is likely enough."""
    if m.best is None:
        return False
    if m.best_rank < MATCH:
        return m.second is None and m.best_rank >= SOLE
    return m.second is None or round(m.best_rank - m.second_rank, 10) >= LEAD


def advance(m: Mention, event: Event) -> tuple[Mention, tuple[int, str, str | None] | None]:
    """The mention after an event, and what became of it by that: time, status and place."""
    if m.status not in ("", "parked"):
        return m, None  # settled
    if event.what == "place" and event.poi_id is not None and event.rank is not None:
        m = _with_place(m, event.poi_id, event.rank)
    elif event.what == "ask" and m.asked < 0:
        m = m._replace(asked=event.at)
    elif event.what in ("attach", "discard") and m.asked >= 0:
        status, poi_id = ("resolved", event.poi_id) if event.what == "attach" else ("discarded", None)
        return m._replace(status=status), (event.at, status, poi_id)
    if m.asked < 0:
        return m, None
    if _aligned(m):
        return m._replace(status="aligned"), (event.at, "aligned", m.best)
    return (m, None) if m.status else (m._replace(status="parked"), (event.at, "parked", None))


def passed(m: Mention, until: int) -> tuple[Mention, tuple[int, str, str | None] | None]:
    """The mention when no event came until a time."""
    if m.status == "parked" and m.asked + _WAIT_MS <= until:
        return m._replace(status="expired"), (m.asked + _WAIT_MS, "expired", None)
    return m, None


def settle(m: Mention, events: list[Event], until: int) -> tuple[Mention, list[tuple[int, str, str | None]]]:
    """The mention after events up to a time, and all that became of it."""
    changes = []
    for event in sorted(events, key=lambda e: (e.at, e.seq, e.what, e.poi_id or "")):
        m, expired = passed(m, event.at)
        m, change = advance(m, event)
        changes += [expired, change]
    m, expired = passed(m, until)
    return m, [x for x in [*changes, expired] if x]


def replay(events: DataFrame, until: str) -> DataFrame:
    """mention_id, at, status, poi_id: what became of each mention, and when, by the events (EVENTS) up to a time."""
    last = events.sparkSession.sql(f"SELECT unix_millis(timestamp'{until}')").first()[0]
    rows = events.where(F.unix_millis("at") <= last).withColumn("at", F.unix_millis("at"))

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        own = [Event(int(r.at), int(r.seq), r.what, r.poi_id, None if pd.isna(r.rank) else float(r.rank)) for r in group.itertuples(name="R")] if len(group) else []
        _, changes = settle(Mention(), own, last)
        return pd.DataFrame([(group["mention_id"].iloc[0], at, status, poi_id) for at, status, poi_id in changes], columns=["mention_id", "at", "status", "poi_id"])

    found = rows.groupBy("mention_id").applyInPandas(fold, CHANGES)
    return found.withColumn("at", F.timestamp_millis("at"))


class _Queue(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.mention = handle.getValueState("mention", "status string, asked long, best string, best_rank double, second string, second_rank double")
        self.waiting = handle.getListState("waiting", "at long, seq long, what string, poi_id string, rank double")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for row in rows:
            self.waiting.appendValue((row["ms"], row["seq"], row["what"], row["poi_id"], row["rank"]))
            self.handle.registerTimer(row["ms"])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        events = [Event(*x) for x in self.waiting.get()]
        before = Mention(*self.mention.get()) if self.mention.exists() else Mention()
        m, changes = settle(before, [e for e in events if e.at <= now], now)
        later = [tuple(e) for e in events if e.at > now]
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        self.mention.update(tuple(m))
        if m.status == "parked" and before.status != "parked":
            self.handle.registerTimer(m.asked + _WAIT_MS)
        return iter([Row(mention_id=key[0], at=at, status=status, poi_id=poi_id) for at, status, poi_id in changes])

    def close(self) -> None:
        pass


def queue(events: DataFrame, late: str = "1 day") -> DataFrame:
    """The same of a stream of events (EVENTS): what becomes of mentions, as soon as no event of that time can come any more. Events more than `late` behind the newest are too late.

    The session's state store must be that of RocksDB.
    """
    rows = events.withWatermark("at", late).withColumn("ms", F.unix_millis("at"))
    found = rows.groupBy("mention_id").transformWithState(statefulProcessor=_Queue(), outputStructType=CHANGES, outputMode="Append", timeMode="EventTime")
    return found.withColumn("at", F.timestamp_millis("at"))
