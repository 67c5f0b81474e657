"""Aligns mentions of places with candidate places, up to the place that a mention belongs to.

candidates has a row for each mention and candidate: mention_id, mention, city (the region code), pos (the
place in the search result), poi_id, name, typecode, type_name, adcode, lat, lng. poi is the table of
known places (poi_id, name, parent_id). Everything is a plan of joins, groups and windows within a mention;
letters are compared in Python only for names that no rule decides, and only the merging of neighbours,
which depends on its own result, goes through the entities of a mention one by one.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo as G
from ..functions import names as N
from ..storage import saved

#: Rank from which a match counts, least rank of a sole entity, least lead over the second, what a containing name loses beside an exact one,
#: metres within which one name and kind are one place, and steps up to a place's ancestors.
MATCH, SOLE, LEAD, DEMOTION, SAME_METRES, HOPS = 0.80, 0.40, 0.08, 0.12, 400.0, 8


def in_city(adcode: Column, city: Column) -> Column:
    """Whether two region codes are of one city, by four characters; a missing code is elsewhere, a missing city holds all."""
    return F.when(F.coalesce(city, F.lit("")) == "", True).otherwise(F.coalesce(F.left(adcode, F.lit(4)) == F.left(city, F.lit(4)), F.lit(False)))


def scored(candidates: DataFrame) -> DataFrame:
    """Adds score, note (exact, contains or null), kind, reject (other_city, not_a_destination or null) and rank, from which a containing name loses where a usable exact one is."""
    rule, bonus = N.rule_score(F.col("mention"), F.col("name")), N.rank_bonus(F.col("mention"), F.col("name"))
    rows = candidates.withColumn("rule", rule)
    known = rows.where("rule IS NOT NULL").withColumn("score", F.col("rule"))
    rest = rows.where("rule IS NULL").withColumn("score", N.letter_score("mention", "name"))
    rows = known.unionByName(rest).drop("rule").withColumns({
        "note": F.when(bonus == N.EXACT_BONUS, "exact").when(bonus == N.CONTAINS_BONUS, "contains"),
        "kind": N.place_kind(F.col("typecode"), F.col("type_name"), F.col("name")),
        "plain": F.bround(F.col("score") + bonus, 4),
    })
    reject = F.when(~in_city(F.col("adcode"), F.col("city")), "other_city").when(F.col("kind") == "irrelevant", "not_a_destination")
    exact = F.max((F.col("reject").isNull() & (F.col("note") == "exact")).cast("int")).over(Window.partitionBy("mention_id"))
    rows = rows.withColumn("reject", reject).withColumn("exact", F.coalesce(exact, F.lit(0)))
    rank = F.when((F.col("exact") == 1) & (F.col("note") == "contains"), F.bround(F.col("plain") - DEMOTION, 4)).otherwise(F.col("plain"))
    return rows.withColumn("rank", rank).drop("exact")


def ordered(rows: DataFrame) -> DataFrame:
    """Adds place: by rank before demotion, of equals by the search's own order."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("mention_id").orderBy(F.desc("plain"), "pos")))


def _climbed(rows: DataFrame, step: Callable[[DataFrame], DataFrame], hops: int) -> DataFrame:
    """poi_id and found of rows after so many steps at most. Only rows that have an `up` go on to the next step, each of which is written, so none holds the joins of all; who has none is done."""
    out = rows.where("up IS NULL").select("poi_id", "found")
    rows = rows.where("up IS NOT NULL")
    for _ in range(hops):
        rows = saved(step(rows))
        out = out.unionByName(rows.where("up IS NULL").select("poi_id", "found"))
        rows = rows.where("up IS NOT NULL")
        if rows.isEmpty():
            return out
    return out.unionByName(rows.select("poi_id", "found"))


def roots(poi: DataFrame, hops: int = HOPS) -> DataFrame:
    """poi_id and root_id: up the parents to one that is unknown, has none, or was met before, in so many hops at most."""
    up = F.nullif(F.trim("parent_id"), F.lit(""))
    links = poi.select(F.col("poi_id").alias("found"), up.alias("up")).where("up IS NOT NULL")

    def step(rows: DataFrame) -> DataFrame:
        moved = rows.select("poi_id", F.col("up").alias("found"), F.coalesce(F.array_contains("seen", F.col("up")), F.lit(False)).alias("again"), F.array_append("seen", F.col("up")).alias("seen"))
        return moved.join(links, "found", "left").select("poi_id", "found", F.when(~F.col("again"), F.col("up")).alias("up"), "seen")

    rows = poi.select("poi_id", F.col("poi_id").alias("found"), F.when(F.col("poi_id").isNotNull(), up).alias("up"), F.array("poi_id").alias("seen"))
    return _climbed(rows, step, hops).select("poi_id", F.col("found").alias("root_id"))


def owners(poi: DataFrame, hops: int = HOPS) -> DataFrame:
    """poi_id and owner_id: up the parents as long as they are known and one's name holds the other's."""
    places = poi.select(F.col("poi_id").alias("up"), F.trim("name").alias("up_name"), F.col("parent_id").alias("up_parent"))

    def step(rows: DataFrame) -> DataFrame:
        rows = rows.join(places, "up", "left")
        one = F.col("up_name").isNotNull() & (F.col("own") != "") & (F.col("up_name") != "") & (F.col("own").contains(F.col("up_name")) | F.col("up_name").contains(F.col("own")))
        take = lambda a, b: F.when(one, F.col(a)).otherwise(F.col(b) if b else F.lit(None))
        return rows.select("poi_id", take("up", "found").alias("found"), take("up_name", "own").alias("own"), take("up_parent", None).alias("up"))

    rows = poi.select("poi_id", F.col("poi_id").alias("found"), F.trim("name").alias("own"), F.col("parent_id").alias("up"))
    return _climbed(rows, step, hops).select("poi_id", F.col("found").alias("owner_id"))


def missing_ancestors(poi: DataFrame, known: DataFrame, hops: int = HOPS) -> DataFrame:
    """The rows of `known` that are ancestors of places in poi and not among them, each once, found level by level; an unknown one ends its chain."""
    found, asked = None, poi.select(F.col("parent_id").alias("poi_id")).where("poi_id <> ''").distinct().join(poi.select("poi_id"), "poi_id", "left_anti")
    for _ in range(hops):
        level = saved(known.join(asked, "poi_id", "left_semi").dropDuplicates(["poi_id"]))
        found = level if found is None else found.unionByName(level)
        if level.isEmpty():
            break
        asked = level.select(F.col("parent_id").alias("poi_id")).where("poi_id <> ''").distinct().join(poi.select("poi_id"), "poi_id", "left_anti").join(found.select("poi_id"), "poi_id", "left_anti")
    return found


def entities(rows: DataFrame, root: DataFrame) -> DataFrame:
    """mention_id, root_id, members, best (rank, pos, poi_id, name, kind, lat, lng, score, note), known: usable candidates by the place they belong to; known tells whether that place is itself a candidate."""
    usable = rows.where("reject IS NULL").join(root, "poi_id", "left").withColumn("root_id", F.coalesce("root_id", "poi_id"))
    first = F.struct(-F.col("rank"), -F.col("plain"), "pos")
    best = F.struct("rank", "plain", "pos", "poi_id", "name", "kind", "lat", "lng", "score", "note")
    return usable.groupBy("mention_id", "root_id").agg(F.count(F.lit(1)).alias("members"), F.min_by(best, first).alias("best"), F.max(F.col("poi_id") == F.col("root_id")).alias("known"))


_MERGED = "mention_id string, root_id string, members long, rank double, plain double, pos long, poi_id string, name string, kind string, lat double, lng double, score double, note string, known boolean"


def _one_place(a, b) -> bool:
    if a.poi_id == b.poi_id or a.name.strip() != b.name.strip() or a.kind != b.kind or any(pd.isna(x) for x in (a.lat, a.lng, b.lat, b.lng)):
        return False
    return G.metres_between(a.lat, a.lng, b.lat, b.lng) <= SAME_METRES


def _merged(group: pd.DataFrame) -> pd.DataFrame:
    """Joins entities of one name, kind and neighbourhood to the first of them; a search result's entities are few."""
    kept: list[dict] = []
    bests: list = []
    for row in group.sort_values(["rank", "plain", "pos"], ascending=[False, False, True]).itertuples(index=False):
        at = next((n for n, best in enumerate(bests) if _one_place(best, row)), None)
        if at is None:
            kept.append(row._asdict())
            bests.append(row)
        else:
            kept[at]["members"] += row.members
            kept[at]["known"] = bool(kept[at]["known"] or row.known)
    return pd.DataFrame(kept, columns=group.columns)


def same_places_merged(found: DataFrame) -> DataFrame:
    """The entities of each mention, flat, after those that are one place were merged."""
    flat = found.select(F.col("mention_id").cast("string").alias("mention_id"), F.col("root_id").cast("string").alias("root_id"), "members", "best.rank", "best.plain", F.col("best.pos").cast("long").alias("pos"), F.col("best.poi_id").cast("string").alias("poi_id"), "best.name", "best.kind", "best.lat", "best.lng", "best.score", "best.note", "known")
    several = flat.groupBy("mention_id", F.trim("name").alias("n"), "kind").count().where("count > 1").select("mention_id").distinct()
    alone = flat.join(several, "mention_id", "left_anti")
    return alone.unionByName(flat.join(several, "mention_id", "left_semi").groupBy("mention_id").applyInPandas(_merged, _MERGED))


def outcomes(mentions: DataFrame, merged: DataFrame, owner: DataFrame) -> DataFrame:
    """mention_id, outcome, matched_id, resolved_id, collapsed, entities: what each mention (mention_id, city) came to.

    Without a city it is unresolved, without a usable entity there is no candidate. A first entity below MATCH
    is taken only if it is the sole one and has SOLE; one that leads by less than LEAD is ambiguous. The one
    taken is resolved to its owner, and collapsed if that is another place.
    """
    w = Window.partitionBy("mention_id").orderBy(F.desc("rank"), F.desc("plain"), "pos")
    ranked = merged.withColumns({"n": F.row_number().over(w), "second": F.lead("rank").over(w), "entities": F.count(F.lit(1)).over(Window.partitionBy("mention_id"))}).where("n = 1")
    rows = mentions.select(F.col("mention_id").cast("string").alias("mention_id"), "city").join(ranked, "mention_id", "left")
    close = F.bround(F.col("rank") - F.col("second"), 10) < LEAD
    outcome = (
        F.when(F.coalesce("city", F.lit("")) == "", "unresolved").when(F.col("rank").isNull(), "no_candidate")
        .when(F.col("rank") < MATCH, F.when((F.col("entities") == 1) & (F.col("rank") >= SOLE), "aligned").otherwise("no_candidate"))
        .when(F.col("second").isNotNull() & close, "ambiguous").otherwise("aligned")
    )
    rows = rows.withColumn("outcome", outcome).withColumn("matched_id", F.when(F.col("outcome") == "aligned", F.col("poi_id")))
    rows = rows.join(owner.select(F.col("poi_id").cast("string").alias("matched_id"), F.col("owner_id").cast("string").alias("owner_id")), "matched_id", "left")
    resolved = F.coalesce("owner_id", "matched_id")
    return rows.select("mention_id", "outcome", "matched_id", resolved.alias("resolved_id"), (resolved != F.col("matched_id")).alias("collapsed"), F.coalesce("entities", F.lit(0)).alias("entities"))


def align(mentions: DataFrame, candidates: DataFrame, poi: DataFrame) -> DataFrame:
    """outcomes() of mentions (mention_id, city) by their candidates."""
    found = entities(scored(candidates), roots(poi))
    return outcomes(mentions, same_places_merged(found), owners(poi))


def tally(found: DataFrame) -> DataFrame:
    """One row: mentions, aligned, collapsed, pending (ambiguous or without candidate), unresolved."""
    is_ = lambda *x: F.count_if(F.col("outcome").isin(*x))
    return found.agg(F.count(F.lit(1)).alias("mentions"), is_("aligned").alias("aligned"), F.count_if("collapsed").alias("collapsed"), is_("ambiguous", "no_candidate").alias("pending"), is_("unresolved").alias("unresolved"))


def resolved_by_hand(tasks: DataFrame, decisions: DataFrame, poi: DataFrame) -> DataFrame:
    """task_id, status, poi_id, city of alignment tasks (task_id, status, poi_id, city) after decisions (task_id, chosen).

    A pending task with a chosen place is resolved to it, one with a decision but no place is discarded; the city
    is the task's, else that of the place's region code. Others stay.
    """
    rows = tasks.join(decisions.withColumn("decided", F.lit(True)), "task_id", "left").join(poi.select(F.col("poi_id").alias("chosen"), "adcode"), "chosen", "left")
    open_ = (F.col("status") == "pending") & F.coalesce("decided", F.lit(False))
    known = open_ & F.col("chosen").isNotNull()
    return rows.select(
        "task_id", F.when(known, "resolved").when(open_, "discarded").otherwise(F.col("status")).alias("status"), F.when(known, F.col("chosen")).otherwise(F.col("poi_id")).alias("poi_id"),
        F.coalesce("city", F.when(known, F.concat(F.left("adcode", F.lit(4)), F.lit("00")))).alias("city"),
    )


def parked(claims: DataFrame, handled: DataFrame) -> DataFrame:
    """One task for each document and subject (doc_id, subject) with its claims in order of pos, of the subject type that came first; none where handled has the pair.

    claims has doc_id, subject, subject_type, pos and text.
    """
    first = Window.partitionBy("doc_id", "subject")
    rows = claims.join(handled.select("doc_id", "subject").distinct(), ["doc_id", "subject"], "left_anti").withColumn("first", F.min_by("subject_type", "pos").over(first))
    ordered_texts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    return rows.where(F.col("subject_type") == F.col("first")).groupBy("doc_id", "subject", "subject_type").agg(ordered_texts.alias("texts"))


def realigned(refs: DataFrame, plan: DataFrame) -> DataFrame:
    """refs (subject, poi_id and others) with poi_id moved where the plan (subject, old_id, new_id) says so, and moved."""
    moves = plan.where(~F.col("new_id").eqNullSafe(F.col("old_id")) & F.col("new_id").isNotNull()).select("subject", F.col("old_id").alias("poi_id"), "new_id")
    joined = refs.join(moves, ["subject", "poi_id"], "left")
    return joined.withColumn("moved", F.col("new_id").isNotNull()).withColumn("poi_id", F.coalesce("new_id", "poi_id")).drop("new_id")
