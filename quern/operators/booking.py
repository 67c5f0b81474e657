"""Booking rules: what is wrong with them, which may be shown, which are due, and what a new seed changes. Today is always a parameter.

rules has poi_id, required, status (draft or reviewed), advance_days, release_time, channels (an array),
real_name, evidence_url, reviewed_at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dates as D

#: Days for which a review holds, and days ahead that are plausible.
REVIEW_DAYS, PLAUSIBLE_DAYS = 90, 90
#: What a rule's signature rests on.
MATERIAL = ("required", "advance_days", "release_time", "channels", "real_name", "id_note", "closed_days", "evidence_url")


def review_due(reviewed_at: Column) -> Column:
    return F.date_add(reviewed_at, REVIEW_DAYS)


def findings(rules: DataFrame, today: Column) -> DataFrame:
    """poi_id, code and severity of everything that is wrong with each rule."""
    c = F.col
    required, reviewed = F.coalesce(c("required"), F.lit(False)), c("status") == "reviewed"
    sourced, dated = F.coalesce(c("evidence_url"), F.lit("")) != "", c("reviewed_at").isNotNull()
    checks = {
        ("no_advance_days", "warn"): required & c("advance_days").isNull(),
        ("implausible_advance_days", "error"): required & (c("advance_days") > PLAUSIBLE_DAYS),
        ("no_channel", "error"): required & (F.coalesce(F.size("channels"), F.lit(0)) <= 0),
        ("advance_days_without_required", "warn"): ~required & c("advance_days").isNotNull(),
        ("bad_release_time", "error"): c("release_time").isNotNull() & D.minutes_of_day(c("release_time")).isNull(),
        ("reviewed_without_evidence", "error"): reviewed & ~sourced,
        ("reviewed_without_date", "error"): reviewed & ~dated,
        ("review_overdue", "warn"): reviewed & (review_due(c("reviewed_at")) <= today),
        ("draft_but_ready", "warn"): ~reviewed & sourced & dated,
        ("unknown_real_name", "warn"): required & c("real_name").isNull(),
    }
    found = F.array_compact(F.array(*[F.when(when, F.struct(F.lit(code).alias("code"), F.lit(level).alias("severity"))) for (code, level), when in checks.items()]))
    return rules.select("poi_id", F.explode(found).alias("f")).select("poi_id", "f.code", "f.severity")


def reviewed(rules: DataFrame, asked: DataFrame, today: Column) -> DataFrame:
    """rules after those in asked (poi_id, revoke) were reviewed today, unless an error of another kind than a missing date stands against it, or set back to draft where revoked; with accepted, null for those not asked."""
    wished = rules.join(asked, "poi_id", "left").withColumn("own", F.col("status"))
    as_reviewed = wished.where("revoke = false").withColumns({"status": F.lit("reviewed"), "reviewed_at": today})
    bad = findings(as_reviewed, today).where("severity = 'error'").select("poi_id").distinct().withColumn("bad", F.lit(True))
    rows = wished.join(bad, "poi_id", "left")
    good = (F.col("revoke") == F.lit(False)) & F.col("bad").isNull()
    status = F.when(F.col("revoke"), "draft").when(good, "reviewed").otherwise(F.col("own"))
    accepted = F.when(F.col("revoke").isNotNull(), F.col("revoke") | good)
    kept = [x for x in rules.columns if x not in ("status", "reviewed_at")]
    return rows.select(*kept, status.alias("status"), F.when(good, today).when(F.col("revoke"), F.lit(None)).otherwise(F.col("reviewed_at")).alias("reviewed_at"), accepted.alias("accepted"))


def seeded(rules: DataFrame, seed: DataFrame) -> DataFrame:
    """poi_id, status, reviewed_at, change of each rule after a seed was taken in: new, unchanged or changed, or kept where the seed has no rule for it.

    A rule whose material is the same keeps its signature; where anything differs, a null included, it is a draft again.
    """
    old, new = rules.alias("o"), seed.alias("n")
    joined = old.join(new, F.col("o.poi_id") == F.col("n.poi_id"), "full")
    same = F.struct(*[F.col(f"o.{x}") for x in MATERIAL]).eqNullSafe(F.struct(*[F.col(f"n.{x}") for x in MATERIAL]))
    change = F.when(F.col("n.poi_id").isNull(), "kept").when(F.col("o.poi_id").isNull(), "new").when(same, "unchanged").otherwise("changed")
    rows = joined.select(F.coalesce("o.poi_id", "n.poi_id").alias("poi_id"), F.col("o.status").alias("status"), F.col("o.reviewed_at").alias("reviewed_at"), change.alias("change"))
    holds = F.col("change").isin("kept", "unchanged")
    return rows.select("poi_id", F.when(holds, F.col("status")).otherwise("draft").alias("status"), F.when(holds, F.col("reviewed_at")).alias("reviewed_at"), "change")


def due_rules(rules: DataFrame, today: Column, within: int = D.SOON_DAYS) -> DataFrame:
    """poi_id, due and days_left of reviewed rules whose review ends within so many days, today and before included."""
    rows = rules.where("status = 'reviewed' AND reviewed_at IS NOT NULL").select("poi_id", review_due(F.col("reviewed_at")).alias("due"))
    return rows.withColumn("days_left", F.datediff("due", today)).where(F.col("days_left") <= within)


def scan(rules: DataFrame, claims: DataFrame, today: Column, within: int = D.SOON_DAYS) -> DataFrame:
    """kind, id, due and days_left of the rules and claims (id, due) that are due within so many days."""
    some = due_rules(rules, today, within).select(F.lit("rule").alias("kind"), F.col("poi_id").cast("string").alias("id"), "due", "days_left")
    other = claims.where("due IS NOT NULL").withColumn("days_left", F.datediff("due", today)).where(F.col("days_left") <= within)
    return some.unionByName(other.select(F.lit("claim").alias("kind"), F.col("id").cast("string").alias("id"), "due", "days_left"))


def draft_places(visits: DataFrame, rules: DataFrame) -> DataFrame:
    """trip and poi_id, each once, of visited places whose rule is still a draft."""
    return visits.select("trip", "poi_id").distinct().join(rules.where("status = 'draft'").select("poi_id"), "poi_id", "left_semi")


def headline(days: Column, release_time: Column) -> Column:
    """What to do about a booking, by the days until tickets are released and the time of day. The wording is fixed."""
    said, timed = days.cast("string"), F.coalesce(release_time, F.lit("")) != ""
    return (
        F.when(days.isNull(), "必须提前线上预约——官方未公布放票口径，出行前以官方渠道为准")
        .when(days < 0, F.concat(F.lit("放票日已过 "), F.abs(days).cast("string"), F.lit(" 天，立刻确认是否还有票")))
        .when(days == 0, F.concat(F.lit("今天"), F.when(timed, F.concat(F.lit(" "), release_time)).otherwise(""), F.lit(" 放票")))
        .when(~timed, F.concat(said, F.lit(" 天后可以开始预约"))).otherwise(F.concat(said, F.lit(" 天后放票")))
    )


def alerts(visits: DataFrame, rules: DataFrame, today: Column) -> DataFrame:
    """trip, place, poi_id, visit_date, release_date, days, urgency, headline, channels of visits (trip, poi_id, visit_date) whose rule asks for booking and was reviewed.

    place numbers a trip's alerts: the one released soonest first, past ones before, those without a day last, equal ones by visit. Rules that
    are drafts, and places without a rule, raise none.
    """
    seen = rules.where("required AND status = 'reviewed'").select("poi_id", "advance_days", "release_time", "channels")
    release = F.date_sub("visit_date", F.col("advance_days"))
    rows = visits.join(seen, "poi_id").withColumn("release_date", release).withColumn("days", F.datediff("release_date", today))
    rows = rows.withColumns({"urgency": D.urgency(F.col("days")), "headline": headline(F.col("days"), F.col("release_time"))})
    order = Window.partitionBy("trip").orderBy(F.asc_nulls_last("days"), "visit_date", "poi_id")
    return rows.withColumn("place", F.row_number().over(order)).select("trip", "place", "poi_id", "visit_date", "release_date", "days", "urgency", "headline", "channels")


def transfer_advice(minutes: Column, available: Column, km: Column, unknown: Column) -> Column:
    """A struct of mode, why and other: what to take between two cities, the rule that says so, and what else there is."""

    def said(mode: str, why: str, *other: str) -> Column:
        return F.struct(F.lit(mode).alias("mode"), F.lit(why).alias("why"), F.array(*map(F.lit, other)).alias("other"))

    return (
        F.when(km <= 60, said("coach", "short", "drive", "rail"))
        .when(unknown & F.coalesce(km <= 1200, F.lit(False)), said("rail", "by_distance", "air")).when(unknown, said("air", "far", "rail"))
        .when(~available | minutes.isNull(), said("air", "no_rail", "coach", "drive"))
        .when(minutes <= 240, said("rail", "fast", "air")).when(minutes < 360, said("rail", "bearable", "air")).otherwise(said("air", "slow_rail", "rail"))
    )


def transfers(stays: DataFrame, rail: DataFrame, today: Column, alternatives: int = 3, window: int = 14) -> DataFrame:
    """One row for each two stays of a trip that follow one another: day, mode, why, service, others.

    stays has trip, stay, seq, city, first, last; rail has a, b, travel_date, service, minutes and km.
    Trains are known from today to `window` days ahead. The journey is on the last day of the stay that ends; if it
    takes over 240 minutes or goes by air, on the first day of the next, and trains are looked up anew for that day.
    """
    w = Window.partitionBy("trip").orderBy("seq")
    legs = stays.withColumns({"next": F.lead("stay").over(w), "b": F.lead("city").over(w), "next_first": F.lead("first").over(w)}).where("next IS NOT NULL")
    legs = legs.select("trip", "stay", "next", F.col("city").alias("a"), "b", "last", "next_first")
    ordered = F.array_sort(F.collect_list(F.struct("minutes", "service")))
    known = rail.groupBy("a", "b", "travel_date").agg(ordered.alias("trains"))
    far = rail.groupBy("a", "b").agg(F.max("km").alias("km"))

    def asked(rows: DataFrame, day: str) -> DataFrame:
        ahead = F.datediff(F.col(day), today)
        rows = rows.join(known.withColumnRenamed("travel_date", day), ["a", "b", day], "left").withColumn("unknown", ~ahead.between(0, window))
        rows = rows.withColumn("trains", F.when(~F.col("unknown"), F.coalesce("trains", F.array().cast(known.schema["trains"].dataType))))
        return rows.withColumn("advice", transfer_advice(F.get("trains", F.lit(0))["minutes"], F.coalesce(F.size("trains"), F.lit(0)) > 0, F.col("km"), F.col("unknown")))

    first = asked(legs.join(far, ["a", "b"], "left"), "last")
    late = (F.col("advice.mode") == "air") | F.coalesce(F.get("trains", F.lit(0))["minutes"] > 240, F.lit(False))
    first = first.withColumn("day", F.when(late, F.col("next_first")).otherwise(F.col("last")))
    stays_put = first.where("day = last")
    again = asked(first.where("day <> last").drop("trains", "unknown", "advice"), "day")
    rows = stays_put.unionByName(again.select(stays_put.columns))
    services = F.transform(F.coalesce("trains", F.array().cast(known.schema["trains"].dataType)), lambda x: x["service"])
    return rows.select("trip", "stay", "next", "day", "advice.mode", "advice.why", F.get(services, F.lit(0)).alias("service"), F.slice(services, 2, alternatives).alias("others"))
