"""Ways between the items of a day, and places for meals that have none.

items has trip, day, item_id, seq, start_time, title, kind, poi_id, lat, lng (the item's own), leg_mode and
leg_key; poi has poi_id, lat and lng. A place's coordinates come before the item's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dates as D
from ..functions import geo as G
from ..functions import names as N
from .alignment import in_city

#: Likeness from which a name is a meal's place, and candidates shown.
MEAL_SCORE, MEAL_CANDIDATES = 0.80, 8


def located(items: DataFrame, poi: DataFrame) -> DataFrame:
    """The items with lat and lng of their place, or else their own."""
    known = poi.select("poi_id", F.col("lat").alias("p_lat"), F.col("lng").alias("p_lng"))
    return items.join(known, "poi_id", "left").withColumns({"lat": F.coalesce("p_lat", "lat"), "lng": F.coalesce("p_lng", "lng")}).drop("p_lat", "p_lng")


def item_order() -> list[Column]:
    """An item's place in its day: those without a time last."""
    minutes = D.minutes_of_day(F.col("start_time"))
    return [minutes.isNull(), minutes, F.col("seq"), F.col("item_id")]


def leg_key(lat: Column, lng: Column, to_lat: Column, to_lng: Column, to_item: Column) -> Column:
    """What a leg was worked out from: both ends, to five places, and the item that it leads to."""
    return F.format_string("%.5f,%.5f->%.5f,%.5f|%s", lat, lng, to_lat, to_lng, to_item.cast("string"))


def pending_legs(items: DataFrame, poi: DataFrame) -> DataFrame:
    """trip, day, item_id, to_item, key, metres of each two items that follow one another, have coordinates, and no leg that still holds."""
    w = Window.partitionBy("trip", "day").orderBy(*item_order())
    ahead = {f"to_{c}": F.lead(c).over(w) for c in ("item_id", "lat", "lng")}
    rows = located(items, poi).withColumns(ahead).where("to_item_id IS NOT NULL AND lat IS NOT NULL AND lng IS NOT NULL AND to_lat IS NOT NULL AND to_lng IS NOT NULL")
    rows = rows.withColumn("key", leg_key(F.col("lat"), F.col("lng"), F.col("to_lat"), F.col("to_lng"), F.col("to_item_id")))
    holds = (F.coalesce("leg_mode", F.lit("")) != "") & F.col("leg_key").eqNullSafe(F.col("key"))
    return rows.where(~holds).select("trip", "day", "item_id", F.col("to_item_id").alias("to_item"), "key", G.metres(F.col("lat"), F.col("lng"), F.col("to_lat"), F.col("to_lng")).alias("metres"))


def planned_legs(pending: DataFrame, routes: DataFrame) -> DataFrame:
    """Adds mode, distance_m and minutes of a route (key, how, distance_m, seconds): on foot within walking distance, else by car; null where none was found, never 0."""
    asked = pending.withColumn("how", F.when(F.col("metres") <= G.WALK_METRES, "walk").otherwise("drive"))
    rows = asked.join(routes, ["key", "how"], "left")
    return rows.withColumn("minutes", F.when(F.col("seconds").isNotNull(), F.greatest(F.lit(1), F.bround(F.col("seconds") / 60).cast("int")))).withColumn("mode", F.when(F.col("seconds").isNotNull(), F.col("how"))).drop("how", "seconds")


def with_legs(items: DataFrame, planned: DataFrame) -> DataFrame:
    """The items with leg_mode, leg_distance_m, leg_minutes and leg_key of the legs that were found from them."""
    new = planned.where("mode IS NOT NULL").select("item_id", F.col("mode").alias("n_mode"), F.col("distance_m").alias("leg_distance_m"), F.col("minutes").alias("leg_minutes"), F.col("key").alias("n_key"))
    return items.join(new, "item_id", "left").withColumns({"leg_mode": F.coalesce("n_mode", "leg_mode"), "leg_key": F.coalesce("n_key", "leg_key")}).drop("n_mode", "n_key")


def pending_meals(items: DataFrame, poi: DataFrame) -> DataFrame:
    """trip, day, item_id, title, anchors: meals without coordinates, with the places of their trip's day that have some, in order."""
    rows = located(items, poi)
    there = rows.where("kind = 'poi' AND lat IS NOT NULL AND lng IS NOT NULL").groupBy("trip", "day").agg(F.array_sort(F.collect_list(F.struct("seq", "item_id", "lat", "lng"))).alias("anchors"))
    meals = rows.where("kind = 'meal' AND lat IS NULL").select("trip", "day", "item_id", "title")
    return meals.join(there, ["trip", "day"], "left").withColumn("anchors", F.coalesce("anchors", F.array().cast(there.schema["anchors"].dataType)))


def meal_scores(meals: DataFrame, found: DataFrame) -> DataFrame:
    """Adds score, in_city and food to the candidates found (item_id, round, poi_id, name, typecode, type_name, adcode, lat, lng) of meals (item_id, title, city)."""
    rows = meals.join(found, "item_id").withColumn("rule", N.rule_score(F.col("title"), F.col("name")))
    rest = rows.where("rule IS NULL").withColumn("score", N.letter_score("title", "name"))
    rows = rows.where("rule IS NOT NULL").withColumn("score", F.col("rule")).unionByName(rest).drop("rule")
    return rows.withColumns({"in_city": in_city(F.col("adcode"), F.col("city")), "food": N.is_food(F.col("typecode"), F.col("type_name"))})


def meal_decisions(meals: DataFrame, found: DataFrame) -> DataFrame:
    """item_id, reason, round, poi_id, lat, lng: the candidate that a meal's title clearly means, in the first round of search that has one.

    reason is found, or of round 0 why not: no_shop, other_city, no_food, unlike, tie, no_place, or nothing.
    """
    shops = meals.where(N.looks_like_a_shop(F.col("title")))
    usable = F.col("in_city") & F.col("food")
    rows = meal_scores(shops, found)
    tops = rows.groupBy("item_id", "round").agg(F.count_if("in_city").alias("here"), F.count_if(usable).alias("n"), F.max(F.when(usable, F.struct("score", "poi_id", "lat", "lng"))).alias("best"), F.collect_list(F.when(usable, F.col("score"))).alias("scores"))
    ties = F.size(F.filter("scores", lambda x: x == F.col("best.score")))
    reason = (
        F.when(F.col("here") == 0, "other_city").when(F.col("n") == 0, "no_food").when(F.col("best.score") < MEAL_SCORE, "unlike").when(ties > 1, "tie")
        .when(F.col("best.lat").isNull() | F.col("best.lng").isNull(), "no_place").otherwise("found")
    )
    judged = tops.withColumn("reason", reason).select("item_id", "round", "reason", F.col("best.poi_id").alias("poi_id"), F.col("best.lat").alias("lat"), F.col("best.lng").alias("lng"))
    first = F.min_by(F.struct("round", "reason", "poi_id", "lat", "lng"), F.struct(F.col("reason") != "found", "round"))
    decided = judged.groupBy("item_id").agg(first.alias("d")).select("item_id", "d.*")
    rows = meals.select("item_id", "title").join(decided, "item_id", "left")
    hit = F.col("reason") == "found"
    why = F.when(~N.looks_like_a_shop(F.col("title")), "no_shop").otherwise(F.coalesce("reason", F.lit("nothing")))
    return rows.select("item_id", why.alias("reason"), *[F.when(hit, F.col(c)).alias(c) for c in ("round", "poi_id", "lat", "lng")])


def meal_candidates(meals: DataFrame, found: DataFrame, limit: int = MEAL_CANDIDATES) -> DataFrame:
    """item_id, place, total, poi_id, score, metres: for each meal its likeliest places, by name, then by how near they are to a place of the day, unknown distances last."""
    rows = meal_scores(meals.drop("anchors"), found).where("in_city AND food").dropDuplicates(["item_id", "poi_id"]).join(meals.select("item_id", "anchors"), "item_id")
    far = F.array_min(F.transform("anchors", lambda a: G.metres(F.col("lat"), F.col("lng"), a["lat"], a["lng"])))
    rows = rows.withColumn("metres", F.bround(far).cast("long"))
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("metres"), "name", "poi_id")
    rows = rows.withColumns({"place": F.row_number().over(w), "total": F.count(F.lit(1)).over(Window.partitionBy("item_id"))})
    return rows.where(F.col("place") <= limit).select("item_id", "place", "total", "poi_id", "score", "metres")


def with_meals(items: DataFrame, chosen: DataFrame) -> DataFrame:
    """The items with lat, lng and address of the places chosen (item_id, lat, lng, address) for meals; what is there already stays."""
    new = chosen.select("item_id", *[F.col(c).alias(f"n_{c}") for c in ("lat", "lng", "address")])
    write = (F.col("kind") == "meal") & F.col("lat").isNull() & F.col("n_lat").isNotNull()
    rows = items.join(new, "item_id", "left").withColumn("written", F.coalesce(write, F.lit(False)))
    return rows.withColumns({"lat": F.when(F.col("written"), F.col("n_lat")).otherwise(F.col("lat")), "lng": F.when(F.col("written"), F.col("n_lng")).otherwise(F.col("lng")), "address": F.when(F.col("written"), F.coalesce("address", "n_address")).otherwise(F.col("address"))}).drop("n_lat", "n_lng", "n_address")
