"""What is known of the places of a city and of a trip: claims by polarity, candidates with their booking rules, and how much of a trip anyone recommends.

claims has city, poi_id, claim_id, polarity (highlight or avoid), confidence and sources (independent ones); rules those of booking.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Claims of a polarity that are shown of a place, and candidates of a city.
SHOWN, CANDIDATES = 8, 60
HIGHLIGHT, AVOID, SURE = "highlight", "avoid", "high"


def trip_insights(items: DataFrame, claims: DataFrame, shown: int = SHOWN) -> DataFrame:
    """trip, poi_id, polarity, place, claim_id, others: the first claims of each polarity on each place of a trip, sure ones first, then by sources; others are those beyond.

    items has trip, kind and poi_id; only places count, once each, and those that are known.
    """
    visited = items.where("kind = 'poi' AND poi_id IS NOT NULL").select("trip", "poi_id").distinct()
    own = Window.partitionBy("poi_id", "polarity")
    order = own.orderBy(F.coalesce(F.col("confidence"), F.lit("")) != SURE, F.desc("sources"), "claim_id")
    ranked = claims.where(F.col("polarity").isin(HIGHLIGHT, AVOID)).withColumns({"place": F.row_number().over(order), "n": F.count(F.lit(1)).over(own)})
    top = ranked.where(F.col("place") <= shown).select("poi_id", "polarity", "place", "claim_id", F.greatest(F.col("n") - shown, F.lit(0)).alias("others"))
    return visited.join(top, "poi_id").select("trip", "poi_id", "polarity", "place", "claim_id", "others")


def city_candidates(claims: DataFrame, poi: DataFrame, rules: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """city, place, poi_id, name, claims, sure, highlights, avoids, booking_required, booking_days, booking_time: the places of a city that claims are made of, most claims first, then most sure ones, then by name.

    A place that isn't known goes by its id. Of rules only reviewed ones count; without one the three booking columns are null.
    """
    polar = lambda x: F.count_if(F.col("polarity") == x)
    counts = claims.where("poi_id IS NOT NULL").groupBy("city", "poi_id").agg(F.count(F.lit(1)).alias("claims"), F.count_if(F.col("confidence") == SURE).alias("sure"), polar(HIGHLIGHT).alias("highlights"), polar(AVOID).alias("avoids"))
    seen = rules.where("status = 'reviewed'").select("poi_id", F.coalesce("required", F.lit(False)).alias("booking_required"), F.col("advance_days").alias("booking_days"), F.col("release_time").alias("booking_time"))
    rows = counts.join(poi.select("poi_id", "name"), "poi_id", "left").join(seen, "poi_id", "left").withColumn("name", F.coalesce("name", F.col("poi_id").cast("string")))
    order = Window.partitionBy("city").orderBy(F.desc("claims"), F.desc("sure"), "name", "poi_id")
    rows = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
    return rows.select("city", "place", "poi_id", "name", "claims", "sure", "highlights", "avoids", "booking_required", "booking_days", "booking_time")


def item_coverage(items: DataFrame, candidates: DataFrame) -> DataFrame:
    """trip, poi_id, title, first_date, recommended, claims, booking_required of each place of a trip: whether it is among its city's candidates. items has trip, kind, poi_id, title, date and city."""
    rows = items.where("kind = 'poi' AND poi_id IS NOT NULL").groupBy("trip", "poi_id", "title").agg(F.min("date").alias("first_date"), F.min_by("city", F.struct("date", "city")).alias("city"))
    known = candidates.select("city", "poi_id", "claims", "booking_required", F.lit(True).alias("recommended"))
    rows = rows.join(known, ["city", "poi_id"], "left")
    return rows.select("trip", "poi_id", "title", "first_date", F.coalesce("recommended", F.lit(False)).alias("recommended"), F.coalesce("claims", F.lit(0)).alias("claims"), "booking_required")


def trip_coverage(items: DataFrame, candidates: DataFrame) -> DataFrame:
    """trip, total, recommended, bookings, unresolved, ratio: places of each trip, those that are recommended and that must be booked, items without a place, and the share that is recommended, null if no place is known."""
    covered = item_coverage(items, candidates).groupBy("trip").agg(F.count(F.lit(1)).alias("total"), F.count_if("recommended").alias("recommended"), F.count_if("booking_required").alias("bookings"))
    loose = items.where("kind = 'poi'").groupBy("trip").agg(F.count_if(F.col("poi_id").isNull()).alias("unresolved"))
    rows = items.select("trip").distinct().join(covered, "trip", "left").join(loose, "trip", "left").fillna(0, ["total", "recommended", "bookings", "unresolved"])
    return rows.withColumn("ratio", F.round(F.col("recommended") / F.nullif("total", F.lit(0)), 6))
