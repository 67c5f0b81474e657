"""A roadbook's days: items in order with what is known of their places, the ways between them, and the weather."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo as G
from .legs import item_order

#: How a way is asked for at the map service, by mode, and what stands for a title.
NAVIGATION = "https://uri.amap.com/navigation?from=%s,%s,%s&to=%s,%s,%s&mode=%s"
MODES = {"walk": "walk", "metro": "bus", "taxi": "car"}
UNTITLED = "（未命名）"


def _escaped(text: Column) -> Column:
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return text


def navigation_url(lat: Column, lng: Column, name: Column, to_lat: Column, to_lng: Column, to_name: Column, mode: Column) -> Column:
    """The address that shows a way on the map."""
    asked = F.when(mode == "walk", MODES["walk"]).when(mode == "metro", MODES["metro"]).otherwise(MODES["taxi"])
    return F.format_string(NAVIGATION, lng.cast("string"), lat.cast("string"), _escaped(name), to_lng.cast("string"), to_lat.cast("string"), _escaped(to_name), asked)


def booking_text(required: Column, advance_days: Column, release_time: Column) -> Column:
    """What a page says of a reviewed rule, null if no booking is needed. The wording is fixed."""
    at = F.when(F.coalesce(release_time, F.lit("")) != "", F.concat(F.lit(" "), release_time)).otherwise("")
    text = F.when(advance_days.isNull(), "必须提前线上预约，放票口径以官方渠道为准").otherwise(F.concat(F.lit("需预约，提前 "), advance_days.cast("string"), F.lit(" 天"), at, F.lit("放票")))
    return F.when(F.coalesce(required, F.lit(False)), text)


def assembled(items: DataFrame, poi: DataFrame, claims: DataFrame, rules: DataFrame, weather: DataFrame) -> DataFrame:
    """trip, day, items, legs, weather, warnings: the days of roadbooks.

    items are those of legs, with leg_distance_m and leg_minutes beside leg_mode; poi has poi_id, name, address, lat and lng; claims
    poi_id, polarity and text, rules those of booking, weather trip, day and text. items is an array of (title, kind, start_time,
    address, highlights, avoids, booking) in the order of the day, legs one of (mode, distance_m, minutes, nav, estimated), an element for each two items that
    follow one another, null where no way is stored and an end has no coordinates. warnings counts places that aren't known.
    """
    known = poi.select("poi_id", F.col("name").alias("p_name"), F.col("address").alias("p_address"), F.col("lat").alias("p_lat"), F.col("lng").alias("p_lng"), F.lit(True).alias("known"))
    said = claims.groupBy("poi_id").agg(*[F.count_if(F.col("polarity") == x).alias(f"{x}s") for x in ("highlight", "avoid")])
    booked = rules.where("status = 'reviewed'").select("poi_id", booking_text(F.col("required"), F.col("advance_days"), F.col("release_time")).alias("booking"))
    rows = items.join(known, "poi_id", "left").join(said, "poi_id", "left").join(booked, "poi_id", "left")
    rows = rows.withColumns({"title": F.coalesce("title", "p_name", F.lit(UNTITLED)), "lat": F.coalesce("p_lat", "lat"), "lng": F.coalesce("p_lng", "lng"), "address": F.coalesce("p_address", "address")})
    order = Window.partitionBy("trip", "day").orderBy(*item_order())
    ahead = {f"to_{c}": F.lead(c).over(order) for c in ("item_id", "title", "lat", "lng")}
    rows = rows.withColumns({**ahead, "turn": F.row_number().over(order)})
    far = G.metres(F.col("lat"), F.col("lng"), F.col("to_lat"), F.col("to_lng"))
    nav = lambda mode: navigation_url(F.col("lat"), F.col("lng"), F.col("title"), F.col("to_lat"), F.col("to_lng"), F.col("to_title"), mode)
    leg = lambda mode, metres, minutes, estimated: F.struct(mode.alias("mode"), metres.cast("long").alias("distance_m"), minutes.cast("int").alias("minutes"), nav(mode).alias("nav"), F.lit(estimated).alias("estimated"))
    guessed = leg(G.leg_mode(far), F.bround(far), G.leg_minutes(far), True)
    stored = leg(F.col("leg_mode"), F.col("leg_distance_m"), F.col("leg_minutes"), False)
    ends = F.col("lat").isNotNull() & F.col("lng").isNotNull() & F.col("to_lat").isNotNull() & F.col("to_lng").isNotNull()
    has_stored = (F.coalesce("leg_mode", F.lit("")) != "") & (F.col("leg_distance_m").isNotNull() | F.col("leg_minutes").isNotNull()) & ends
    rows = rows.withColumn("leg", F.when(F.col("to_item_id").isNotNull(), F.struct(F.when(has_stored, stored).when(ends, guessed).alias("leg"))))
    counts = [F.coalesce(f"{x}s", F.lit(0)).alias(f"{x}s") for x in ("highlight", "avoid")]
    item = F.struct("turn", "title", "kind", "start_time", "address", *counts, "booking")
    listed = F.transform(F.array_sort(F.collect_list(item)), lambda x: x.dropFields("turn"))
    ways = F.transform(F.array_sort(F.collect_list(F.when(F.col("leg").isNotNull(), F.struct("turn", "leg.leg")))), lambda x: x["leg"])
    unknown = F.count_if((F.col("kind") == "poi") & F.col("known").isNull())
    days = rows.groupBy("trip", "day").agg(listed.alias("items"), ways.alias("legs"), unknown.alias("warnings"))
    return days.join(weather.groupBy("trip", "day").agg(F.min("text").alias("weather")), ["trip", "day"], "left").select("trip", "day", "items", "legs", "weather", "warnings")
