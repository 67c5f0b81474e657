"""The nearest places on the globe, and all within a distance, by cells.

The globe is cut into rings of latitude of one height, and each ring into cells about as wide as high, so
that a circle reaches no further than a known number of rings, and in each of them a known range of cells,
around the poles and across the 180th meridian, too. The nearest places are sought in circles that grow until
as many are found inside as are asked for; whoever has enough leaves the search, so it ends after as many rounds as the
farthest answer needs. Points that coincide are searched for, and measured, once for all of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo as G
from ..storage import saved

#: Metres of a circle of the globe, and of the smallest circle that is searched; and how much circles grow.
AROUND = 2 * math.pi * G.EARTH_METRES
LEAST_METRES, GROWTH = 1.0, 4.0


def _rings(size: float) -> int:
    """Rings of which none is lower than so many metres."""
    return max(1, int(AROUND / 2 / size))


def _ring(lat: Column, rings: int) -> Column:
    return F.least(F.floor((lat + 90) / 180 * rings), F.lit(rings - 1)).cast("long")


def _widest(ring: Column, rings: int) -> Column:
    """Cosine of the latitude nearest to the equator in a ring."""
    low, high = ring * 180 / rings - 90, (ring + 1) * 180 / rings - 90
    near = F.when((low <= 0) & (high >= 0), 0.0).otherwise(F.least(F.abs(low), F.abs(high)))
    return F.cos(F.radians(near))


def _cells(ring: Column, rings: int) -> Column:
    """Cells of a ring; at its widest none is narrower than high."""
    return F.greatest(F.lit(1), F.floor(_widest(ring, rings) * 2 * rings)).cast("long")


def _cell(lng: Column, cells: Column) -> Column:
    return F.pmod(F.floor(F.pmod(lng + 180, F.lit(360.0)) / 360 * cells).cast("long"), cells)


def _met(asked: DataFrame, places: DataFrame, metres: float, on: list[str]) -> DataFrame:
    """asked_id, place_id, metres of all within a distance; both have lat, lng and the columns in `on`."""
    rings = _rings(metres)
    put = places.withColumn("ring", _ring(F.col("lat"), rings))
    put = put.withColumn("cell", _cell(F.col("lng"), _cells(F.col("ring"), rings))).select("place_id", "ring", "cell", *on, F.col("lat").alias("p_lat"), F.col("lng").alias("p_lng"))
    own = asked.withColumn("own_ring", _ring(F.col("lat"), rings))
    own = own.withColumn("ring", F.explode(F.sequence(F.greatest(F.col("own_ring") - 1, F.lit(0)), F.least(F.col("own_ring") + 1, F.lit(rings - 1)))))
    # how far the circle reaches in longitude: all around where it holds a pole
    reach, top = F.lit(metres / G.EARTH_METRES), F.radians(F.abs("lat"))
    bend = F.sin(reach) / F.cos(top)
    degrees = F.when(top + reach >= math.pi / 2, 180.0).otherwise(F.degrees(F.asin(F.least(bend, F.lit(1.0))))) + 1e-9
    own = own.withColumns({"cells": _cells(F.col("ring"), rings), "degrees": degrees})
    wide = F.ceil(F.col("degrees") / 360 * F.col("cells")).cast("long")
    middle = _cell(F.col("lng"), F.col("cells"))
    every = F.when(2 * wide + 1 >= F.col("cells"), F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)).otherwise(F.transform(F.sequence(middle - wide, middle + wide), lambda c: F.pmod(c, F.col("cells"))))
    own = own.withColumn("cell", F.explode(F.array_distinct(every)))
    pairs = own.join(put, ["ring", "cell", *on]).withColumn("metres", G.metres(F.col("lat"), F.col("lng"), F.col("p_lat"), F.col("p_lng")))
    return pairs.where(F.col("metres") <= metres).select("asked_id", "place_id", "metres")


def _known(rows: DataFrame) -> DataFrame:
    return rows.where("lat IS NOT NULL AND lng IS NOT NULL AND abs(lat) <= 90")


def _spots(rows: DataFrame, name: str, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """The different points of rows with a number as their `name`, and the rows' own ids with the number of their spot."""
    spots = saved(rows.select("lat", "lng", *on).distinct().withColumn(name, F.monotonically_increasing_id()))
    return spots, rows.join(spots.withColumnRenamed(name, "spot"), ["lat", "lng", *on]).select(name, "spot")


def within(asked: DataFrame, places: DataFrame, metres: float, on: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """asked_id, place_id, metres: all places within a distance of each point asked for, of those that agree in the columns of `on`. metres are rounded to so many digits, if any.

    asked has asked_id, lat, lng, places place_id, lat, lng. Points without coordinates, or beyond a pole, are nowhere; longitudes go around.
    """
    (points, askers), (spots, there) = _spots(_known(asked), "asked_id", on or []), _spots(_known(places), "place_id", on or [])
    shown = F.col("metres") if digits is None else F.round("metres", digits).alias("metres")
    met = saved(_met(points, spots, metres, on or []).select(F.col("asked_id").alias("at"), F.col("place_id").alias("spot"), shown))
    near = met.join(there, "spot").select("at", "place_id", "metres")
    return askers.withColumnRenamed("spot", "at").join(near, "at").select("asked_id", "place_id", "metres")


def _first_metres(places: DataFrame, k: int, on: list[str]) -> float:
    """Radius of a circle that would hold k places, if they lay evenly between their outermost ones."""
    row = places.agg(F.count(F.lit(1)).alias("n"), F.min("lat"), F.max("lat"), F.min("lng"), F.max("lng"), *([F.approx_count_distinct(F.struct(*on)).alias("groups")] if on else [])).first()
    if not row["n"]:
        return LEAST_METRES
    degree = AROUND / 360
    area = max(degree, (row[2] - row[1]) * degree) * max(degree, (row[4] - row[3]) * degree)
    return min(AROUND / 2, max(LEAST_METRES, math.sqrt(2 * k * area * (row["groups"] if on else 1) / (math.pi * row["n"]))))


def nearest(asked: DataFrame, places: DataFrame, k: int = 1, on: list[str] | None = None) -> DataFrame:
    """asked_id, rank, place_id, metres: the k nearest places of each point, equally near ones by place_id; of those that agree in the columns of `on`. Fewer if there aren't as many.

    asked has each asked_id once. A point that has no place to agree with has no rows.
    """
    on = on or []
    kind = asked.schema["asked_id"].dataType.simpleString()
    asked, askers = _spots(_known(asked), "asked_id", on)
    # of places that coincide, only the first k can be among the nearest
    first = Window.partitionBy("lat", "lng", *on).orderBy("place_id")
    places = saved(_known(places).withColumn("same", F.row_number().over(first)).where(F.col("same") <= k).select("place_id", "lat", "lng", *on))
    there = places.select(*on).groupBy(*on).agg(F.count(F.lit(1)).alias("there")) if on else places.agg(F.count(F.lit(1)).alias("there"))
    left = asked.join(there, on) if on else asked.crossJoin(F.broadcast(there))  # a table of one row
    left = saved(left.where("there > 0").withColumn("want", F.least(F.lit(k), F.col("there"))))
    done, metres = None, _first_metres(places, k, on)
    order = Window.partitionBy("asked_id").orderBy("metres", "place_id")
    while not left.isEmpty():
        last = metres >= AROUND / 2
        found = _met(left, places, metres, on).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        enough = found.groupBy("asked_id").agg(F.count(F.lit(1)).alias("found"))
        whole = left.join(enough, "asked_id").where(F.lit(last) | (F.col("found") >= F.col("want"))).select("asked_id")
        part = saved(found.join(whole, "asked_id", "left_semi").select("asked_id", "rank", "place_id", "metres"))
        done = part if done is None else done.unionByName(part)
        left = saved(left.join(part.select("asked_id").distinct(), "asked_id", "left_anti"))
        metres *= GROWTH
        if last:
            break
    if done is None:
        return asked.sparkSession.createDataFrame([], f"asked_id {kind}, rank int, place_id {places.schema['place_id'].dataType.simpleString()}, metres double")
    return askers.join(done.withColumnRenamed("asked_id", "spot"), "spot").select("asked_id", "rank", "place_id", "metres")
