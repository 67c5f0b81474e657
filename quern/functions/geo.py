"""Distances, legs and fares as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_METRES = 6_371_000.0
#: Distances in metres up to which one walks or takes the metro, and speeds in km/h.
WALK_METRES, METRO_METRES = 1500, 6000
SPEED = {"walk": 4.5, "metro": 25.0, "taxi": 22.0}
#: Yuan per km by class of train, least fare.
RATES = {"high_speed": 0.45, "bullet": 0.31, "conventional": 0.16}
LEAST_FARE = 15.0


def metres(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance."""
    a, b = F.radians(lat1), F.radians(lat2)
    half = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * EARTH_METRES * F.asin(F.sqrt(half))


def metres_between(lat1: float, lng1: float, lat2: float, lng2: float) -> float:
    """The same for two points in Python."""
    a, b = math.radians(lat1), math.radians(lat2)
    half = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(lng2 - lng1) / 2) ** 2
    return 2 * EARTH_METRES * math.asin(math.sqrt(half))


def leg_mode(distance: Column) -> Column:
    return F.when(distance <= WALK_METRES, "walk").when(distance <= METRO_METRES, "metro").otherwise("taxi")


def leg_minutes(distance: Column) -> Column:
    mode = leg_mode(distance)
    speed = F.when(mode == "walk", SPEED["walk"]).when(mode == "metro", SPEED["metro"]).otherwise(SPEED["taxi"])
    return F.greatest(F.lit(1), F.bround(distance / 1000 / speed * 60).cast("int"))


def train_class(number: Column) -> Column:
    first = F.upper(F.left(number, F.lit(1)))
    return F.when(first.isin("G", "C"), "high_speed").when(first == "D", "bullet").otherwise("conventional")


def rail_fare(km: Column, kind: Column) -> Column:
    """Estimated fare, to half a yuan."""
    rate = F.when(kind == "high_speed", RATES["high_speed"]).when(kind == "bullet", RATES["bullet"]).otherwise(RATES["conventional"])
    return F.when(km <= 0, LEAST_FARE).otherwise(F.bround(F.greatest(km * rate, F.lit(LEAST_FARE)) * 2) / 2)
