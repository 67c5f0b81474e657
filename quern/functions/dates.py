"""Due dates, release dates and urgency as column expressions. Today is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days after which a claim of a facet is checked again, none for a photo, and days that count as soon.
REFRESH_DAYS = {"price_diff": 90, "closure": 90, "hours": 90, "queue": 180, "crowd": 180, "transit": 180, "entrance": 180, "other": 180}
SOON_DAYS, URGENT_DAYS = 14, 3


def refresh_days(facet: Column) -> Column:
    out = F.when(facet == "photo", F.lit(None).cast("int"))
    for name, days in REFRESH_DAYS.items():
        out = out.when(facet == name, days)
    return out.otherwise(180)


def verify_due(first_seen: Column, last_verified: Column, facet: Column) -> Column:
    return F.date_add(F.coalesce(last_verified, first_seen), refresh_days(facet))


def urgency(days: Column) -> Column:
    return F.when(days.isNull(), "later").when(days < 0, "overdue").when(days == 0, "today").when(days <= URGENT_DAYS, "soon").otherwise("later")


def minutes_of_day(time: Column) -> Column:
    """Minutes since midnight of HH:MM, null for anything else."""
    return F.when(time.rlike(r"^([01]\d|2[0-3]):[0-5]\d$"), F.left(time, F.lit(2)).cast("int") * 60 + F.right(time, F.lit(2)).cast("int"))
