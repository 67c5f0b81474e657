"""Trips: laying days out anew, plans of an engine, transfers and budgets, gaps in candidates, and the offline roadbook."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dates as D
from ..functions import text as T

#: Metres from which a leg on foot is a surprise, and lookups that filling gaps may take.
FAR_ON_FOOT, LOOKUPS = 1500, 20
#: What an engine calls the items of a day.
ATTRACTION, MEALS = "attraction", ("lunch", "dinner")


def relaid(days: DataFrame, layout: DataFrame) -> DataFrame:
    """The days of a new layout (trip, date, city) with theme and items of an old day of the same trip, date and city, if it had either."""
    old = days.where("theme IS NOT NULL OR size(items) > 0").select("trip", "date", "city", "theme", "items")
    return layout.join(old, ["trip", "date", "city"], "left").withColumn("items", F.coalesce("items", F.array().cast(days.schema["items"].dataType)))


def planned_items(plans: DataFrame) -> DataFrame:
    """trip, offset, date, theme, kind, title, poi_id, unresolved of each item of engine plans (trip, start_date, plan as JSON).

    Days go by their number and follow one another from start_date, or the plan's own if that is null. An attraction
    is aligned only with both an id and coordinates; items of unknown type are left out. A plan without days,
    start or destination gives no rows.
    """
    kind = "destination string, start_date string, days array<struct<day:int,theme:string,timeline:array<struct<type:string,name:string,amap_poi_id:string,location:struct<lat:double,lng:double>>>>>"
    p = plans.select("trip", "start_date", F.from_json("plan", kind).alias("p")).withColumn("start", F.coalesce(F.col("start_date"), F.col("p.start_date").try_cast("date")))
    p = p.where(F.col("start").isNotNull() & (F.trim(F.coalesce("p.destination", F.lit(""))) != ""))
    ordered = F.array_sort("p.days", lambda a, b: F.coalesce(a["day"], F.lit(0)) - F.coalesce(b["day"], F.lit(0)))
    days = p.select("trip", "start", F.posexplode(ordered).alias("offset", "d"))
    items = days.select("trip", "offset", F.date_add("start", F.col("offset")).alias("date"), F.nullif(F.trim("d.theme"), F.lit("")).alias("theme"), F.posexplode_outer("d.timeline").alias("pos", "x"))
    poi = F.col("x.type") == ATTRACTION
    id_ = F.nullif(F.trim("x.amap_poi_id"), F.lit(""))
    aligned = poi & id_.isNotNull() & F.col("x.location.lat").isNotNull() & F.col("x.location.lng").isNotNull()
    rows = items.where(poi | F.col("x.type").isin(*MEALS))
    return rows.select("trip", "offset", "date", "theme", "pos", F.when(poi, "poi").otherwise("meal").alias("kind"), F.trim("x.name").alias("title"), F.when(aligned, id_).alias("poi_id"), F.when(poi & ~aligned, F.trim("x.name")).alias("unresolved"))


def budget(transfers: DataFrame, others: DataFrame, people: int = 1) -> DataFrame:
    """trip, intercity, other, total, reference: transfers (trip, price, is_reference) and other rows (trip, amount), to two places; reference tells whether any price is one."""
    rows = transfers.where("price IS NOT NULL").select("trip", F.lit("intercity").alias("category"), (F.col("price") * people).alias("amount"), F.col("is_reference").alias("reference"))
    rows = rows.unionByName(others.select("trip", F.lit("other").alias("category"), "amount", F.lit(False).alias("reference")))
    part = lambda c: F.bround(F.coalesce(F.sum(F.when(F.col("category") == c, F.col("amount"))), F.lit(0.0)), 2)
    return rows.groupBy("trip").agg(part("intercity").alias("intercity"), part("other").alias("other"), F.bround(F.sum("amount"), 2).alias("total"), F.max("reference").alias("reference"))


def filled(candidates: DataFrame, known: DataFrame, limit: int = LOOKUPS) -> DataFrame:
    """Candidates (city, place, poi_id, address, lat, lng, open_time) of each city with what a lookup adds where something is null, and asked; the first `limit` that lack coordinates or hours are looked up."""
    needs = F.col("lat").isNull() | F.col("open_time").isNull()
    turn = F.sum(needs.cast("int")).over(Window.partitionBy("city").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    rows = candidates.withColumn("asked", needs & (turn <= limit))
    columns = ("address", "lat", "lng", "open_time")
    new = known.select("poi_id", *[F.col(c).alias(f"n_{c}") for c in columns])
    joined = rows.join(new, "poi_id", "left")
    return joined.withColumns({c: F.when(F.col("asked"), F.coalesce(c, f"n_{c}")).otherwise(F.col(c)) for c in columns}).drop(*[f"n_{c}" for c in columns])


def pools(own: DataFrame, searched: DataFrame, limit: int = 60) -> DataFrame:
    """city, poi_id, source, place: a city's own candidates by claims, certain claims and name; the searched ones only where it has none at all."""
    cities = own.select("city").distinct()
    rows = own.select("city", "poi_id", F.lit("own").alias("source"), "claims", "sure", "name").unionByName(
        searched.join(cities, "city", "left_anti").select("city", "poi_id", F.lit("search").alias("source"), F.lit(0).cast("long").alias("claims"), F.lit(0).cast("long").alias("sure"), "name")
    )
    w = Window.partitionBy("city").orderBy(F.desc("claims"), F.desc("sure"), "name", "poi_id")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).select("city", "poi_id", "source", "place")


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def roadbooks(trips: DataFrame, items: DataFrame) -> DataFrame:
    """trip, days, items, html, external: each trip's items (trip, date, seq, start_time, title, note) under their days, as one page that loads nothing from elsewhere."""
    line = F.concat(F.lit("<li>"), F.when(F.col("start_time").isNotNull(), F.concat("start_time", F.lit(" "))).otherwise(""), _escaped(F.col("title")), F.when(F.col("note").isNotNull(), F.concat(F.lit(" <small>"), _escaped(F.col("note")), F.lit("</small>"))).otherwise(""), F.lit("</li>"))
    day = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))), lambda x: x["line"]), "")
    days = items.groupBy("trip", "date").agg(day.alias("lines"), F.count(F.lit(1)).alias("n"))
    html = F.concat(F.lit("<section><h2>"), F.col("date").cast("string"), F.lit("</h2><ol>"), F.col("lines"), F.lit("</ol></section>"))
    pages = days.groupBy("trip").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("date", html.alias("html")))), lambda x: x["html"]), "").alias("body"), F.count(F.lit(1)).alias("days"), F.sum("n").alias("items"))
    rows = trips.join(pages, "trip", "left")
    page = F.concat(F.lit("<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>"), _escaped(F.col("name")), F.lit("</title><style>body{font-family:sans-serif}</style></head><body><h1>"), _escaped(F.col("name")), F.lit("</h1>"), F.coalesce("body", F.lit("")), F.lit("</body></html>"))
    rows = rows.withColumn("html", page)
    return rows.select("trip", F.coalesce("days", F.lit(0)).alias("days"), F.coalesce("items", F.lit(0)).alias("items"), "html", F.size(T.external_resources(F.col("html"))).alias("external"))


def _codes(rows: DataFrame, keys: list[str], checks: dict[tuple[str, str], Column]) -> DataFrame:
    found = F.array_compact(F.array(*[F.when(when, F.struct(F.lit(code).alias("code"), F.lit(level).alias("severity"))) for (code, level), when in checks.items()]))
    return rows.select(*keys, F.explode(found).alias("f")).select(*keys, "f.code", "f.severity")


def trip_problems(trips: DataFrame, days: DataFrame, items: DataFrame, bookings: DataFrame) -> DataFrame:
    """trip, place, code, severity of everything that makes roadbooks useless or worse, but for odd coordinates.

    trips has trip, start, end and external (resources elsewhere); days trip, date, legs (their number); items trip,
    date, seq, kind, address, booking, start_time and leg, a struct of mode, distance_m, minutes and nav, null
    where there is none; bookings trip, name, channels and visit_date.
    """
    c = F.col
    spans = days.groupBy("trip").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    whole = trips.join(spans, "trip", "left")
    found = _codes(whole, ["trip"], {
        ("no_days", "error"): c("first").isNull(), ("external_refs", "error"): c("first").isNotNull() & (c("external") > 0),
        ("start_mismatch", "error"): c("first") != c("start"), ("end_mismatch", "error"): c("last") != c("end"),
    }).select("trip", F.lit("").alias("place"), "code", "severity")
    gap = F.datediff("date", F.lag("date").over(Window.partitionBy("trip").orderBy("date"))) != 1
    sizes = items.groupBy("trip", "date").agg(F.count(F.lit(1)).alias("n"))
    dated = days.join(sizes, ["trip", "date"], "left").withColumns({"gap": gap, "expected": F.greatest(F.coalesce("n", F.lit(0)) - 1, F.lit(0))})
    place = F.concat_ws(" ", c("date").cast("string"), c("seq").cast("string"))
    found = found.unionByName(_codes(dated, ["trip", "date"], {("date_gap", "error"): c("gap"), ("leg_count", "error"): c("legs") != c("expected")}).select("trip", c("date").cast("string").alias("place"), "code", "severity"))
    in_day = Window.partitionBy("trip", "date").orderBy("seq")
    minute = D.minutes_of_day(c("start_time"))
    rows = items.join(dated.where("legs = expected").select("trip", "date", F.lit(True).alias("whole")), ["trip", "date"], "left")
    rows = rows.withColumns({"before": F.last(minute, True).over(in_day.rowsBetween(Window.unboundedPreceding, -1)), "more": F.lead("seq").over(in_day).isNotNull(), "minute": minute})
    leg = F.coalesce(c("whole"), F.lit(False)) & c("more")
    there = leg & c("leg").isNotNull()
    checks = {
        ("poi_without_address", "warn"): (c("kind") == "poi") & (F.coalesce("address", F.lit("")) == ""), ("empty_booking", "error"): (c("booking") != "") & (F.trim("booking") == ""),
        ("time_out_of_order", "error"): c("minute") < c("before"), ("leg_missing", "warn"): leg & c("leg").isNull(), ("leg_undescribed", "warn"): there & ((F.coalesce("leg.mode", F.lit("")) == "") | (c("leg.distance_m").isNull() & c("leg.minutes").isNull())),
        ("leg_without_nav", "warn"): there & c("leg.nav").isNull(), ("walk_too_far", "warn"): there & (c("leg.mode") == "walk") & (c("leg.distance_m") >= FAR_ON_FOOT),
    }
    found = found.unionByName(_codes(rows.withColumn("place", place), ["trip", "place"], checks))
    booked = {("booking_without_channel", "error"): F.coalesce(F.size("channels"), F.lit(0)) <= 0, ("booking_without_date", "error"): c("visit_date").isNull()}
    dated_trips = spans.where(c("first").isNotNull()).select("trip")  # of a trip without days nothing else is said
    return found.unionByName(_codes(bookings.join(dated_trips, "trip", "left_semi").withColumn("place", c("name")), ["trip", "place"], booked))
