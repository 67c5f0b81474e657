"""Answers of map, rail and weather services, as JSON or text in a column, made into rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo as G
from ..functions import text as T

#: What a weather code means, and marks of weather that is bad outdoors.
WEATHER = {
    0: "晴", 1: "少云", 2: "多云", 3: "阴", 45: "雾", 48: "冻雾", 51: "小毛毛雨", 53: "毛毛雨", 55: "大毛毛雨", 56: "冻毛毛雨", 57: "强冻毛毛雨", 61: "小雨", 63: "中雨", 65: "大雨",
    66: "冻雨", 67: "强冻雨", 71: "小雪", 73: "中雪", 75: "大雪", 77: "米雪", 80: "小阵雨", 81: "阵雨", 82: "强阵雨", 85: "小阵雪", 86: "强阵雪", 95: "雷阵雨", 96: "雷阵雨伴小冰雹", 99: "雷阵雨伴冰雹",
}
BAD_WEATHER = ("雨", "雪", "冰雹", "雾", "沙尘", "霾", "雷")
#: Days that forecasts and ticket sales reach ahead, and for which a list of stations is fresh.
FORECAST_DAYS, SALE_DAYS, STATION_DAYS = 16, 14, 30
#: Places in a ticket row, of seats by name, and of all that tell whether there is any ticket.
SEATS = {26: "无座", 30: "二等座", 31: "一等座", 32: "商务座"}
ANY_TICKET = (23, 26, 28, 29, 30, 31, 32)
NO_TICKET = "无"


def weather_text(code: Column) -> Column:
    out = F.when(code.isNull(), "天气未知")
    for value, text in WEATHER.items():
        out = out.when(code == value, text)
    return out.otherwise(F.concat(F.lit("未知天气（编码 "), code.cast("int").cast("string"), F.lit("）")))


def is_bad_outdoors(day: Column, night: Column) -> Column:
    marks = "|".join(BAD_WEATHER)
    return F.coalesce(day.rlike(marks), F.lit(False)) | F.coalesce(night.rlike(marks), F.lit(False))


def _text(parsed: Column, path: str) -> Column:
    """A value as text: a list's texts are joined, other values are as they stand, and what is empty is null. The value's own type decides, not how its text begins."""
    value = F.try_variant_get(parsed, path, "variant")
    listed = F.array_join(F.try_variant_get(parsed, path, "array<string>"), "")
    plain = F.try_variant_get(parsed, path, "string")
    return F.nullif(F.trim(F.when(F.schema_of_variant(value).startswith("ARRAY"), listed).otherwise(plain)), F.lit(""))


def _once(rows: DataFrame, *columns: Column) -> DataFrame:
    """The columns of each row, worked out once, whatever is asked of them later: neither another select nor a condition is merged with a generator."""
    return rows.select(F.inline(F.array(F.struct(*columns))))


def places(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """The places in a map service's answers, one a row; those without id or coordinates are left out."""
    x = F.col("parsed")
    texts = {
        "poi_id": "$.id", "named": "$.name", "typecode": "$.typecode", "type_name": "$.type", "adcode": "$.adcode", "address": "$.address", "parent_id": "$.parent", "location": "$.location",
        "rated": "$.biz_ext.rating", "later": "$.biz_ext.opentime2", "open": "$.biz_ext.opentime", "photo_url": "$.photos[0].url",
    }
    read = _once(_once(rows, F.try_parse_json(F.col(raw)).alias("parsed")), *[_text(x, path).alias(name) for name, path in texts.items()])
    at = F.split("location", ",", 2)
    number = lambda c: c.try_cast("double")
    found = read.select(
        "poi_id", F.coalesce("named", "poi_id").alias("name"), "typecode", "type_name", "adcode", "address", "parent_id", number(F.get(at, F.lit(1))).alias("lat"), number(F.get(at, F.lit(0))).alias("lng"),
        number(F.col("rated")).alias("rating"), F.coalesce("later", "open").alias("open_time"), "photo_url",
    )
    return found.where("poi_id IS NOT NULL AND lat IS NOT NULL AND lng IS NOT NULL")


def picked_cities(asked: DataFrame, districts: DataFrame) -> DataFrame:
    """asked_id and the adcode of the city that a name means: one of just that name, else the first city in the answer; provinces and districts never.

    asked has asked_id and name, districts asked_id, pos, name, adcode and level.
    """
    rows = asked.select("asked_id", F.trim("name").alias("asked")).join(districts.where("level = 'city' AND trim(adcode) <> ''"), "asked_id")
    best = F.min_by("adcode", F.struct(F.trim("name") != F.col("asked"), "pos")).alias("adcode")
    return asked.select("asked_id").join(rows.groupBy("asked_id").agg(best), "asked_id", "left")


def stations(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """code, name, pinyin of a station file: records after at-signs, fields between bars."""
    records = rows.select(F.explode(F.slice(F.split(raw, "@"), 2, 1 << 30)).alias("r")).select(F.split("r", r"\|").alias("f")).where("size(f) >= 3")
    field = lambda n: F.trim(F.get("f", F.lit(n)))
    return records.select(field(2).alias("code"), field(1).alias("name"), F.coalesce(field(3), F.lit("")).alias("pinyin")).where("name <> '' AND code <> ''")


def is_fresh(fetched: Column, today: Column, days: int = STATION_DAYS) -> Column:
    """Whether something fetched on a day may still be used."""
    return F.coalesce(F.datediff(today, fetched) <= days, F.lit(False))


def on_sale(day: Column, today: Column) -> Column:
    return F.datediff(day, today).between(0, SALE_DAYS)


def tickets(rows: DataFrame, names: DataFrame, raw: str = "raw", km: str = "km") -> DataFrame:
    """The trains in ticket rows with their columns: class, stations by name, minutes, fare by distance, whether any ticket is left, and seats. Rows too short, without number or duration are left out."""
    kept = [c for c in rows.columns if c not in (raw, km)]
    f = rows.select(*kept, km, F.transform(F.split(raw, r"\|"), lambda x: F.trim(x)).alias("f")).where("size(f) >= 33")
    at = lambda n: F.get("f", F.lit(n))
    took = F.regexp_extract_all(at(10), F.lit(r"^(\d{1,3}):(\d{2})$"), F.lit(0))
    minutes = F.when(F.size(took) > 0, F.split(at(10), ":")[0].cast("int") * 60 + F.split(at(10), ":")[1].cast("int"))
    seats = F.map_filter(F.create_map(*[x for n, label in SEATS.items() for x in (F.lit(label), at(n))]), lambda k, v: v != "")
    left = F.exists(F.array(*map(at, ANY_TICKET)), lambda v: (v != "") & (v != NO_TICKET))
    trains = f.select(*kept, at(3).alias("service"), at(6).alias("a"), at(7).alias("b"), at(8).alias("departs"), at(9).alias("arrives"), minutes.alias("minutes"), left.alias("has_tickets"), seats.alias("seats"), km).where("service <> '' AND minutes IS NOT NULL")
    for side in ("a", "b"):
        trains = trains.join(names.select(F.col("code").alias(side), F.col("name").alias(f"{side}_name")), side, "left").withColumn(side, F.coalesce(f"{side}_name", side)).drop(f"{side}_name")
    kind = G.train_class(F.col("service"))
    return trains.withColumns({"class": kind, "price": F.when(F.col(km) > 0, G.rail_fare(F.col(km), kind))}).drop(km)


def daily_weather(rows: DataFrame, today: Column, raw: str = "raw") -> DataFrame:
    """The days of a forecast in parallel lists, of which some may be short, up to its horizon: day, text, low, high, rain."""
    kept = [c for c in rows.columns if c != raw]
    kind = "daily struct<time:array<string>,weather_code:array<double>,temperature_2m_max:array<double>,temperature_2m_min:array<double>,precipitation_probability_max:array<double>>"
    d = rows.select(*kept, F.from_json(raw, kind)["daily"].alias("d"))
    lists = [F.coalesce(F.col(f"d.{x}"), F.array().cast("array<string>" if x == "time" else "array<double>")).alias(x) for x in ("time", "weather_code", "temperature_2m_max", "temperature_2m_min", "precipitation_probability_max")]
    days = d.select(*kept, *lists).select(*kept, F.explode(F.arrays_zip("time", "weather_code", "temperature_2m_max", "temperature_2m_min", "precipitation_probability_max")).alias("z"))
    day = F.col("z.time").try_cast("date")
    out = days.select(*kept, day.alias("day"), weather_text(F.col("z.weather_code")).alias("text"), F.col("z.temperature_2m_min").alias("low"), F.col("z.temperature_2m_max").alias("high"), F.col("z.precipitation_probability_max").alias("rain"))
    return out.where(F.col("day").isNotNull() & (F.col("day") <= F.date_add(today, FORECAST_DAYS - 1)))


def day_and_night_weather(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """The same from a service that tells days and nights apart: day, text, night, low, high."""
    kept = [c for c in rows.columns if c != raw]
    casts = rows.select(*kept, F.explode(F.from_json(raw, "array<struct<date:string,day_weather:string,night_weather:string,day_temp:string,night_temp:string>>")).alias("z"))
    text = F.coalesce(F.nullif(F.col("z.day_weather"), F.lit("")), F.lit("天气未知"))
    out = casts.select(*kept, F.col("z.date").try_cast("date").alias("day"), text.alias("text"), F.nullif(F.col("z.night_weather"), F.lit("")).alias("night"), F.col("z.night_temp").try_cast("double").alias("low"), F.col("z.day_temp").try_cast("double").alias("high"))
    return out.where("day IS NOT NULL")


def first_source(sources: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """Rows of the first source that has any for a key, never mixed with another's, and that source's name. All have the same columns."""
    every = None
    for n, (name, rows) in enumerate(sources):
        some = rows.withColumns({"source": F.lit(name), "rank": F.lit(n)})
        every = some if every is None else every.unionByName(some)
    best = F.min("rank").over(Window.partitionBy(key))
    return every.withColumn("best", best).where("rank = best").drop("rank", "best")


def read_rules(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """Booking rules of a seed, a JSON object a row, with its other columns and `error`: what is wrong with an entry, or null. A seed with any error must not be taken in; see checked_rules()."""
    kept = [c for c in rows.columns if c != raw]
    kind = "poi_id string, booking_required boolean, advance_days int, release_time string, channels array<string>, evidence_url string, bad string"
    seen = rows.withColumn("r", F.from_json(raw, kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"}))
    error = (
        F.when(F.col("r.bad").isNotNull() | F.col("r").isNull(), "malformed").when(F.coalesce("r.poi_id", F.lit("")) == "", "no_poi").when(F.col("r.booking_required").isNull(), "no_required")
        .when(F.col("r.advance_days") < 0, "negative_days")
    )
    return seen.select(*kept, "r.poi_id", "r.booking_required", "r.advance_days", "r.release_time", "r.channels", "r.evidence_url", error.alias("error"))


def checked_rules(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """The rules of a seed without error; any error fails the load."""
    found = read_rules(rows, raw)
    first = found.where("error IS NOT NULL").select("poi_id", "error").head()
    if first is not None:
        raise ValueError(f"seed entry {first['poi_id']}: {first['error']}")
    return found.drop("error")


def rail_answers(asked: DataFrame, known: DataFrame, options: DataFrame, today: Column) -> DataFrame:
    """asked_id, note, a_code, services of rail questions (asked_id, a, b, day).

    known has city, code and place (its rank among the city's stations); options a_code, b_code, day, minutes and
    service. Outside the sale window nothing is looked up. The first station of each city is asked, then the
    second of the first city; the first that has trains answers.
    """
    first = known.where("place = 1")
    rows = asked.join(known.where("place <= 2").select(F.col("city").alias("a"), F.col("code").alias("a_code"), "place"), "a", "left").join(first.select(F.col("city").alias("b"), F.col("code").alias("b_code")), "b", "left")
    trains = options.groupBy("a_code", "b_code", "day").agg(F.transform(F.array_sort(F.collect_list(F.struct("minutes", "service"))), lambda x: x["service"]).alias("services"))
    rows = rows.join(trains, ["a_code", "b_code", "day"], "left").withColumn("hit", F.coalesce(F.size("services"), F.lit(0)) > 0)
    best = F.min_by(F.struct("day", "a_code", "b_code", "services"), F.struct(~F.col("hit"), "place")).alias("x")
    sold = on_sale(F.col("x.day"), today)
    note = F.when(~sold, "not_on_sale").when(F.col("x.a_code").isNull() | F.col("x.b_code").isNull(), "no_station").when(F.coalesce(F.size("x.services"), F.lit(0)) <= 0, "no_train")
    found = rows.groupBy("asked_id").agg(best)
    return found.select("asked_id", note.alias("note"), F.when(note.isNull(), F.col("x.a_code")).alias("a_code"), F.when(note.isNull(), F.col("x.services")).alias("services"))


#: What a claim is of, how it is meant, and what it is about.
SUBJECT_TYPES, POLARITIES = ("poi", "route", "city"), ("avoid", "highlight")
FACETS = ("queue", "entrance", "hours", "crowd", "photo", "transit", "price_diff", "closure", "other")


def whole_json(raw: Column) -> Column:
    """A JSON text as a variant, null if anything is wrong with it. The parser overlooks what follows a value, so the text must also stand in a list and in an object, where it would be in the way."""
    alone = lambda a, b: F.try_parse_json(F.concat(F.lit(a), raw, F.lit(b))).isNotNull()
    return F.when(alone("[", "]") & alone('{"x":', "}"), F.try_parse_json(raw))


def _items(raw: Column, path: str) -> Column:
    """The elements of a list in a JSON text; none if there is no list."""
    return F.coalesce(F.try_variant_get(whole_json(raw), path, "array<variant>"), F.array().cast("array<variant>"))


def is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def json_objects(rows: DataFrame, raw: str, path: str = "$") -> DataFrame:
    """The rows with pos and item, one for each element of the list in their JSON text; texts that are malformed or hold no list there have none."""
    return rows.select(*[c for c in rows.columns if c != raw], F.posexplode(_items(F.col(raw), path)).alias("pos", "item"))


def extracted_claims(answers: DataFrame, raw: str = "raw") -> DataFrame:
    """The claims in a model's answers, one by one, with reason: why a claim is dropped, null for one that counts.

    An element that is no object, or of unknown subject type or polarity, is dropped without the others; an unknown facet
    becomes "other". Names and texts lose the white space around them, quotes keep it.
    """
    rows = json_objects(answers, raw, "$.claims")
    field = lambda name: F.coalesce(F.try_variant_get("item", f"$.{name}", "string"), F.lit(""))
    kept = [c for c in answers.columns if c != raw]
    facet = T.strip(field("facet"))
    named = rows.select(
        *kept, "pos", is_object(F.col("item")).alias("object"), T.strip(field("subject_name")).alias("subject_name"), T.strip(field("subject_type")).alias("subject_type"), T.strip(field("polarity")).alias("polarity"),
        F.when(facet.isin(*FACETS), facet).otherwise("other").alias("facet"), T.strip(field("text")).alias("text"), field("quote").alias("quote"),
    )
    reason = F.when(~F.col("object"), "no_object").when(~F.col("subject_type").isin(*SUBJECT_TYPES), "subject_type").when(~F.col("polarity").isin(*POLARITIES), "polarity")
    return named.withColumn("reason", reason).drop("object")


#: The order of a city's stations by the side in their names, after the one that has just the city's name; others follow.
SIDES = ("南", "东", "北", "西")


def ranked_stations(cities: DataFrame, stations: DataFrame) -> DataFrame:
    """city, place, code and name of the stations of each city (city, name), those whose names begin with its name: shorter ones first, then by side, then by name.

    A name and "市" at its end mean the same city. Blank names have no stations. Stations meet cities by the beginnings of their names.
    """
    known = cities.select("city", F.regexp_replace(T.strip(F.col("name")), "市$", "").alias("begin")).where("begin <> ''")
    begins = stations.select("code", "name", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("name"), F.lit(1))), lambda i: F.left("name", i))).alias("begin"))
    rows = begins.join(known, "begin")
    side = F.substring("name", F.length("begin") + 1, F.length("name"))
    rank = F.lit(len(SIDES) + 5)
    for n, mark in reversed(list(enumerate(SIDES))):
        rank = F.when(side == mark, n).otherwise(rank)
    order = Window.partitionBy("city").orderBy(F.length("name") - F.length("begin"), rank, "name", "code")
    return rows.withColumn("place", F.row_number().over(order)).select("city", "place", "code", "name")
