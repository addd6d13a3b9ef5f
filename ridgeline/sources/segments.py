"""Segments of an activity service: polyline text and normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.geo import clamp, half_up, num


def decode_polyline(text: Column) -> Column:
    """array<struct<lat, lng>> of a polyline text (1e-5 degrees, five bits a character).

    The text is cut after each number's last character; one fold adds up the deltas. No step looks at the whole again.
    """

    def number(chunk: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("value"), F.lit(0).alias("shift"))
        bits = lambda char: (F.ascii(char) - 63).bitwiseAND(31).cast("bigint")
        read = lambda s, char: F.struct((s["value"] + F.call_function("shiftleft", bits(char), s["shift"])).alias("value"), (s["shift"] + 5).alias("shift"))
        whole = lambda v: F.when(v % 2 == 1, -F.shiftright(v, 1) - 1).otherwise(F.shiftright(v, 1))
        return F.aggregate(F.filter(F.split(chunk, ""), lambda c: c != ""), start, read, lambda s: whole(s["value"]))

    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"[^\x00-\x5e]*[\x00-\x5e]"), F.lit(0)), number)
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    start = F.struct(none.alias("up"), zero.alias("lat"), zero.alias("lng"), F.array().cast("array<struct<lat: bigint, lng: bigint>>").alias("path"))

    def add(s: Column, d: Column) -> Column:
        first = s["up"].isNull()  # deltas come in turn: latitude, longitude
        lat, lng = s["lat"] + s["up"], s["lng"] + d
        return F.struct(
            F.when(first, d).alias("up"),
            F.when(first, s["lat"]).otherwise(lat).alias("lat"),
            F.when(first, s["lng"]).otherwise(lng).alias("lng"),
            F.when(first, s["path"]).otherwise(F.array_append(s["path"], F.struct(lat.alias("lat"), lng.alias("lng")))).alias("path"),
        )

    path = F.aggregate(numbers, start, add, lambda s: s["path"])
    return F.transform(path, lambda p: F.struct((p["lat"] / num(1e5)).alias("lat"), (p["lng"] / num(1e5)).alias("lng")))


def encode_polyline(points: Column) -> Column:
    """The inverse of ``decode_polyline``, coordinates rounded to 1e-5 degrees."""
    whole = F.transform(points, lambda p: F.array(half_up(p["lat"] * 100000).cast("bigint"), half_up(p["lng"] * 100000).cast("bigint")))
    zero = F.array(F.lit(0).cast("bigint"), F.lit(0).cast("bigint"))
    before = F.concat(F.array(zero), F.slice(whole, F.lit(1), F.greatest(F.size(whole) - 1, F.lit(0))))
    deltas = F.flatten(F.transform(F.arrays_zip(whole.alias("p"), before.alias("q")), lambda z: F.when(z["p"].isNotNull(), F.zip_with(z["p"], z["q"], lambda a, b: a - b)).otherwise(F.array().cast("array<bigint>"))))

    def chunks(d: Column) -> Column:
        n = F.when(d < 0, -d * 2 - 1).otherwise(d * 2)
        part = lambda k: F.call_function("shiftright", n, k * 5)
        kept = F.filter(F.sequence(F.lit(0), F.lit(6)), lambda k: (k == 0) | (part(k) > 0))
        return F.array_join(F.transform(kept, lambda k: F.char(part(k).bitwiseAND(31) + F.when(part(k + 1) > 0, 32).otherwise(0) + 63)), "")

    return F.array_join(F.transform(deltas, chunks), "")


def normalize_segments(raw: DataFrame, activity: str) -> DataFrame:
    """Segments with rounded distance, gain, duration and signals; those without two points are dropped.

    raw: id, name, points (polyline) or start and end (struct<lat, lng>), distance_m, climb_m, grade, category, starred.
    """
    ends = F.when(F.col("start").isNotNull() & F.col("end").isNotNull(), F.array("start", "end"))
    geometry = F.when(F.coalesce(F.col("points"), F.lit("")) != "", decode_polyline(F.col("points"))).otherwise(ends)
    km = half_up(F.col("distance_m") / 1000, 1)
    grade, category = F.abs(F.coalesce("grade", num(0))), F.coalesce("category", F.lit(0))
    penalty, boost = F.least(num(28), grade * 3 + category * 5), F.least(num(20), category * 4 + grade * num(1.5))
    cycling = activity == "riding"
    cut = lambda x: F.floor(x).cast("double")
    return raw.withColumn("geometry", geometry).where(F.size("geometry") >= 2).select(
        F.concat(F.lit("segment-"), F.col("id").cast("string")).alias("id"),
        "name",
        F.lit("cycling" if cycling else "running").alias("activity"),
        km.alias("km"),
        F.greatest(half_up(F.coalesce("climb_m", num(0))), num(0)).alias("gain_m"),
        F.greatest(half_up(km * num(3.1 if cycling else 5.6)), num(1)).alias("minutes"),
        "geometry",
        F.struct(
            num(54).alias("park"),
            num(44).alias("shade"),
            num(32).alias("road"),
            cut(F.greatest(num(52), num(76) - penalty * num(0.4))).alias("safety"),
            F.when(F.coalesce("starred", F.lit(False)), num(62)).otherwise(num(56)).alias("novelty"),
            cut(clamp(num(58) + boost, 0, 88)).alias("scenery"),
            num(74).alias("surface"),
            num(24).alias("crossings"),
        ).alias("signals"),
    )


#: Activities that a call asks for.
ACTIVITIES = ("running", "riding")


def explore(answers: DataFrame, activity: str) -> DataFrame:
    """Normalised segments of recorded answers (the columns of ``normalize_segments`` and ``activity``); "all" is the union of the calls for each activity."""
    wanted = ACTIVITIES if activity == "all" else (activity,)
    parts = [normalize_segments(answers.where(F.col("activity") == a).drop("activity"), a) for a in wanted]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found
