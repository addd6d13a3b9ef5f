"""Route payloads as JSON: reading with typed errors, merging, and the check of candidate envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.cluster import spread
from ridgeline.functions.geo import valid_point

# What a reader says about a payload that it can't take.
NO_JSON = "Could not parse stored JSON payload."
NO_OBJECT = "Route payload must be a JSON object."
NO_TIME = "savedAt must be an ISO timestamp."
NO_STRING, NO_VALUE, NO_NUMBER = " must be a string.", " is required.", " must be a number."
FEW_POINTS, NO_POINT = "Route geometry must contain at least two points.", "Route geometry points must be objects."
NO_COORDINATE, BAD_COORDINATE = "Route geometry point {} must be a number.", "Route geometry point {} is out of range."
RANGES = {"lng": 180.0, "lat": 90.0}
INSTANT = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?Z$"
MOST_CANDIDATES = 3


def _kind(v: Column, path: str) -> Column:
    """Type name of a member; null if it is missing, VOID if it is null."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _number(kind: Column) -> Column:
    return F.coalesce(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)"), F.lit(False))


def _fail(test: Column, message: str) -> Column:
    return F.when(test, F.lit(message))


def _text(v: Column, field: str, required: bool = True) -> tuple[Column, Column]:
    """(value, error) of a text member."""
    kind = _kind(v, f"$.{field}")
    value = F.when(kind == "STRING", F.try_variant_get(v, f"$.{field}", "string"))
    error = _fail(kind.isNotNull() & ~kind.isin("VOID", "STRING"), field + NO_STRING)
    return value, F.coalesce(error, _fail(value.isNull() | value.rlike(r"^\s*$"), field + NO_VALUE)) if required else error


def _decimal(v: Column, field: str) -> tuple[Column, Column]:
    good = _number(_kind(v, f"$.{field}"))
    return F.when(good, F.try_variant_get(v, f"$.{field}", "double")), _fail(~good, field + NO_NUMBER)


def _point_error(p: Column) -> Column:
    errors = [_fail(~F.coalesce(F.schema_of_variant(p).startswith("OBJECT"), F.lit(False)), NO_POINT)]
    for field, most in RANGES.items():
        good, value = _number(_kind(p, f"$.{field}")), F.try_variant_get(p, f"$.{field}", "double")
        errors += [_fail(~good, NO_COORDINATE.format(field)), _fail(~F.coalesce(value.between(-most, most), F.lit(False)), BAD_COORDINATE.format(field))]
    return F.coalesce(*errors)


def read_routes(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Adds a payload's fields and ``error``, the first rule that it breaks (then all fields are null).

    Fields: id, source, name, activity, route_type (may be missing), distance_km, minutes, gain_m,
    geometry array<struct<lat, lng>>, saved_at (may be missing). Rows are dealt over the cluster first.
    """
    # parsed text and points are columns of their own, so each row is parsed once
    parsed = spread(payloads).withColumn("_v", F.try_parse_json(F.col(column)))
    is_list = F.coalesce(_kind(F.col("_v"), "$.geometry").startswith("ARRAY"), F.lit(False))
    parsed = parsed.withColumn("_points", F.when(is_list, F.try_variant_get(F.col("_v"), "$.geometry", "array<variant>")))
    v, points = F.col("_v"), F.col("_points")
    texts = {c: _text(v, f, c != "route_type") for c, f in (("id", "id"), ("source", "source"), ("name", "name"), ("activity", "activity"), ("route_type", "routeType"))}
    numbers = {c: _decimal(v, f) for c, f in (("distance_km", "distanceKm"), ("minutes", "estimatedDurationMin"), ("gain_m", "elevationGainM"))}
    saved, said = _kind(v, "$.savedAt"), F.try_variant_get(v, "$.savedAt", "string")
    time = F.try_to_timestamp(F.when((saved == "STRING") & said.rlike(INSTANT), said))
    errors = [
        _fail(v.isNull(), NO_JSON),
        _fail(~F.schema_of_variant(v).startswith("OBJECT"), NO_OBJECT),
        _fail(saved.isNotNull() & (saved != "VOID") & time.isNull(), NO_TIME),
        *[e for _, e in texts.values()],
        *[e for _, e in numbers.values()],
        _fail(points.isNull() | (F.size(points) < 2), FEW_POINTS),
        F.get(F.filter(F.transform(points, _point_error), lambda e: e.isNotNull()), F.lit(0)),
    ]
    place = lambda p: F.struct(F.try_variant_get(p, "$.lat", "double").alias("lat"), F.try_variant_get(p, "$.lng", "double").alias("lng"))
    fields = {c: x for c, (x, _) in texts.items()} | {c: x for c, (x, _) in numbers.items()} | {"geometry": F.transform(points, place), "saved_at": time}
    fields["minutes"] = fields["minutes"].cast("int")
    found = parsed.withColumn("error", F.coalesce(*errors))
    return found.withColumns({c: F.when(F.col("error").isNull(), x) for c, x in fields.items()}).drop("_v", "_points")


def renamed(payload: Column, name: Column, notes: Column) -> Column:
    """The payload's JSON text with another name, trimmed, and notes (null for none); null without a name."""
    members = F.map_filter(F.variant_get(F.parse_json(payload), "$", "map<string,variant>"), lambda k, _: ~k.isin("name", "notes"))
    said = F.coalesce(notes.cast("variant"), F.parse_json(F.lit("null")))
    return F.when(F.trim(name) != "", F.to_json(F.map_concat(members, F.create_map(F.lit("name"), F.trim(name).cast("variant"), F.lit("notes"), said))))


def valid_envelopes(candidates: DataFrame, requests: DataFrame, key: str = "request_id") -> DataFrame:
    """(key, ok): whether a request's answer holds one to three sound candidates of different ids, of the kind asked for."""
    asked = requests.select(key, F.col("activity").alias("_activity"), F.col("route_type").alias("_type"))
    points = (F.size("geometry") >= 2) & F.forall("geometry", lambda p: p.isNotNull() & valid_point(p["lat"], p["lng"]))
    finite = F.col("km").isNotNull() & ~F.isnan("km") & (F.col("km") >= 0) & (F.col("km") < float("inf"))
    sound = F.col("id").isNotNull() & F.col("name").isNotNull() & (F.col("source") == "generated") & (F.col("activity") == F.col("_activity")) & (F.col("route_type") == F.col("_type")) & points & finite
    checked = candidates.join(asked, key).groupBy(key).agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.min(F.coalesce(sound, F.lit(False))).alias("sound"))
    found = checked.select(key, ((F.col("n") <= MOST_CANDIDATES) & (F.col("ids") == F.col("n")) & F.col("sound")).alias("ok"))
    return requests.select(key).join(found, key, "left").select(key, F.coalesce("ok", F.lit(False)).alias("ok"))
