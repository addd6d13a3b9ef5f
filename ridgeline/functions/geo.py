"""Geographic and preference expressions on columns.

Points are pairs of columns (latitude, longitude) in degrees. All functions are built-in
expressions, so they stay inside whole-stage code generation and can be pushed and folded.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the data model.
EARTH_KM = 6371.0
EARTH_M = 6371000.0
KM_PER_DEGREE = 111.32
BOX_KM_PER_DEGREE = 111.0
DEFAULT_START = (40.0149, -105.2705)
DEFAULT_TARGET_KM = 5.0
PACE_MIN_PER_KM = {"running": 5.6, "hiking": 12.5, "cycling": 3.1}
METRES_PER_DEGREE = math.pi * EARTH_M / 180.0


def num(x: float) -> Column:
    return F.lit(float(x))


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounds halves towards plus infinity: -2.5 to -2."""
    factor = num(10.0**digits)
    return F.floor(x * factor + num(0.5)).cast("double") / factor


def clamp(x: Column, low: float | Column, high: float | Column) -> Column:
    low = low if isinstance(low, Column) else num(low)
    high = high if isinstance(high, Column) else num(high)
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))  # null stays null


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    dlat, dlng = F.radians(lat2 - lat1) / 2, F.radians(lng2 - lng1) / 2
    h = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlng) * F.sin(dlng)
    return num(2 * EARTH_KM * 1000.0) * F.asin(F.sqrt(h))


def bearing(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Initial bearing, 0 to 360."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lng2 - lng1)
    y = F.sin(d) * F.cos(b)
    x = F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)
    return (F.degrees(F.atan2(y, x)) + num(360)) % num(360)


def destination(lat: Column, lng: Column, towards: Column, metres: Column) -> tuple[Column, Column]:
    """The point so many metres away, to six decimals."""
    d, b, p, q = metres / num(EARTH_M), F.radians(towards), F.radians(lat), F.radians(lng)
    to = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(b))
    east = q + F.atan2(F.sin(b) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(to))
    return half_up(F.degrees(to), 6), half_up(F.degrees(east), 6)


def angular_difference(a: Column, b: Column) -> Column:
    d = F.abs(a - b) % num(360)
    return F.least(d, num(360) - d)


def midpoint(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> tuple[Column, Column]:
    return (lat1 + lat2) / 2, (lng1 + lng2) / 2


def offset_m(lat0: Column, lng0: Column, lat: Column, lng: Column) -> tuple[Column, Column]:
    """Metres east and north of an origin, on a local plane."""
    return (lng - lng0) * num(METRES_PER_DEGREE) * F.cos(F.radians(lat0)), (lat - lat0) * num(METRES_PER_DEGREE)


def _along(ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column]:
    """(share of the segment at which it is nearest to the origin, squared length)."""
    sx, sy = bx - ax, by - ay
    squared = sx * sx + sy * sy
    return clamp(-(ax * sx + ay * sy) / F.when(squared != 0, squared), 0, 1), squared


def project_on_segment(lat: Column, lng: Column, lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> tuple[Column, Column, Column]:
    """(latitude, longitude, metres) of a segment's point nearest to (lat, lng)."""
    (ax, ay), (bx, by) = offset_m(lat, lng, lat1, lng1), offset_m(lat, lng, lat2, lng2)
    t, squared = _along(ax, ay, bx, by)
    x, y = ax + (bx - ax) * t, ay + (by - ay) * t
    away = F.when(squared == 0, haversine_m(lat, lng, lat1, lng1)).otherwise(F.sqrt(x * x + y * y))
    t = F.coalesce(t, num(0))
    return lat1 + (lat2 - lat1) * t, lng1 + (lng2 - lng1) * t, away


def segment_distance_km(lat: Column, lng: Column, lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    east, north = num(KM_PER_DEGREE) * F.cos(F.radians(lat)), num(KM_PER_DEGREE)
    ax, ay, bx, by = (lng1 - lng) * east, (lat1 - lat) * north, (lng2 - lng) * east, (lat2 - lat) * north
    t, squared = _along(ax, ay, bx, by)
    x, y = ax + (bx - ax) * t, ay + (by - ay) * t
    return F.when(squared == 0, haversine_m(lat, lng, lat1, lng1) / 1000).otherwise(F.sqrt(x * x + y * y))


def with_segment_km(rows: DataFrame, name: str, place: tuple[str, str], line: tuple[str, str, str, str]) -> DataFrame:
    """Adds ``segment_distance_km`` of columns, in steps of their own: as one expression each part of it is computed
    wherever it stands, some fifty cosines a row. A filter on it belongs behind an aggregation, or it is computed twice."""
    lat, lng, lat1, lng1, lat2, lng2 = map(F.col, (*place, *line))
    east, north = num(KM_PER_DEGREE) * F.cos(F.radians(lat)), num(KM_PER_DEGREE)
    found = rows.withColumn("_east", east)
    found = found.withColumns({"_ax": (lng1 - lng) * F.col("_east"), "_ay": (lat1 - lat) * north, "_bx": (lng2 - lng) * F.col("_east"), "_by": (lat2 - lat) * north})
    found = found.withColumns({"_sx": F.col("_bx") - F.col("_ax"), "_sy": F.col("_by") - F.col("_ay")})
    found = found.withColumn("_squared", F.col("_sx") * F.col("_sx") + F.col("_sy") * F.col("_sy"))
    found = found.withColumn("_t", clamp(-(F.col("_ax") * F.col("_sx") + F.col("_ay") * F.col("_sy")) / F.when(F.col("_squared") != 0, F.col("_squared")), 0, 1))
    found = found.withColumns({"_x": F.col("_ax") + F.col("_sx") * F.col("_t"), "_y": F.col("_ay") + F.col("_sy") * F.col("_t")})
    km = F.when(F.col("_squared") == 0, haversine_m(lat, lng, lat1, lng1) / 1000).otherwise(F.sqrt(F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y")))
    return found.withColumn(name, km).drop("_east", "_ax", "_ay", "_bx", "_by", "_sx", "_sy", "_squared", "_t", "_x", "_y")


def box_around(lat: Column, lng: Column, km: Column, km_per_degree: float = BOX_KM_PER_DEGREE) -> tuple[Column, Column, Column, Column]:
    """(south, west, north, east) of a box of half-width ``km``."""
    dlat = km / num(km_per_degree)
    dlng = km / (num(km_per_degree) * F.cos(F.radians(lat)))
    return lat - dlat, lng - dlng, lat + dlat, lng + dlng


def valid_point(lat: Column, lng: Column) -> Column:
    fine = lat.between(-90, 90) & lng.between(-180, 180) & ~F.isnan(lat) & ~F.isnan(lng)
    return F.coalesce(fine, F.lit(False))


def edge_key(a: Column, b: Column) -> Column:
    return F.concat(F.least(a, b), F.lit("<>"), F.greatest(a, b))


def coordinate_key(lat: Column, lng: Column) -> Column:
    """'lat,lng' to six decimals, halves of the decimal text up."""
    return F.format_string("%.6f,%.6f", lat, lng)


def point_in_ring(lat: Column, lng: Column, ring: Column) -> Column:
    """Even-odd test of a point against array<struct<lat, lng>>, closed or not."""
    size = F.size(ring)

    def crosses(i: Column) -> Column:
        c, p = F.element_at(ring, i), F.element_at(ring, F.when(i == 1, size).otherwise(i - 1))
        spans = (c["lng"] > lng) != (p["lng"] > lng)
        cut = (p["lat"] - c["lat"]) * (lng - c["lng"]) / F.when(p["lng"] != c["lng"], p["lng"] - c["lng"]) + c["lat"]
        return spans & (lat < cut)

    return F.size(F.filter(F.sequence(F.lit(1), size), lambda i: F.coalesce(crosses(i), F.lit(False)))) % 2 == 1


def polyline_length_m(points: Column) -> Column:
    """Length of array<struct<lat, lng>>; 0 below two points."""
    steps = F.zip_with(F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))), lambda a, b: haversine_m(a["lat"], a["lng"], b["lat"], b["lng"]))
    return F.aggregate(steps, num(0), lambda total, x: total + x)


# -- preferences


def normalize_preference(v: Column) -> Column:
    """Two pieces: up to 1 as it is, above 1 from 0 again to 1 at 3."""
    return F.when(v <= 1, clamp(v, 0, 1)).otherwise(clamp((v - 1) / 2, 0, 1))


def pace(activity: Column) -> Column:
    return F.when(activity == "running", num(PACE_MIN_PER_KM["running"])).when(activity == "hiking", num(PACE_MIN_PER_KM["hiking"])).otherwise(num(PACE_MIN_PER_KM["cycling"]))


def duration_min(km: Column, activity: Column) -> Column:
    return F.greatest(half_up(km * pace(activity)), num(1))


def target_km(distance: Column, minutes: Column, activity: Column) -> Column:
    return F.coalesce(F.when(distance > 0, distance), F.when(minutes > 0, half_up(minutes / pace(activity), 1)), num(DEFAULT_TARGET_KM))


def tolerance(target: Column) -> Column:
    """Largest accepted share of distance missed."""
    return F.greatest(num(0.08), num(0.35) / F.sqrt(F.greatest(target, num(0.1))))


def reach_km(target: Column, activity: Column) -> Column:
    """How far the roads of a request lie from its start: further for longer targets, without an upper limit."""
    reach = target * F.when(activity == "cycling", num(0.65)).otherwise(num(0.6)) + 1
    return F.when(reach.isNotNull(), F.greatest(reach, num(2.5)))


def search_radius_km(target: Column, activity: Column) -> Column:
    """The published figure, ``reach_km`` up to a limit; searches use the whole reach."""
    return clamp(reach_km(target, activity), 2.5, F.when(activity == "cycling", num(20)).otherwise(num(14)))


def _mentions(departure: Column, words: tuple[str, ...]) -> Column:
    return F.lower(F.coalesce(departure, F.lit(""))).rlike("|".join(words))


def is_afternoon(departure: Column) -> Column:
    return _mentions(departure, ("afternoon", "12:", "13:", "14:", "15:"))


def is_night(departure: Column) -> Column:
    return _mentions(departure, ("night", "late", "22:", "23:"))
