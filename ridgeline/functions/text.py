"""Text formats: names, labels, units, XML, links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ridgeline.functions.geo import half_up, num

# Unit factors.
MILES_PER_KM, FEET_PER_M = 0.621371, 3.28084
#: Characters that XML 1.0 does not allow.
_NOT_XML = "[^\\x{9}\\x{A}\\x{D}\\x{20}-\\x{D7FF}\\x{E000}-\\x{FFFD}\\x{10000}-\\x{10FFFF}]"


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def escape_xml(text: Column, strip_illegal: bool = True) -> Column:
    out = F.regexp_replace(text, _NOT_XML, "") if strip_illegal else text
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def safe_filename(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9._-]", "_")


def number_text(x: Column, digits: int = 6) -> Column:
    """Plain decimal text without trailing zeros, at most so many digits; null stays null."""
    text = F.when(x.isNotNull(), F.format_string(f"%.{digits}f", x))
    short = F.regexp_replace(F.regexp_replace(text, "0+$", ""), "[.]$", "")
    return F.when(short == "-0", F.lit("0")).otherwise(short)


def exact_text(x: Column) -> Column:
    """The shortest plain decimal text that reads back as the same number."""
    plain = F.regexp_replace(x.cast("string"), "[.]0$", "")
    return F.when((x == 0) | F.abs(x).between(1e-3, 9.99e6), F.when(plain == "-0", F.lit("0")).otherwise(plain)).otherwise(number_text(x, 20))


def title_label(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def km_to_mi(km: Column) -> Column:
    return km * num(MILES_PER_KM)


def m_to_ft(m: Column) -> Column:
    return m * num(FEET_PER_M)


def miles_text(km: Column) -> Column:
    """One decimal below 100 miles, whole miles from there."""
    mi = km_to_mi(km)
    return F.when(mi < 100, F.concat(F.format_string("%.1f", half_up(mi, 1)), F.lit(" mi"))).otherwise(F.concat(half_up(mi).cast("long").cast("string"), F.lit(" mi")))


def feet_text(m: Column) -> Column:
    return F.concat(half_up(m_to_ft(m)).cast("long").cast("string"), F.lit(" ft"))


def normalize_email(text: Column) -> Column:
    """Trimmed and lower-cased; null unless it looks like an address of at most 254 characters."""
    clean = F.lower(F.trim(text))
    return F.when(clean.rlike("^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$") & (F.length(clean) <= 254), clean)


def safe_path(path: Column, fallback: str = "/") -> Column:
    """A local path that can't lead to another host; the fallback otherwise."""
    good = path.startswith("/") & ~path.startswith("//") & ~path.contains("\\") & ~path.rlike("[\\x00-\\x1F\\x7F]")
    return F.when(F.coalesce(good, F.lit(False)), path).otherwise(F.lit(fallback))


def linestring_geojson(points: Column) -> Column:
    """GeoJSON text of array<struct<lat, lng>>."""
    pairs = F.transform(points, lambda p: F.array(p["lng"], p["lat"]))
    return F.to_json(F.struct(F.lit("LineString").alias("type"), pairs.alias("coordinates")))


def sample_waypoints(points: Column, most: int = 9) -> Column:
    """Evenly spread inner points of a polyline, at most ``most``."""
    inner = F.greatest(F.size(points) - 2, F.lit(0))
    count = F.least(inner, F.lit(most))
    step = F.slice(points, F.lit(2), F.greatest(inner, F.lit(0)))
    picks = F.transform(F.filter(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: i < count), lambda i: F.element_at(step, (F.floor((i + 1) * inner / (count + 1)) + 1).cast("int")))
    return picks


def maps_url(points: Column, activity: Column) -> Column:
    """Directions link with origin, destination and sampled waypoints."""
    pair = lambda p: F.concat(number_text(p["lat"]), F.lit(","), number_text(p["lng"]))
    mode = F.when(activity == "cycling", F.lit("bicycling")).otherwise(F.lit("walking"))
    stops = F.array_join(F.transform(sample_waypoints(points), pair), "|")
    base = F.concat(
        F.lit("https://www.google.com/maps/dir/?api=1&origin="), F.url_encode(pair(F.element_at(points, 1))), F.lit("&destination="), F.url_encode(pair(F.element_at(points, -1))), F.lit("&travelmode="), mode
    )
    return F.when(stops == "", base).otherwise(F.concat(base, F.lit("&waypoints="), F.url_encode(stops)))
