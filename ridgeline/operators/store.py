"""Saved routes, shares, caches and segments: what the persistence layer asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.cluster import stored, tasks
from ridgeline.functions.geo import half_up, haversine_m, num, segment_distance_km, with_segment_km
from ridgeline.operators import grid
from ridgeline.operators.graph import best_of

# Cache limits.
TTL_S, LEAST_TTL_S, MOST_TTL_S = 600, 60, 86400
SEGMENTS, MOST_SEGMENTS = 10, 50
#: Least side of the cells in which segments are found.
SEGMENT_CELL_M = 150.0


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Latest row of each key. One aggregation: the newest is kept on the map side already."""
    both = table.unionByName(changes)
    rest = [c for c in both.columns if c not in keys]
    newest = both.groupBy(*keys).agg(F.max(F.struct(version, *[c for c in rest if c != version])).alias("row"))
    return newest.select(*keys, *[F.col(f"row.{c}").alias(c) for c in rest])


def fresh(cache: DataFrame, now: Column) -> DataFrame:
    return cache.where(F.col("expires_at") > now)


def expiry(saved: Column, ttl_s: Column) -> Column:
    """When a cached row ends; the time to live is held within its limits."""
    seconds = F.least(F.greatest(F.coalesce(ttl_s, F.lit(TTL_S)), F.lit(LEAST_TTL_S)), F.lit(MOST_TTL_S))
    return saved + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def resolve_shares(shares: DataFrame, routes: DataFrame, now: Column) -> DataFrame:
    """Shared routes whose link has not expired."""
    live = shares.withColumn("expires_at", F.col("created_at") + F.make_dt_interval(F.lit(0), F.col("hours").cast("int"))).where(F.col("expires_at") > now)
    return live.select("token", "route_key", "expires_at").join(routes.select("route_key", "id", "user_id", "distance_km", "saved_at"), "route_key")


def without_rows(table: DataFrame, doomed: DataFrame, keys: list[str]) -> DataFrame:
    """The table after a delete of the keys, as it is to be written back."""
    return table.join(doomed.select(*keys).distinct(), keys, "left_anti")


def latest_by_user(routes: DataFrame, most: int) -> DataFrame:
    """Each user's newest routes, newest first."""
    order = Window.partitionBy("user_id").orderBy(F.desc("saved_at"), "id")
    return routes.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= most)


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, that of the least order."""
    rest = [c for c in rows.columns if c not in (key, order)]
    least = rows.groupBy(key).agg(F.min(F.struct(order, *rest)).alias("row"))
    return least.select(key, *[F.col(f"row.{c}").alias(c) for c in (order, *rest)])


def segment_distance(lat: Column, lng: Column, points: Column) -> Column:
    """Kilometres from a point to a polyline array<struct<lat, lng>>; infinite if it is empty."""
    pairs = F.zip_with(F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))), lambda a, b: segment_distance_km(lat, lng, a["lat"], a["lng"], b["lat"], b["lng"]))
    first = F.get(points, F.lit(0))
    return F.coalesce(F.array_min(pairs), haversine_m(lat, lng, first["lat"], first["lng"]) / 1000, num(float("inf")))


def nearby_segments(requests: DataFrame, segments: DataFrame, radius_km: float, limit: int | None = None, key: str = "request_id") -> DataFrame:
    """Each request's (key, lat, lng) segments within the radius, nearest first: ``segment_id``, ``km``, ``rank``.

    segments: segment_id, geometry, of which the steps are joined. limit: 1 to 50, 10 by default. A step lies in
    the cells along its line, grown by the radius, so a request meets few steps that are too far; distinct
    places are answered once. They are stored first, so that few of them are sent to the steps, and the many
    rows of cells aren't shuffled. Segments are dealt out whole, so each finds its nearest step where it lies.
    """
    most = min(max(SEGMENTS if limit is None else limit, 1), MOST_SEGMENTS)
    points = F.col("geometry")
    inner = F.greatest(F.size(points) - 1, F.lit(1))  # a single point is a step to itself
    steps = F.zip_with(F.slice(points, F.lit(1), inner), F.slice(points, F.least(F.size(points), F.lit(2)), inner), lambda a, b: F.struct(a["lat"].alias("a"), a["lng"].alias("b"), b["lat"].alias("lat2"), b["lng"].alias("lng2")))
    # a number of parts of its own: an equal one would be taken for the shuffle of an aggregation before, and its parts joined by size
    dealt = segments.where(F.size("geometry") > 0).repartition(2 * tasks(segments.sparkSession), "segment_id")
    pieces = dealt.select("segment_id", F.inline(steps))
    metres = radius_km * 1000
    degrees = grid.height(max(metres, SEGMENT_CELL_M))
    whole = pieces.where("a IS NOT NULL AND b IS NOT NULL AND lat2 IS NOT NULL AND lng2 IS NOT NULL")
    placed = grid.line_spread(whole, ("a", "b", "lat2", "lng2"), metres, degrees)
    places = stored(requests.where("lat IS NOT NULL AND lng IS NOT NULL").select("lat", "lng").distinct().withColumn("_cell", grid.cell(F.col("lat"), F.col("lng"), degrees)), "places")
    reach = num(grid.height(metres))
    level = F.col("lat").between(F.least("a", "lat2") - reach, F.greatest("a", "lat2") + reach)  # a cheap test before the distance
    pairs = places.join(placed, "_cell").where(level)
    measured = with_segment_km(pairs, "km", ("lat", "lng"), ("a", "b", "lat2", "lng2"))
    near = measured.groupBy("lat", "lng", "segment_id").agg(F.min("km").alias("km")).where(F.col("km") <= radius_km)
    best = best_of(near.withColumn("km", half_up(F.col("km"), 6)), Window.partitionBy("lat", "lng").orderBy("km", "segment_id"), most)
    return requests.select(key, "lat", "lng").join(best, ["lat", "lng"]).select(key, "segment_id", "km", "rank")


def of_activity(routes: DataFrame, wanted: str) -> DataFrame:
    """Routes of one activity, or of all."""
    return routes if wanted == "all" else routes.where(F.col("activity") == wanted)


def as_imported(routes: DataFrame) -> DataFrame:
    """Imported routes aim at their own length: ``target_km`` is ``km``."""
    return routes.withColumn("target_km", F.col("km"))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, rows) of each table, counted in one job."""
    parts = [t.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows") for name, t in tables.items()]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found
