"""Operators on routes: aggregates of their edges, overlaps, loop shape, ranking, selection.

A route is rows (route_id, seq, edge_key, distance_m, scores ...). Sums of scores are made of whole
millionths, so partial aggregation in any order gives the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.cluster import spread
from ridgeline.functions.geo import angular_difference, bearing, half_up, haversine_m, num

# Pool and result sizes, overlap limits.
POOL, RESULTS, MOST_OVERLAP, MOST_OVERLAP_LOOSE = 8, 3, 0.65, 0.85
MEANS = ("park", "shade", "safety", "scenery", "novelty", "traffic")


def _units(x: Column) -> Column:
    return half_up(x * 1000000).cast("long")


def weighted_metrics(edges: DataFrame, key: str = "route_id") -> DataFrame:
    """km, gain_m, max_slope and the distance-weighted means of the scores of each route."""
    weight = F.greatest(F.col("distance_m"), num(1))
    values = {
        "park": F.col("park_score"),
        "shade": F.col("shade_score"),
        "safety": F.col("safety_score"),
        "scenery": F.col("scenery_score"),
        "novelty": F.coalesce("novelty_score", "scenery_score"),
        "traffic": F.coalesce("traffic_exposure", num(0.2)),
    }
    means = [F.coalesce(F.sum(_units(v * weight)) / F.when(F.sum(weight) > 0, F.sum(weight)) / 1000000, num(0.5)).alias(k) for k, v in values.items()]
    return edges.groupBy(key).agg(
        half_up(F.sum("distance_m") / 1000, 1).alias("km"),
        half_up(F.sum(F.greatest(F.coalesce("elevation_gain_m", num(0)), num(0)))).alias("gain_m"),
        F.coalesce(F.max(F.abs(F.coalesce("slope", num(0)))), num(0)).alias("max_slope"),
        F.sum("distance_m").alias("metres"),
        *means,
    )


def self_overlap(edges: DataFrame, key: str = "route_id") -> DataFrame:
    """Share of a route's length on edges that it uses more than once.

    Two aggregations: by edge within the route, then by route. No window, so no route is sorted.
    """
    used = edges.groupBy(key, "edge_key").agg(F.count("*").alias("n"), F.sum("distance_m").alias("d"))
    again = F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("d"))), num(0))
    return used.groupBy(key).agg(F.when(F.sum("d") > 0, again / F.sum("d")).otherwise(num(0)).alias("overlap"))


def reference_overlap(edges: DataFrame, reference: DataFrame, key: str = "route_id", group: str = "request_id") -> DataFrame:
    """Share of each route's length on edges of its group's reference route."""
    keys = reference.select(group, F.col("edge_key")).distinct().withColumn("hit", F.lit(True))
    joined = edges.join(keys, [group, "edge_key"], "left")
    shared = F.coalesce(F.sum(F.when(F.col("hit"), F.col("distance_m"))), num(0))
    return joined.groupBy(group, key).agg(F.when(F.sum("distance_m") > 0, shared / F.sum("distance_m")).otherwise(num(0)).alias("overlap"))


def edge_distances(edges: DataFrame, *keys: str) -> DataFrame:
    return edges.groupBy(*keys, "edge_key").agg(F.sum("distance_m").alias("d"))


def pair_overlap(edges: DataFrame, group: str = "request_id", key: str = "route_id") -> DataFrame:
    """Shared length of routes of one group that have an edge in common: a < b, ``shared_m``.

    Joined on (group, edge): only routes that meet on an edge become pairs. Edges are dealt out before they are summed:
    nearly every (route, edge) is a group of its own, and an input split of them is more than a task should hold.
    """
    d = edge_distances(spread(edges.select(group, key, "edge_key", "distance_m"), group, "edge_key"), group, key)
    a = d.select(group, "edge_key", F.col(key).alias("a"), F.col("d").alias("da"))
    b = d.select(group, "edge_key", F.col(key).alias("b"), F.col("d").alias("db"))
    pairs = a.join(b, [group, "edge_key"]).where("a < b").select(group, "a", "b", F.least("da", "db").alias("m"))
    return spread(pairs, group, "a", "b").groupBy(group, "a", "b").agg(F.sum("m").alias("shared_m"))


def centroids(points: DataFrame, key: str = "route_id") -> DataFrame:
    """Mean point and bounding box of each route, from whole 1e-7 degrees."""
    tiny = lambda c: half_up(F.col(c) * 10000000).cast("long")
    mean = lambda c: (F.sum(tiny(c)) / F.count("*") / 10000000).alias(c)
    box = [f(c).alias(n) for n, f, c in (("south", F.min, "lat"), ("west", F.min, "lng"), ("north", F.max, "lat"), ("east", F.max, "lng"))]
    return points.groupBy(key).agg(mean("lat"), mean("lng"), *box)


def loop_shape(points: DataFrame, key: str = "route_id", metres: str = "metres") -> DataFrame:
    """compactness, coverage and backtrack of closed point sequences (key, seq, lat, lng, metres).

    The polygon's area comes from a lead over the sequence, wrapped to the first point.
    """
    order, whole = Window.partitionBy(key).orderBy("seq"), Window.partitionBy(key)
    first = lambda c: F.first(c).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    p = points.withColumns({"_lat0": first("lat"), "_lng0": first("lng"), "_n": F.count("*").over(whole)})
    x = (F.col("lng") - F.col("_lng0")) * num(111320) * F.cos(F.radians("_lat0"))
    p = p.withColumns({"_x": x, "_y": (F.col("lat") - F.col("_lat0")) * num(110540)})
    nx, ny = F.coalesce(F.lead("_x").over(order), num(0)), F.coalesce(F.lead("_y").over(order), num(0))
    p = p.withColumn("_cross", half_up((F.col("_x") * ny - nx * F.col("_y")) * 1000).cast("long"))
    away = haversine_m(F.col("_lat0"), F.col("_lng0"), F.col("lat"), F.col("lng")) >= 120
    p = p.withColumn("_sector", F.when(away, F.floor(bearing(F.col("_lat0"), F.col("_lng0"), F.col("lat"), F.col("lng")) / 45)))
    p = p.withColumn("_towards", bearing(F.lag("lat").over(order), F.lag("lng").over(order), F.col("lat"), F.col("lng")))
    p = p.withColumn("_turn", angular_difference(F.col("_towards"), F.lag("_towards").over(order)))
    area = F.abs(F.sum("_cross")) / num(2000)
    return p.groupBy(key).agg(
        F.when((F.count("*") >= 3) & (F.max(metres) > 0), num(4 * 3.141592653589793) * area / (F.max(metres) * F.max(metres))).otherwise(num(0)).alias("compactness"),
        (F.count_distinct("_sector") / num(8)).alias("coverage"),
        F.when(F.count("*") > 2, F.count_if(F.col("_turn") >= 155) / (F.count("*") - 2).cast("double")).otherwise(num(0)).alias("backtrack"),
    )


def spike_share(edges: DataFrame, limit: Column, key: str = "route_id") -> DataFrame:
    """Share of each route on short steep edges: at most 700 m, slope above the limit."""
    steep = (F.abs(F.coalesce("slope", num(0))) > limit) & (F.col("distance_m") <= 700)
    return edges.groupBy(key).agg((F.coalesce(F.sum(F.when(steep, F.col("distance_m"))), num(0)) / F.sum("distance_m")).alias("spike"))


def rank_routes(routes: DataFrame, group: str = "request_id") -> DataFrame:
    """Adds ``place``: total score, then distance score, both descending, then least absolute gain, then ``ord``."""
    order = Window.partitionBy(group).orderBy(F.desc("total_score"), F.desc("distance_score"), F.abs("gain_m"), "ord")
    return routes.withColumn("place", F.row_number().over(order).cast("long"))


def pool(routes: DataFrame, group: str = "request_id", most: int = POOL) -> DataFrame:
    """Routes within tolerance of their target; where fewer than three are, also the nearest misses, eight in all.

    routes: km, target_km, tolerance, ord. A route within tolerance comes before any other.
    """
    whole = Window.partitionBy(group)
    fits = F.abs(F.col("km") - F.col("target_km")) / F.col("target_km") <= F.col("tolerance")
    routes = routes.withColumn("fits", fits).withColumn("_fitting", F.count_if("fits").over(whole))
    order = Window.partitionBy(group).orderBy(F.desc("fits"), F.when(F.col("fits"), num(0)).otherwise(F.abs(F.col("km") - F.col("target_km"))), "ord")
    routes = routes.withColumn("_k", F.row_number().over(order))
    return routes.where(F.when(F.col("_fitting") >= 3, F.col("fits")).otherwise(F.col("_k") <= most)).drop("_fitting", "_k")


def greedy_diverse(ranked: DataFrame, conflicts: DataFrame, group: str = "request_id", key: str = "route_id", limit: int = RESULTS) -> DataFrame:
    """Keeps routes in order of ``place`` unless they conflict with one kept before, at most ``limit``.

    conflicts: group, a, b (in either order). Each group's pool is small by construction, so the
    greedy pass is a fold over one array a group.
    """
    hits = conflicts.select(group, F.col("a").alias(key), F.col("b").alias("with")).unionByName(conflicts.select(group, F.col("b").alias(key), F.col("a").alias("with")))
    hits = hits.groupBy(group, key).agg(F.collect_set("with").alias("hits"))
    rows = ranked.join(hits, [group, key], "left").withColumn("hits", F.coalesce("hits", F.array().cast("array<long>")))
    lists = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("place", F.col(key).alias("id"), "hits"))).alias("_all"))
    kept = F.aggregate(
        "_all",
        F.array().cast("array<long>"),
        lambda kept, r: F.when((F.size(kept) < limit) & ~F.arrays_overlap(kept, r["hits"]), F.array_append(kept, r["id"])).otherwise(kept),
    )
    return lists.select(group, F.posexplode(kept).alias("slot", key)).withColumn("slot", (F.col("slot") + 1).cast("long"))


def until_enough(found: DataFrame, least: int = 8, group: str = "request_id") -> DataFrame:
    """Rows of the tiers up to the first, from the second on, by which ``least`` rows of the group ``fits``.

    A search that goes tier by tier stops there; groups that never have enough keep all.
    """
    tiers = found.groupBy(group, "tier").agg(F.count_if("fits").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(group).orderBy("tier"))
    stop = tiers.withColumn("_upto", upto).where((F.col("tier") >= 2) & (F.col("_upto") >= least)).groupBy(group).agg(F.min("tier").alias("_stop"))
    return found.join(stop, group, "left").where(F.col("_stop").isNull() | (F.col("tier") <= F.col("_stop"))).drop("_stop")


def distinct_paths(edges: DataFrame, group: str = "request_id", key: str = "route_id") -> DataFrame:
    """(group, key): the first route of each sequence of edges within a group. A route bounds the list that signs it."""
    steps = F.transform(F.array_sort(F.collect_list(F.struct("seq", "edge_key"))), lambda s: s["edge_key"])
    signed = edges.groupBy(group, key).agg(steps.alias("_signature"))
    return signed.groupBy(group, "_signature").agg(F.min(key).alias(key)).select(group, key)
