"""Route requests: validation and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.geo import DEFAULT_START, num, valid_point
from ridgeline.operators.graph import near_join

# Accepted ranges.
LIMITS = {
    "target_distance_km": (0.1, 200),
    "target_duration_min": (1, 1440),
    "park_preference": (0, 3),
    "shade_preference": (0, 3),
    "elevation_preference": (0, 3),
    "safety_preference": (0, 3),
    "exploration_preference": (0, 3),
}
OPTIONAL = ("target_distance_km", "target_duration_min")


def valid_request(p: dict[str, Column], limits: dict[str, tuple[float, float]] = LIMITS) -> Column:
    """True if the start is a point and every number lies in its range; targets may be missing."""
    good = valid_point(p["start_lat"], p["start_lng"])
    for name, (low, high) in limits.items():
        within = p[name].between(low, high)
        good &= (p[name].isNull() | within) if name in OPTIONAL else F.coalesce(within, F.lit(False))
    return good



def with_start(requests: DataFrame) -> DataFrame:
    """Requests whose start is missing, wholly or in part, begin at the default start."""
    whole = F.col("start_lat").isNotNull() & F.col("start_lng").isNotNull()
    lat, lng = map(num, DEFAULT_START)
    return requests.withColumns({"start_lat": F.when(whole, F.col("start_lat")).otherwise(lat), "start_lng": F.when(whole, F.col("start_lng")).otherwise(lng)})


# Codes of requests without routes, in the order in which they are looked for; nodes and edges that a graph needs.
MALFORMED, NO_GRAPH, NO_ROUTE = "malformed_input", "insufficient_graph_data", "no_route"
LEAST_NODES, LEAST_EDGES = 8, 8
#: Kilometres to which a request's radius is held.
MOST_RADIUS_KM = 20.0


def reachable(requests: DataFrame, edges: DataFrame, most_km: float = MOST_RADIUS_KM, key: str = "request_id") -> DataFrame:
    """(key, edges, nodes): the edges whose middle lies within each request's ``radius_km`` (``most_km`` at most), and their
    distinct ends; requests with nothing in reach are left out.

    requests: key, lat, lng, radius_km. edges: src, dst, lat1, lng1, lat2, lng2. Requests of one place and radius are counted once.
    """
    radius = F.least(F.col("radius_km"), num(most_km)) * 1000
    asked = requests.select(key, "lat", "lng", radius.alias("reach"))
    middle = edges.select("src", "dst", ((F.col("lat1") + F.col("lat2")) / 2).alias("to_lat"), ((F.col("lng1") + F.col("lng2")) / 2).alias("to_lng"))
    near = near_join(asked.select("lat", "lng", "reach").distinct(), middle, most_km * 1000).where(F.col("metres") <= F.col("reach"))
    ends = near.select("lat", "lng", "reach", F.explode(F.array("src", "dst")).alias("node")).groupBy("lat", "lng", "reach")
    sizes = ends.agg((F.count("*") / 2).cast("long").alias("edges"), F.count_distinct("node").alias("nodes"))
    return asked.join(sizes, ["lat", "lng", "reach"]).select(key, "edges", "nodes")


def outcomes(requests: DataFrame, valid: Column, graphs: DataFrame, routes: DataFrame, key: str = "request_id") -> DataFrame:
    """(key, routes, code): every request once, with the number of its routes or the code that says why it has none.

    valid: whether a request is well formed. graphs: key, edges, nodes of the map in its reach, missing where there is
    none. routes: key, one row a route. A request that is not well formed has no routes, whatever the table holds.
    """
    count = routes.groupBy(key).agg(F.count("*").alias("n"))
    joined = requests.withColumn("_valid", F.coalesce(valid, F.lit(False))).select(key, "_valid").join(graphs.select(key, "edges", "nodes"), key, "left").join(count, key, "left")
    small = (F.coalesce("edges", F.lit(0)) < LEAST_EDGES) | (F.coalesce("nodes", F.lit(0)) < LEAST_NODES)
    code = F.when(~F.col("_valid"), MALFORMED).when(small, NO_GRAPH).when(F.coalesce("n", F.lit(0)) == 0, NO_ROUTE)
    return joined.select(key, F.when(code.isNull(), F.col("n")).otherwise(0).cast("long").alias("routes"), code.alias("code"))
