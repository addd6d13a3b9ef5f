"""Queries over the road graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridgeline.cluster import stored
from ridgeline.functions.cost import ROAD, SURFACE, edge_cost
from ridgeline.functions.geo import half_up, num
from ridgeline.operators import graph
from ridgeline.plans.geo_queries import normalized_sql
from ridgeline.plans.projection import half_up_sql, haversine_sql, views
from ridgeline.plans.registry import query

C = F.col
#: Preferences of one request, for queries over the whole graph.
ONE = {
    "activity": "running",
    "park_preference": 2.0,
    "shade_preference": 1.0,
    "elevation_preference": 2.5,
    "safety_preference": 3.0,
    "exploration_preference": 1.5,
    "departure_time": "22:30",
    "route_style": "scenic",
}
ORIGIN = (40.0225, -105.246)


def one_request():
    return {k: F.lit(v) for k, v in ONE.items()}


def _case(column: str, table: dict[str, float]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in table.items()) + " ELSE 0e0 END"


def cost_sql(p: str = "") -> str:
    """The cost expression for DuckDB, over v_edge and v_pref columns."""
    n = {k: normalized_sql(f"{p}{k}_preference") for k in ("park", "shade", "elevation", "safety", "exploration")}
    novelty, d, style = "coalesce(novelty_score, scenery_score)", "distance_m", f"coalesce({p}route_style, '')"
    late, dark = f"regexp_matches(lower({p}departure_time), 'afternoon|12:|13:|14:|15:')", f"regexp_matches(lower({p}departure_time), 'night|late|22:|23:')"
    terms = [
        d,
        f"CASE WHEN {style} = 'climbing' THEN -least({d} * 0.24e0, {n['elevation']} * elevation_gain_m * 1.6e0) + CASE WHEN abs(slope) > 0.12 THEN {d} * abs(slope) * 2.2e0 ELSE 0e0 END"
        f" ELSE {n['elevation']} * elevation_gain_m * 4.5e0 + {n['elevation']} * abs(slope) * {d} * 1.8e0 END",
        f"CASE {style} WHEN 'easy_flat' THEN elevation_gain_m * 3.5e0 + abs(slope) * {d} * 2.5e0 WHEN 'park_heavy' THEN -park_score * {d} * 0.28e0 WHEN 'shaded' THEN -shade_score * {d} * 0.35e0"
        f" WHEN 'scenic' THEN -scenery_score * {d} * 0.28e0 WHEN 'exploration' THEN -{novelty} * {d} * 0.28e0 ELSE 0e0 END",
        f"{n['safety']} * (1 - safety_score) * {d} * 1.15e0",
        f"{n['shade']} * (1 - shade_score) * {d} * 0.42e0",
        f"-{n['park']} * park_score * {d} * 0.32e0",
        f"-{n['exploration']} * {novelty} * {d} * 0.24e0",
        f"-scenery_score * {d} * 0.08e0",
        f"CASE WHEN {late} THEN {n['shade']} * (1 - shade_score) * {d} * 0.28e0 ELSE 0e0 END",
        f"CASE WHEN {dark} THEN (1 - safety_score) * {d} * 0.35e0 + coalesce(traffic_exposure, 0.25e0) * {d} * 0.18e0 ELSE 0e0 END",
        f"CASE WHEN {p}activity = 'cycling' THEN (1 - bike_score) * {d} * 0.48e0 - bike_score * {d} * 0.32e0 + CASE WHEN abs(slope) > 0.08 THEN {d} * abs(slope) * 3.8e0 ELSE 0e0 END"
        f" ELSE (1 - walk_score) * {d} * 0.32e0 - walk_score * {d} * 0.24e0 END",
        f"CASE WHEN {p}activity = 'hiking' AND road_type IN ('trail', 'park_path') THEN -0.28e0 * {d} WHEN {p}activity = 'hiking' AND road_type = 'arterial' THEN 0.28e0 * {d} ELSE 0e0 END",
        f"{_case('road_type', ROAD)} * {d}",
        f"{_case('surface_type', SURFACE)} * {d}",
        f"coalesce(traffic_exposure, 0e0) * {n['safety']} * {d} * 0.38e0",
    ]
    return f"greatest({' + '.join(f'({t})' for t in terms)}, {d} * 0.2e0)"


def _literals(sql: str) -> str:
    """The same with the preferences of ONE."""
    for k, v in ONE.items():
        sql = sql.replace(f"p.{k}", f"'{v}'" if isinstance(v, str) else f"{v}e0")
    return sql


ONE_COST = _literals(cost_sql("p."))


@query(f"SELECT edge_id, CASE WHEN access_allowed THEN {half_up_sql(ONE_COST, 6)} END AS cost FROM v_edge")
def edge_cost_one(spark, sf_dir):
    (e,) = views(spark, sf_dir, "v_edge")
    cost = edge_cost({c: C(c) for c in e.columns}, one_request())
    return e.select("edge_id", F.when(C("access_allowed"), half_up(cost, 6)).alias("cost"))


@query(
    f"""SELECT e.edge_id, p.request_id, {half_up_sql(cost_sql('p.'), 5)} AS cost FROM v_edge e JOIN v_pref p ON abs(e.lat1 - p.start_lat) < 0.003 AND abs(e.lng1 - p.start_lng) < 0.004
        AND {haversine_sql('p.start_lat', 'p.start_lng', 'e.lat1', 'e.lng1')} <= 150 WHERE access_allowed"""
)
def edge_cost_by_request(spark, sf_dir):
    """Costs of the edges around each request's start, under its own preferences."""
    e, p = views(spark, sf_dir, "v_edge", "v_pref")
    starts = p.withColumns({"lat": C("start_lat"), "lng": C("start_lng")})
    met = graph.near_join(starts, e.where("access_allowed").withColumns({"to_lat": C("lat1"), "to_lng": C("lng1")}), 150)
    return met.select("edge_id", "request_id", half_up(edge_cost({c: C(c) for c in e.columns}, {c: C(c) for c in p.columns}), 5).alias("cost"))


BOTH = """(SELECT edge_id, true AS forward, src, dst, elevation_gain_m, slope, from_elev, to_elev FROM v_edge
    UNION ALL SELECT edge_id, false, dst, src, -elevation_gain_m, -slope, to_elev, from_elev FROM v_edge)"""


@query(f"SELECT edge_id, forward, src, dst, elevation_gain_m + 0e0 AS elevation_gain_m, {half_up_sql('slope', 6)} AS slope, from_elev, to_elev FROM {BOTH}")
def edge_both_ways(spark, sf_dir):
    (e,) = views(spark, sf_dir, "v_edge")
    found = graph.both_ways(e)
    return found.select("edge_id", "forward", "src", "dst", (C("elevation_gain_m") + num(0)).alias("elevation_gain_m"), half_up(C("slope"), 6).alias("slope"), "from_elev", "to_elev")


@query(
    """SELECT node_id, count(*) AS degree, count(*) FILTER (WHERE access_allowed) AS open_degree FROM
       (SELECT src AS node_id, access_allowed FROM v_edge UNION ALL SELECT dst, access_allowed FROM v_edge) GROUP BY node_id"""
)
def node_degree(spark, sf_dir):
    (e,) = views(spark, sf_dir, "v_edge")
    return graph.node_degree(graph.both_ways(e))


def _worth_sql() -> str:
    n = {k: _literals(normalized_sql(f"p.{k}_preference")) for k in ("park", "shade", "safety", "exploration")}
    worth = f"park_score * {n['park']} + shade_score * {n['shade']} + safety_score * {n['safety']} + coalesce(novelty_score, scenery_score) * {n['exploration']} + scenery_score * 0.4e0 + walk_score"
    return f"CAST(floor((CASE WHEN access_allowed THEN {worth} ELSE -3e0 END) * 1000000 + 0.5e0) AS bigint)"


QUALITY = f"(SELECT node_id, CAST(sum({_worth_sql()}) AS bigint) / count(*) / 1000000 AS quality, count(*) AS degree FROM (SELECT src AS node_id, * FROM v_edge UNION ALL SELECT dst, * FROM v_edge) GROUP BY node_id)"


@query(f"SELECT node_id, {half_up_sql('quality', 6)} AS quality FROM {QUALITY}")
def node_quality(spark, sf_dir):
    (e,) = views(spark, sf_dir, "v_edge")
    return graph.node_qualities(graph.both_ways(e), one_request()).select("node_id", half_up(C("quality"), 6).alias("quality"))


def requests(spark, sf_dir):
    """Starts that lie off the grid's nodes."""
    (p,) = views(spark, sf_dir, "v_pref")
    return p.select("request_id", (C("start_lat") + num(0.00013)).alias("lat"), (C("start_lng") + num(0.00017)).alias("lng"))


REQUESTS = "(SELECT request_id, start_lat + 0.00013e0 AS lat, start_lng + 0.00017e0 AS lng FROM v_pref)"
TO_NODE = haversine_sql("r.lat", "r.lng", "n.lat", "n.lng")


@query(
    f"""SELECT request_id, best.node_id AS node_id, best.metres AS metres FROM (SELECT request_id, min(struct_pack(metres := metres, node_id := node_id)) AS best FROM
        (SELECT r.request_id, n.node_id, {half_up_sql(TO_NODE, 3)} AS metres FROM {REQUESTS} r CROSS JOIN v_node n) GROUP BY request_id)"""
)
def nearest_node(spark, sf_dir):
    (n,) = views(spark, sf_dir, "v_node")
    return graph.nearest(requests(spark, sf_dir), n, "request_id")


@query(
    f"""SELECT request_id, node_id, {half_up_sql('metres', 3)} AS metres FROM (SELECT r.request_id, n.node_id, {TO_NODE} AS metres
        FROM {REQUESTS} r JOIN v_node n ON abs(n.lat - r.lat) < 0.006 AND abs(n.lng - r.lng) < 0.009) WHERE abs(metres - 300) <= 60"""
)
def ring_nodes(spark, sf_dir):
    (n,) = views(spark, sf_dir, "v_node")
    return graph.ring(requests(spark, sf_dir), n, 300, 60).select("request_id", "node_id", half_up(C("metres"), 3).alias("metres"))


RADIUS_M = 400.0
_BAND = f"{haversine_sql('r.lat', 'r.lng', 'n.lat', 'n.lng')}"
_SECTOR = "fmod(floor(fmod(degrees(atan2(sin(radians(n.lng - r.lng)) * cos(radians(n.lat)), cos(radians(r.lat)) * sin(radians(n.lat)) - sin(radians(r.lat)) * cos(radians(n.lat)) * cos(radians(n.lng - r.lng)))) + 360e0, 360e0) / 45), 8)"
TOP = f"""(SELECT request_id, sector, node_id, quality, rank, lat, lng, lat0, lng0 FROM (SELECT *, row_number() OVER (PARTITION BY request_id, sector ORDER BY quality DESC, node_id DESC) AS rank FROM
    (SELECT r.request_id, n.node_id, n.lat, n.lng, r.lat AS lat0, r.lng AS lng0, CAST({_SECTOR} AS bigint) AS sector, {half_up_sql(f'q.quality - abs({_BAND} - 400e0) / 400e0 * 0.4e0', 6)} AS quality
     FROM {REQUESTS} r JOIN v_node n ON abs(n.lat - r.lat) < 0.012 AND abs(n.lng - r.lng) < 0.016 JOIN {QUALITY} q ON q.node_id = n.node_id
     WHERE q.degree >= 2 AND {_BAND} BETWEEN 220e0 AND 620e0)) WHERE rank <= 4)"""


def by_place(spark, sf_dir, find):
    """Rows of ``find(top)`` for every request; top: the best nodes of each sector. Requests of one place share theirs."""
    return graph.answered(requests(spark, sf_dir), "request_id", lambda places: find(stored(graph.sector_top(sector_candidates(spark, sf_dir, places)), "sector-top")))


def sector_candidates(spark, sf_dir, places):
    n, e = views(spark, sf_dir, "v_node", "v_edge")
    directed = graph.both_ways(e)
    good = graph.node_qualities(directed, one_request()).join(graph.node_degree(directed).where("degree >= 2"), "node_id").select(C("node_id").alias("q_id"), "quality")
    targets = n.select("node_id", C("lat").alias("to_lat"), C("lng").alias("to_lng"))
    near = graph.near_join(places, targets, RADIUS_M * 1.55).where(C("metres") >= RADIUS_M * 0.55)
    near = near.join(good, near["node_id"] == good["q_id"])
    return near.select(
        "request_id", "node_id", C("to_lat").alias("lat"), C("to_lng").alias("lng"), C("lat").alias("lat0"), C("lng").alias("lng0"),
        graph.sector(C("lat"), C("lng"), C("to_lat"), C("to_lng")).alias("sector"),
        half_up(C("quality") - F.abs(C("metres") - RADIUS_M) / RADIUS_M * num(0.4), 6).alias("quality"),
    )


@query(f"SELECT request_id, sector, node_id, rank, quality FROM {TOP}")
def sector_top4(spark, sf_dir):
    return by_place(spark, sf_dir, lambda top: top.select("request_id", "sector", "node_id", "rank", "quality"))


def _bear(a: str, b: str) -> str:
    p, q, r, s = f"{a[0]}", f"{a[1]}", f"{b[0]}", f"{b[1]}"
    return f"fmod(degrees(atan2(sin(radians({s} - {q})) * cos(radians({r})), cos(radians({p})) * sin(radians({r})) - sin(radians({p})) * cos(radians({r})) * cos(radians({s} - {q})))) + 360e0, 360e0)"


def _apart(pivot, a, b) -> str:
    d = f"abs({_bear(pivot, a)} - {_bear(pivot, b)})"
    return f"least({d}, 360e0 - {d}) >= 25"


def _at(t: str):
    return f"{t}.lat", f"{t}.lng"


PAIRS_SQL = f"""a AS MATERIALIZED (SELECT t.*, s.step, (t.sector + s.step) % 8 AS other FROM t CROSS JOIN (SELECT 4 AS step UNION ALL SELECT 2) s WHERE s.step = 2 OR t.sector < 4),
    p AS MATERIALIZED (SELECT a.request_id, a.node_id AS a, b.node_id AS b, a.step, a.sector, greatest(a.rank, b.rank) AS tier, {_bear(('a.lat0', 'a.lng0'), _at('a'))} AS x, {_bear(('a.lat0', 'a.lng0'), _at('b'))} AS y
        FROM a JOIN t b ON b.request_id = a.request_id AND b.sector = a.other),
    pairs AS MATERIALIZED (SELECT request_id, a, b, CASE WHEN step = 4 AND sector % 2 = 0 THEN 'recommended' ELSE 'exploration' END AS strategy, tier FROM p WHERE a <> b AND least(abs(x - y), 360e0 - abs(x - y)) >= 25)"""


@query(f"WITH t AS MATERIALIZED {TOP}, {PAIRS_SQL} SELECT request_id, a, b, strategy, tier FROM pairs")
def waypoint_pairs(spark, sf_dir):
    return by_place(spark, sf_dir, graph.sector_pairs)


TRIPLES_SQL = f"""z AS MATERIALIZED (SELECT a.request_id, a.node_id AS a, b.node_id AS b, c.node_id AS c, a.rank AS tier, a.sector,
      {_apart(('a.lat0', 'a.lng0'), _at('a'), _at('b'))} AND {_apart(('a.lat0', 'a.lng0'), _at('a'), _at('c'))} AND (a.rank > 1 OR {_apart(_at('b'), _at('a'), _at('c'))}) AS ok
    FROM t a JOIN t b ON b.request_id = a.request_id AND b.sector = (a.sector + 2) % 8 AND b.rank = 1 JOIN t c ON c.request_id = a.request_id AND c.sector = (a.sector + 4) % 8 AND c.rank = 1
    WHERE a.rank <= 2 AND a.node_id <> b.node_id AND a.node_id <> c.node_id AND b.node_id <> c.node_id),
    triples AS MATERIALIZED (SELECT request_id, a, b, c, tier FROM z WHERE ok AND EXISTS (SELECT 1 FROM z y WHERE y.request_id = z.request_id AND y.sector = z.sector AND y.tier = 1 AND y.ok))"""


@query(f"WITH t AS MATERIALIZED {TOP}, {TRIPLES_SQL} SELECT request_id, a, b, c, tier FROM triples")
def waypoint_triples(spark, sf_dir):
    return by_place(spark, sf_dir, graph.sector_triples)


_MID = haversine_sql(f"{ORIGIN[0]}e0", f"{ORIGIN[1]}e0", "((lat1 + lat2) / 2)", "((lng1 + lng2) / 2)")


@query(
    f"""SELECT edge_id, trim_score FROM (SELECT edge_id, {half_up_sql(f'{_MID} - (park_score + shade_score + safety_score + scenery_score) * 120', 3)} AS trim_score
        FROM v_edge WHERE {_MID} <= 2500) ORDER BY trim_score, edge_id LIMIT 1000"""
)
def trim_graph(spark, sf_dir):
    (e,) = views(spark, sf_dir, "v_edge")
    return graph.trim(e, num(ORIGIN[0]), num(ORIGIN[1]), num(2500), 1000).select("edge_id", "trim_score")


_LOCAL_M = "(pi() * 6371000e0 / 180e0)"


#: The six nearest edges of every request, all edges of the map considered.
_SNAPPED = f"""(SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY {half_up_sql('metres', 6)}, edge_id) AS rank FROM
    (SELECT *, sqrt((x1 + (x2 - x1) * t) * (x1 + (x2 - x1) * t) + (y1 + (y2 - y1) * t) * (y1 + (y2 - y1) * t)) AS metres, lat1 + (lat2 - lat1) * t AS snap_lat, lng1 + (lng2 - lng1) * t AS snap_lng FROM
    (SELECT *, least(greatest(-(x1 * (x2 - x1) + y1 * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 0e0), 1e0) AS t FROM
    (SELECT r.*, e.edge_id, e.lat1, e.lng1, e.lat2, e.lng2, e.elevation_gain_m AS gain, (e.lng1 - r.lng) * {_LOCAL_M} * cos(radians(r.lat)) AS x1, (e.lat1 - r.lat) * {_LOCAL_M} AS y1,
     (e.lng2 - r.lng) * {_LOCAL_M} * cos(radians(r.lat)) AS x2, (e.lat2 - r.lat) * {_LOCAL_M} AS y2 FROM {REQUESTS} r CROSS JOIN v_edge e))) QUALIFY rank <= 6)"""


@query(f"SELECT request_id, edge_id, rank, {half_up_sql('metres', 4)} AS metres FROM {_SNAPPED}")
def anchor_top6(spark, sf_dir):
    (e,) = views(spark, sf_dir, "v_edge")
    return graph.anchors(e, requests(spark, sf_dir), "request_id").select("request_id", "edge_id", "rank", half_up(C("metres"), 4).alias("metres"))


_PARTS = {"connector": haversine_sql("lat", "lng", "snap_lat", "snap_lng"), "first": haversine_sql("lat1", "lng1", "snap_lat", "snap_lng"), "second": haversine_sql("snap_lat", "snap_lng", "lat2", "lng2")}


@query(
    f"""WITH s AS MATERIALIZED (SELECT *, {', '.join(f'greatest({half_up_sql(x)}, 1e0) AS d_{k}' for k, x in _PARTS.items())} FROM {_SNAPPED})
        SELECT request_id, rank, edge_id, 'connector' AS part, d_connector AS distance_m, 0e0 AS elevation_gain_m FROM s
        UNION ALL SELECT request_id, rank, edge_id, 'first', d_first, {half_up_sql('coalesce(gain, 0e0) * (d_first / (d_first + d_second))', 1)} FROM s
        UNION ALL SELECT request_id, rank, edge_id, 'second', d_second, {half_up_sql('coalesce(gain, 0e0) * (d_second / (d_first + d_second))', 1)} FROM s"""
)
def anchor_splits(spark, sf_dir):
    (e,) = views(spark, sf_dir, "v_edge")
    return graph.split_at_anchor(graph.anchors(e, requests(spark, sf_dir), "request_id"), "request_id")


@query("SELECT node_id FROM v_node WHERE node_id IN (SELECT src FROM v_edge WHERE access_allowed UNION SELECT dst FROM v_edge WHERE access_allowed)")
def retain_nodes(spark, sf_dir):
    n, e = views(spark, sf_dir, "v_node", "v_edge")
    open_ = e.where("access_allowed")
    ends = open_.select(C("src").alias("node_id")).union(open_.select("dst"))
    return n.join(ends, "node_id", "left_semi").select("node_id")


@query("SELECT edge_id, src, dst FROM v_edge WHERE edge_id % 7 <> 0 AND (dst % 11 <> 0 OR dst = 110)")
def blocked_edges(spark, sf_dir):
    n, e = views(spark, sf_dir, "v_node", "v_edge")
    return graph.without(e, e.where("edge_id % 7 = 0").select("edge_id"), n.where("node_id % 11 = 0"), F.lit(110)).select("edge_id", "src", "dst")


@query(
    """SELECT edge_id, coalesce(CASE WHEN edge_id % 3 = 0 THEN CAST(edge_id % 2 AS double) END, CASE WHEN edge_id % 5 = 0 THEN distance_m * 0.6e0 END, 0e0) AS penalty FROM v_edge"""
)
def penalty_precedence(spark, sf_dir):
    (e,) = views(spark, sf_dir, "v_edge")
    e = e.withColumn("edge_key", F.concat_ws("<>", "src", "dst"))
    own = e.where("edge_id % 3 = 0").select("edge_id", (C("edge_id") % 2).cast("double").alias("penalty"))
    shared = e.where("edge_id % 5 = 0").select("edge_key", (C("distance_m") * num(0.6)).alias("penalty"))
    return graph.with_penalties(e, own, shared).select("edge_id", "penalty")


@query(
    f"""SELECT edge_id, CASE WHEN known THEN {half_up_sql('b - a', 1)} ELSE elevation_gain_m END AS elevation_gain_m, {half_up_sql(f"CASE WHEN known THEN {half_up_sql('b - a', 1)} / distance_m ELSE slope END", 6)} AS slope
        FROM (SELECT *, src % 11 <> 0 AND dst % 11 <> 0 AS known, from_elev * 2 AS a, to_elev * 2 AS b FROM v_edge)"""
)
def edge_elevations(spark, sf_dir):
    n, e = views(spark, sf_dir, "v_node", "v_edge")
    found = graph.with_elevations(e, n.where("node_id % 11 <> 0").select("node_id", (C("elev") * 2).alias("elev")))
    return found.select("edge_id", "elevation_gain_m", half_up(C("slope"), 6).alias("slope"))


def _side(i: int) -> str:
    south, north, west, east = "g.lat - g.half", "g.lat + g.half", "g.lng - g.half", "g.lng + g.half"
    ring = [(south, west), (south, east), (north, east), (north, west), (south, west)]
    (a, b), (c, d) = ring[i], ring[i + 1]
    x1, y1, x2, y2 = f"(({b}) - n.lng) * {_LOCAL_M} * cos(radians(n.lat))", f"(({a}) - n.lat) * {_LOCAL_M}", f"(({d}) - n.lng) * {_LOCAL_M} * cos(radians(n.lat))", f"(({c}) - n.lat) * {_LOCAL_M}"
    t = f"least(greatest(-(({x1}) * (({x2}) - ({x1})) + ({y1}) * (({y2}) - ({y1}))) / ((({x2}) - ({x1})) * (({x2}) - ({x1})) + (({y2}) - ({y1})) * (({y2}) - ({y1}))), 0e0), 1e0)"
    return f"sqrt(pow(({x1}) + (({x2}) - ({x1})) * {t}, 2) + pow(({y1}) + (({y2}) - ({y1})) * {t}, 2))"


@query(
    f"""SELECT node_id, {', '.join(half_up_sql(f'max(w * {k})', 4) + f' AS {name}' for name, k in (
            ('park_near', "CASE WHEN kind IN ('park', 'woods') THEN 1e0 ELSE 0.45e0 END"),
            ('shade_near', "CASE kind WHEN 'woods' THEN 1e0 WHEN 'park' THEN 0.72e0 ELSE 0.28e0 END"),
            ('scenery_near', "CASE kind WHEN 'water' THEN 1e0 ELSE 0.82e0 END")))}
        FROM (SELECT *, greatest(0e0, least(1e0, 1 - away / 300e0)) AS w, row_number() OVER (PARTITION BY node_id ORDER BY away, ord) AS k FROM
        (SELECT n.node_id, g.ord, g.kind, CASE WHEN n.lat >= g.lat - g.half AND n.lat < g.lat + g.half AND n.lng >= g.lng - g.half AND n.lng < g.lng + g.half THEN 0e0
                ELSE {half_up_sql('least(' + ', '.join(_side(i) for i in range(4)) + ')', 6)} END AS away
         FROM v_node n CROSS JOIN v_green g) WHERE away <= 300) WHERE k <= 5 GROUP BY node_id"""
)
def green_knn_scores(spark, sf_dir):
    n, g = views(spark, sf_dir, "v_node", "v_green")
    found = graph.green_scores(n.select("node_id", "lat", "lng"), g, "node_id")
    return found.select("node_id", *[half_up(C(c), 4).alias(c) for c in ("park_near", "shade_near", "scenery_near")])


# the flagship: waypoint candidates of every request, costs included
@query(
    f"""WITH c AS (SELECT src AS node_id, CAST(sum(CAST(floor({ONE_COST}) AS bigint)) AS bigint) AS cost FROM v_edge WHERE access_allowed GROUP BY src)
        SELECT t.request_id, t.sector, t.node_id, t.rank, c.cost FROM {TOP} t LEFT JOIN c ON c.node_id = t.node_id"""
)
def sector_costs(spark, sf_dir):
    (e,) = views(spark, sf_dir, "v_edge")
    cost = edge_cost({c: C(c) for c in e.columns}, one_request())
    costs = e.where("access_allowed").groupBy("src").agg(F.sum(F.floor(cost).cast("long")).alias("cost"))
    return by_place(spark, sf_dir, lambda top: top.join(costs, top["node_id"] == costs["src"], "left").select("request_id", "sector", "node_id", "rank", "cost"))

