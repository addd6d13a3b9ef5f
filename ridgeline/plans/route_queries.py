"""Queries over routes: scores, overlaps, loops, ranking and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridgeline.functions import geo, scores
from ridgeline.functions.geo import half_up, num
from ridgeline.operators import routes
from ridgeline.plans.geo_queries import TARGET_SQL, normalized_sql, target
from ridgeline.plans.projection import half_up_sql, haversine_sql, views
from ridgeline.plans.registry import query

C = F.col
_VALUES = {
    "park": "park_score",
    "shade": "shade_score",
    "safety": "safety_score",
    "scenery": "scenery_score",
    "novelty": "coalesce(novelty_score, scenery_score)",
    "traffic": "coalesce(traffic_exposure, 0.2e0)",
}
_W = "greatest(distance_m, 1e0)"
METRICS = f"""(SELECT route_id, {half_up_sql('sum(distance_m) / 1000', 1)} AS km, {half_up_sql('sum(greatest(elevation_gain_m, 0e0))')} AS gain_m, max(abs(slope)) AS max_slope, sum(distance_m) AS metres,
    {', '.join(f'CAST(sum(CAST(floor({v} * {_W} * 1000000 + 0.5e0) AS bigint)) AS bigint) / sum({_W}) / 1000000 AS {k}' for k, v in _VALUES.items())} FROM v_route_edge GROUP BY route_id)"""


def _edges(spark, sf_dir):
    return views(spark, sf_dir, "v_route_edge")[0]


@query(f"SELECT route_id, km, gain_m, max_slope, {', '.join(f'{half_up_sql(k, 5)} AS {k}' for k in _VALUES)} FROM {METRICS}")
def route_weighted_metrics(spark, sf_dir):
    m = routes.weighted_metrics(_edges(spark, sf_dir))
    return m.select("route_id", "km", "gain_m", "max_slope", *[half_up(C(k), 5).alias(k) for k in _VALUES])


OVERLAP = "(SELECT route_id, coalesce(sum(d) FILTER (WHERE n > 1), 0e0) / sum(d) AS overlap FROM (SELECT route_id, edge_key, count(*) AS n, sum(distance_m) AS d FROM v_route_edge GROUP BY route_id, edge_key) GROUP BY route_id)"


@query(f"SELECT route_id, {half_up_sql('overlap', 6)} AS overlap FROM {OVERLAP}")
def route_self_overlap(spark, sf_dir):
    return routes.self_overlap(_edges(spark, sf_dir)).select("route_id", half_up(C("overlap"), 6).alias("overlap"))


def _grouped(spark, sf_dir):
    """Routes of one customer form a group; an edge key is coarsened so that routes meet."""
    e, s = views(spark, sf_dir, "v_route_edge", "v_saved")
    return e.withColumn("edge_key", C("edge_key") % 200).join(s.select(C("route_key").alias("route_id"), C("user_id").alias("request_id")), "route_id")


GROUPED = "(SELECT e.route_id, e.seq, e.edge_key % 200 AS edge_key, e.distance_m, s.user_id AS request_id FROM v_route_edge e JOIN v_saved s ON s.route_key = e.route_id)"


@query(
    f"""WITH e AS {GROUPED}, f AS (SELECT request_id, min(route_id) AS route_id FROM e GROUP BY request_id),
        k AS (SELECT DISTINCT e.request_id, e.edge_key FROM e JOIN f ON f.request_id = e.request_id AND f.route_id = e.route_id)
        SELECT e.request_id, e.route_id, {half_up_sql('coalesce(sum(e.distance_m) FILTER (WHERE k.edge_key IS NOT NULL), 0e0) / sum(e.distance_m)', 6)} AS overlap
        FROM e LEFT JOIN k ON k.request_id = e.request_id AND k.edge_key = e.edge_key GROUP BY e.request_id, e.route_id"""
)
def route_reference_overlap(spark, sf_dir):
    e = _grouped(spark, sf_dir)
    first = e.groupBy("request_id").agg(F.min("route_id").alias("route_id"))
    found = routes.reference_overlap(e, e.join(first, ["request_id", "route_id"], "left_semi"))
    return found.select("request_id", "route_id", half_up(C("overlap"), 6).alias("overlap"))


PAIRS = f"""(SELECT a.request_id, a.route_id AS a, b.route_id AS b, sum(least(a.d, b.d)) AS shared_m FROM (SELECT request_id, route_id, edge_key, sum(distance_m) AS d FROM {GROUPED} GROUP BY ALL) a
    JOIN (SELECT request_id, route_id, edge_key, sum(distance_m) AS d FROM {GROUPED} GROUP BY ALL) b ON a.request_id = b.request_id AND a.edge_key = b.edge_key AND a.route_id < b.route_id GROUP BY ALL)"""


@query(f"SELECT request_id, a, b, shared_m FROM {PAIRS}")
def route_pair_overlap(spark, sf_dir):
    return routes.pair_overlap(_grouped(spark, sf_dir))


@query(
    f"""SELECT route_id, {', '.join(half_up_sql(f'CAST(sum(CAST(floor({c} * 10000000 + 0.5e0) AS bigint)) AS bigint) / count(*) / 10000000', 6) + f' AS {c}' for c in ('lat', 'lng'))},
        min(lat) AS south, min(lng) AS west, max(lat) AS north, max(lng) AS east FROM v_route_edge GROUP BY route_id"""
)
def route_centroid_box(spark, sf_dir):
    c = routes.centroids(_edges(spark, sf_dir))
    return c.select("route_id", half_up(C("lat"), 6).alias("lat"), half_up(C("lng"), 6).alias("lng"), "south", "west", "north", "east")


# -- scores

_PREF_COLUMNS = ("activity", "target_distance_km", "target_duration_min", "park_preference", "shade_preference", "elevation_preference", "safety_preference", "exploration_preference", "departure_time", "route_style")


def _scored(spark, sf_dir):
    e, s, p = views(spark, sf_dir, "v_route_edge", "v_saved", "v_pref")
    m = routes.weighted_metrics(e).join(routes.self_overlap(e), "route_id")
    m = m.join(s.select(C("route_key").alias("route_id"), C("user_id").alias("request_id")), "route_id").join(p.select("request_id", *_PREF_COLUMNS), "request_id")
    m = m.withColumn("target_km", target())
    pref = {c: C(c) for c in _PREF_COLUMNS}
    m = m.withColumns({k: half_up(v, 6) for k, v in scores.metric_scores({c: C(c) for c in m.columns}, pref).items()})
    return m.withColumn("total_score", scores.total_score({c: C(c) for c in m.columns}, pref))


def _clamped(x: str) -> str:
    return f"least(greatest({x}, 0e0), 100e0)"


_LATE, _DARK = "regexp_matches(lower(departure_time), 'afternoon|12:|13:|14:|15:')", "regexp_matches(lower(departure_time), 'night|late|22:|23:')"
_EP = normalized_sql("elevation_preference")
_BIKE = "activity = 'cycling'"
_ELEVATION = f"""CASE WHEN coalesce(route_style, '') = 'climbing' THEN 100 - abs(gain_m / greatest(km, 0.1e0) - CASE WHEN {_BIKE} THEN 14 + {_EP} * 12 ELSE 22 + {_EP} * 34 END) * 1.25e0
    - greatest(max_slope * 100 - CASE WHEN {_BIKE} THEN 8 ELSE 14 END, 0e0) * 4
    ELSE 100 - gain_m / greatest(km, 0.1e0) * CASE WHEN {_BIKE} THEN 1.2e0 ELSE 1.05e0 END * (0.65e0 + {_EP} * 0.75e0) - greatest(max_slope * 100 - CASE WHEN {_BIKE} THEN 7 ELSE 11 END, 0e0) * 3.5e0 END"""
_SCORES = {
    "distance_score": "100 - abs(km - target_km) / greatest(target_km, 0.1e0) * 160",
    "elevation_score": _ELEVATION,
    "park_score": "park * 100",
    "shade_score": f"shade * 100 - CASE WHEN {_LATE} THEN 8 ELSE 0 END * (1 - shade)",
    "safety_score": f"safety * 100 - CASE WHEN {_DARK} THEN 8 ELSE 0 END - traffic * 9",
    "exploration_score": "novelty * 70 + (1 - overlap) * 30",
    "scenery_score": "scenery * 100",
}
_WEIGHTS = {name: f"(CASE activity {' '.join(f'WHEN {chr(39)}{a}{chr(39)} THEN {w[i]}e0' for a, w in scores.WEIGHTS.items())} END" + (f" + {normalized_sql(f'{name}_preference')} * {scores.BUMPS[name]}e0)" if name in scores.BUMPS else ")") for i, name in enumerate(scores.SCORES)}
SCORED = f"""(SELECT *, {half_up_sql(f"({' + '.join(f'{w} * {n}_score' for n, w in _WEIGHTS.items())}) / ({' + '.join(_WEIGHTS.values())})")} AS total_score FROM
    (SELECT *, {', '.join(f'{half_up_sql(_clamped(v), 6)} AS {k}' for k, v in _SCORES.items())} FROM
    (SELECT m.*, o.overlap, p.*, {TARGET_SQL} AS target_km FROM {METRICS} m JOIN {OVERLAP} o ON o.route_id = m.route_id JOIN v_saved s ON s.route_key = m.route_id JOIN v_pref p ON p.request_id = s.user_id)))"""


@query(f"SELECT route_id, {', '.join(f'{half_up_sql(k, 4)} AS {k}' for k in _SCORES)} FROM {SCORED}")
def route_metric_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select("route_id", *[half_up(C(k), 4).alias(k) for k in _SCORES])


@query(f"SELECT route_id, total_score FROM {SCORED}")
def route_total_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("route_id", "total_score")


_EFFORT = "km * CASE WHEN activity = 'cycling' THEN 0.35e0 ELSE 1e0 END + gain_m / greatest(km, 0.1e0) * 0.18e0 + floor(max_slope * 1000 + 0.5e0) / 10e0 * 0.18e0"
DIFFICULTY = f"CASE WHEN {_EFFORT} > CASE WHEN activity = 'hiking' THEN 18 ELSE 13 END THEN 'Hard' WHEN {_EFFORT} > CASE WHEN activity = 'cycling' THEN 8 ELSE 7 END THEN 'Moderate' ELSE 'Easy' END"


@query(f"SELECT route_id, {DIFFICULTY} AS difficulty FROM {SCORED}")
def route_difficulty(spark, sf_dir):
    m = _scored(spark, sf_dir)
    return m.select("route_id", scores.difficulty(C("km"), C("gain_m"), half_up(C("max_slope") * 100, 1), C("activity")).alias("difficulty"))


_REASON = ", ".join(
    f"CASE WHEN {score} >= {least} THEN " + (f"CASE WHEN coalesce(route_style, '') = 'climbing' THEN '{scores.CLIMBING_REASON}' ELSE '{words}' END" if score == "elevation_score" else f"'{words}'") + " END"
    for score, least, words in scores.REASONS
)


@query(
    f"""SELECT route_id, CASE WHEN len(r) = 0 THEN 'Balances distance, safety, surface quality, and outdoor appeal for your ' || activity || '.'
        ELSE upper(array_to_string(r, ', ')[1]) || array_to_string(r, ', ')[2:] || CASE WHEN {_LATE} AND shade_score >= 65 THEN ' during your selected afternoon departure time' ELSE '' END || '.' END AS explanation
        FROM (SELECT *, list_filter([{_REASON}], lambda x: x IS NOT NULL)[1:4] AS r FROM {SCORED})"""
)
def route_explanation(spark, sf_dir):
    m = _scored(spark, sf_dir)
    return m.select("route_id", scores.explanation({c: C(c) for c in m.columns}, {c: C(c) for c in _PREF_COLUMNS}).alias("explanation"))


# -- loops

_POINTS = "(SELECT user_id AS route_id, seq, lat, lng, 20000e0 AS metres FROM v_track)"
_TURN = "fmod(degrees(atan2(sin(radians(lng - plng)) * cos(radians(lat)), cos(radians(plat)) * sin(radians(lat)) - sin(radians(plat)) * cos(radians(lat)) * cos(radians(lng - plng)))) + 360e0, 360e0)"
_FROM0 = "fmod(degrees(atan2(sin(radians(lng - lng0)) * cos(radians(lat)), cos(radians(lat0)) * sin(radians(lat)) - sin(radians(lat0)) * cos(radians(lat)) * cos(radians(lng - lng0)))) + 360e0, 360e0)"
_PTS = f"""(SELECT *, least(d, 360e0 - d) AS turn FROM (SELECT *, abs(towards - lag(towards) OVER w) AS d FROM (SELECT *, {_TURN} AS towards, {_FROM0} AS from0,
    CAST(floor((x * coalesce(lead(y) OVER w, 0e0) - coalesce(lead(x) OVER w, 0e0) * y) * 1000 + 0.5e0) AS bigint) AS cross_ FROM
    (SELECT *, (lng - lng0) * 111320e0 * cos(radians(lat0)) AS x, (lat - lat0) * 110540e0 AS y, lag(lat) OVER w AS plat, lag(lng) OVER w AS plng FROM
    (SELECT *, first_value(lat) OVER w AS lat0, first_value(lng) OVER w AS lng0 FROM {_POINTS} WINDOW w AS (PARTITION BY route_id ORDER BY seq))
    WINDOW w AS (PARTITION BY route_id ORDER BY seq)) WINDOW w AS (PARTITION BY route_id ORDER BY seq)) WINDOW w AS (PARTITION BY route_id ORDER BY seq)))"""
SHAPE = f"""(SELECT route_id, 4 * 3.141592653589793e0 * (abs(CAST(sum(cross_) AS bigint)) / 2000e0) / (max(metres) * max(metres)) AS compactness,
    count(DISTINCT CASE WHEN {haversine_sql('lat0', 'lng0', 'lat', 'lng')} >= 120 THEN floor(from0 / 45) END) / 8e0 AS coverage,
    count(*) FILTER (WHERE turn >= 155) / CAST(count(*) - 2 AS double) AS backtrack FROM {_PTS} GROUP BY route_id)"""


def _shape(spark, sf_dir):
    (t,) = views(spark, sf_dir, "v_track")
    return routes.loop_shape(t.select(C("user_id").alias("route_id"), "seq", "lat", "lng", num(20000).alias("metres")))


@query(f"SELECT route_id, {half_up_sql('compactness', 6)} AS compactness, coverage, {half_up_sql('backtrack', 6)} AS backtrack FROM {SHAPE}")
def loop_shape(spark, sf_dir):
    return _shape(spark, sf_dir).select("route_id", half_up(C("compactness"), 6).alias("compactness"), "coverage", half_up(C("backtrack"), 6).alias("backtrack"))


_EXTRA = "(route_id % 10) / 60e0"
_LOOP_SCORE = f"""{_clamped(half_up_sql(f"100 - {_EXTRA} * 60 - backtrack * 80 - (route_id % 2) * 25 - greatest(0.025e0 - compactness, 0e0) / 0.025e0 * 35 - greatest(1 + (route_id % 5) / 2e0 - 2, 0e0) * 15 - {_EXTRA} * 70 + coverage * 22"))}"""


@query(
    f"""SELECT route_id, {_LOOP_SCORE} AS score, {_EXTRA} <= 0.15 AND route_id % 2 = 0 AND compactness >= 0.025 AND backtrack <= 0.18 AND 1 + (route_id % 5) / 2e0 <= 2.8 AND {_EXTRA} <= 0.16 AS accepted,
        CASE WHEN route_id % 4 = 0 THEN 'Park Loop' WHEN route_id % 3 = 0 THEN CASE WHEN coverage >= 0.6 THEN 'Triangle Loop' ELSE 'Scenic Loop' END WHEN coverage >= 0.75 THEN 'City Loop'
             WHEN compactness >= 0.1 THEN 'Compact Loop' ELSE 'Balanced Loop' END AS name FROM {SHAPE}"""
)
def loop_score_name(spark, sf_dir):
    s = _shape(spark, sf_dir).withColumns(
        {"overlap": (C("route_id") % 10) / num(60), "spike": (C("route_id") % 10) / num(60), "dead_ends": C("route_id") % 2, "max_detour": num(1) + (C("route_id") % 5) / num(2)}
    )
    shape, run = {c: C(c) for c in s.columns}, F.lit("running")
    strategy, stops = F.when(C("route_id") % 4 == 0, F.lit("park")).otherwise(F.lit("direct")), F.when(C("route_id") % 3 == 0, F.lit(3)).otherwise(F.lit(2))
    return s.select(
        "route_id", scores.loop_score(shape, run).alias("score"), scores.loop_accepted(shape, run).alias("accepted"), scores.loop_name(strategy, stops, C("coverage"), C("compactness")).alias("name")
    )


@query(f"SELECT route_id, {half_up_sql('coalesce(sum(distance_m) FILTER (WHERE abs(slope) > 0.05e0 AND distance_m <= 700), 0e0) / sum(distance_m)', 6)} AS spike FROM v_route_edge GROUP BY route_id")
def loop_spike(spark, sf_dir):
    return routes.spike_share(_edges(spark, sf_dir), num(0.05)).select("route_id", half_up(C("spike"), 6).alias("spike"))


# -- ranking and selection

RANKED = f"(SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY total_score DESC, distance_score DESC, abs(gain_m), route_id) AS place FROM {SCORED})"


@query(f"SELECT request_id, route_id, place FROM {RANKED}")
def rank_routes(spark, sf_dir):
    return routes.rank_routes(_scored(spark, sf_dir).withColumn("ord", C("route_id"))).select("request_id", "route_id", "place")


POOLED = f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY fits DESC, CASE WHEN fits THEN 0e0 ELSE abs(km - target_km) END, route_id) AS pk, count(*) FILTER (WHERE fits) OVER (PARTITION BY request_id) AS nf FROM
    (SELECT *, abs(km - target_km) / target_km <= greatest(0.08e0, 0.35e0 / sqrt(greatest(target_km, 0.1e0))) AS fits FROM {SCORED})) WHERE CASE WHEN nf >= 3 THEN fits ELSE pk <= 8 END)"""


def _pool(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return routes.pool(s.withColumns({"ord": C("route_id"), "tolerance": geo.tolerance(C("target_km"))}))


@query(f"SELECT request_id, route_id, fits FROM {POOLED}")
def select_pool(spark, sf_dir):
    return _pool(spark, sf_dir).select("request_id", "route_id", "fits")


@query(
    f"""WITH RECURSIVE p AS MATERIALIZED (SELECT request_id, route_id, km, row_number() OVER (PARTITION BY request_id ORDER BY total_score DESC, distance_score DESC, abs(gain_m), route_id) AS place FROM {POOLED}),
        c AS MATERIALIZED (SELECT o.request_id, o.a, o.b FROM {PAIRS} o JOIN p x ON x.request_id = o.request_id AND x.route_id = o.a JOIN p y ON y.request_id = o.request_id AND y.route_id = o.b
             WHERE least(x.km, y.km) > 0 AND o.shared_m / (least(x.km, y.km) * 1000) > 0.05e0),
        h AS MATERIALIZED (SELECT request_id, r, list(w) AS hits FROM (SELECT request_id, a AS r, b AS w FROM c UNION ALL SELECT request_id, b, a FROM c) GROUP BY ALL),
        f AS (SELECT DISTINCT request_id, CAST(0 AS bigint) AS place, CAST([] AS bigint[]) AS kept FROM p
              UNION ALL SELECT f.request_id, f.place + 1, CASE WHEN len(kept) < 3 AND NOT list_has_any(kept, coalesce(h.hits, CAST([] AS bigint[]))) THEN list_append(kept, p.route_id) ELSE kept END
              FROM f JOIN p ON p.request_id = f.request_id AND p.place = f.place + 1 LEFT JOIN h ON h.request_id = p.request_id AND h.r = p.route_id)
        SELECT request_id, unnest(kept) AS route_id, CAST(generate_subscripts(kept, 1) AS bigint) AS slot FROM (SELECT request_id, max_by(kept, place) AS kept FROM f GROUP BY request_id)"""
)
def greedy_diverse(spark, sf_dir):
    ranked = routes.rank_routes(_pool(spark, sf_dir)).select("request_id", "route_id", "place", "km")
    o = routes.pair_overlap(_grouped(spark, sf_dir))
    a = ranked.select("request_id", C("route_id").alias("a"), C("km").alias("ka"))
    b = ranked.select("request_id", C("route_id").alias("b"), C("km").alias("kb"))
    shorter = F.least("ka", "kb")
    conflicts = o.join(a, ["request_id", "a"]).join(b, ["request_id", "b"]).where((shorter > 0) & (C("shared_m") / (shorter * 1000) > 0.05))
    return routes.greedy_diverse(ranked, conflicts)
