"""Queries over payloads, segments, recorded elevations, and the smaller pieces of a request."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridgeline.cluster import stored
from ridgeline.functions import client, geo
from ridgeline.functions.geo import half_up, num
from ridgeline.functions.text import linestring_geojson
from ridgeline.operators import graph, payloads, profiles, routes, store
from ridgeline.plans.graph_queries import PAIRS_SQL, QUALITY, REQUESTS, TOP, TRIPLES_SQL, by_place, one_request, requests
from ridgeline.plans.profile_queries import PROFILE
from ridgeline.plans.projection import half_up_sql, haversine_sql, views
from ridgeline.plans.registry import query
from ridgeline.plans.route_queries import METRICS
from ridgeline.sources import elevations, synthetic

C = F.col

# -- payloads

_TEXTS = {"id": "id", "source": "source", "name": "name", "activity": "activity"}
_NUMBER = "('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT')"


def _fails(field: str, required: bool = True) -> str:
    kind = f"json_type(j, '$.{field}')"
    text = f"WHEN {kind} IS NOT NULL AND {kind} NOT IN ('NULL', 'VARCHAR') THEN '{field}{payloads.NO_STRING}'"
    return text + (f" WHEN coalesce({kind}, 'NULL') = 'NULL' OR trim(j ->> '$.{field}') = '' THEN '{field}{payloads.NO_VALUE}'" if required else "")


def _point_fails(p: str) -> str:
    parts = [f"WHEN json_type(j, '{p}') <> 'OBJECT' THEN '{payloads.NO_POINT}'"]
    for field, most in payloads.RANGES.items():
        parts.append(f"WHEN coalesce(json_type(j, '{p}.{field}'), 'NULL') NOT IN {_NUMBER} THEN '{payloads.NO_COORDINATE.format(field)}'")
        parts.append(f"WHEN abs(CAST(j ->> '{p}.{field}' AS double)) > {most} THEN '{payloads.BAD_COORDINATE.format(field)}'")
    return " ".join(parts)


_ERROR = f"""CASE WHEN j IS NULL THEN '{payloads.NO_JSON}' WHEN json_type(j) <> 'OBJECT' THEN '{payloads.NO_OBJECT}'
    WHEN coalesce(json_type(j, '$.savedAt'), 'NULL') <> 'NULL' AND NOT (json_type(j, '$.savedAt') = 'VARCHAR' AND regexp_matches(j ->> '$.savedAt', '{payloads.INSTANT}')) THEN '{payloads.NO_TIME}'
    {' '.join(_fails(f) for f in _TEXTS)} {_fails('routeType', False)}
    {' '.join(f"WHEN coalesce(json_type(j, '$.{f}'), 'NULL') NOT IN {_NUMBER} THEN '{f}{payloads.NO_NUMBER}'" for f in ('distanceKm', 'estimatedDurationMin', 'elevationGainM'))}
    WHEN coalesce(json_type(j, '$.geometry'), 'NULL') <> 'ARRAY' OR json_array_length(j, '$.geometry') < 2 THEN '{payloads.FEW_POINTS}'
    {_point_fails('$.geometry[0]')} {_point_fails('$.geometry[1]')} END"""


@query(
    f"""SELECT route_key, error, CASE WHEN error IS NULL THEN j ->> '$.id' END AS id, CASE WHEN error IS NULL THEN j ->> '$.routeType' END AS route_type,
        CASE WHEN error IS NULL THEN CAST(j ->> '$.distanceKm' AS double) END AS km, CASE WHEN error IS NULL THEN CAST(j ->> '$.estimatedDurationMin' AS int) END AS minutes,
        CASE WHEN error IS NULL THEN (j ->> '$.savedAt') IS NOT NULL END AS saved, CASE WHEN error IS NULL THEN '{{"type":"LineString","coordinates":[[-105.5,40.25],[-105.25,40.5]]}}' END AS line
        FROM (SELECT *, {_ERROR} AS error FROM (SELECT route_key, CASE WHEN json_valid(payload) THEN payload END AS j FROM v_payload))"""
)
def read_payloads(spark, sf_dir):
    """Stored payloads with their fields or the first rule that they break."""
    (p,) = views(spark, sf_dir, "v_payload")
    found = payloads.read_routes(p)
    line = F.when(C("error").isNull(), linestring_geojson(C("geometry")))
    return found.select("route_key", "error", "id", "route_type", C("distance_km").alias("km"), "minutes", F.when(C("error").isNull(), C("saved_at").isNotNull()).alias("saved"), line.alias("line"))


@query(
    """SELECT route_key, CASE WHEN route_key % 5 <> 0 THEN concat('New ', CAST(route_key AS varchar)) END AS name, CASE WHEN route_key % 5 <> 0 AND route_key % 3 <> 0 THEN concat('note ', CAST(route_key % 9 AS varchar)) END AS notes,
       CASE WHEN route_key % 5 <> 0 THEN j ->> '$.id' END AS id, CASE WHEN route_key % 5 <> 0 THEN CAST(len(json_keys(j)) + 1 AS int) END AS members
       FROM (SELECT route_key, CASE WHEN json_valid(payload) THEN payload END AS j FROM v_payload) WHERE json_type(j) = 'OBJECT'"""
)
def rename_payloads(spark, sf_dir):
    """Payloads under a new name and new notes; a blank name is refused."""
    (p,) = views(spark, sf_dir, "v_payload")
    objects = p.where(F.schema_of_variant(F.try_parse_json("payload")).startswith("OBJECT"))
    name = F.when(C("route_key") % 5 != 0, F.concat(F.lit("  New "), C("route_key").cast("string"), F.lit(" "))).otherwise(F.lit("  "))
    notes = F.when(C("route_key") % 3 != 0, F.concat(F.lit("note "), (C("route_key") % 9).cast("string")))
    merged = objects.withColumn("merged", payloads.renamed(C("payload"), name, notes))
    member = lambda k: F.get_json_object("merged", f"$.{k}").alias(k)
    return merged.select("route_key", member("name"), member("notes"), member("id"), F.size(F.json_object_keys("merged")).alias("members"))


@query(
    """WITH c AS (SELECT s.*, row_number() OVER (PARTITION BY s.user_id ORDER BY s.saved_at DESC, s.id) AS place FROM v_saved s),
       d AS (SELECT p.request_id, route_key % 11 AS id, route_key % 9 <> 0 AND route_key % 17 <> 0 AND route_key % 13 <> 0 AS sound FROM c JOIN v_pref p ON p.request_id = c.user_id WHERE place <= 1 + user_id % 4),
       g AS (SELECT request_id, count(*) <= 3 AND count(DISTINCT id) = count(*) AND bool_and(sound) AS ok FROM d GROUP BY request_id)
       SELECT p.request_id, coalesce(g.ok, false) AS ok FROM v_pref p LEFT JOIN g ON g.request_id = p.request_id"""
)
def candidate_envelopes(spark, sf_dir):
    """Which answers to a request are sound."""
    s, p = views(spark, sf_dir, "v_saved", "v_pref")
    s = store.latest_by_user(s, 4).where(C("place") <= 1 + C("user_id") % 4).withColumnRenamed("user_id", "request_id").join(p.select("request_id", "activity", "route_type"), "request_id")
    k, point = C("route_key"), lambda lat: F.struct(lat.alias("lat"), num(-105).alias("lng"))
    given = s.select(
        "request_id", (k % 11).cast("string").alias("id"), F.lit("x").alias("name"), F.lit("generated").alias("source"), F.when(k % 9 == 0, F.lit("flying")).otherwise(C("activity")).alias("activity"), "route_type",
        F.array(point(num(40)), point(F.when(k % 17 == 0, num(95)).otherwise(num(41)))).alias("geometry"), F.when(k % 13 == 0, num(float("nan"))).otherwise(C("distance_km")).alias("km"),
    )
    return payloads.valid_envelopes(given, p)


# -- segments, filters, counts

_KMD = "111.32e0"
_SEG = f"""(SELECT r.request_id, t.user_id, least(greatest(-(ax * (bx - ax) + ay * (by_ - ay)) / nullif((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay), 0e0), 0e0), 1e0) AS u, ax, ay, bx, by_, r.lat AS rlat, r.lng AS rlng, t.lat, t.lng FROM {REQUESTS} r,
    (SELECT *, lead(lat) OVER w AS lat2, lead(lng) OVER w AS lng2 FROM v_track WINDOW w AS (PARTITION BY user_id ORDER BY seq)) t,
    LATERAL (SELECT (t.lng - r.lng) * ({_KMD} * cos(radians(r.lat))) AS ax, (t.lat - r.lat) * {_KMD} AS ay, (t.lng2 - r.lng) * ({_KMD} * cos(radians(r.lat))) AS bx, (t.lat2 - r.lat) * {_KMD} AS by_) WHERE t.lat2 IS NOT NULL)"""
_SEG_KM = f"CASE WHEN u IS NULL THEN {haversine_sql('rlat', 'rlng', 'lat', 'lng')} / 1000 ELSE sqrt((ax + (bx - ax) * u) * (ax + (bx - ax) * u) + (ay + (by_ - ay) * u) * (ay + (by_ - ay) * u)) END"


@query(
    f"""SELECT request_id, user_id AS segment_id, km, rank FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY km, user_id) AS rank FROM
        (SELECT request_id, user_id, {half_up_sql('min(d)', 6)} AS km FROM (SELECT *, {_SEG_KM} AS d FROM {_SEG}) WHERE d <= 0.15e0 GROUP BY request_id, user_id)) WHERE rank <= 4"""
)
def nearby_segments(spark, sf_dir):
    """The four segments nearest to each request within 150 m; users' tracks stand for segments."""
    (t,) = views(spark, sf_dir, "v_track")
    lines = t.groupBy(C("user_id").alias("segment_id")).agg(F.array_sort(F.collect_list(F.struct("seq", "lat", "lng"))).alias("geometry"))
    return store.nearby_segments(requests(spark, sf_dir), lines, 0.15, 4)


@query("SELECT request_id, activity FROM v_pref WHERE activity = 'hiking'")
def activity_filter(spark, sf_dir):
    (p,) = views(spark, sf_dir, "v_pref")
    return store.of_activity(store.of_activity(p, "all"), "hiking").select("request_id", "activity")


@query("SELECT route_key, 100e0 AS distance_score FROM v_saved")
def imported_targets(spark, sf_dir):
    """Imported routes aim at their own length, so their distance score is full."""
    (s,) = views(spark, sf_dir, "v_saved")
    r = store.as_imported(s.withColumn("km", C("distance_km")))
    found = client.imported_scores(C("km"), C("target_km"), num(0), F.lit("running"), F.lit(""), {})
    return r.select("route_key", found["distance_score"].alias("distance_score"))


@query("SELECT 'saved' AS name, count(*) AS rows FROM v_saved UNION ALL SELECT 'share', count(*) FROM v_share UNION ALL SELECT 'track', count(*) FROM v_track")
def table_counts(spark, sf_dir):
    saved, share, track = views(spark, sf_dir, "v_saved", "v_share", "v_track")
    return store.row_counts({"saved": saved, "share": share, "track": track})


# -- waypoints and paths

_END = ("r.lat + 0.0031e0", "r.lng - 0.0017e0")


def _ends(spark, sf_dir):
    return requests(spark, sf_dir).select("request_id", (C("lat") + num(0.0031)).alias("lat"), (C("lng") - num(0.0017)).alias("lng"))


@query(
    f"""SELECT request_id, concat('end-link-', CAST(k - 1 AS varchar)) AS id, node_id, {half_up_sql('metres')} AS distance_m FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY metres, node_id) AS k FROM
        (SELECT r.request_id, n.node_id, {half_up_sql(haversine_sql(*(f'({x})' for x in _END), 'n.lat', 'n.lng'), 3)} AS metres FROM {REQUESTS} r CROSS JOIN v_node n)) WHERE k <= 4"""
)
def end_links(spark, sf_dir):
    """Every request's end tied to the four nearest nodes."""
    (n,) = views(spark, sf_dir, "v_node")
    return graph.end_links(_ends(spark, sf_dir), n)


_AWAY = haversine_sql(*(f"({x})" for x in _END), "n.lat", "n.lng")


@query(
    f"""SELECT request_id, best.node_id AS node_id, {half_up_sql('best.score', 6)} AS score FROM (SELECT request_id, max(struct_pack(score := quality - metres / 350e0 * 0.1e0, minus := -node_id, node_id := node_id)) AS best FROM
        (SELECT r.request_id, n.node_id, q.quality, {_AWAY} AS metres FROM {REQUESTS} r CROSS JOIN v_node n JOIN {QUALITY} q ON q.node_id = n.node_id WHERE q.degree >= 2 AND (r.request_id + n.node_id) % 5 <> 0)
        WHERE metres <= 350 GROUP BY request_id)"""
)
def pick_nodes(spark, sf_dir):
    """The best node near each request's end, some nodes excluded."""
    n, e = views(spark, sf_dir, "v_node", "v_edge")
    directed = graph.both_ways(e)
    good = graph.node_qualities(directed, one_request()).join(graph.node_degree(directed).where("degree >= 2"), "node_id").select("node_id", "quality")
    ends = _ends(spark, sf_dir)
    near = graph.near_join(ends, n.select("node_id", C("lat").alias("to_lat"), C("lng").alias("to_lng")), 350)
    excluded = near.where((C("request_id") + C("node_id")) % 5 == 0).select("request_id", "node_id")
    return graph.pick(ends, n.join(good, "node_id"), excluded, "request_id", 350).select("request_id", "node_id", half_up(C("score"), 6).alias("score"))


_SETS = f"t AS MATERIALIZED {TOP}, {PAIRS_SQL}, {TRIPLES_SQL}, sets AS (SELECT request_id, a, b, CAST(NULL AS bigint) AS c, strategy, tier, 0 AS kind FROM pairs UNION ALL SELECT request_id, a, b, c, 'park', tier, 1 FROM triples)"


def _sets(top):
    return graph.waypoint_order(graph.sector_pairs(top), graph.sector_triples(top))


@query(f"WITH {_SETS} SELECT request_id, a, b, c, strategy, tier, row_number() OVER (PARTITION BY request_id ORDER BY tier, kind, a, b, c NULLS FIRST) AS place FROM sets")
def waypoint_order(spark, sf_dir):
    return by_place(spark, sf_dir, _sets)


@query(
    f"""WITH {_SETS}, f AS (SELECT *, (a + b) % 3 = 0 AS fits FROM sets), n AS (SELECT request_id, tier, count(*) FILTER (WHERE fits) AS n FROM f GROUP BY ALL),
        u AS (SELECT *, sum(n) OVER (PARTITION BY request_id ORDER BY tier) AS upto FROM n), s AS (SELECT request_id, min(tier) AS stop FROM u WHERE tier >= 2 AND upto >= 8 GROUP BY request_id)
        SELECT f.request_id, f.a, f.b, f.c, f.tier FROM f LEFT JOIN s ON s.request_id = f.request_id WHERE s.stop IS NULL OR f.tier <= s.stop"""
)
def tiers_until_enough(spark, sf_dir):
    """Waypoint sets up to the tier at which a request has eight that fit."""
    enough = lambda top: routes.until_enough(stored(_sets(top).withColumn("fits", (C("a") + C("b")) % 3 == 0), "waypoint-sets"))
    return by_place(spark, sf_dir, lambda top: enough(top).select("request_id", "a", "b", "c", "tier"))


@query(
    """WITH p AS (SELECT route_id % 40 AS request_id, route_id, list(edge_key % 3 ORDER BY seq) AS signature FROM v_route_edge WHERE seq <= 3 GROUP BY route_id)
       SELECT request_id, min(route_id) AS route_id FROM p GROUP BY request_id, signature"""
)
def distinct_paths(spark, sf_dir):
    (e,) = views(spark, sf_dir, "v_route_edge")
    e = e.where("seq <= 3").withColumns({"request_id": C("route_id") % 40, "edge_key": C("edge_key") % 3})
    return routes.distinct_paths(e)


# -- elevations

_STATS = f"""(SELECT route_id, sum(greatest(step, 0e0)) AS up, sum(greatest(-step, 0e0)) AS down, min(elev) AS low, max(elev) AS high FROM
    (SELECT route_id, elev, coalesce(elev - lag(elev) OVER (PARTITION BY route_id ORDER BY seq), 0e0) AS step FROM {PROFILE}) WHERE route_id % 3 <> 0 GROUP BY route_id)"""


@query(
    f"""SELECT m.route_id, m.km, coalesce(s.up, m.gain_m) AS gain_m, coalesce(s.down, 0e0) AS descent_m, CASE WHEN s.up IS NULL THEN 1.5e0 WHEN m.km > 0 THEN {half_up_sql('s.up / (m.km * 1000) * 1000')} / 10 ELSE 1.5e0 END AS slope_pct,
        s.high - s.low AS span_m, 'Hard' AS difficulty FROM {METRICS} m LEFT JOIN {_STATS} s ON s.route_id = m.route_id"""
)
def enriched_routes(spark, sf_dir):
    """Routes with their profile's figures; every third has no profile and stays as it is."""
    from ridgeline.plans.profile_queries import _profile
    from ridgeline.plans.route_queries import _edges
    from pyspark.sql import Window

    step = C("elev") - F.lag("elev").over(Window.partitionBy("route_id").orderBy("seq"))
    p = _profile(spark, sf_dir).where("route_id % 3 <> 0").withColumn("step", F.coalesce(step, num(0)))
    stats = p.groupBy("route_id").agg(F.sum(F.greatest("step", num(0))).alias("gain_m"), F.sum(F.greatest(-C("step"), num(0))).alias("descent_m"), F.min("elev").alias("low_m"), F.max("elev").alias("high_m"))
    none = F.lit(None).cast("double")
    r = routes.weighted_metrics(_edges(spark, sf_dir)).select("route_id", "km", "gain_m").withColumns({"descent_m": num(0), "low_m": none, "high_m": none, "slope_pct": num(1.5), "difficulty": F.lit("Hard")})
    return profiles.enriched(r, stats).select("route_id", "km", "gain_m", "descent_m", "slope_pct", "span_m", "difficulty")


def _batched(spark, sf_dir, service):
    (t,) = views(spark, sf_dir, "v_track")
    return elevations.batches(t.withColumn("place", C("seq")), service, "user_id")


@query(
    """SELECT user_id, (seq - 1) // 100 AS batch, count(*) AS points, md5(concat('latitude=', string_agg(printf('%.6f', lat), ',' ORDER BY seq), '&longitude=', string_agg(printf('%.6f', lng), ',' ORDER BY seq))) AS body
       FROM v_track GROUP BY user_id, (seq - 1) // 100"""
)
def elevation_batches(spark, sf_dir):
    """What the elevation service is asked, a hundred points at a time."""
    batched = _batched(spark, sf_dir, "open-meteo")
    sizes = batched.groupBy("user_id", "batch").agg(F.count("*").alias("points"))
    return sizes.join(elevations.batch_bodies(batched, "open-meteo", "user_id"), ["user_id", "batch"]).withColumn("body", F.md5("body"))


@query("SELECT user_id, seq, CASE WHEN (seq - 1) // 200 % 2 = 0 THEN elev END AS elev FROM v_track")
def elevation_answers(spark, sf_dir):
    """Recorded answers read back; every second batch failed."""
    batched = _batched(spark, sf_dir, "open-elevation")
    results = F.transform(F.array_sort(F.collect_list(F.struct("at", F.struct(F.col("elev").alias("elevation")).alias("r")))), lambda x: x["r"])
    answers = batched.groupBy("user_id", "batch").agg(results.alias("results"))
    answer = F.when(C("batch") % 2 == 0, F.to_json(F.struct("results"), {"ignoreNullFields": "false"})).otherwise(F.lit("<html>busy</html>"))
    return elevations.elevated(batched.drop("elev"), answers.select("user_id", "batch", answer.alias("answer")), "open-elevation", "user_id").select("user_id", "seq", "elev")


_BEARING = "fmod(degrees(atan2(sin(radians(lng2 - lng1)) * cos(radians(lat2)), cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lng2 - lng1)))) + 360e0, 360e0)"


@query(f"SELECT edge_id, {half_up_sql(f'distance_m * (cos(radians({_BEARING})) * 0.018e0 + sin(radians({_BEARING})) * 0.01e0)', 4)} AS gain FROM v_edge")
def estimated_gains(spark, sf_dir):
    """Gains of edges without elevations, by their direction."""
    (e,) = views(spark, sf_dir, "v_edge")
    towards = geo.bearing(C("lat1"), C("lng1"), C("lat2"), C("lng2"))
    return e.select("edge_id", half_up(synthetic.uphill_bias(C("distance_m"), towards), 4).alias("gain"))


@query(f"SELECT route_id, CASE WHEN km > 0 THEN {half_up_sql('gain_m / (km * 1000) * 100', 1)} END AS slope_pct FROM {METRICS}")
def average_slopes(spark, sf_dir):
    from ridgeline.plans.route_queries import _edges

    m = routes.weighted_metrics(_edges(spark, sf_dir))
    return m.select("route_id", profiles.average_slope_pct(C("gain_m"), C("km") * 1000).alias("slope_pct"))


@query(
    """WITH e AS (SELECT row_number() OVER (ORDER BY s, k) - 1 AS edge_id, s AS src, CASE k WHEN 0 THEN s + 1 ELSE s + 90 END AS dst FROM range(8100) g(s) CROSS JOIN range(2) h(k) WHERE CASE k WHEN 0 THEN (s + 1) % 90 <> 0 ELSE s + 90 < 8100 END),
       c AS (SELECT n AS edge_limit, m AS every FROM (SELECT unnest([10000, 14000]) AS n) CROSS JOIN (SELECT unnest([1, 7]) AS m))
       SELECT CAST(edge_limit AS int) AS edge_limit, CAST(every AS int) AS every, count(*) AS edges, CAST(sum(src) AS bigint) AS src, CAST(sum(dst) AS bigint) AS dst, max(edge_id) AS last FROM e JOIN c ON edge_id < edge_limit AND edge_id % every = 0 GROUP BY ALL"""
)
def stress_grids(spark, sf_dir):
    """The grids of the stress cases: dense and sparse, at both edge limits."""
    found = None
    for limit in (10000, 14000):
        for every in (1, 7):
            e = synthetic.grid(spark, 90, limit, every)
            part = e.agg(F.count("*").alias("edges"), F.sum("src").alias("src"), F.sum("dst").alias("dst"), F.max("edge_id").alias("last")).select(F.lit(limit).alias("edge_limit"), F.lit(every).alias("every"), "*")
            found = part if found is None else found.unionByName(part)
    return found
