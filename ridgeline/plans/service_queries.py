"""Queries over the service's edges: map scans, elevation providers, caches, sinks, address search, outcomes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ridgeline.cluster import shared_dir, spread, stored
from ridgeline.functions import client, text
from ridgeline.functions.geo import num
from ridgeline.operators import cache, places
from ridgeline.operators import requests as asks
from ridgeline.operators.payloads import read_routes
from ridgeline.plans.projection import half_up_sql, haversine_sql, views
from ridgeline.plans.registry import query
from ridgeline.plans.request_queries import _ERROR, _fails
from ridgeline.sources import elevations, map_scan, segments, sinks
from ridgeline.sources.elevations import Provider

C = F.col

# -- map scan

SIDE = 0.02
_TILE = "concat(CAST(CAST(floor(lat / 0.02e0) AS bigint) AS varchar), '_', CAST(CAST(floor(lng / 0.02e0) AS bigint) AS varchar))"
_MATCH = {tag: ", ".join(f"'{v}'" for v in values) for tag, values in map_scan.SELECTORS.items()}


def recorded_mirrors(spark, sf_dir):
    """Two mirrors recorded from the ways: the first knows every second row of tiles only. (mirrors, box)"""
    t, n = views(spark, sf_dir, "v_tag", "v_node")
    place = F.struct("lat", C("lng").alias("lon"))
    tags = F.map_filter(F.create_map(*[x for k in map_scan.SELECTORS for x in (F.lit(k), C(k) if k in t.columns else F.lit(None).cast("string"))]), lambda k, v: v.isNotNull())
    tile = lambda c: F.floor(C(c) / num(SIDE)).cast("string")
    way = F.struct(F.lit("way").alias("type"), C("way_id").alias("id"), F.array("way_id").alias("nodes"), F.array(place).alias("geometry"), tags.alias("tags"))
    rows = t.join(n.select(C("node_id").alias("way_id"), "lat", "lng"), "way_id").select(F.floor(C("lat") / num(SIDE)).alias("row"), F.concat(tile("lat"), F.lit("_"), tile("lng")).alias("tile"), way.alias("way"))
    answers = stored(rows.groupBy("row", "tile").agg(F.to_json(F.struct(F.collect_list("way").alias("elements"))).alias("json")), "answers")
    mirrors = [f"{shared_dir(spark)}/mirror-{uuid.uuid4().hex}" for _ in range(2)]
    map_scan.record_answers(answers.where("row % 2 = 0"), mirrors[0])
    map_scan.record_answers(answers, mirrors[1])
    top = n.agg(F.min("lat"), F.min("lng"), F.max("lat"), F.max("lng")).first()
    return mirrors, (top[0], top[1], top[2] + 1e-6, top[3] + 1e-6)


@query(
    f"""SELECT tile, selector, value, CAST(way_id AS bigint) AS way_id, CASE WHEN floor(lat / 0.02e0) % 2 = 0 THEN 0 ELSE 1 END AS mirror FROM (SELECT t.way_id, n.lat, {_TILE} AS tile,
        CASE WHEN t.highway IN ({_MATCH['highway']}) THEN 'highway' WHEN t.leisure IN ({_MATCH['leisure']}) THEN 'leisure' WHEN t."natural" IN ({_MATCH['natural']}) THEN 'natural' END AS selector,
        CASE WHEN t.highway IN ({_MATCH['highway']}) THEN t.highway WHEN t.leisure IN ({_MATCH['leisure']}) THEN t.leisure WHEN t."natural" IN ({_MATCH['natural']}) THEN t."natural" END AS value
        FROM v_tag t JOIN v_node n ON n.node_id = t.way_id) WHERE selector IN ('highway', 'leisure') AND value IN ('path', 'footway', 'primary', 'park')"""
)
def map_tile_scan(spark, sf_dir):
    """Ways of some tags, scanned tile by tile; where the first mirror fails the second answers."""
    mirrors, box = recorded_mirrors(spark, sf_dir)
    found = map_scan.scan_map(spark, mirrors, *box, side=SIDE).where(C("selector").isin("highway", "leisure") & C("value").isin("path", "footway", "primary", "park"))
    return found.select("tile", "selector", "value", F.get_json_object("element", "$.id").cast("long").alias("way_id"), "mirror")


# -- elevation providers


def _fails_first(body, seconds):
    """A service that leaves out some points and breaks down at some batches."""
    lats, lngs = (part.split("=")[1].split(",") for part in body.split("&"))
    if lats[0][-3] == "2":
        raise RuntimeError("busy")
    return '{"elevation": [' + ", ".join("null" if b[-3] == "5" else a[-5:].lstrip("0") or "0" for a, b in zip(lats, lngs)) + "]}"


def _knows_most(body, seconds):
    """A service that gives every elevation but those of one kind of point."""
    import json

    found = [{"elevation": None if f"{p['longitude']:.6f}"[-3] == "5" and f"{p['latitude']:.6f}"[-3] == "4" else -float(f"{p['latitude']:.6f}"[-4:])} for p in json.loads(body)["locations"]]
    return json.dumps({"results": found})


_LAT, _LNG = "printf('%.6f', lat)", "printf('%.6f', lng)"


@query(
    f"""WITH u AS (SELECT user_id, min(seq) AS seq, {_LAT} AS a, {_LNG} AS b FROM v_track GROUP BY user_id, {_LAT}, {_LNG}),
        k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) - 1 AS k FROM u QUALIFY k < 800),
        f AS (SELECT user_id, min(k // 100) AS broken FROM k WHERE k % 100 = 0 AND a[-3] = '2' GROUP BY user_id),
        p AS (SELECT k.*, CASE WHEN k.k // 100 < coalesce(f.broken, 99) AND b[-3] <> '5' THEN CAST(a[-5:] AS double) END AS one FROM k LEFT JOIN f USING (user_id))
        SELECT user_id, CAST(seq AS bigint) AS place, CASE WHEN one IS NOT NULL THEN one WHEN NOT (b[-3] = '5' AND a[-3] = '4') THEN -CAST(a[-4:] AS double) END AS elev,
          CASE WHEN one IS NOT NULL THEN 'open-meteo' WHEN NOT (b[-3] = '5' AND a[-3] = '4') THEN 'open-elevation' END AS service FROM p"""
)
def elevation_chain(spark, sf_dir):
    """Elevations of track points from two services; the second is asked for what the first left."""
    (t,) = views(spark, sf_dir, "v_track")
    chain = [Provider("open-meteo", _fails_first), Provider("open-elevation", _knows_most)]
    found = elevations.look_up(t.select("user_id", C("seq").alias("place"), "lat", "lng"), chain, budget_ms=10**9, key="user_id")
    return found.select("user_id", "place", "elev", "service")


# -- caches

_LOG = "(SELECT user_id AS instance, event_id AS request_id, concat(event_type, CAST(event_id % 7 AS varchar)) AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"


def _replay_sql(name: str, entries: int, memory_s: int, stored_s: int | None, clear: bool) -> str:
    """A recursive table that folds every instance's requests: m (memory entries) and t (stored ones), each with its end."""
    now = "(l.n * 30)"
    hit = f"len(list_filter(f.m, lambda x: x.k = l.key AND x.e > {now})) > 0"
    kept = f"len(list_filter(f.t, lambda x: x.k = l.key AND x.e > {now})) > 0" if stored_s is not None else "false"
    # only the "oldest" policy drops expired entries, and the entry of the key itself, before it counts
    live = "list_filter(f.m, lambda x: x.k <> l.key)" if clear else f"list_filter(f.m, lambda x: x.e > {now})"
    size = "len(f.m)" if clear else f"len({live})"
    room = f"CASE WHEN {size} < {entries} THEN {live} " + ("ELSE [] END" if clear else f"ELSE {live}[{size} - {entries} + 2:] END")
    gone = f"CASE WHEN {size} < {entries} THEN 0 ELSE " + (size if clear else f"{size} - {entries} + 1") + " END"
    none = "CAST([] AS struct(k varchar, e bigint)[])"
    stored_ = f"CASE WHEN hit OR kept THEN f.t ELSE list_append(list_filter(f.t, lambda x: x.e > {now}), {{'k': l.key, 'e': {now} + {stored_s or 0}}}) END" if stored_s is not None else "f.t"
    step = f"SELECT f.*, l.request_id AS next_id, l.key AS key, l.n AS next_n, {hit} AS hit, {kept} AS kept FROM {name} f JOIN log l ON l.instance = f.instance AND l.n = f.n + 1"
    return f"""{name}(instance, n, request_id, m, t, outcome, evicted) AS (
        SELECT DISTINCT instance, CAST(0 AS bigint), CAST(NULL AS bigint), {none}, {none}, CAST(NULL AS varchar), CAST(0 AS bigint) FROM log
        UNION ALL SELECT f.instance, f.next_n, f.next_id, CASE WHEN hit THEN f.m ELSE list_append({room.replace('l.n', 'f.next_n').replace('l.key', 'f.key')}, {{'k': f.key, 'e': f.next_n * 30 + {memory_s}}}) END,
          {stored_.replace('l.n', 'f.next_n').replace('l.key', 'f.key')}, CASE WHEN hit THEN 'memory_hit' WHEN kept THEN 'stored_hit' ELSE 'miss' END, CAST(CASE WHEN hit THEN 0 ELSE {gone.replace('l.n', 'f.next_n').replace('l.key', 'f.key')} END AS bigint)
        FROM ({step}) f)"""


@query(
    f"""WITH RECURSIVE log AS MATERIALIZED (SELECT * FROM {_LOG}), {_replay_sql('a', 5, 300, 900, False)}, {_replay_sql('b', 6, 450, None, True)}
        SELECT a.instance, a.request_id, a.outcome, a.evicted, b.outcome AS user_outcome, b.evicted AS user_evicted FROM a JOIN b ON b.instance = a.instance AND b.request_id = a.request_id"""
)
def cache_replay(spark, sf_dir):
    """Events replayed as requests through two caches: tiers with the oldest entry evicted, and one that is emptied when full."""
    from pyspark.sql import Window

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) * 30
    log = e.select(C("user_id").alias("instance"), C("event_id").alias("request_id"), F.concat("event_type", (C("event_id") % 7).cast("string")).alias("cache_key"), at.alias("at"))
    tiers = cache.read_through(log, 5, 300, 900)
    emptied = cache.read_through(log, 6, 450, None, "clear").select("instance", "request_id", C("outcome").alias("user_outcome"), C("evicted").alias("user_evicted"))
    return tiers.join(emptied, ["instance", "request_id"])


# -- sinks


def _folder(spark):
    return f"{shared_dir(spark)}/routes-{uuid.uuid4().hex}"


_OWN_ID = _ERROR.replace(_fails("id"), "")


@query(
    f"""WITH r AS (SELECT user_id, CASE WHEN json_type(j) = 'OBJECT' THEN j END AS j FROM (SELECT *, {_ERROR} AS error FROM (SELECT route_key, user_id, CASE WHEN json_valid(payload) THEN payload END AS j FROM v_payload)) WHERE error IS NULL),
        c AS (SELECT user_id, count(*) AS n, min(least(CAST(j ->> '$.geometry[0].lng' AS double), CAST(j ->> '$.geometry[1].lng' AS double))) AS west, max(greatest(CAST(j ->> '$.geometry[0].lat' AS double), CAST(j ->> '$.geometry[1].lat' AS double))) AS north FROM r GROUP BY user_id)
        SELECT p.request_id, coalesce(c.n, 0) AS route_count, coalesce(c.n, 0) AS candidates, c.west, c.north, 36 AS id_length, 'only' AS commit FROM v_pref p LEFT JOIN c ON c.user_id = p.request_id"""
)
def saved_batches(spark, sf_dir):
    """Generated batches after a write that was repeated: one batch a request, with its candidates and envelope."""
    p, v = views(spark, sf_dir, "v_pref", "v_payload")
    # stored before it is filtered: a filter pushed below the parsed text would parse it once for every rule
    sound = stored(read_routes(v.select(C("user_id").alias("request_id"), "payload")), "payloads").where("error IS NULL")
    asked = p.select("request_id", F.to_json(F.struct("activity", "route_type")).alias("preferences"))
    folder = _folder(spark)
    for _ in range(2):
        sinks.commit(folder, "only", lambda: sinks.batch_tables(asked, sound))
    batches, found = (sinks.committed(spark, folder, t, s) for t, s in (("batches", sinks.BATCHES), ("candidates", sinks.CANDIDATES)))
    held = found.groupBy("batch_id").agg(F.count("*").alias("candidates"))
    joined = batches.join(held, "batch_id", "left")
    return joined.select("request_id", "route_count", F.coalesce("candidates", F.lit(0)).alias("candidates"), "envelope.west", "envelope.north", F.length("batch_id").alias("id_length"), "commit")


@query(f"SELECT route_key, error, CASE WHEN error IS NULL THEN 42 END AS id_length, CASE WHEN error IS NULL THEN 1 END AS holders, error IS NULL AS own FROM (SELECT *, {_OWN_ID} AS error FROM (SELECT route_key, CASE WHEN json_valid(payload) THEN payload END AS j FROM v_payload))")
def saved_under_new_ids(spark, sf_dir):
    """Payloads saved under the server's ids: none keeps the client's, none is given twice."""
    (v,) = views(spark, sf_dir, "v_payload")
    saved = sinks.new_saved(v.select("route_key", "payload"))
    saved = spread(saved, "id")
    holders = saved.where("error IS NULL").groupBy("id").agg(F.count("*").cast("int").alias("holders"))
    own = C("id").startswith("saved-") & (F.get_json_object("payload", "$.id") == C("id")) & (C("id") != F.concat(F.lit("saved-"), C("route_key").cast("string")))
    return saved.join(holders, "id", "left").select("route_key", "error", F.length("id").alias("id_length"), "holders", F.coalesce(own, F.lit(False)).alias("own"))


_HOURS = "CASE WHEN route_key % 5 <> 0 THEN CAST(route_key % 2500 AS int) - 50 END"


@query(
    f"""SELECT route_key, CASE WHEN h BETWEEN 1 AND 2160 THEN TIMESTAMP '2024-05-01 00:00:00' + to_hours(CAST(h AS bigint)) END AS expires_at, CASE WHEN h NOT BETWEEN 1 AND 2160 THEN '{sinks.BAD_HOURS}' END AS error,
        CASE WHEN h BETWEEN 1 AND 2160 THEN 32 END AS token_length, CASE WHEN h BETWEEN 1 AND 2160 THEN 1 END AS holders FROM (SELECT route_key, coalesce({_HOURS}, 168) AS h FROM v_saved)"""
)
def shares_created(spark, sf_dir):
    """New shares: their ends, the refusals, and tokens that are all different."""
    (s,) = views(spark, sf_dir, "v_saved")
    hours = F.when(C("route_key") % 5 != 0, (C("route_key") % 2500).cast("int") - 50)
    made = sinks.new_shares(s.select("route_key", "user_id", hours.alias("hours")), F.expr("TIMESTAMP '2024-05-01 00:00:00'"))
    holders = made.where("error IS NULL").groupBy("token").agg(F.count("*").cast("int").alias("holders"))
    shape = F.when(C("token").rlike("^[A-Za-z0-9_-]+$"), F.length("token"))
    return made.join(holders, "token", "left").select("route_key", "expires_at", "error", shape.alias("token_length"), "holders")


# -- addresses, outcomes


_TEXT = "CASE c_custkey % 4 WHEN 0 THEN right(c_name, 4) WHEN 1 THEN concat('  ', upper(substr(c_name, 3, 5)), ' ') WHEN 2 THEN right(c_name, 2) ELSE 'zz9' END"


@query(
    f"""SELECT query_id, id, name, rank FROM (SELECT q.query_id, p.s_suppkey AS id, p.s_name AS name, row_number() OVER (PARTITION BY q.query_id ORDER BY length(p.s_name), p.s_name, p.s_suppkey) AS rank
        FROM (SELECT c_custkey AS query_id, lower(trim({_TEXT})) AS said FROM customer) q JOIN supplier p ON contains(lower(p.s_name), q.said)) WHERE rank <= 6"""
)
def search_all_places(spark, sf_dir):
    """Every customer's text as an address query over the suppliers' names."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    texts = read("customer").select(C("c_custkey").alias("query_id"), F.expr(_TEXT).alias("text"))
    return places.search_all(texts, read("supplier").select(C("s_suppkey").alias("id"), C("s_name").alias("name")))


_VALID = "(target_distance_km IS NULL OR target_distance_km BETWEEN 0.5 AND 90) AND elevation_preference BETWEEN 0 AND 3"
_MIDDLE = haversine_sql("r.lat", "r.lng", "(e.lat1 + e.lat2) / 2", "(e.lng1 + e.lng2) / 2")


@query(
    f"""WITH q AS (SELECT request_id, start_lat + 0.00013e0 + CASE WHEN request_id % 7 = 0 THEN 3 ELSE 0 END AS lat, start_lng + 0.00017e0 AS lng, (request_id % 3 + 1) / 10e0 AS radius_km, {_VALID} AS valid FROM v_pref),
        n AS (SELECT r.request_id, e.edge_id, e.src, e.dst FROM q r JOIN v_edge e ON {_MIDDLE} <= r.radius_km * 1000),
        g AS (SELECT request_id, count(DISTINCT edge_id) AS edges, count(DISTINCT node) AS nodes FROM (SELECT request_id, edge_id, src AS node FROM n UNION ALL SELECT request_id, edge_id, dst FROM n) GROUP BY request_id),
        s AS (SELECT user_id, count(*) AS n FROM v_saved GROUP BY user_id)
        SELECT request_id, CASE WHEN code IS NULL THEN n ELSE 0 END AS routes, code FROM (SELECT q.request_id, s.n, CASE WHEN NOT valid THEN 'malformed_input' WHEN coalesce(edges, 0) < 8 OR coalesce(nodes, 0) < 8 THEN 'insufficient_graph_data'
          WHEN s.n IS NULL THEN 'no_route' END AS code FROM q LEFT JOIN g ON g.request_id = q.request_id LEFT JOIN s ON s.user_id = q.request_id)"""
)
def request_outcomes(spark, sf_dir):
    """What became of every request: routes, or the code of what it lacks. Saved routes stand for answers."""
    p, e, s = views(spark, sf_dir, "v_pref", "v_edge", "v_saved")
    away = F.when(C("request_id") % 7 == 0, num(3)).otherwise(num(0))
    asked = p.select("*", (C("start_lat") + num(0.00013) + away).alias("lat"), (C("start_lng") + num(0.00017)).alias("lng"), ((C("request_id") % 3 + 1) / num(10)).alias("radius_km"))
    graphs = asks.reachable(asked, e, most_km=0.3)
    return asks.outcomes(asked, F.expr(_VALID), graphs, s.select(C("user_id").alias("request_id")))


# -- small pieces


@query(
    """SELECT request_id, CASE activity WHEN 'running' THEN 'Running' WHEN 'hiking' THEN 'Hiking' ELSE 'Cycling' END AS activity_label,
       CASE route_type WHEN 'loop' THEN 'Loop' WHEN 'out_and_back' THEN 'Out And Back' ELSE 'Point To Point' END AS type_label, CASE WHEN request_id % 6 = 0 THEN 40.0149e0 ELSE start_lat END AS start_lat, CASE WHEN request_id % 6 = 0 THEN -105.2705e0 ELSE start_lng END AS start_lng FROM v_pref"""
)
def request_labels(spark, sf_dir):
    """Labels of activities and route types, and the default start where one is missing."""
    (p,) = views(spark, sf_dir, "v_pref")
    gaps = p.withColumn("start_lat", F.when(C("request_id") % 6 != 0, C("start_lat")))
    return asks.with_start(gaps).select("request_id", text.title_label(C("activity")).alias("activity_label"), text.title_label(C("route_type")).alias("type_label"), "start_lat", "start_lng")


_MAIL = "concat(CASE c_custkey % 3 WHEN 0 THEN ' ' ELSE '' END, c_name, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN '@' ELSE '@mail.' END, CASE c_custkey % 5 WHEN 0 THEN 'a b.org' ELSE 'Example.ORG' END)"


@query(f"SELECT c_custkey, CASE WHEN regexp_matches(m, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') AND length(m) <= 254 THEN m END AS email FROM (SELECT c_custkey, lower(trim({_MAIL})) AS m FROM customer)")
def normalized_emails(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select("c_custkey", text.normalize_email(F.expr(_MAIL)).alias("email"))


_STRENGTH = " ".join(f"CASE WHEN {k} >= {least} THEN '{words}' END," for k, least, words in client.STRENGTHS).rstrip(",")


@query(
    f"""SELECT route_key, concat(difficulty, ' running route tuned for ', CASE WHEN len(found) > 0 THEN array_to_string(found[1:2], ' and ') ELSE 'a balanced outing' END, '.') AS explanation FROM
        (SELECT route_key, CASE route_key % 3 WHEN 0 THEN 'Easy' WHEN 1 THEN 'Moderate' ELSE 'Hard' END AS difficulty, list_filter([{_STRENGTH}], lambda x: x IS NOT NULL) AS found FROM
         (SELECT route_key, {', '.join(f"CAST((route_key * {7 + 4 * i}) % 101 AS double) AS {k}" for i, (k, _, _) in enumerate(client.STRENGTHS))} FROM v_saved))"""
)
def imported_explanations(spark, sf_dir):
    (s,) = views(spark, sf_dir, "v_saved")
    scores = {k: ((C("route_key") * (7 + 4 * i)) % 101).cast("double") for i, (k, _, _) in enumerate(client.STRENGTHS)}
    level = F.when(C("route_key") % 3 == 0, "Easy").when(C("route_key") % 3 == 1, "Moderate").otherwise("Hard")
    return s.select("route_key", client.imported_explanation(scores, level, F.lit("running")).alias("explanation"))


@query(
    f"""SELECT concat('segment-', CAST(user_id AS varchar)) AS id, kind AS activity, km, {half_up_sql("km * CASE kind WHEN 'cycling' THEN 3.1e0 ELSE 5.6e0 END")} AS minutes, CASE WHEN user_id % 4 = 0 THEN 62e0 ELSE 56e0 END AS novelty FROM
        (SELECT user_id, kind, {half_up_sql('m / 1000', 1)} AS km FROM (SELECT user_id, CAST(max(seq) * 700 AS double) AS m FROM v_track GROUP BY user_id HAVING max(seq) >= 2) CROSS JOIN (SELECT 'running' AS kind UNION ALL SELECT 'cycling'))"""
)
def explored_segments(spark, sf_dir):
    """Segments of all activities: the answers of both calls together."""
    (t,) = views(spark, sf_dir, "v_track")
    ends = t.groupBy("user_id").agg(F.min_by(F.struct("lat", "lng"), "seq").alias("start"), F.max_by(F.struct("lat", "lng"), "seq").alias("end"), F.max("seq").alias("n")).where("n >= 2")
    none = lambda t_: F.lit(None).cast(t_)
    raw = ends.select(C("user_id").alias("id"), F.lit("x").alias("name"), none("string").alias("points"), "start", "end", (C("n") * 700).cast("double").alias("distance_m"), none("double").alias("climb_m"), none("double").alias("grade"), none("int").alias("category"), (C("user_id") % 4 == 0).alias("starred"))
    found = segments.explore(raw.withColumn("activity", F.lit("running")).unionByName(raw.withColumn("activity", F.lit("riding"))), "all")
    return found.select("id", "activity", "km", "minutes", "signals.novelty")
