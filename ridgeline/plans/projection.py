"""Route entities over the star-schema tables.

The tables carry no coordinates, so each entity is a deterministic projection, written once as SQL
that Spark and DuckDB both read; only divisions and a quoted name are spelled differently. ``views`` builds
them for Spark, ``with_views`` puts them in front of a DuckDB statement.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

GRID = 40
HAVERSINE = "2 * 6371e0 * 1000e0 * asin(sqrt(sin(radians({2} - {0}) / 2) * sin(radians({2} - {0}) / 2) + cos(radians({0})) * cos(radians({2})) * sin(radians({3} - {1}) / 2) * sin(radians({3} - {1}) / 2)))"


def half_up_sql(x: str, digits: int = 0) -> str:
    f = f"1e{digits}"
    return f"cast(floor(({x}) * {f} + 0.5e0) as double) / {f}"


def haversine_sql(*point: str) -> str:
    return HAVERSINE.format(*point)


def _score(factor: int, size: str = "p_size") -> str:
    return f"(({size} * {factor}) % 50) / 50e0"


VIEWS: dict[str, str] = {
    "v_node": """
        SELECT p_partkey AS node_id, 40e0 + (p_partkey DIV 40) * 0.0009e0 AS lat, -105.27e0 + (p_partkey % 40) * 0.0012e0 AS lng,
               p_retailprice AS elev, CAST(p_size AS bigint) AS size, p_type AS kind
        FROM part""",
    "v_link": f"""
        SELECT a.node_id * 2 + k.k AS edge_id, a.node_id AS src, b.node_id AS dst, a.lat AS lat1, a.lng AS lng1, b.lat AS lat2, b.lng AS lng2,
               {half_up_sql(haversine_sql('a.lat', 'a.lng', 'b.lat', 'b.lng'))} AS distance_m, {half_up_sql('b.elev - a.elev', 1)} AS elevation_gain_m,
               a.elev AS from_elev, b.elev AS to_elev, a.size AS size
        FROM v_node a JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) k ON k.k = 1 OR (a.node_id + 1) % 40 <> 0
        JOIN v_node b ON b.node_id = a.node_id + CASE WHEN k.k = 0 THEN 1 ELSE 40 END""",
    "v_edge": f"""
        SELECT edge_id, src, dst, lat1, lng1, lat2, lng2, distance_m, elevation_gain_m, elevation_gain_m / distance_m AS slope, from_elev, to_elev,
               {_score(1, 'size')} AS park_score, {_score(7, 'size')} AS shade_score, {_score(13, 'size')} AS safety_score, {_score(17, 'size')} AS scenery_score,
               {_score(19, 'size')} AS bike_score, {_score(23, 'size')} AS walk_score,
               CASE WHEN size % 9 <> 0 THEN {_score(29, 'size')} END AS novelty_score, CASE WHEN size % 7 <> 0 THEN {_score(31, 'size')} END AS traffic_exposure,
               CASE size % 9 WHEN 0 THEN 'highway' WHEN 1 THEN 'arterial' WHEN 2 THEN 'collector' WHEN 3 THEN 'residential' WHEN 4 THEN 'greenway'
                    WHEN 5 THEN 'park_path' WHEN 6 THEN 'trail' WHEN 7 THEN 'bike_path' ELSE 'service' END AS road_type,
               CASE size % 6 WHEN 0 THEN 'gravel' WHEN 1 THEN 'dirt' WHEN 2 THEN 'rough_trail' WHEN 3 THEN 'sidewalk' WHEN 4 THEN 'paved' ELSE 'asphalt' END AS surface_type,
               size % 17 <> 0 AS access_allowed
        FROM v_link""",
    "v_pref": """
        SELECT c_custkey AS request_id,
               CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') THEN 'cycling' WHEN c_mktsegment = 'BUILDING' THEN 'hiking' ELSE 'running' END AS activity,
               CASE c_custkey % 3 WHEN 0 THEN 'loop' WHEN 1 THEN 'out_and_back' ELSE 'point_to_point' END AS route_type,
               CASE WHEN c_custkey % 5 <> 0 THEN CASE WHEN c_acctbal < 10 THEN 0.1e0 WHEN c_acctbal > 20000 THEN 200e0 ELSE c_acctbal / 100 END END AS target_distance_km,
               CASE WHEN c_custkey % 10 <> 0 THEN CAST(c_custkey % 180 + 1 AS double) END AS target_duration_min,
               CAST(c_custkey DIV 3 % 4 AS double) AS park_preference, CAST(c_custkey DIV 12 % 4 AS double) AS shade_preference,
               (c_custkey % 7) / 2e0 AS elevation_preference, (c_custkey % 11) / 4e0 AS safety_preference, (c_custkey % 13) / 5e0 AS exploration_preference,
               CASE c_custkey % 6 WHEN 0 THEN 'Afternoon' WHEN 1 THEN '22:30' WHEN 2 THEN '07:15' WHEN 3 THEN 'late evening' WHEN 4 THEN '13:00' ELSE '' END AS departure_time,
               CASE c_custkey % 8 WHEN 0 THEN 'easy_flat' WHEN 1 THEN 'park_heavy' WHEN 2 THEN 'shaded' WHEN 3 THEN 'scenic' WHEN 4 THEN 'climbing' WHEN 5 THEN 'exploration' END AS route_style,
               40e0 + c_nationkey * 0.0011e0 AS start_lat, -105.27e0 + (c_custkey % 40) * 0.0012e0 AS start_lng
        FROM customer""",
    "v_route_edge": """
        SELECT l_orderkey AS route_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS bigint) AS seq,
               l_partkey AS edge_key, CAST(floor(l_extendedprice / 100) AS double) AS distance_m, l_discount * 10 AS park_score, l_tax * 10 AS shade_score,
               l_quantity / 50 AS safety_score, (l_partkey % 100) / 100e0 AS scenery_score, (l_suppkey % 10) / 10e0 AS novelty_score,
               CASE WHEN l_partkey % 5 <> 0 THEN (l_partkey % 9) / 9e0 END AS traffic_exposure,
               CAST(l_partkey % 21 - 10 AS double) AS elevation_gain_m, ((l_partkey % 21) - 10) / 100e0 AS slope,
               40e0 + (l_partkey % 200 DIV 40) * 0.0009e0 AS lat, -105.27e0 + (l_partkey % 40) * 0.0012e0 AS lng
        FROM lineitem""",
    "v_saved": """
        SELECT concat('saved-', CAST(o_orderkey AS varchar(20))) AS id, o_orderkey AS route_key, o_custkey AS user_id, o_orderstatus AS status,
               o_totalprice / 1000 AS distance_km, o_orderdate AS saved_at
        FROM orders""",
    "v_payload": """
        SELECT route_key, user_id, CASE WHEN route_key % 29 = 0 THEN concat(chr(123), 'broken') WHEN route_key % 31 = 0 THEN '[1, 2]' ELSE translate(concat(
               '<"id": ', CASE WHEN route_key % 7 = 0 THEN '5' WHEN route_key % 11 = 0 THEN '" "' ELSE concat('"', id, '"') END, ', "source": "generated", "name": ',
               CASE WHEN route_key % 13 = 0 THEN 'null' ELSE concat('"Route ', CAST(route_key AS varchar(20)), '"') END, ', "activity": "running", "routeType": ',
               CASE WHEN route_key % 17 = 0 THEN '[]' WHEN route_key % 3 = 0 THEN 'null' ELSE '"loop"' END, ', "distanceKm": ',
               CASE WHEN route_key % 19 = 0 THEN '"far"' ELSE concat(CAST(route_key % 40 AS varchar(20)), '.5') END, ', "estimatedDurationMin": ', CAST(route_key % 200 AS varchar(20)),
               ', "elevationGainM": ', CAST(route_key % 900 AS varchar(20)), ', "savedAt": ', CASE WHEN route_key % 23 = 0 THEN '"yesterday"' WHEN route_key % 2 = 0 THEN 'null' ELSE '"2024-05-01T10:00:00Z"' END,
               ', "geometry": [<"lat": ', CASE WHEN route_key % 37 = 0 THEN '95.0' ELSE '40.25' END, ', "lng": ', CASE WHEN route_key % 41 = 0 THEN '"west"' ELSE '-105.5' END, '>',
               CASE WHEN route_key % 43 = 0 THEN '' WHEN route_key % 47 = 0 THEN ', 7' ELSE ', <"lat": 40.5, "lng": -105.25>' END, ']>'), '<>', concat(chr(123), chr(125))) END AS payload
        FROM v_saved""",
    "v_share": """
        SELECT md5(CAST(o_orderkey AS varchar(20))) AS token, o_orderkey AS route_key, o_custkey AS user_id, (o_orderkey % 2160) + 1 AS hours, o_orderdate AS created_at
        FROM orders WHERE o_orderkey % 3 = 0""",
    "v_track": """
        SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS bigint) AS seq, ts, 40e0 + (event_id % 97) * 0.0004e0 AS lat,
               -105.27e0 + (event_id % 89) * 0.0005e0 AS lng, CASE WHEN event_id % 11 <> 0 THEN value END AS elev
        FROM events""",
    "v_tag": """
        SELECT node_id AS way_id,
               CASE size % 12 WHEN 0 THEN 'primary' WHEN 1 THEN 'secondary' WHEN 2 THEN 'tertiary' WHEN 3 THEN 'residential' WHEN 4 THEN 'cycleway' WHEN 5 THEN 'footway'
                    WHEN 6 THEN 'path' WHEN 7 THEN 'pedestrian' WHEN 8 THEN 'track' WHEN 9 THEN 'service' WHEN 10 THEN 'motorway' ELSE 'living_street' END AS highway,
               CASE node_id % 13 WHEN 0 THEN 'private' WHEN 1 THEN 'customers' WHEN 2 THEN 'yes' END AS access,
               CASE node_id % 7 WHEN 0 THEN 'no' WHEN 1 THEN 'designated' WHEN 2 THEN 'yes' END AS bicycle,
               CASE node_id % 11 WHEN 0 THEN 'no' WHEN 1 THEN 'designated' END AS foot,
               CASE node_id % 6 WHEN 0 THEN 'dirt' WHEN 1 THEN 'asphalt' WHEN 2 THEN 'ground' END AS surface,
               CASE node_id % 5 WHEN 0 THEN 'both' WHEN 1 THEN 'no' END AS sidewalk,
               CASE node_id % 4 WHEN 0 THEN '30 mph' WHEN 1 THEN '50' WHEN 2 THEN 'walk' END AS maxspeed,
               CASE node_id % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS lit,
               CASE node_id % 17 WHEN 0 THEN 'parking_aisle' WHEN 1 THEN 'alley' WHEN 2 THEN 'driveway' END AS service,
               CASE node_id % 19 WHEN 0 THEN 'yes' END AS covered, CASE node_id % 23 WHEN 0 THEN 'yes' END AS tree_lined,
               CASE node_id % 10 WHEN 0 THEN 'water' WHEN 1 THEN 'wood' END AS "natural", CASE node_id % 9 WHEN 0 THEN 'park' WHEN 1 THEN 'garden' END AS leisure
        FROM v_node""",
    "v_green": """
        SELECT s_suppkey AS feature_id, s_suppkey AS ord, CASE s_nationkey % 4 WHEN 0 THEN 'park' WHEN 1 THEN 'woods' WHEN 2 THEN 'water' ELSE 'green' END AS kind,
               40e0 + ((s_suppkey * 7) % 50) * 0.0009e0 AS lat, -105.27e0 + ((s_suppkey * 11) % 40) * 0.0012e0 AS lng, 0.0004e0 + (s_suppkey % 5) * 0.0002e0 AS half
        FROM supplier""",
}
#: What Spark reads in place of the entities' own text. An edge without length is flat: its division would be an error.
SPELLED = {'"natural"': "`natural`", "elevation_gain_m / distance_m AS slope": "coalesce(try_divide(elevation_gain_m, distance_m), 0e0) AS slope"}
#: Names of the tag columns of v_tag.
TAGS = ("highway", "access", "bicycle", "foot", "surface", "sidewalk", "maxspeed", "lit", "service", "covered", "tree_lined", "natural", "leisure")


def _needs(sql: str) -> list[str]:
    return [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]


def _closure(names: list[str]) -> list[str]:
    found: set[str] = set()

    def add(name: str) -> None:
        if name not in found:
            found.add(name)
            for v in _needs(VIEWS[name]):
                add(v)

    for n in names:
        add(n)
    return [v for v in VIEWS if v in found]


def views(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The named entities as DataFrames, read from Parquet."""
    built: dict[str, DataFrame] = {}
    for name in _closure(list(names)):
        text = VIEWS[name]
        for own, spelled in SPELLED.items():
            text = text.replace(own, spelled)
        inputs = {}
        for source in re.findall(r"\b(?:FROM|JOIN) (\w+)", text):
            if source not in inputs:
                inputs[source] = built[source] if source in built else spark.read.parquet(f"{sf_dir}/{source}.parquet")
        text = re.sub(r"\b(FROM|JOIN) (\w+)", r"\1 {\2}", text)
        built[name] = spark.sql(text, **inputs)
    return [built[n] for n in names]


def with_views(sql: str) -> str:
    """DuckDB statement with the entities that it names as common table expressions."""
    parts = [f"{v} AS ({VIEWS[v].replace(' DIV ', ' // ')})" for v in _closure(_needs(sql))]
    if not parts:
        return sql
    own = sql.lstrip()
    if own.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {', '.join(parts)}, {own[15:]}"
    return f"WITH {', '.join(parts)}" + (f", {own[5:]}" if own.startswith("WITH ") else f" {sql}")
