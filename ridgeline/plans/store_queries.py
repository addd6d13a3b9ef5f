"""Queries over saved routes, shares, caches, text formats and map elements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridgeline.functions import text
from ridgeline.functions.geo import half_up, num
from ridgeline.operators import store
from ridgeline.plans.projection import half_up_sql, haversine_sql, views
from ridgeline.plans.registry import query
from ridgeline.sources import formats, overpass

C = F.col
NOW = "TIMESTAMP '1995-06-17 00:00:00'"


@query("SELECT user_id, id, saved_at, distance_km, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY saved_at DESC, id) AS place FROM v_saved) WHERE place <= 5")
def saved_routes_by_user(spark, sf_dir):
    (s,) = views(spark, sf_dir, "v_saved")
    return store.latest_by_user(s, 5).select("user_id", "id", "saved_at", "distance_km", "place")


@query(
    f"""SELECT s.token, s.route_key, s.created_at + to_hours(CAST(s.hours AS bigint)) AS expires_at, r.id, r.user_id, r.distance_km, r.saved_at
        FROM v_share s JOIN v_saved r ON r.route_key = s.route_key WHERE s.created_at + to_hours(CAST(s.hours AS bigint)) > {NOW}"""
)
def share_resolve(spark, sf_dir):
    s, r = views(spark, sf_dir, "v_share", "v_saved")
    return store.resolve_shares(s, r, F.expr(NOW))


@query(
    """SELECT user_id, saved_at, distance_km FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY saved_at DESC, distance_km DESC) AS k FROM
       (SELECT user_id, saved_at, distance_km FROM v_saved UNION ALL SELECT user_id, saved_at + to_days(30), distance_km * 2 FROM v_saved WHERE route_key % 4 = 0)) WHERE k = 1"""
)
def cache_latest_wins(spark, sf_dir):
    (s,) = views(spark, sf_dir, "v_saved")
    rows = s.select("user_id", "saved_at", "distance_km")
    changes = s.where("route_key % 4 = 0").select("user_id", (C("saved_at") + F.expr("INTERVAL 30 DAYS")).alias("saved_at"), (C("distance_km") * 2).alias("distance_km"))
    return store.upsert(rows, changes, ["user_id"], "saved_at").select("user_id", "saved_at", "distance_km")


@query(
    f"""SELECT route_key, expires_at FROM (SELECT route_key, saved_at + to_seconds(CAST(least(greatest(coalesce(CASE WHEN route_key % 3 <> 0 THEN route_key * 7 END, 600), 60), 86400) AS bigint)) AS expires_at FROM v_saved)
        WHERE expires_at > {NOW}"""
)
def cache_fresh(spark, sf_dir):
    (s,) = views(spark, sf_dir, "v_saved")
    ttl = F.when(C("route_key") % 3 != 0, C("route_key") * 7)
    return store.fresh(s.select("route_key", store.expiry(C("saved_at"), ttl).alias("expires_at")), F.expr(NOW))


@query("SELECT route_key FROM v_saved WHERE user_id NOT IN (SELECT user_id FROM v_saved WHERE status = 'F')")
def saved_routes_after_delete(spark, sf_dir):
    (s,) = views(spark, sf_dir, "v_saved")
    return store.without_rows(s, s.where("status = 'F'"), ["user_id"]).select("route_key")


@query("SELECT l_partkey AS segment, min(l_orderkey) AS seen FROM lineitem GROUP BY l_partkey")
def segment_first_seen(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(C("l_partkey").alias("segment"), C("l_orderkey").alias("seen"))
    return store.first_seen(rows, "segment", "seen")


# -- text formats


@query(r"SELECT doc_id, regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM documents")
def slugify(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.slugify(C("text")).alias("slug"))


@query(
    """SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;')) AS escaped FROM pages"""
)
def escape_xml(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.md5(text.escape_xml(C("html"), strip_illegal=False)).alias("escaped"))


@query(r"SELECT page_id, regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g') AS filename FROM pages")
def safe_filename(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", text.safe_filename(C("url")).alias("filename"))


@query(
    r"""SELECT page_id, CASE WHEN starts_with(p, '/') AND NOT starts_with(p, '//') AND NOT contains(p, '\') AND NOT regexp_matches(p, '[\x00-\x1F\x7F]') THEN p ELSE '/' END AS path
        FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN regexp_replace(url, '^https?:/', '') ELSE regexp_replace(url, '^https?://[^/]*', '') END AS p FROM pages)"""
)
def safe_path(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = F.when(C("page_id") % 3 == 0, C("url")).when(C("page_id") % 3 == 1, F.regexp_replace("url", "^https?:/", "")).otherwise(F.regexp_replace("url", "^https?://[^/]*", ""))
    return p.select("page_id", text.safe_path(path).alias("path"))


@query(
    f"""SELECT route_key, CASE WHEN mi < 100 THEN printf('%.1f', {half_up_sql('mi', 1)}) || ' mi' ELSE CAST(CAST({half_up_sql('mi')} AS bigint) AS varchar) || ' mi' END AS miles,
        CAST(CAST({half_up_sql('distance_km * 3.28084e0')} AS bigint) AS varchar) || ' ft' AS feet FROM (SELECT *, distance_km * 0.621371e0 AS mi FROM v_saved)"""
)
def unit_texts(spark, sf_dir):
    (s,) = views(spark, sf_dir, "v_saved")
    return s.select("route_key", text.miles_text(C("distance_km")).alias("miles"), text.feet_text(C("distance_km")).alias("feet"))


def tracks_as_arrays(spark, sf_dir):
    """Each user's track as one ordered array; a track is one document to export."""
    (t,) = views(spark, sf_dir, "v_track")
    points = F.array_sort(F.collect_list(F.struct("seq", half_up(C("lat"), 6).alias("lat"), half_up(C("lng"), 6).alias("lng"), half_up(C("elev"), 2).alias("elev"))))
    return t.groupBy("user_id").agg(points.alias("points"))


_TRACK = f"(SELECT user_id, seq, {half_up_sql('lat', 6)} AS lat, {half_up_sql('lng', 6)} AS lng, {half_up_sql('elev', 2)} AS elev FROM v_track)"


@query(f"SELECT user_id, count(*) AS points, {half_up_sql('sum(lat)', 3)} AS lat, {half_up_sql('coalesce(sum(elev), 0e0)', 1)} AS elev FROM {_TRACK} GROUP BY user_id")
def gpx_round_trip(spark, sf_dir):
    """Tracks written as GPX and read back: points, and sums of what was read."""
    return _sums(formats.parse_gpx(_exported(spark, sf_dir, formats.gpx)))


@query(f"SELECT user_id, count(*) AS points, {half_up_sql('sum(lat)', 3)} AS lat, {half_up_sql('coalesce(sum(elev), 0e0)', 1)} AS elev FROM {_TRACK} GROUP BY user_id")
def kml_round_trip(spark, sf_dir):
    return _sums(formats.parse_kml(_exported(spark, sf_dir, formats.kml)))


def _exported(spark, sf_dir, writer):
    # a missing elevation is written as 0, so that every point has one
    whole = F.transform("points", lambda p: F.struct(p["lat"].alias("lat"), p["lng"].alias("lng"), F.coalesce(p["elev"], num(0)).alias("elev")))
    t = tracks_as_arrays(spark, sf_dir)
    return t.select("user_id", writer(F.concat(F.lit("Track <"), C("user_id").cast("string"), F.lit("> & more")), whole).alias("xml"))


def _sums(parsed):
    add = lambda field: F.aggregate(F.transform("points", lambda p: p[field]), num(0), lambda t, x: t + x)
    return parsed.select("user_id", F.size("points").cast("long").alias("points"), half_up(add("lat"), 3).alias("lat"), half_up(add("elev"), 1).alias("elev"))


@query(
    f"""SELECT user_id, 'LineString' AS type, CAST(count(*) AS bigint) AS points FROM {_TRACK} GROUP BY user_id"""
)
def geojson_linestring(spark, sf_dir):
    t = tracks_as_arrays(spark, sf_dir).select("user_id", text.linestring_geojson(C("points")).alias("json"))
    parsed = F.from_json("json", "struct<type: string, coordinates: array<array<double>>>")
    return t.select("user_id", parsed["type"].alias("type"), F.size(parsed["coordinates"]).cast("long").alias("points"))


_NUMBER_TEXT = r"regexp_replace(regexp_replace(printf('%.6f', {0}), '0+$', ''), '[.]$', '')"


@query(
    f"""WITH t AS (SELECT user_id, list(concat({_NUMBER_TEXT.format('lat')}, ',', {_NUMBER_TEXT.format('lng')}) ORDER BY seq) AS p FROM {_TRACK} GROUP BY user_id),
        c AS (SELECT *, greatest(len(p) - 2, 0) AS n, least(greatest(len(p) - 2, 0), 9) AS c FROM t)
        SELECT user_id, concat('https://www.google.com/maps/dir/?api=1&origin=', url_encode(p[1]), '&destination=', url_encode(p[-1]), '&travelmode=bicycling',
            CASE WHEN c > 0 THEN concat('&waypoints=', url_encode(array_to_string(list_transform(range(c), lambda i: p[(i + 1) * n // (c + 1) + 2]), '|'))) ELSE '' END) AS url FROM c"""
)
def maps_urls(spark, sf_dir):
    return tracks_as_arrays(spark, sf_dir).select("user_id", text.maps_url(C("points"), F.lit("cycling")).alias("url"))


# -- map elements


def ways(spark, sf_dir):
    """Map ways from the grid's rows and columns, written as JSON and parsed again."""
    (n,) = views(spark, sf_dir, "v_node")
    lines = n.select(F.expr("node_id div 40").alias("line"), "node_id", "lat", "lng").union(n.select((C("node_id") % 40 + 100000).alias("line"), "node_id", "lat", "lng"))
    lines = lines.withColumn("lat", C("lat") + (C("node_id") % 3) * num(0.0001))
    points = F.array_sort(F.collect_list(F.struct("node_id", C("lat").alias("lat"), C("lng").alias("lon"))))
    rows = lines.groupBy("line").agg(points.alias("p"))
    json = F.to_json(
        F.struct(
            F.array(
                F.struct(
                    F.lit("way").alias("type"), C("line").alias("id"), F.transform("p", lambda x: x["node_id"]).alias("nodes"), F.transform("p", lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon"))).alias("geometry"),
                    F.create_map(F.lit("highway"), F.lit("path")).alias("tags"),
                )
            ).alias("elements")
        )
    )
    return overpass.parse_elements(rows.select(json.alias("json")))


_LINES = """(SELECT line, node_id, lat + (node_id % 3) * 0.0001e0 AS lat, lng, row_number() OVER (PARTITION BY line ORDER BY node_id) - 1 AS i, count(*) OVER (PARTITION BY line) - 1 AS last_i FROM
    (SELECT node_id // 40 AS line, * FROM v_node UNION ALL SELECT node_id % 40 + 100000, * FROM v_node))"""


@query(
    f"""WITH RECURSIVE p AS MATERIALIZED (SELECT *, coalesce({haversine_sql('lag(lat) OVER w', 'lag(lng) OVER w', 'lat', 'lng')}, 0e0) AS step FROM {_LINES} WINDOW w AS (PARTITION BY line ORDER BY i)),
        f AS (SELECT line, i, CAST(0 AS bigint) AS start, 0e0 AS length, CAST(NULL AS bigint) AS from_i, CAST(NULL AS double) AS metres FROM p WHERE i = 0
              UNION ALL SELECT p.line, p.i, CASE WHEN cut THEN p.i ELSE f.start END, CASE WHEN cut THEN 0e0 ELSE f.length + p.step END, CASE WHEN cut THEN f.start END, CASE WHEN cut THEN {half_up_sql('f.length + p.step')} END
              FROM (SELECT f.*, p.i AS pi, (p.i = p.last_i OR p.node_id % 7 = 0 OR f.length + p.step >= 280e0) AND f.length + p.step >= 2e0 AS cut FROM f JOIN p ON p.line = f.line AND p.i = f.i + 1) f
              JOIN p ON p.line = f.line AND p.i = f.pi)
        SELECT line AS id, CAST(from_i AS bigint) AS from_i, CAST(i AS bigint) AS to_i, metres FROM f WHERE from_i IS NOT NULL"""
)
def way_split(spark, sf_dir):
    """Ways cut at given nodes and every 280 m."""
    w = ways(spark, sf_dir)
    (n,) = views(spark, sf_dir, "v_node")
    cuts = n.where("node_id % 7 = 0").select(C("node_id").alias("node"))
    return overpass.split_ways(w, cuts).select("id", C("from_i").cast("long").alias("from_i"), C("to_i").cast("long").alias("to_i"), "metres")


@query("SELECT node_id AS node FROM v_node")
def way_shared_nodes(spark, sf_dir):
    """Every grid node lies on a row and a column."""
    return overpass.shared_nodes(ways(spark, sf_dir))


# -- imported routes, segments, synthetic graphs


_CLIENT = "CASE route_key % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'hiking' ELSE 'cycling' END"
_KM, _GAIN, _PARK = "distance_km / 10", "CAST(route_key % 700 AS double)", "CASE WHEN route_key % 5 <> 0 THEN CAST(route_key % 101 AS double) ELSE 55e0 END"
_CLIMB = f"({_GAIN} / greatest({_KM}, 0.1e0))"
_CLIENT_SCORES = {
    "distance_score": f"CASE WHEN route_key % 4 = 0 THEN 88e0 ELSE least(greatest(100 - abs({_KM} - (route_key % 30 + 1)) / (route_key % 30 + 1) * 150, 0e0), 100e0) END",
    "elevation_score": f"least(greatest(CASE act WHEN 'hiking' THEN 92 - abs({_CLIMB} - 35) * 0.9e0 WHEN 'cycling' THEN 96 - {_CLIMB} * 0.85e0 ELSE 100 - {_CLIMB} * 1.15e0 END, 0e0), 100e0)",
    "park_score": _PARK,
    "shade_score": f"least(greatest(45 + {_PARK} * 0.18e0 - 35 * 0.2e0 - CASE WHEN regexp_matches(said, 'afternoon|2:|3:') THEN 12e0 WHEN contains(said, 'evening') THEN 4e0 ELSE 0e0 END, 0e0), 100e0)",
    "safety_score": "72 + 72 * 0.14e0 - 32 * 0.22e0",
    "exploration_score": "45e0",
    "scenery_score": "58e0",
}


def _client_weights() -> str:
    from ridgeline.functions.client import WEIGHTS

    return " + ".join(f"{n} * CASE act {' '.join(f'WHEN {chr(39)}{a}{chr(39)} THEN {w[i]}e0' for a, w in WEIGHTS.items())} END" for i, n in enumerate(_CLIENT_SCORES))


@query(
    f"""SELECT route_key, {', '.join(half_up_sql(n, 4) + f' AS {n}' for n in ('distance_score', 'elevation_score', 'shade_score'))}, {half_up_sql(_client_weights())} AS total_score,
        CASE WHEN effort > CASE WHEN act = 'hiking' THEN 18 ELSE 13 END THEN 'Hard' WHEN effort > CASE WHEN act = 'cycling' THEN 8 ELSE 7 END THEN 'Moderate' ELSE 'Easy' END AS difficulty
        FROM (SELECT *, {_KM} * CASE WHEN act = 'cycling' THEN 0.35e0 ELSE 1e0 END + {_CLIMB} * 0.18e0 AS effort, {', '.join(f'{v} AS {k}' for k, v in _CLIENT_SCORES.items())} FROM
        (SELECT *, {_CLIENT} AS act, CASE route_key % 5 WHEN 0 THEN 'afternoon' WHEN 1 THEN '12:30' WHEN 2 THEN 'evening' WHEN 3 THEN '08:00' ELSE '' END AS said FROM v_saved))"""
)
def imported_scores(spark, sf_dir):
    from ridgeline.functions import client

    (s,) = views(spark, sf_dir, "v_saved")
    k = C("route_key")
    act = F.when(k % 3 == 0, F.lit("running")).when(k % 3 == 1, F.lit("hiking")).otherwise(F.lit("cycling"))
    said = F.when(k % 5 == 0, F.lit("afternoon")).when(k % 5 == 1, F.lit("12:30")).when(k % 5 == 2, F.lit("evening")).when(k % 5 == 3, F.lit("08:00")).otherwise(F.lit(""))
    s = s.withColumns({"act": act, "said": said, "km": C("distance_km") / 10, "gain": (k % 700).cast("double"), "target": F.when(k % 4 != 0, (k % 30 + 1).cast("double")), "park": F.when(k % 5 != 0, (k % 101).cast("double"))})
    found = client.imported_scores(C("km"), C("target"), C("gain"), C("act"), C("said"), {"park_access": C("park")})
    return s.select(
        "route_key", *[half_up(found[n], 4).alias(n) for n in ("distance_score", "elevation_score", "shade_score")], client.imported_total(found, C("act")).alias("total_score"),
        client.imported_difficulty(C("km"), C("gain"), C("act")).alias("difficulty"),
    )


@query(f"SELECT user_id, count(*) AS points, CAST(sum(CAST(floor(lat * 100000 + 0.5e0) AS bigint)) AS bigint) AS lat, CAST(sum(CAST(floor(lng * 100000 + 0.5e0) AS bigint)) AS bigint) AS lng FROM v_track GROUP BY user_id")
def polyline_round_trip(spark, sf_dir):
    """Tracks as polyline text and back."""
    from ridgeline.sources import segments

    (t,) = views(spark, sf_dir, "v_track")
    lines = t.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("seq", "lat", "lng"))).alias("p"))
    decoded = lines.select("user_id", segments.encode_polyline(C("p")).alias("text")).select("user_id", segments.decode_polyline(C("text")).alias("p"))
    total = lambda c: F.aggregate(F.transform("p", lambda x: half_up(x[c] * 100000).cast("bigint")), F.lit(0).cast("bigint"), lambda a, b: a + b)
    return decoded.select("user_id", F.size("p").cast("long").alias("points"), total("lat").alias("lat"), total("lng").alias("lng"))


def _ring_sql() -> str:
    from ridgeline.plans.geo_queries import TARGET_SQL
    from ridgeline.sources.synthetic import RADII, STEP

    def place(angle: str, radius: str) -> tuple[str, str]:
        d, p, b = f"(({radius}) / 6371000e0)", "radians(start_lat)", f"radians({angle})"
        to = f"asin(sin({p}) * cos({d}) + cos({p}) * sin({d}) * cos({b}))"
        return half_up_sql(f"degrees({to})", 6), half_up_sql(f"degrees(radians(start_lng) + atan2(sin({b}) * sin({d}) * cos({p}), cos({d}) - sin({p}) * sin({to})))", 6)

    (a, b), (c, d) = place("angle", "radius"), place("to_angle", "to_radius")
    return f"""WITH radii AS (SELECT unnest([{', '.join(f'{r}e0' for r in RADII)}]) AS radius, unnest(range({len(RADII)})) AS ring),
        q AS (SELECT request_id, start_lat, start_lng, greatest(5000e0, {TARGET_SQL} * 480) + 4500 AS reach FROM v_pref),
        b AS (SELECT q.*, r.radius, r.ring, r2.radius AS wide, r2.radius <= q.reach AS outward, g.angle, (g.angle + {STEP}) % 360 AS onward FROM q JOIN radii r ON r.radius <= q.reach LEFT JOIN radii r2 ON r2.ring = r.ring + 1
              CROSS JOIN (SELECT unnest(range(0, 360, {STEP})) AS angle) g),
        l AS (SELECT *, 0 AS to_angle, 0e0 AS to_radius, true AS open FROM b WHERE ring = 0 UNION ALL SELECT *, onward, radius, NOT (ring = 1 AND angle = 210) FROM b
              UNION ALL SELECT *, angle, wide, true FROM b WHERE outward UNION ALL SELECT *, onward, wide, true FROM b WHERE outward AND angle % {2 * STEP} = 0),
        e AS (SELECT request_id, open, {a} AS lat1, {b} AS lng1, CASE WHEN to_radius = 0 THEN start_lat ELSE {c} END AS lat2, CASE WHEN to_radius = 0 THEN start_lng ELSE {d} END AS lng2 FROM l)
        SELECT request_id, count(*) AS edges, sum({half_up_sql(haversine_sql('lat1', 'lng1', 'lat2', 'lng2'))}) AS metres, count(*) FILTER (WHERE NOT open) AS closed FROM e GROUP BY request_id"""


@query(_ring_sql())
def ring_graphs(spark, sf_dir):
    """A synthetic graph around every request's start."""
    from ridgeline.plans.search_queries import requests
    from ridgeline.sources import synthetic

    e = synthetic.ring_graph(requests(spark, sf_dir))
    return e.groupBy("request_id").agg(F.count("*").alias("edges"), F.sum("distance_m").alias("metres"), F.count_if(~C("access_allowed")).alias("closed"))
