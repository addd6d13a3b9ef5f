"""Queries over geometry, preferences and tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridgeline.functions import geo, tags
from ridgeline.functions.geo import half_up, num
from ridgeline.operators import graph
from ridgeline.plans.projection import TAGS, half_up_sql, haversine_sql, views
from ridgeline.plans.registry import query

C = F.col
HAV = haversine_sql("lat1", "lng1", "lat2", "lng2")
BEARING = "fmod(degrees(atan2(sin(radians(lng2 - lng1)) * cos(radians(lat2)), cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lng2 - lng1)))) + 360e0, 360e0)"


def ends():
    return C("lat1"), C("lng1"), C("lat2"), C("lng2")


@query(f"SELECT edge_id, {half_up_sql(HAV, 6)} AS metres FROM v_link")
def geo_haversine(spark, sf_dir):
    (e,) = views(spark, sf_dir, "v_link")
    return e.select("edge_id", half_up(geo.haversine_m(*ends()), 6).alias("metres"))


@query(f"SELECT edge_id, {half_up_sql(BEARING, 6)} AS bearing FROM v_link")
def geo_bearing(spark, sf_dir):
    (e,) = views(spark, sf_dir, "v_link")
    return e.select("edge_id", half_up(geo.bearing(*ends()), 6).alias("bearing"))


_DEST_LAT = "asin(sin(radians(lat)) * cos(d) + cos(radians(lat)) * sin(d) * cos(radians(b)))"


@query(
    f"""SELECT node_id, {half_up_sql('degrees(to_lat)', 6)} AS to_lat,
        {half_up_sql('degrees(radians(lng) + atan2(sin(radians(b)) * sin(d) * cos(radians(lat)), cos(d) - sin(radians(lat)) * sin(to_lat)))', 6)} AS to_lng
        FROM (SELECT *, {_DEST_LAT} AS to_lat FROM (SELECT *, CAST(node_id % 360 AS double) AS b, (size * 100e0) / 6371000e0 AS d FROM v_node))"""
)
def geo_destination(spark, sf_dir):
    (n,) = views(spark, sf_dir, "v_node")
    lat, lng = geo.destination(C("lat"), C("lng"), (C("node_id") % 360).cast("double"), C("size") * num(100))
    return n.select("node_id", lat.alias("to_lat"), lng.alias("to_lng"))


@query(f"SELECT edge_id, least(d, 360e0 - d) AS difference FROM (SELECT edge_id, fmod(abs((edge_id * 7) % 720 - size * 11e0), 360e0) AS d FROM v_link)")
def geo_angular_difference(spark, sf_dir):
    (e,) = views(spark, sf_dir, "v_link")
    return e.select("edge_id", geo.angular_difference(((C("edge_id") * 7) % 720).cast("double"), C("size") * num(11)).alias("difference"))


_M = "(pi() * 6371000e0 / 180e0)"
_SEGMENT = """(SELECT *, {ax} AS x1, {ay} AS y1, {bx} AS x2, {by} AS y2 FROM (SELECT *, lat1 + 0.0003e0 AS plat, lng1 + 0.0002e0 + (size % 7) * 0.0002e0 AS plng FROM v_link))"""
_LOCAL = _SEGMENT.format(
    ax=f"(lng1 - plng) * {_M} * cos(radians(plat))", ay=f"(lat1 - plat) * {_M}", bx=f"(lng2 - plng) * {_M} * cos(radians(plat))", by=f"(lat2 - plat) * {_M}"
)
_T = "least(greatest(-(x1 * (x2 - x1) + y1 * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 0e0), 1e0)"


@query(
    f"""SELECT edge_id, {half_up_sql('lat1 + (lat2 - lat1) * t', 6)} AS lat, {half_up_sql('lng1 + (lng2 - lng1) * t', 6)} AS lng,
        {half_up_sql('sqrt((x1 + (x2 - x1) * t) * (x1 + (x2 - x1) * t) + (y1 + (y2 - y1) * t) * (y1 + (y2 - y1) * t))', 4)} AS metres FROM (SELECT *, {_T} AS t FROM {_LOCAL})"""
)
def geo_projection(spark, sf_dir):
    (e,) = views(spark, sf_dir, "v_link")
    lat, lng, away = geo.project_on_segment(C("lat1") + num(0.0003), C("lng1") + num(0.0002) + (C("size") % 7) * num(0.0002), *ends())
    return e.select("edge_id", half_up(lat, 6).alias("lat"), half_up(lng, 6).alias("lng"), half_up(away, 4).alias("metres"))


_FLAT = _SEGMENT.format(
    ax="(lng1 - plng) * (111.32e0 * cos(radians(plat)))", ay="(lat1 - plat) * 111.32e0", bx="(lng2 - plng) * (111.32e0 * cos(radians(plat)))", by="(lat2 - plat) * 111.32e0"
)


@query(
    f"SELECT edge_id, {half_up_sql('sqrt((x1 + (x2 - x1) * t) * (x1 + (x2 - x1) * t) + (y1 + (y2 - y1) * t) * (y1 + (y2 - y1) * t))', 6)} AS km FROM (SELECT *, {_T} AS t FROM {_FLAT})"
)
def geo_segment_distance(spark, sf_dir):
    (e,) = views(spark, sf_dir, "v_link")
    km = geo.segment_distance_km(C("lat1") + num(0.0003), C("lng1") + num(0.0002) + (C("size") % 7) * num(0.0002), *ends())
    return e.select("edge_id", half_up(km, 6).alias("km"))


@query(
    f"""SELECT node_id, {half_up_sql('lat - d', 6)} AS south, {half_up_sql('lng - e', 6)} AS west, {half_up_sql('lat + d', 6)} AS north, {half_up_sql('lng + e', 6)} AS east
        FROM (SELECT *, size / 10e0 / 111e0 AS d, size / 10e0 / (111e0 * cos(radians(lat))) AS e FROM v_node)"""
)
def geo_box_around(spark, sf_dir):
    (n,) = views(spark, sf_dir, "v_node")
    box = geo.box_around(C("lat"), C("lng"), C("size") / num(10))
    return n.select("node_id", *[half_up(x, 6).alias(k) for k, x in zip(("south", "west", "north", "east"), box)])


@query("SELECT edge_id, least(CAST(src AS varchar), CAST(dst AS varchar)) || '<>' || greatest(CAST(src AS varchar), CAST(dst AS varchar)) AS edge_key FROM v_link")
def geo_edge_key(spark, sf_dir):
    (e,) = views(spark, sf_dir, "v_link")
    return e.select("edge_id", geo.edge_key(C("src").cast("string"), C("dst").cast("string")).alias("edge_key"))


@query("SELECT node_id, printf('%.6f,%.6f', lat, lng) AS point_key FROM v_node")
def geo_coordinate_key(spark, sf_dir):
    (n,) = views(spark, sf_dir, "v_node")
    return n.select("node_id", geo.coordinate_key(C("lat"), C("lng")).alias("point_key"))


_KEPT = "v >= -90 AND v <= 90 AND w >= -180 AND w <= 180"


@query(f"SELECT node_id, coalesce({_KEPT}, false) AS valid FROM (SELECT node_id, CASE WHEN node_id % 13 <> 0 THEN lat * (1 + node_id % 4) END AS v, lng * (node_id % 3) AS w FROM v_node)")
def geo_valid_point(spark, sf_dir):
    (n,) = views(spark, sf_dir, "v_node")
    lat = F.when(C("node_id") % 13 != 0, C("lat") * (C("node_id") % 4 + 1))
    return n.select("node_id", geo.valid_point(lat, C("lng") * (C("node_id") % 3)).alias("valid"))


@query(
    """SELECT n.node_id, g.feature_id FROM v_node n JOIN v_green g
       ON n.lat >= g.lat - g.half AND n.lat < g.lat + g.half AND n.lng >= g.lng - g.half AND n.lng < g.lng + g.half"""
)
def point_in_polygon(spark, sf_dir):
    n, g = views(spark, sf_dir, "v_node", "v_green")
    south, north, west, east = C("lat") - C("half"), C("lat") + C("half"), C("lng") - C("half"), C("lng") + C("half")
    corner = lambda a, b: F.struct(a.alias("lat"), b.alias("lng"))
    ring = F.array(corner(south, west), corner(south, east), corner(north, east), corner(north, west))
    rings = g.select("feature_id", ring.alias("ring"), south.alias("south"), west.alias("west"), north.alias("north"), east.alias("east"))
    near = graph.box_join(n, rings, 1, 300)
    return near.where(geo.point_in_ring(C("lat"), C("lng"), C("ring"))).select("node_id", "feature_id")


# -- preferences

_PREFS = ("park", "shade", "elevation", "safety", "exploration")


def normalized_sql(v: str) -> str:
    return f"(CASE WHEN {v} <= 1 THEN least(greatest({v}, 0e0), 1e0) ELSE least(greatest(({v} - 1) / 2, 0e0), 1e0) END)"


@query("SELECT request_id, " + ", ".join(f"{normalized_sql(f'{k}_preference')} AS {k}" for k in _PREFS) + " FROM v_pref")
def pref_normalize(spark, sf_dir):
    (p,) = views(spark, sf_dir, "v_pref")
    return p.select("request_id", *[geo.normalize_preference(C(f"{k}_preference")).alias(k) for k in _PREFS])


PACE_SQL = "CASE activity WHEN 'running' THEN 5.6e0 WHEN 'hiking' THEN 12.5e0 ELSE 3.1e0 END"
TARGET_SQL = f"coalesce(CASE WHEN target_distance_km > 0 THEN target_distance_km END, CASE WHEN target_duration_min > 0 THEN {half_up_sql(f'target_duration_min / {PACE_SQL}', 1)} END, 5e0)"


def target():
    return geo.target_km(C("target_distance_km"), C("target_duration_min"), C("activity"))


@query(
    f"""SELECT request_id, t AS target_km, {half_up_sql('greatest(0.08e0, 0.35e0 / sqrt(greatest(t, 0.1e0)))', 6)} AS tolerance,
        least(greatest(t * CASE activity WHEN 'cycling' THEN 0.65e0 ELSE 0.6e0 END + 1, 2.5e0), CASE activity WHEN 'cycling' THEN 20e0 ELSE 14e0 END) AS radius_km,
        greatest({half_up_sql(f't * {PACE_SQL}')}, 1e0) AS minutes FROM (SELECT *, {TARGET_SQL} AS t FROM v_pref)"""
)
def pref_targets(spark, sf_dir):
    (p,) = views(spark, sf_dir, "v_pref")
    p = p.withColumn("t", target())
    return p.select(
        "request_id",
        C("t").alias("target_km"),
        half_up(geo.tolerance(C("t")), 6).alias("tolerance"),
        geo.search_radius_km(C("t"), C("activity")).alias("radius_km"),
        geo.duration_min(C("t"), C("activity")).alias("minutes"),
    )


@query(
    """SELECT request_id, regexp_matches(lower(departure_time), 'afternoon|12:|13:|14:|15:') AS afternoon,
       regexp_matches(lower(departure_time), 'night|late|22:|23:') AS night FROM v_pref"""
)
def pref_departure_flags(spark, sf_dir):
    (p,) = views(spark, sf_dir, "v_pref")
    return p.select("request_id", geo.is_afternoon(C("departure_time")).alias("afternoon"), geo.is_night(C("departure_time")).alias("night"))


@query(
    """SELECT request_id, (target_distance_km IS NULL OR target_distance_km BETWEEN 0.5 AND 90) AND (target_duration_min IS NULL OR target_duration_min BETWEEN 1 AND 170)
       AND elevation_preference BETWEEN 0 AND 3 AND safety_preference BETWEEN 0 AND 2.25 AND start_lat BETWEEN -90 AND 90 AND start_lng BETWEEN -180 AND 180 AS valid FROM v_pref"""
)
def pref_validate(spark, sf_dir):
    from ridgeline.operators.requests import valid_request

    (p,) = views(spark, sf_dir, "v_pref")
    limits = {"target_distance_km": (0.5, 90), "target_duration_min": (1, 170), "elevation_preference": (0, 3), "safety_preference": (0, 2.25)}
    return p.select("request_id", valid_request({c: C(c) for c in p.columns}, limits).alias("valid"))


# -- tags


def way_tags(spark, sf_dir):
    """Ways with a tag map without null values, and an activity."""
    (t,) = views(spark, sf_dir, "v_tag")
    pairs = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), C(k).alias("value")) for k in TAGS]), lambda e: e["value"].isNotNull()))
    activity = F.when(C("way_id") % 3 == 0, F.lit("cycling")).when(C("way_id") % 3 == 1, F.lit("hiking")).otherwise(F.lit("running"))
    return t.select("way_id", pairs.alias("tags"), activity.alias("activity"))


_ACT = "CASE way_id % 3 WHEN 0 THEN 'cycling' WHEN 1 THEN 'hiking' ELSE 'running' END"
_ACCESS = """NOT (coalesce(access IN ('private', 'no', 'customers', 'permit'), false) OR (act <> 'cycling' AND (coalesce(foot = 'no', false) OR highway = 'motorway'))
    OR (act = 'cycling' AND (coalesce(bicycle = 'no', false) OR (highway = 'footway' AND coalesce(bicycle NOT IN ('yes', 'designated'), true)))))"""


@query(f"SELECT way_id, {_ACCESS} AS allowed, {_ACCESS} AND NOT (highway = 'service' AND coalesce(service IN ('parking_aisle', 'driveway'), false)) AS road FROM (SELECT *, {_ACT} AS act FROM v_tag)")
def tag_access(spark, sf_dir):
    w = way_tags(spark, sf_dir)
    one_point = F.array(F.lit(1))
    return w.select("way_id", tags.access_allowed(C("tags"), C("activity")).alias("allowed"), tags.is_road(C("tags"), one_point, C("activity")).alias("road"))


TRAFFIC_SQL = """CASE WHEN highway = 'primary' THEN 0.86e0 WHEN highway = 'secondary' THEN 0.68e0 WHEN highway = 'tertiary' THEN 0.48e0 WHEN highway IN ('residential', 'living_street') THEN 0.18e0
    WHEN highway IN ('cycleway', 'footway', 'path', 'pedestrian') THEN 0.04e0 ELSE 0.28e0 END"""


@query(
    f"""SELECT way_id, {TRAFFIC_SQL} AS traffic, coalesce(surface, CASE WHEN highway IN ('path', 'track') THEN 'dirt' ELSE 'paved' END) AS surface,
        CASE WHEN highway = 'cycleway' THEN 'bike_path' WHEN highway IN ('path', 'footway', 'pedestrian') THEN CASE WHEN surface IN ('dirt', 'ground') THEN 'trail' ELSE 'park_path' END ELSE highway END AS road,
        CASE WHEN "natural" = 'water' THEN 'water' WHEN "natural" = 'wood' THEN 'woods' WHEN leisure = 'park' THEN 'park' ELSE 'green' END AS green FROM v_tag"""
)
def tag_road_surface(spark, sf_dir):
    w, t = way_tags(spark, sf_dir), C("tags")
    return w.select("way_id", tags.traffic_exposure(t).alias("traffic"), tags.surface_type(t).alias("surface"), tags.road_type(t).alias("road"), tags.green_kind(t).alias("green"))


@query(
    f"""SELECT way_id, {half_up_sql(f'''least(greatest(0.86e0 - {TRAFFIC_SQL} * 0.5e0 + (CASE WHEN sidewalk = 'both' THEN 0.14e0 ELSE 0e0 END + CASE WHEN lit = 'yes' THEN 0.06e0 ELSE 0e0 END
        + CASE WHEN highway IN ('cycleway', 'footway', 'path', 'pedestrian') THEN 0.16e0 ELSE 0e0 END)
        - coalesce(least(greatest((TRY_CAST(nullif(regexp_replace(maxspeed, '[^0-9]', '', 'g'), '') AS int) - 25) / 120e0, 0e0), 0.2e0), 0e0), 0.05e0), 0.98e0)''', 6)} AS safety,
        CASE WHEN highway = 'cycleway' OR bicycle = 'designated' THEN 0.96e0 WHEN highway IN ('residential', 'living_street') THEN 0.68e0 WHEN highway = 'path' AND coalesce(bicycle, '') <> 'no' THEN 0.62e0
             WHEN highway IN ('primary', 'secondary') THEN 0.34e0 ELSE 0.52e0 END AS bike,
        CASE WHEN highway IN ('footway', 'pedestrian') OR foot = 'designated' THEN 0.96e0 WHEN highway IN ('path', 'track') THEN 0.9e0 WHEN sidewalk = 'both' THEN 0.78e0
             WHEN highway IN ('residential', 'living_street') THEN 0.7e0 ELSE 0.44e0 END AS walk FROM v_tag"""
)
def tag_scores(spark, sf_dir):
    w, t = way_tags(spark, sf_dir), C("tags")
    return w.select("way_id", half_up(tags.safety_score(t), 6).alias("safety"), tags.bike_score(t).alias("bike"), tags.walk_score(t).alias("walk"))


_NEAR = "(way_id % 11) / 10e0"


@query(
    f"""SELECT way_id, least(greatest({_NEAR}, CASE WHEN highway IN ('path', 'footway', 'cycleway') THEN 0.35e0 ELSE 0e0 END), 0.98e0) AS park,
        {half_up_sql(f'least(0.28e0 + {_NEAR} * 0.58e0, 0.98e0)', 6)} AS scenery,
        {half_up_sql(f'''CASE WHEN covered = 'yes' THEN 0.95e0 WHEN tree_lined = 'yes' THEN least(0.72e0 + {_NEAR} * 0.2e0, 0.96e0)
            ELSE least(greatest(0.35e0 + {_NEAR} * 0.58e0 - {TRAFFIC_SQL} * 0.18e0, 0.04e0), 0.96e0) END''', 6)} AS shade,
        {half_up_sql(f"least(0.36e0 + least(0.28e0 + {_NEAR} * 0.58e0, 0.98e0) * 0.38e0 + CASE WHEN highway = 'path' THEN 0.16e0 ELSE 0e0 END, 0.98e0)", 6)} AS novelty FROM v_tag"""
)
def tag_surroundings(spark, sf_dir):
    w, t, near = way_tags(spark, sf_dir), C("tags"), (C("way_id") % 11) / num(10)
    scenery = tags.scenery_score(t, near)
    return w.select("way_id", tags.park_score(t, near).alias("park"), half_up(scenery, 6).alias("scenery"), half_up(tags.shade_score(t, near), 6).alias("shade"), half_up(tags.novelty_score(t, scenery), 6).alias("novelty"))
