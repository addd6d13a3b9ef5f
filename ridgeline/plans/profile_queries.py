"""Queries over elevation profiles, corridors and request pieces."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridgeline.functions.geo import half_up, num
from ridgeline.operators import profiles
from ridgeline.plans.projection import half_up_sql, haversine_sql, views
from ridgeline.plans.registry import query

C = F.col
_UPTO = "(PARTITION BY route_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
PROFILE = f"""(SELECT route_id, seq, {half_up_sql('m / 10')} / 100e0 AS km, {half_up_sql('coalesce(known + g - last_value(CASE WHEN to_elev IS NOT NULL THEN g END IGNORE NULLS) OVER u, start + g)')} AS elev FROM
    (SELECT *, last_value(to_elev IGNORE NULLS) OVER u AS known, coalesce(first_value(from_elev IGNORE NULLS) OVER (PARTITION BY route_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0e0) AS start,
     sum(distance_m) OVER u AS m, CAST(sum(CAST(floor(elevation_gain_m * 10 + 0.5e0) AS bigint)) OVER u AS bigint) / 10e0 AS g FROM
     (SELECT *, CASE WHEN edge_key % 4 = 0 THEN CAST(edge_key % 300 AS double) END AS to_elev, CASE WHEN edge_key % 4 = 1 THEN CAST(edge_key % 200 AS double) END AS from_elev FROM v_route_edge) WINDOW u AS {_UPTO}) WINDOW u AS {_UPTO})"""


def _profile(spark, sf_dir):
    (e,) = views(spark, sf_dir, "v_route_edge")
    k = C("edge_key")
    e = e.withColumns({"to_elev": F.when(k % 4 == 0, (k % 300).cast("double")), "from_elev": F.when(k % 4 == 1, (k % 200).cast("double"))})
    return profiles.elevation_profile(e)


@query(f"SELECT route_id, seq, km, elev FROM {PROFILE}")
def elevation_profile(spark, sf_dir):
    return _profile(spark, sf_dir)


@query(
    f"""SELECT route_id, seq, CASE WHEN last > 0 THEN {half_up_sql('km * (route_id % 50 + 1) / last', 2)} ELSE km END AS km, elev FROM (SELECT *, max(km) OVER (PARTITION BY route_id) AS last FROM {PROFILE})"""
)
def scaled_profile(spark, sf_dir):
    p = _profile(spark, sf_dir)
    return profiles.scaled_profile(p, p.select("route_id").distinct().withColumn("length_km", (C("route_id") % 50 + 1).cast("double")))


_SEG = "(SELECT user_id AS route_id, lat AS a, lng AS b, lead(lat) OVER w AS c, lead(lng) OVER w AS d, row_number() OVER w AS k, count(*) OVER (PARTITION BY user_id) AS n FROM v_walk WINDOW w AS (PARTITION BY user_id ORDER BY seq))"
_T = "least(greatest(-(x1 * (x2 - x1) + y1 * (y2 - y1)) / nullif((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1), 0), 0e0), 1e0)"
WALK = "(SELECT user_id, seq, 40e0 + (seq % 60) * 0.0005e0 AS lat, -105.27e0 + (user_id % 40) * 0.0012e0 + (seq % 5) * 0.0006e0 AS lng FROM v_track )"


@query(
    f"""WITH v_walk AS {WALK}, s AS (SELECT * FROM {_SEG} WHERE k < least(n, greatest(2, floor(n * 0.4e0)))),
        h AS (SELECT DISTINCT route_id, node_id FROM (SELECT *, sqrt(pow(x1 + (x2 - x1) * {_T}, 2) + pow(y1 + (y2 - y1) * {_T}, 2)) AS km FROM
          (SELECT s.route_id, n.node_id, (b - n.lng) * 111.32e0 * cos(radians(n.lat)) AS x1, (a - n.lat) * 111.32e0 AS y1, (d - n.lng) * 111.32e0 * cos(radians(n.lat)) AS x2, (c - n.lat) * 111.32e0 AS y2
           FROM s JOIN v_node n ON abs(n.lat - a) < 0.004 AND abs(n.lng - b) < 0.005)) WHERE km * 1000 < 45)
        SELECT h.route_id, e.edge_id, sum(e.distance_m) * 15 AS penalty FROM h JOIN (SELECT src, edge_id, distance_m FROM v_edge UNION ALL SELECT dst, edge_id, distance_m FROM v_edge) e ON e.src = h.node_id GROUP BY h.route_id, e.edge_id"""
)
def corridor_penalty(spark, sf_dir):
    t, n, e = views(spark, sf_dir, "v_track", "v_node", "v_edge")
    walk = t.select(C("user_id").alias("route_id"), "seq", (num(40) + (C("seq") % 60) * num(0.0005)).alias("lat"), (num(-105.27) + (C("user_id") % 40) * num(0.0012) + (C("seq") % 5) * num(0.0006)).alias("lng"))
    ends = e.select(F.explode(F.array("src", "dst")).alias("src"), "edge_id", "distance_m")
    return profiles.corridor_penalties(walk, n, ends)


_SPOT = "printf('%.4f,%.4f', lat, lng)"


@query(
    f"""WITH p AS (SELECT e.*, s.user_id AS request_id FROM v_route_edge e JOIN v_saved s ON s.route_key = e.route_id),
        g AS (SELECT DISTINCT request_id, route_id, least(a, b) || '|' || greatest(a, b) AS segment FROM (SELECT request_id, route_id, {_SPOT} AS a, lead({_SPOT}) OVER (PARTITION BY request_id, route_id ORDER BY seq) AS b FROM p) WHERE b IS NOT NULL),
        n AS (SELECT request_id, route_id, count(*) AS n FROM g GROUP BY ALL)
        SELECT x.request_id, x.route_id AS a, y.route_id AS b, count(*) / CAST(least(any_value(m.n), any_value(k.n)) AS double) AS overlap FROM g x JOIN g y ON x.request_id = y.request_id AND x.segment = y.segment AND x.route_id < y.route_id
        JOIN n m ON m.request_id = x.request_id AND m.route_id = x.route_id JOIN n k ON k.request_id = y.request_id AND k.route_id = y.route_id GROUP BY x.request_id, x.route_id, y.route_id"""
)
def geometry_overlap(spark, sf_dir):
    e, s = views(spark, sf_dir, "v_route_edge", "v_saved")
    return profiles.geometry_overlap(e.join(s.select(C("route_key").alias("route_id"), C("user_id").alias("request_id")), "route_id"), "request_id", "route_id")


_AWAY = half_up_sql(haversine_sql("lat0", "lng0", "lat", "lng"), 3)


@query(
    f"""SELECT user_id, point_key, metres, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY metres, point_key) AS place FROM
        (SELECT user_id, printf('%.6f,%.6f', lat, lng) AS point_key, min({_AWAY}) AS metres FROM (SELECT *, 40.01e0 AS lat0, -105.26e0 AS lng0 FROM v_track) GROUP BY ALL)) WHERE place <= 25"""
)
def elevation_points(spark, sf_dir):
    (t,) = views(spark, sf_dir, "v_track")
    return profiles.first_points(t.withColumns({"lat0": num(40.01), "lng0": num(-105.26)}), "user_id", 25)


@query("SELECT n_nationkey AS id, n_name AS name FROM nation WHERE contains(lower(n_name), 'on_1') ORDER BY length(n_name), n_name LIMIT 6")
def search_places(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(C("n_nationkey").alias("id"), C("n_name").alias("name"))
    return profiles.search_places(n, " ON_1 ")


@query(
    """SELECT node_id, CASE WHEN node_id % 4 <> 0 AND node_id % 5 <> 0 THEN lat END AS south, CASE WHEN node_id % 4 <> 0 AND node_id % 5 <> 0 THEN lng + 1 END AS east FROM v_node"""
)
def parse_boxes(spark, sf_dir):
    (n,) = views(spark, sf_dir, "v_node")
    number = lambda c: c.cast("string")
    text = F.concat_ws(", ", number(C("lat")), number(C("lng")), number(C("lat") + F.when(C("node_id") % 4 == 0, -1).otherwise(1)), F.when(C("node_id") % 5 == 0, F.lit("x")).otherwise(number(C("lng") + 1)))
    box = profiles.parse_box(text)
    return n.select("node_id", box["south"].alias("south"), box["east"].alias("east"))


@query("SELECT route_key, CASE WHEN route_key % 3 <> 0 THEN strftime(saved_at, '%Y-%m-%dT%H:%M:%SZ') END AS iso FROM v_saved")
def iso_times(spark, sf_dir):
    (s,) = views(spark, sf_dir, "v_saved")
    text = F.when(C("route_key") % 3 == 0, F.date_format("saved_at", "yyyy-MM-dd")).otherwise(F.date_format("saved_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return s.select("route_key", profiles.iso_time(text).alias("iso"))


@query(f"SELECT user_id, {half_up_sql('41e0 + arg_max(lat, seq) - arg_min(lat, seq)', 6)} AS lat, {half_up_sql('-100e0 + arg_max(lng, seq) - arg_min(lng, seq)', 6)} AS lng FROM v_track GROUP BY user_id")
def moved_routes(spark, sf_dir):
    (t,) = views(spark, sf_dir, "v_track")
    lines = t.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("seq", "lat", "lng"))).alias("p"))
    last = F.element_at(profiles.moved_to(C("p"), num(41), num(-100)), -1)
    return lines.select("user_id", half_up(last["lat"], 6).alias("lat"), half_up(last["lng"], 6).alias("lng"))
