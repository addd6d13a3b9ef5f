"""Spatial joins at every latitude and across the date line, against plain double loops."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from ridgeline.functions.cost import edge_cost_arrays
from ridgeline.functions.geo import haversine_m, project_on_segment
from ridgeline.operators import graph, grid, profiles, routes, search, store
from ridgeline.plans.projection import views
from ridgeline.plans.search_queries import requests
from tests.conftest import SF
from tests.test_search import arrays, edges  # noqa: F401  (a fixture)


def far(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371000 * math.asin(math.sqrt(min(1, h)))


PLACES = [(0.0, 0.0), (50.0, 8.0), (65.0, -150.0), (-85.0, 20.0), (89.9, 0.0), (-89.99, 100.0), (12.0, 179.999), (66.0, -179.999)]


def around(place, n, seed, spread=1500):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        lat = max(-90.0, min(90.0, place[0] + rng.uniform(-spread, spread) / 111195))
        lng = place[1] + rng.uniform(-spread, spread) / 111195 / max(math.cos(math.radians(lat)), 1e-6)
        out.append((lat, (lng + 180) % 360 - 180))
    return out


def test_near_join_everywhere(spark):
    points = [(i, *p) for i, p in enumerate(p for k, place in enumerate(PLACES) for p in around(place, 60, k))]
    targets = [(i, *p) for i, p in enumerate(p for k, place in enumerate(PLACES) for p in around(place, 60, 100 + k))]
    want = {(a[0], b[0]) for a in points for b in targets if far(a[1:], b[1:]) <= 700}
    found = graph.near_join(spark.createDataFrame(points, "p long, lat double, lng double"), spark.createDataFrame(targets, "t long, to_lat double, to_lng double"), 700)
    rows = [(r["p"], r["t"]) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and len(want) > 1000


def test_nearest_has_no_limit(spark):
    points = [(i, *p) for i, p in enumerate(PLACES)]
    nodes = [(i, *p) for i, p in enumerate([(48.0, 2.0), (48.0, 2.001), (-33.0, 151.0), (12.0, -179.99)])]
    found = graph.nearest(spark.createDataFrame(points, "p long, lat double, lng double"), spark.createDataFrame(nodes, "node_id long, lat double, lng double"), "p")
    assert {r["p"]: r["node_id"] for r in found.collect()} == {p[0]: min(nodes, key=lambda n: (round(far(p[1:], n[1:]), 3), n[0]))[0] for p in points}
    none = graph.nearest(spark.createDataFrame(points, "p long, lat double, lng double"), spark.createDataFrame([], "node_id long, lat double, lng double"), "p")
    assert none.count() == 0


def test_anchors_find_long_edges(spark):
    """An edge counts by its nearest place, even if both its ends are far away."""
    rows = [(1, 1, 2, 50.0, 7.9, 50.0, 8.1, 0.0, "path"), (2, 3, 4, 50.0025, 8.0, 50.003, 8.0, 0.0, "path"), (3, 5, 6, 50.0, 8.0, 50.0, 8.0, 0.0, "connector"), (4, 7, 8, 51.0, 8.0, 51.0, 8.1, 0.0, "path")]
    e = spark.createDataFrame(rows, "edge_id long, src long, dst long, lat1 double, lng1 double, lat2 double, lng2 double, elevation_gain_m double, road_type string")
    found = graph.anchors(e, spark.createDataFrame([(1, 50.0, 8.0)], "k long, lat double, lng double"), "k").orderBy("rank").collect()
    assert [r["edge_id"] for r in found] == [1, 2, 4] and found[0]["metres"] == pytest.approx(0, abs=1e-6) and found[0]["snap_lng"] == pytest.approx(8.0)


def test_anchors_equal_a_full_scan(spark):
    rng = random.Random(5)
    for k, place in enumerate([(0.0, 0.0), (50.0, 8.0), (65.0, -150.0), (85.0, 20.0)]):
        ends = list(zip(around(place, 40, k, 3000), around(place, 40, 50 + k, 3000)))
        e = spark.createDataFrame([(i, i, i, *a, *b, 0.0, "path") for i, (a, b) in enumerate(ends)], "edge_id long, src long, dst long, lat1 double, lng1 double, lat2 double, lng2 double, elevation_gain_m double, road_type string")
        points = spark.createDataFrame([(i, *p) for i, p in enumerate(around(place, 5, 90 + rng.randrange(9), 2000))], "k long, lat double, lng double")
        away = project_on_segment(F.col("lat"), F.col("lng"), F.col("lat1"), F.col("lng1"), F.col("lat2"), F.col("lng2"))[2]
        every = points.crossJoin(e).withColumn("m", away).collect()
        want = {(p, r["edge_id"]) for p in range(5) for r in sorted((r for r in every if r["k"] == p), key=lambda r: (r["m"], r["edge_id"]))[:6]}
        assert {(r["k"], r["edge_id"]) for r in graph.anchors(e, points, "k", 200).collect()} == want


def test_large_green_features_and_long_segments(spark):
    points = spark.createDataFrame([(1, 50.0, 8.0), (2, 50.0, 9.0)], "node_id long, lat double, lng double")
    square = spark.createDataFrame([(1, "park", 50.3, 8.3, 0.31), (2, "water", 50.0, 8.003, 0.0005)], "ord long, kind string, lat double, lng double, half double")
    found = {r["node_id"]: r for r in graph.green_scores(points, square, "node_id").collect()}
    assert set(found) == {1} and found[1]["park_near"] == 1.0 and 0 < found[1]["scenery_near"] <= 1
    corner = lambda lat, lng: {"lat": lat, "lng": lng}
    ring = spark.createDataFrame([(1, "park", [corner(49.9, 7.9), corner(49.9, 9.1), corner(50.1, 9.1), corner(50.1, 7.9)]), (2, "water", [corner(50.0, 8.0005), corner(50.2, 8.0005)])], "ord long, kind string, geometry array<struct<lat: double, lng: double>>")
    found = {r["node_id"]: r for r in graph.green_scores(points, ring, "node_id").collect()}
    assert found[1]["park_near"] == found[2]["park_near"] == 1.0 and found[1]["scenery_near"] > found[2]["scenery_near"] == 0.82
    path = spark.createDataFrame([(1, k, 50.0, 7.8 + 0.2 * k) for k in range(6)], "route_id long, seq long, lat double, lng double")
    roads = spark.createDataFrame([(7, 1, 100.0), (8, 2, 50.0)], "edge_id long, src long, distance_m double")
    nodes = spark.createDataFrame([(1, 50.0002, 7.93), (2, 50.001, 7.93)], "node_id long, lat double, lng double")
    assert [tuple(r) for r in profiles.corridor_penalties(path, nodes, roads).collect()] == [(1, 7, 1500.0)]


def test_segments_by_distance(spark):
    line = lambda *p: [{"lat": a, "lng": b} for a, b in p]
    given = [(1, line((50.0, 8.0), (50.0, 9.0))), (2, line((50.003, 8.5))), (3, line((50.01, 8.5), (50.02, 8.5))), (4, [])]
    segments = spark.createDataFrame(given, "segment_id long, geometry array<struct<lat: double, lng: double>>")
    asked = spark.createDataFrame([(1, 50.001, 8.5)], "request_id long, lat double, lng double")
    assert [r["segment_id"] for r in store.nearby_segments(asked, segments, 0.5).orderBy("rank").collect()] == [1, 2]
    assert [r["segment_id"] for r in store.nearby_segments(asked, segments, 5, 1).collect()] == [1]


@pytest.mark.parametrize("lat", [0.0, 60.0, 85.0])
def test_tiles_hold_the_whole_reach(spark, lat):
    """A request near a tile's edge sees all edges within its radius."""
    rng = random.Random(int(lat))
    lng_metre = 1 / (111195 * math.cos(math.radians(lat)))
    places = [(lat + rng.uniform(-19_000, 19_000) / 111195, 10 + rng.uniform(-19_000, 19_000) * lng_metre) for _ in range(300)]
    want = {i for i, p in enumerate(places) if far((lat, 10.0), p) <= 20_000}
    at = (F.col("lat"), F.col("lng"))
    cells = grid.spread(spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "i long, lat double, lng double"), at + at, search.TILE_M, grid.height(search.TILE_M), "tile")
    own = spark.createDataFrame([(lat, 10.0)], "a double, b double").select(grid.cell(F.col("a"), F.col("b"), grid.height(search.TILE_M)).alias("tile"))
    assert want <= {r["i"] for r in cells.join(own, "tile").collect()}


def test_shape_of_routes_in_both_forms(spark, edges):  # noqa: F811
    """The kernel's shape of a loop is what the DataFrame form computes of its points."""
    e, found = arrays(edges), []
    for x in requests(spark, SF).where("route_type = 'loop'").collect():
        r = x.asDict()
        g = search.RoadGraph(e, *edge_cost_arrays(e, r))
        found = found or [(g, f) for f in search.loops(g, g.nearest(r["start_lat"], r["start_lng"]), r)[:5]]
    rows, shapes = [], {}
    for i, (g, (_, p, _)) in enumerate(found):
        stops = [int(g.src[p[0]]), *map(int, g.dst[p])]
        rows += [(i, k, float(g.lat[n]), float(g.lng[n]), g.length(p)) for k, n in enumerate(stops)]
        shapes[i] = search.shape(g, p, g.slope, 0.14)
    assert shapes
    for row in routes.loop_shape(spark.createDataFrame(rows, "route_id long, seq long, lat double, lng double, metres double")).collect():
        for c in ("compactness", "coverage", "backtrack"):
            assert row[c] == pytest.approx(shapes[row["route_id"]][c], abs=1e-6)


def test_waypoint_sets(spark, edges):  # noqa: F811
    """Pairs and triples in the kernel are those of the definition; few sets call for the rings around the start."""
    e = arrays(edges)
    r = requests(spark, SF).where("route_type = 'loop'").first().asDict()
    g = search.RoadGraph(e, *edge_cost_arrays(e, r))
    for start in (90, 105, 60):
        for km in (2.0, 3.0, 6.0):
            sets = search.waypoint_sets(g, start, km)
            assert [t for t, *_ in sets] == sorted(t for t, *_ in sets)
            towards = g.bearings(start, range(len(g.nodes)))
            for tier, strategy, nodes in sets:
                assert start not in nodes and len(set(nodes)) == len(nodes) and search.apart(towards[nodes[0]], towards[nodes[1]])
                assert (strategy == "park") == (len(nodes) == 3) and 1 <= tier <= 5
            if any(t == search.FALLBACK_TIER for t, *_ in sets):
                assert sum(t < search.FALLBACK_TIER for t, *_ in sets) < search.LEAST_SETS


def test_the_way_home_avoids_the_way_out(spark, edges):  # noqa: F811
    """Legs are the cheapest under penalties: the closing one by a plain search without bounds."""
    e = arrays(edges)
    r = requests(spark, SF).where("route_type = 'loop'").first().asDict()
    g = search.RoadGraph(e, *edge_cost_arrays(e, r))
    start, out, home = 90, g.search(90)[2], g.costs_to(90)
    for to, then in ((12, 150), (30, 111), (130, 55)):
        leg = search._first_leg(g, out, start, to)
        if leg is None:
            continue
        edges_, _ = search._closed(g, start, (to, then), leg, home)
        penalty = leg[2].copy()
        second = g.path(leg[4], to, then)
        g.penalised(second, search.LEG_PENALTY, penalty)
        total = penalty * search.RETURN_SCALE + leg[3]
        best = g.search(then, penalty=total)[0][start]
        last = g.route(then, start, total, bound=home)
        assert (g.cost + total[g.group])[last].sum() == pytest.approx(best)
        near = {int(n) for n in leg[0] for n in (g.src[n], g.dst[n])}
        assert leg[3].sum() > 0 and near


def test_costs_to_are_bounds(spark, edges):  # noqa: F811
    e = arrays(edges)
    r = requests(spark, SF).first().asDict()
    g = search.RoadGraph(e, *edge_cost_arrays(e, r))
    back = g.costs_to(17)
    for a in (0, 50, 120):
        assert back[a] == pytest.approx(g.search(a, 17)[0][17])


def test_haversine_of_the_globe(spark):
    row = spark.range(1).select(haversine_m(F.lit(12.0), F.lit(179.9999), F.lit(12.0), F.lit(-179.9999)).alias("m")).first()
    assert row["m"] == pytest.approx(far((12.0, 179.9999), (12.0, -179.9999)))


@pytest.mark.parametrize("most", [1, 4])
def test_nearest_by_the_pyramid(spark, most):
    """Points anywhere, far from clusters, at the poles and across the date line find their nearest targets."""
    import math
    import random

    from ridgeline.operators import graph, pyramid

    rng = random.Random(most)
    clusters = [(40.0, -105.2), (-33.0, 179.99), (89.9, 10.0), (0.0, -180.0), (-89.99, 100.0)]
    nodes = [(i, max(-90.0, min(90.0, a + rng.uniform(-0.2, 0.2))), b + rng.uniform(-0.2, 0.2)) for i in range(150) for a, b in [rng.choice(clusters)]] + [(500, 40.0, -105.2), (501, 40.0, -105.2)]
    points = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(60)] + [(100, 90.0, 0.0), (101, -90.0, 5.0), (102, 0.0, 180.0), (103, 40.0, -105.2), (104, -33.0, -179.95), (105, None, 1.0)]

    def metres(a, b, c, d):
        h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * 6371000 * math.asin(math.sqrt(min(1.0, h)))

    n = spark.createDataFrame(nodes, "node_id long, lat double, lng double").repartition(3)
    p = spark.createDataFrame(points, "request_id long, lat double, lng double").repartition(3)
    pairs = pyramid.nearest_pairs(p, n.selectExpr("node_id", "lat AS to_lat", "lng AS to_lng"), "request_id", most).collect()
    near = {}
    for r in pairs:
        near.setdefault(r["request_id"], []).append(r["metres"])
    ranked = {(r["request_id"], r["rank"]): r["metres"] for r in graph.nearest_k(p, n, "request_id", most).collect()}
    for key, lat, lng in points:
        want = sorted(metres(lat, lng, b, c) for _, b, c in nodes)[:most] if lat is not None else []
        assert sorted(near.get(key, []))[:most] == pytest.approx(want, abs=0.01)
        assert [ranked[key, k + 1] for k in range(len(want))] == pytest.approx(want, abs=0.01)
    assert graph.nearest(p, n.limit(0), "request_id").count() == 0


def test_far_points_read_few_rows(spark):
    """A point at sea reads a handful of the ten thousand targets of a town."""
    from ridgeline.operators import pyramid

    town = spark.range(10_000).selectExpr("id AS node_id", "40 + (id % 100) * 0.001 AS to_lat", "-105 + floor(id / 100) * 0.001 AS to_lng")
    sea = spark.createDataFrame([(1, 0.0, -30.0), (2, -60.0, 150.0)], "request_id long, lat double, lng double")
    assert pyramid.nearest_pairs(sea, town, "request_id", 4).count() <= 600


def test_places_are_answered_once(spark):
    """However many points a place has, the search sees it once; points without a place have no row."""
    p = spark.range(2000).selectExpr("id AS k", "CASE WHEN id % 4 < 3 THEN 40 + (id % 4) / 10D END AS lat", "-105D AS lng")
    seen = []

    def find(places):
        seen.append(places.count())
        return places.select("k", F.explode(F.array(F.lit(1), F.lit(2))).alias("x"), (F.col("lat") * 10).alias("y"))

    rows = graph.answered(p, "k", find).collect()
    assert seen == [3] and len(rows) == 1500 * 2
    assert all(round(r["y"] - 400) == r["k"] % 4 for r in rows) and len({(r["k"], r["x"]) for r in rows}) == 3000


@pytest.mark.parametrize("ask", ["nearest", "nearest_k", "anchors"])
def test_search_works_on_places(spark, monkeypatch, ask):
    """What the joins on cells are given grows with the places, not with the points."""
    p = spark.range(500).selectExpr("id AS k", "40 + (id % 5) * 0.001D AS lat", "-105D AS lng")
    n = spark.range(30).selectExpr("id AS node_id", "40 + id * 0.0004D AS lat", "-105.001D AS lng")
    e = n.selectExpr("node_id AS edge_id", "node_id AS src", "node_id + 1 AS dst", "lat AS lat1", "lng AS lng1", "lat + 0.0004D AS lat2", "lng AS lng2", "0D AS elevation_gain_m", "'trail' AS road_type")
    sizes = []
    for name in ("near_join", "box_join"):
        own = getattr(graph, name)
        monkeypatch.setattr(graph, name, lambda points, *a, own=own: sizes.append(points.count()) or own(points, *a))
    found = graph.anchors(e, p, "k") if ask == "anchors" else graph.nearest(p, n, "k") if ask == "nearest" else graph.nearest_k(p, n, "k", 4)
    assert found.count() == 500 * {"nearest": 1, "nearest_k": 4, "anchors": 6}[ask] and set(sizes) == {5}


def test_features_of_one_shape_meet_a_point_once_for_each_rank(spark, monkeypatch):
    """A thousand features of one shape count by their first five; the join is not given more."""
    f = spark.range(1000).selectExpr("id AS ord", "CASE WHEN id < 2 THEN 'water' WHEN id = 4 THEN 'woods' ELSE 'green' END AS kind", "40D AS lat", "-105D AS lng", "0.0004D AS half")
    n = spark.createDataFrame([(1, 40.0, -105.0)], "node_id long, lat double, lng double")
    own, given = graph.box_join, []
    monkeypatch.setattr(graph, "box_join", lambda points, shapes, *a: given.append(shapes.count()) or own(points, shapes, *a))
    (r,) = graph.green_scores(n, f, "node_id").collect()
    assert given == [5] and (r["park_near"], r["shade_near"], r["scenery_near"]) == (1.0, 1.0, 1.0)
