"""Search kernels against plain definitions."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.functions.cost import edge_cost, edge_cost_arrays, node_quality, with_ground_weights
from ridgeline.operators import graph, search
from ridgeline.plans.projection import views
from ridgeline.plans.search_queries import requests
from tests.conftest import SF


@pytest.fixture(scope="module")
def edges(spark):
    return with_ground_weights(graph.both_ways(views(spark, SF, "v_edge")[0])).toPandas()


def arrays(part):
    e = {c: part[c].to_numpy() for c in search.EDGE_COLUMNS}
    return e | {c: e[c].astype(float) for c in ("elevation_gain_m", "slope", "novelty_score", "traffic_exposure")}


def test_both_cost_forms_agree(spark, edges):
    e = views(spark, SF, "v_edge")[0]
    asked = requests(spark, SF).limit(40).collect()
    plain = arrays(edges[edges["forward"]])
    order = np.argsort(plain["edge_id"])
    for r in asked:
        p = {k: F.lit(v) for k, v in r.asDict().items()}
        columns = {c: F.col(c) for c in e.columns}
        rows = e.select("edge_id", edge_cost(columns, p).alias("c"), node_quality(columns, p).alias("q")).orderBy("edge_id").collect()
        cost, worth = edge_cost_arrays(plain, r.asDict())
        assert cost[order] == pytest.approx([x["c"] for x in rows], abs=1e-9) and worth[order] == pytest.approx([x["q"] for x in rows], abs=1e-9)
        assert (cost >= 0.2 * plain["distance_m"] - 1e-9).all()


@pytest.fixture(scope="module")
def road(edges):
    e = arrays(edges)
    return search.RoadGraph(e, np.where(e["access_allowed"].astype(bool), e["distance_m"], np.inf), e["park_score"])


def brute(g, start):
    cost = [math.inf] * len(g.nodes)
    cost[start] = 0.0
    for _ in g.nodes:
        for s, d, c in zip(g.src, g.dst, g.cost):
            cost[d] = min(cost[d], cost[s] + c)
    return np.array(cost)


def test_search_is_optimal(road):
    want = brute(road, 3)
    cost, _, last = road.search(3)
    assert cost == pytest.approx(want)
    for end in (0, 57, len(road.nodes) - 1):
        path = road.route(3, end)
        assert road.cost[path].sum() == pytest.approx(want[end]) and road.src[path[0]] == 3 and road.dst[path[-1]] == end
        assert all(road.dst[a] == road.src[b] for a, b in zip(path, path[1:]))
    assert road.path(last, 3, 3) == []


def test_k_shortest(road):
    paths = search.k_shortest(road, 0, 42, 4)
    costs = [road.cost[p].sum() for p in paths]
    assert costs == sorted(costs) and costs[0] == pytest.approx(brute(road, 0)[42])
    assert len({tuple(p) for p in paths}) == len(paths) == 4
    for p in paths:
        stops = [road.src[p[0]], *road.dst[p]]
        assert len(set(stops)) == len(stops)


def test_diverse_paths_differ(road):
    paths = search.diverse_paths(road, 0, 81, 4)
    assert len(paths) >= 2 and all(tuple(a) != tuple(b) for a, b in itertools.combinations(paths, 2))


def test_spurs_are_removed(road):
    path = road.route(0, 5)
    there_and_back = road.route(5, 6)
    assert search.without_spurs(road, path + there_and_back + road.back(there_and_back)) == path
    assert search.without_spurs(road, path + road.back(path)) == []


def test_out_and_back_returns(road):
    for _, p in search.out_and_back(road, 10, 1500.0):
        half = len(p) // 2
        assert road.src[p[0]] == road.dst[p[-1]] == 10 and [road.edge[e] for e in p[:half]] == [road.edge[e] for e in p[half:]][::-1]


def test_generated_routes_join_up(spark):
    e = graph.both_ways(views(spark, SF, "v_edge")[0])
    routes = search.generate_routes(requests(spark, SF), e, together=7).join(e.select("edge_id", "forward", "src", "dst"), ["edge_id", "forward"]).toPandas()
    kinds = {r["request_id"]: r["route_type"] for r in requests(spark, SF).collect()}
    assert len(routes)
    for (request, _), own in routes.groupby(["request_id", "route"]):
        own = own.sort_values("seq")
        assert own["seq"].tolist() == list(range(1, len(own) + 1)) and (own["dst"].to_numpy()[:-1] == own["src"].to_numpy()[1:]).all()
        if kinds[request] != "point_to_point":
            assert own["src"].iloc[0] == own["dst"].iloc[-1]


def test_a_busy_tile_is_dealt_into_chunks(spark):
    e = graph.both_ways(views(spark, SF, "v_edge")[0])
    one, many = (search.generate_routes(requests(spark, SF), e, together=k).orderBy("request_id", "route", "seq").collect() for k in (1000, 5))
    assert one == many


def test_generated_loops_keep_their_shape(spark, edges):
    asked = [r.asDict() for r in requests(spark, SF).where("route_type = 'loop'").collect()]
    seen = 0
    for r in asked[:25]:
        e = arrays(edges)
        g = search.RoadGraph(e, *edge_cost_arrays(e, r))
        found = search.loops(g, g.nearest(r["start_lat"], r["start_lng"]), r)
        for _, p, score in found:
            assert 0 <= score <= 100
            f = search.shape(g, p, g.slope, 0.14)
            assert f["overlap"] <= 0.15 and f["dead_ends"] == 0 and f["compactness"] >= 0.025 and g.src[p[0]] == g.dst[p[-1]]
        seen += len(found)
    assert seen


def test_shape_of_a_square(road):
    around = [road.route(a, b)[0] for a, b in ((0, 1), (1, 41), (41, 40), (40, 0))]
    f = search.shape(road, around, road.slope, 1.0)
    assert f["overlap"] == 0 and f["backtrack"] == 0 and f["compactness"] == pytest.approx(0.785, abs=0.02)
    there = road.route(0, 5)
    back = search.shape(road, there + road.back(there), road.slope, 1.0)
    assert back["overlap"] == 1 and back["compactness"] == 0 and back["backtrack"] > 0


@pytest.mark.parametrize("block_nodes", [1000, 7])
def test_costs_over_blocks_are_least(spark, block_nodes):
    """Float costs, two sources, closed and missing ways, a node that none reaches: as plain relaxation finds."""
    rng = np.random.default_rng(5)
    rows = [(int(a), int(b), float(c)) for a, b, c in zip(rng.integers(0, 40, 130), rng.integers(0, 40, 130), rng.random(130))] + [(1, 90, math.inf), (2, 91, None), (70, 71, 1.0)]
    got = search.shortest_costs(spark.createDataFrame(rows, "src long, dst long, cost double"), spark.createDataFrame([(5, 3), (6, 70), (7, 200)], "source long, node_id long"), block_nodes).collect()
    want = {}
    for source, start in ((5, 3), (6, 70), (7, 200)):
        best = {start: 0.0}
        for _ in range(60):
            for a, b, c in rows:
                if a in best and c is not None and c < math.inf:
                    best[b] = min(best.get(b, math.inf), best[a] + c)
        want |= {(source, n): c for n, c in best.items()}
    assert {(r["source"], r["node_id"]): r["cost"] for r in got} == want and len(got) == len(want)


def test_rounds_follow_blocks(spark, monkeypatch):
    """A path of 3,000 edges over three blocks takes few rounds."""
    made = []
    own = search._settled
    monkeypatch.setattr(search, "_settled", lambda bounds: made.append(1) or own(bounds))
    e = spark.range(3000).selectExpr("id AS src", "id + 1 AS dst", "1D AS cost")
    found = search.shortest_costs(e.union(e.select("dst", "src", "cost")), spark.createDataFrame([(0, 0)], "source long, node_id long"), 1001)
    assert {r["node_id"]: r["cost"] for r in found.collect()} == {n: float(n) for n in range(3001)} and len(made) <= 6
