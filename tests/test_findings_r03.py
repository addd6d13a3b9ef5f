"""What the findings of round 3 ask for, on tables small enough for a test."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ridgeline.operators import profiles, store
from ridgeline.operators.payloads import read_routes
from ridgeline.plans import search_queries
from ridgeline.sources import long_tracks, overpass, sinks, synthetic


def test_a_repeated_commit_makes_no_tables(spark, tmp_path):
    """the second call neither reads nor draws anything."""
    made = []

    def tables():
        made.append(1)
        return {"t": spark.range(3)}

    root = f"file://{tmp_path}"
    assert sinks.commit(root, "only", tables) and not sinks.commit(root, "only", tables)
    assert made == [1] and sinks.committed(spark, root, "t", "id long").count() == 3


def test_payloads_are_read_by_many_tasks(spark):
    """a table of one split is read by more than one task."""
    sound = {"id": "a", "source": "x", "name": "n", "activity": "running", "distanceKm": 1, "estimatedDurationMin": 2, "elevationGainM": 3, "geometry": [{"lat": 1, "lng": 2}, {"lat": 3, "lng": 4}]}
    rows = spark.range(64, numPartitions=1).withColumn("payload", F.lit(json.dumps(sound)))
    read = read_routes(rows)
    assert read.rdd.getNumPartitions() >= 8 and read.where("error IS NULL AND distance_km = 1").count() == 64


def test_read_candidates_are_not_read_again(spark):
    """batches of candidates that were read already."""
    sound = {"id": "a", "source": "x", "name": "n", "activity": "running", "distanceKm": 1, "estimatedDurationMin": 2, "elevationGainM": 3, "geometry": [{"lat": 1, "lng": 2}, {"lat": 3, "lng": 4}]}
    rows = spark.createDataFrame([(1, json.dumps(sound)), (1, json.dumps(sound))], "request_id long, payload string")
    asked = spark.createDataFrame([(1, "{}"), (2, "{}")], "request_id long, preferences string")
    drop = lambda t: sorted(map(str, t["batches"].drop("batch_id").collect())) + sorted(map(str, t["candidates"].drop("batch_id").collect()))
    assert drop(sinks.batch_tables(asked, read_routes(rows))) == drop(sinks.batch_tables(asked, rows))


def test_ring_graphs_are_made_once_a_place(spark, monkeypatch):
    """requests that start at one place share a graph, each reaching as far as its own target."""
    made = []
    own = synthetic.ring_graph_of
    monkeypatch.setattr(synthetic, "ring_graph_of", lambda places: made.append(places.count()) or own(places))
    asked = spark.range(90).selectExpr("id AS request_id", "40.0 AS start_lat", "-105.0D AS start_lng", "IF(id % 3 = 0, 20D, 5D) AS target_km").withColumn("start_lat", F.col("start_lat").cast("double"))
    counts = {r["request_id"]: r["n"] for r in synthetic.ring_graph(asked).groupBy("request_id").agg(F.count("*").alias("n")).collect()}
    one = {t: synthetic.ring_graph(asked.where(f"request_id = {i}")).count() for t, i in (("far", 0), ("near", 1))}
    assert made[0] == 2 and len(counts) == 90 and one["far"] > one["near"] and all(n == one["near" if k % 3 else "far"] for k, n in counts.items())


def test_long_ways_are_split_in_one_pass(spark):
    """F16: a way of 30,000 points, cut at given nodes and by length, as a plain fold cuts it; a missing place ends the cuts."""
    n = 30_000
    rows = [(1, list(range(n)), [(i * 0.0004, 0.0) for i in range(n)]), (2, [0, 7, 2], [(0.0, 0.0), (0.00001, 0.0), (0.001, 0.0)]), (3, [1, 2, 3], [(0.0, 0.0), (None, 0.0), (0.01, 0.0)]), (4, [1], [(0.0, 0.0)])]
    ways = spark.createDataFrame(rows, "id long, nodes array<long>, geometry array<struct<lat: double, lng: double>>")
    got = sorted((r["id"], r["from_i"], r["to_i"]) for r in overpass.split_ways(ways, spark.createDataFrame([(k,) for k in range(0, n, 7)], "node long")).collect())
    want, start = [], 0
    for i in range(1, n):
        if i % 7 == 0 or i == n - 1 or (i - start) * 44.47797 >= 280:
            want.append((1, start, i))
            start = i
    assert got == want + [(2, 0, 2)]


def test_equal_questions_are_searched_once(spark):
    """F8: requests of one question, nulls included, share the answer of the first; a question without an answer has no row."""
    asked = spark.createDataFrame([(1, 1.0, "a"), (2, 1.0, "a"), (3, 1.0, "b"), (4, None, "a"), (5, None, "a"), (6, 9.0, "a")], "request_id long, lat double, activity string")
    seen = []

    def find(requests):
        seen.extend(r["request_id"] for r in requests.collect())
        return requests.where("request_id <> 6").selectExpr("request_id", "request_id * 10D AS metres")

    got = {r["request_id"]: r["metres"] for r in search_queries.asked_once(asked, ("lat", "activity"), find).collect()}
    assert sorted(seen) == [1, 3, 4, 6] and got == {1: 10.0, 2: 10.0, 3: 30.0, 4: 40.0, 5: 40.0}


def test_segments_are_dealt_out_and_measured_in_steps(spark):
    """a pair costs a few cosines, not one for each part of the formula, and steps are searched by many tasks without a shuffle of their cells."""
    line = [{"lat": 40.0 + i / 1000, "lng": -105.0} for i in range(3)]
    segments = spark.createDataFrame([(i, line) for i in range(40)], "segment_id long, geometry array<struct<lat: double, lng: double>>")
    asked = spark.createDataFrame([(1, 40.001, -105.0), (2, 40.001, -105.0), (3, 40.0015, -105.001), (4, 41.0, -105.0)], "request_id long, lat double, lng double")
    found = store.nearby_segments(asked, segments, 0.15, 3)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("COS(") <= 8
    got = sorted((r["request_id"], r["segment_id"], r["rank"], round(r["km"], 3)) for r in found.collect())
    assert got == [(r, i, i + 1, km) for r, km in ((1, 0.0), (2, 0.0), (3, 0.085)) for i in range(3)]


def test_equal_corridor_segments_are_measured_once(spark, monkeypatch):
    """thirty paths over the same stops, one of them walked twice, have three segments among them."""
    seen = []
    own = profiles.box_join
    monkeypatch.setattr(profiles, "box_join", lambda points, shapes, *sizes: seen.append(shapes.count()) or own(points, shapes, *sizes))
    paths = spark.range(30).selectExpr("id AS route_id", "explode(sequence(0, 9)) AS seq").selectExpr("route_id", "seq", "40 + (seq % 3) * 0.001D AS lat", "-105D AS lng").withColumn("lat", F.col("lat").cast("double"))
    nodes = spark.createDataFrame([(1, 40.0, -105.0), (2, 40.001, -105.0), (3, 41.0, -105.0)], "node_id long, lat double, lng double")
    ends = spark.createDataFrame([(1, 7, 10.0), (2, 7, 10.0), (3, 8, 10.0)], "src long, edge_id long, distance_m double")
    got = {(r["route_id"], r["edge_id"], r["penalty"]) for r in profiles.corridor_penalties(paths, nodes, ends).collect()}
    assert seen == [3] and got == {(i, 7, 300.0) for i in range(30)}


def test_parts_of_a_block_are_numbered_by_themselves(spark, tmp_path, monkeypatch):
    """what a task numbers at once doesn't grow with the blocks of a file; parts of four pieces, cut anywhere, give the same points."""
    at = [(f"{-105 - i / 1000:.3f}", f"{40 + i / 1000:.3f}", i) for i in range(60)]
    text = lambda part: "<LineString><coordinates>" + " ".join(",".join(map(str, p)) for p in part) + "</coordinates></LineString>"
    (tmp_path / "a.kml").write_text(f"<kml><name>A, b</name>{text(at[:31])}<Point><coordinates>1,2,3</coordinates></Point>{text(at[31:])}</kml>")
    monkeypatch.setattr(long_tracks, "PART_BITS", 2)
    read = long_tracks.read_kml_points(spark, f"file://{tmp_path}")
    got = sorted((r["seq"], r["lng"], r["lat"], r["elev"]) for r in read.collect())
    assert got == [(i + 1, float(lng), float(lat), float(e)) for i, (lng, lat, e) in enumerate(at)]


def test_roads_of_a_place_are_laid_out_once(spark, monkeypatch):
    """requests of one place, radius and activity share their roads, each under its own costs, and are answered as if alone."""
    import numpy as np
    import pandas as pd

    from ridgeline.functions.cost import with_ground_weights
    from ridgeline.operators import graph, search
    from ridgeline.plans.projection import views
    from tests.conftest import SF

    edges = with_ground_weights(graph.both_ways(views(spark, SF, "v_edge")[0])).toPandas()
    asked = search_queries.requests(spark, SF).toPandas()
    one = asked[asked["route_type"] == "point_to_point"].iloc[0]
    alike = pd.DataFrame([one.to_dict() | {"request_id": i, "target_km": 2.0, "safety_preference": i / 4, "route_type": t} for i, t in enumerate(["loop", "out_and_back", "point_to_point", "point_to_point"])])
    run = search._answer(search.candidates)
    alone = pd.concat([run(alike.iloc[[i]], edges) for i in range(4)], ignore_index=True)
    made = []
    own = search.RoadGraph.__init__
    monkeypatch.setattr(search.RoadGraph, "__init__", lambda self, *a: made.append(1) or own(self, *a))
    together = run(alike, edges)
    assert len(made) == 1 and together["request_id"].nunique() >= 3 and np.isfinite(together["cost"]).all()
    pd.testing.assert_frame_equal(together, alone)


def test_sharper_bounds_keep_the_paths(spark, monkeypatch):
    """paths under growing penalties are the same with a bound made anew each time as with none, and take fewer nodes."""
    import numpy as np

    from ridgeline.operators import search

    rng, side = np.random.default_rng(3), 30
    a = np.arange(side * side)
    src, dst = (np.concatenate(x) for x in zip((a[a % side < side - 1], a[a % side < side - 1] + 1), (a[a < side * (side - 1)], a[a < side * (side - 1)] + side)))
    n = len(src)
    place = lambda at: {"lat": 40 + at // side * 0.001, "lng": -105 + at % side * 0.001}
    rows = {"edge_id": np.tile(np.arange(n), 2), "forward": np.repeat([True, False], n), "src": np.r_[src, dst], "dst": np.r_[dst, src], "distance_m": np.full(2 * n, 100.0), "slope": np.zeros(2 * n)}
    for i, at in (("1", rows["src"]), ("2", rows["dst"])):
        rows |= {f"{k}{i}": v for k, v in place(at).items()}
    g = search.RoadGraph(rows, np.tile(rng.integers(20, 40, n).astype(float), 2), np.zeros(2 * n))
    taken, found = [], []
    own = search.RoadGraph._ordered
    monkeypatch.setattr(search.RoadGraph, "_ordered", lambda self, *a: (x := own(self, *a), taken.append(len(x[2])))[0])
    for wide in (float("inf"), 0.0):
        monkeypatch.setattr(search, "WIDE", wide)
        taken.clear()
        found.append((search.diverse_paths(g, 31, 868), sum(taken)))
    assert found[0][0] == found[1][0] and len(found[0][0]) == 8 and found[1][1] < found[0][1] / 2


def test_requests_without_activity_are_answered(spark):
    """a missing activity is a place of its own, not a reason to drop the request."""
    from ridgeline.operators import graph, search
    from ridgeline.plans.projection import views
    from tests.conftest import SF

    asked = search_queries.requests(spark, SF).where("route_type = 'point_to_point' AND radius_km < 5").limit(3).withColumn("activity", F.lit(None).cast("string"))
    assert search.generate_routes(asked, graph.both_ways(views(spark, SF, "v_edge")[0])).select("request_id").distinct().count() == 3
