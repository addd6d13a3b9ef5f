"""The chain from map elements to enriched routes, payload rules, and recorded elevations."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from ridgeline.operators import chain, payloads
from ridgeline.plans.search_queries import requests, route_service
from ridgeline.plans.store_queries import ways
from tests.conftest import SF


def test_prepared_edges(spark):
    e = chain.prepare(ways(spark, SF), "running")
    rows = e.collect()
    assert rows and len({r["edge_id"] for r in rows}) == len(rows)
    for r in rows:
        assert 2 <= r["distance_m"] and r["access_allowed"] and all(0 <= r[c] <= 1 for c in ("park_score", "shade_score", "safety_score", "scenery_score", "walk_score", "bike_score"))
    points = {r["node_id"] for r in chain.node_points(e).collect()}
    assert points == {r["src"] for r in rows} | {r["dst"] for r in rows}


def test_route_service(spark):
    rows = route_service(spark, SF).collect()
    runners = {r["request_id"] for r in requests(spark, SF).where("activity = 'running'").collect()}
    assert rows and {r["request_id"] for r in rows} <= runners
    assert max(Counter(r["request_id"] for r in rows).values()) <= 3
    by_source = {r["source"] for r in rows}
    assert by_source == {"map", "synthetic"} and all((r["source"] == "synthetic") == (r["request_id"] % 7 == 0) for r in rows)


def test_payload_rules(spark):
    good = '{"id":"a","source":"s","name":"n","activity":"running","distanceKm":1.5,"estimatedDurationMin":7.9,"elevationGainM":3,"geometry":[{"lat":1,"lng":2},{"lat":-1.5,"lng":180}]}'
    cases = {
        good: None,
        "nonsense": payloads.NO_JSON,
        "7": payloads.NO_OBJECT,
        good.replace('"a"', "null"): "id is required.",
        good.replace('"n"', "[]"): "name must be a string.",
        good.replace("1.5,", '"1.5",', 1): "distanceKm must be a number.",
        good.replace("180", "180.5"): payloads.BAD_COORDINATE.format("lng"),
        good.replace('{"lat":1,"lng":2},', ""): payloads.FEW_POINTS,
        good.replace('{"lat":1,"lng":2}', "5"): payloads.NO_POINT,
        good.replace('"lat":1,', ""): payloads.NO_COORDINATE.format("lat"),
        good[:-1] + ',"savedAt":"2024-02-30T00:00:00Z"}': payloads.NO_TIME,
    }
    rows = payloads.read_routes(spark.createDataFrame([(c,) for c in cases], "payload string")).collect()
    assert {r["payload"]: r["error"] for r in rows} == cases
    (whole,) = [r for r in rows if r["error"] is None]
    assert whole["minutes"] == 7 and whole["distance_km"] == 1.5 and [p["lng"] for p in whole["geometry"]] == [2.0, 180.0]


def test_rename_keeps_other_members(spark):
    df = spark.createDataFrame([('{"id":"a","name":"x","extra":{"k":[1,2]}}', " y ", None), ("{}", " ", "z")], "payload string, name string, notes string")
    rows = [r[0] for r in df.select(payloads.renamed(F.col("payload"), F.col("name"), F.col("notes"))).collect()]
    import json

    assert json.loads(rows[0]) == {"id": "a", "name": "y", "notes": None, "extra": {"k": [1, 2]}} and rows[1] is None
