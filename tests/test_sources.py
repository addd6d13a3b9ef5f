"""Segments, synthetic graphs and streams."""

from __future__ import annotations

import json
import time

import pytest
from pyspark.sql import functions as F

from ridgeline.functions import client
from ridgeline.functions.geo import num
from ridgeline.sources import segments, synthetic
from ridgeline.streaming import tracks


def test_polyline_of_the_format_description(spark):
    text = "_p~iF~ps|U_ulLnnqC_mqNvxq`@"
    (r,) = spark.range(1).select(segments.decode_polyline(F.lit(text)).alias("p")).collect()
    assert [(p["lat"], p["lng"]) for p in r["p"]] == [(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)]
    points = F.array(*[F.struct(num(a).alias("lat"), num(b).alias("lng")) for a, b in ((38.5, -120.2), (40.7, -120.95), (43.252, -126.453))])
    assert spark.range(1).select(segments.encode_polyline(points).alias("t")).first()["t"] == text


def test_long_polylines_take_time_in_proportion(spark):
    points = F.transform(F.sequence(F.lit(1), F.lit(4000)), lambda i: F.struct((i * i % 9001 / num(1e3)).alias("lat"), (-i % 777 / num(1e2)).alias("lng")))
    began = time.time()
    lines = spark.range(1).select(points.alias("p")).select("p", segments.encode_polyline(F.col("p")).alias("t"))
    r = lines.select("p", segments.decode_polyline(F.col("t")).alias("q")).first()
    assert time.time() - began < 20
    assert [tuple(p) for p in r["q"]] == [tuple(p) for p in r["p"]]


def test_polylines_of_no_whole_point(spark):
    texts = {"": [], "_p~iF": [], "_p~iF~ps|U_ulL": [(38.5, -120.2)], "_p~iF~ps|U_": [(38.5, -120.2)]}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", segments.decode_polyline(F.col("t")).alias("p"), segments.encode_polyline(F.array().cast("array<struct<lat: double, lng: double>>")).alias("none")).collect()
    assert {r["t"]: [tuple(p) for p in r["p"]] for r in rows} == texts and {r["none"] for r in rows} == {""}


def test_segments_without_a_line_are_dropped(spark):
    schema = "id long, name string, points string, start struct<lat: double, lng: double>, end struct<lat: double, lng: double>, distance_m double, climb_m double, grade double, category int, starred boolean"
    rows = [(1, "a", None, (1.0, 2.0), (3.0, 4.0), 12345.0, -5.0, 6.0, 3, True), (2, "b", "", None, (3.0, 4.0), 1.0, None, None, None, None), (3, "c", "_p~iF~ps|U_ulLnnqC", None, None, 100.0, None, None, None, None)]
    a, c = segments.normalize_segments(spark.createDataFrame(rows, schema), "riding").orderBy("id").collect()
    assert (a["km"], a["gain_m"], a["minutes"], a["activity"]) == (12.3, 0.0, 38.0, "cycling")
    assert (a["signals"]["safety"], a["signals"]["novelty"], a["signals"]["scenery"]) == (64.0, 62.0, 78.0)
    assert (c["km"], c["minutes"], c["signals"]["safety"], c["signals"]["novelty"]) == (0.1, 1.0, 76.0, 56.0)


def test_ring_graph(spark):
    e = synthetic.ring_graph(spark.createDataFrame([(1, 40.0149, -105.2705, 8.0)], "request_id long, start_lat double, start_lng double, target_km double"))
    rows = e.collect()
    rings = sum(r <= 9500 for r in synthetic.RADII)  # reach of an 8 km target
    assert len(rows) == 12 + 12 * rings + (12 + 6) * (rings - 1)
    assert [r["id"] for r in rows if not r["access_allowed"]] == ["ring-1-210"] and next(r for r in rows if not r["access_allowed"])["safety_score"] == 0.05
    assert all(r["distance_m"] == pytest.approx(650, abs=1) for r in rows if r["id"].startswith("spoke"))


@pytest.mark.parametrize("width,limit,every", [(5, 1000, 1), (5, 17, 1), (6, 1000, 7)])
def test_grid(spark, width, limit, every):
    want = []
    for i in range(width * width):
        for j in (i + 1, i + width):
            if j < width * width and not (j == i + 1 and j // width != i // width):
                want.append((len(want), i, j))
    got = sorted((r["edge_id"], r["src"], r["dst"]) for r in synthetic.grid(spark, width, limit, every).collect())
    assert got == [w for w in want if w[0] < limit and w[0] % every == 0]


def test_sun_penalty_reads_any_two(spark):
    got = [spark.range(1).select(client.sun_penalty(F.lit(x)).alias("p")).first()["p"] for x in ("12:00", "13:00", "evening", "08:10", None)]
    assert got == [12, 12, 4, 0, 0]


def test_streams(spark, tmp_path):
    rows = [(1, f"2024-01-01 10:{m:02d}:00", 40.0, -105.0, float(m)) for m in (0, 5, 20, 59)] + [(1, "2024-01-01 15:00:00", 40.0, -105.0, None)]
    points = spark.createDataFrame(rows, "user_id long, ts string, lat double, lng double, elev double").withColumn("ts", F.to_timestamp("ts"))
    points.write.parquet(str(tmp_path / "in"))
    for name, made in (("windows", tracks.windowed_stats), ("outings", tracks.outings)):
        q = made(tracks.read_points(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert [(r["points"], r["lowest"], r["highest"]) for r in spark.table("windows").orderBy("start").collect()] == [(4, 0.0, 59.0)]
    assert sorted(r["points"] for r in spark.table("outings").collect()) == [1, 3]


def test_request_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"request_id": i, "activity": "running", "target_distance_km": 5.0}) for i in range(3)))
    q = tracks.answer_lines(spark, str(tmp_path / "in"), lambda df: df.select("request_id", (F.col("target_distance_km") * 1000).alias("m")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert {(r["request_id"], r["m"]) for r in spark.read.json(str(tmp_path / "out")).collect()} == {(i, 5000.0) for i in range(3)}
