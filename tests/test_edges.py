"""Edge cases of route operators."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from ridgeline.functions import geo, text
from ridgeline.operators import graph, store, tracks
from ridgeline.sources import formats, overpass


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("x,digits,want", [(-2.5, 0, -2.0), (2.5, 0, 3.0), (1.005, 1, 1.0), (-0.05, 1, 0.0)])
def test_halves_go_up(spark, x, digits, want):
    assert value(spark, geo.half_up(F.lit(x), digits)) == want


def test_preferences_are_two_pieces(spark):
    got = [value(spark, geo.normalize_preference(F.lit(v))) for v in (-1.0, 0.5, 1.0, 1.0001, 3.0, 9.0)]
    assert got == pytest.approx([0, 0.5, 1, 0.00005, 1, 1])


def test_degenerate_segment(spark):
    p = [F.lit(x) for x in (40.0, -105.0, 40.001, -105.0, 40.001, -105.0)]
    lat, _, away = geo.project_on_segment(*p)
    assert value(spark, lat) == 40.001 and value(spark, away) == pytest.approx(111.19, abs=0.01)


def test_targets_fall_back(spark):
    none = F.lit(None).cast("double")
    assert value(spark, geo.target_km(none, none, F.lit("running"))) == 5.0
    assert value(spark, geo.target_km(F.lit(0.0), F.lit(56.0), F.lit("running"))) == 10.0


def test_near_join_equals_a_cross_join(spark):
    points = spark.range(60).select(F.col("id").alias("p"), (F.rand(1) / 50 + 40).alias("lat"), (F.rand(2) / 50 - 105).alias("lng"))
    targets = spark.range(60).select(F.col("id").alias("t"), (F.rand(3) / 50 + 40).alias("to_lat"), (F.rand(4) / 50 - 105).alias("to_lng"))
    points, targets = (spark.createDataFrame(x.collect(), x.schema) for x in (points, targets))
    far = geo.haversine_m(F.col("lat"), F.col("lng"), F.col("to_lat"), F.col("to_lng"))
    want = {(r["p"], r["t"]) for r in points.crossJoin(targets).where(far <= 500).collect()}
    assert {(r["p"], r["t"]) for r in graph.near_join(points, targets, 500).collect()} == want and want


def test_track_without_elevation_is_flat(spark):
    t = spark.createDataFrame([(1, i, 40.0 + i / 1000, -105.0, None) for i in range(1, 5)], "k long, seq long, lat double, lng double, elev double")
    assert {r["filled"] for r in tracks.fill_missing(tracks.with_distance(t, "k"), "k").collect()} == {0.0}


def test_resample_of_standing_still(spark):
    t = spark.createDataFrame([(1, i, 40.0, -105.0) for i in range(1, 4)], "k long, seq long, lat double, lng double")
    assert tracks.resample(t, "k").count() == 1


def test_spike_needs_agreeing_neighbours(spark):
    t = spark.createDataFrame([(1, i, v) for i, v in enumerate([10.0, 30.0, 12.0, 40.0, 80.0], 1)], "k long, seq long, v double")
    got = [r["x"] for r in tracks.remove_spikes(t, "k", "v", "x").orderBy("seq").collect()]
    assert got == [10.0, 11.0, 12.0, 40.0, 80.0]


def test_gpx_names_points_and_gain(spark):
    xml = '<gpx xmlns="http://www.topografix.com/GPX/1/1"><metadata><name>A &amp; B</name></metadata><trk><trkseg>' + "".join(
        f'<trkpt lat="{40 + i / 100}" lon="-105"><ele>{e}</ele></trkpt>' for i, e in enumerate((10, 25, 40, 20))
    )
    docs = spark.createDataFrame([(1, xml + "</trkseg></trk></gpx>"), (2, '<gpx><trkpt lat="1" lon="2"/></gpx>'), (3, '<gpx><trkpt lat="x" lon="2"/><trkpt lat="91" lon="2"/></gpx>')], "id long, xml string")
    a, b, c = formats.parse_gpx(docs).orderBy("id").collect()
    assert a["name"] == "A & B" and len(a["points"]) == 4 and a["gain_m"] == 30.0
    assert b["points"] is None and c["points"] is None


def test_kml_joins_all_lines(spark):
    line = "<LineString><coordinates>{}</coordinates></LineString>"
    xml = f'<kml xmlns="http://www.opengis.net/kml/2.2"><name>K</name>{line.format("-105,40,5 -105.1,40.1,9")}{line.format(" -105.2,40.2")}<Point><coordinates>1,1</coordinates></Point></kml>'
    (r,) = formats.parse_kml(spark.createDataFrame([(xml,)], "xml string")).collect()
    assert [(p["lng"], p["lat"]) for p in r["points"]] == [(-105.0, 40.0), (-105.1, 40.1), (-105.2, 40.2)] and r["gain_m"] == 4.0


def test_elements_from_json(spark):
    doc = {"elements": [{"type": "way", "nodes": [1, "x", 2**53 + 3], "geometry": [{"lat": 1, "lng": 2}, {"lat": 1, "lon": 3}, {"lat": 1}], "tags": {"highway": "path", "n": None}}, {"type": "node", "id": 9}]}
    a, b = overpass.parse_elements(spark.createDataFrame([(json.dumps(doc),)], "json string")).collect()
    assert a["id"] == 0 and a["nodes"] == [1, 2**53 + 3] and [(p["lat"], p["lng"]) for p in a["geometry"]] == [(1, 2), (1, 3)] and a["tags"] == {"highway": "path"}
    assert b["id"] == 9 and b["nodes"] is None and b["geometry"] is None


def test_short_pieces_run_on(spark):
    points = [(40.0, -105.0), (40.000001, -105.0), (40.001, -105.0), (40.0010001, -105.0)]
    w = spark.createDataFrame([(1, [1, 2, 3, 4], points)], "id long, nodes array<long>, geometry array<struct<lat: double, lng: double>>")
    cuts = spark.createDataFrame([(2,), (3,)], "node long")
    assert [(r["from_i"], r["to_i"], r["metres"]) for r in overpass.split_ways(w, cuts).collect()] == [(0, 2, 111.0)]


def test_text_functions(spark):
    assert value(spark, text.slugify(F.lit("--Über Café 12!"))) == "ber-caf-12"
    assert value(spark, text.escape_xml(F.lit("a\u0001<b>&'\""))) == "a&lt;b&gt;&amp;&apos;&quot;"
    assert [value(spark, text.safe_path(F.lit(p))) for p in ("/a?b#c", "//evil", "/\\evil", "http://x", "/\t/x")] == ["/a?b#c", "/", "/", "/", "/"]
    assert [value(spark, text.number_text(F.lit(x))) for x in (1.5, 2.0, -0.0, 1e-7)] == ["1.5", "2", "0", "0"]
    assert value(spark, text.normalize_email(F.lit(" A@B.co "))) == "a@b.co" and value(spark, text.normalize_email(F.lit("a@b"))) is None


def test_maps_link_samples_stops(spark):
    points = F.array(*[F.struct(F.lit(40.0 + i).alias("lat"), F.lit(-100.0).alias("lng")) for i in range(21)])
    url = value(spark, text.maps_url(points, F.lit("hiking")))
    assert "travelmode=walking" in url and url.count("%7C") == 8 and "origin=40%2C-100" in url and "destination=60%2C-100" in url


def test_upsert_keeps_the_newest(spark):
    a = spark.createDataFrame([("x", 1, "old"), ("y", 5, "kept")], "k string, v long, p string")
    b = spark.createDataFrame([("x", 2, "new"), ("y", 4, "late")], "k string, v long, p string")
    assert {tuple(r) for r in store.upsert(a, b, ["k"], "v").collect()} == {("x", 2, "new"), ("y", 5, "kept")}
