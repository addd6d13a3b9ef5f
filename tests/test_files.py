"""Long track files, the export, handles that expire and jobs under a deadline."""

from __future__ import annotations

import threading
import time
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ridgeline import cluster
from ridgeline.deadline import Budget, DeadlineExceeded, deadline
from ridgeline.sources import formats, long_tracks
from ridgeline.streaming import handles

GPX = """<?xml version="1.0"?>
<gpx><metadata><name>Kept lat="1"</name></metadata><wpt lat="5" lon="5"><ele>3</ele></wpt><trk><trkseg>
<trkpt lat="40.0" lon="-105.0"><ele>10</ele></trkpt><trkpt lon='-105.1'
  lat='40.1'/><trkpt lat="40.2" lon="-105.2"><time>x</time></trkpt><trkpt lat="91" lon="0"><ele>1</ele></trkpt>
<trkpt lat="x" lon="0"></trkpt><trkpt lat="40.3" lon="-105.3">
<ele> 12.5 </ele></trkpt></trkseg></trk><wpt lat="6" lon="6"><ele>9</ele></wpt></gpx>"""

KML = """<kml><name>One, two,three</name><Point><coordinates>1,2,3</coordinates></Point>
<LineString><tessellate>1</tessellate><coordinates>
\t-105.0,40.0,10\n-105.1,40.1 -105.2,40.2,x
-105.3,95,1 nonsense ,7,8 5 -105.4,40.4,14,15,16</coordinates></LineString><description>a,b 1,2</description>
<LineString><coordinates>-105.5,40.5,20</coordinates></LineString></kml>"""


def _rows(points):
    return [(r["lat"], r["lng"], r["elev"]) for r in sorted(points.collect(), key=lambda r: r["seq"])]


@pytest.fixture(params=[None, 64])
def block(request, spark):
    """Whole files, and blocks that cut through tags and numbers."""
    if request.param:
        for name in ("maxPartitionBytes", "openCostInBytes"):
            spark.conf.set(f"spark.sql.files.{name}", request.param)
    yield request.param
    for name in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.unset(f"spark.sql.files.{name}")


def test_gpx_points(spark, tmp_path, block):
    (tmp_path / "a.gpx").write_text(GPX)
    (tmp_path / "b.gpx").write_text("")
    (tmp_path / "c.gpx").write_text("<gpx></gpx>")
    points = long_tracks.read_gpx_points(spark, str(tmp_path))
    assert _rows(points) == [(40.0, -105.0, 10.0), (40.1, -105.1, None), (40.2, -105.2, None), (40.3, -105.3, 12.5)]
    assert [r["seq"] for r in points.orderBy("seq").collect()] == [1, 2, 3, 4]


def test_kml_points(spark, tmp_path, block):
    (tmp_path / "a.kml").write_text(KML)
    (tmp_path / "b.kml").write_text("")
    points = long_tracks.read_kml_points(spark, str(tmp_path))
    assert _rows(points) == [(40.0, -105.0, 10.0), (40.1, -105.1, None), (40.2, -105.2, None), (40.4, -105.4, 14.0), (40.5, -105.5, 20.0)]
    whole = formats.parse_kml(spark.createDataFrame([(KML,)], "xml string")).first()["points"]
    assert [tuple(p) for p in whole] == _rows(points)


@pytest.mark.parametrize("kind", ["gpx", "kml"])
def test_a_long_file_is_read_by_several_tasks(spark, tmp_path, kind):
    """Rises are summed across stretches and blocks, and order holds."""
    n = 150_000
    at = [(40 + i / 1e6, -105 - i / 1e6, (i * 7919) % 100) for i in range(n)]
    gpx, kml = (f'<trkpt lat="{a:.6f}" lon="{b:.6f}"><ele>{c}</ele></trkpt>' for a, b, c in at), (f"{b:.6f},{a:.6f},{c}" for a, b, c in at)
    text = "<gpx>" + "\n".join(gpx) + "</gpx>" if kind == "gpx" else "<LineString><coordinates>" + "\n".join(kml) + "</coordinates></LineString>"
    (tmp_path / "long").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 500_000)
    try:
        points = (long_tracks.read_gpx_points if kind == "gpx" else long_tracks.read_kml_points)(spark, str(tmp_path / "long"))
        assert spark.read.text(str(tmp_path / "long")).rdd.getNumPartitions() > 5
        found = long_tracks.climbs(points).first()
        wrong = points.where(F.abs(F.col("lat") - (40 + (F.col("seq") - 1) / 1e6)) > 1e-9).count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert (found["points"], found["gain_m"], wrong) == (n, sum(max(0, b[2] - a[2]) for a, b in zip(at, at[1:])), 0)


# -- export

LINE = "array<struct<lat double, lng double, time string>>"
ROUTES = f"id long, name string, saved_at string, geometry {LINE}, profile array<struct<distance_km double, elev_m double>>"


def test_export_interpolates_by_distance(spark):
    line = [(0.0, 0.0, "2024-05-01T10:00:00Z"), (0.0, 0.01, None), (0.0, 0.02, "soon")]
    km = 6371 * 0.01 * 3.141592653589793 / 180
    rows = [
        (1, "A & b", "2024-05-01T09:00:00Z", line, [(2 * km, 300.0), (0.0, 100.0), (None, 5.0)]),
        (2, None, "later", line, []),
        (3, "held", None, line, [(km / 2, 50.0), (km * 1.5, 70.0)]),
        (4, "short", None, line[:1], []),
        (5, "hole", None, [*line, (None, 1.0, None)], []),
        (6, "none", None, None, None),
    ]
    found = {r["id"]: r["gpx"] for r in formats.route_gpx(spark.createDataFrame(rows, ROUTES), "id").collect()}
    assert set(found) == {1, 2, 3, 4, 5, 6} and found[4] is found[5] is found[6] is None
    assert "<name>A &amp; b</name>\n    <time>2024-05-01T09:00:00Z</time>\n  </metadata>" in found[1]
    elevations = lambda text: [float(part.split("</ele>")[0]) for part in text.split("<ele>")[1:]]
    assert elevations(found[1]) == pytest.approx([100, 200, 300], abs=1e-3)
    assert elevations(found[3]) == pytest.approx([50, 60, 70], abs=1e-3)
    assert '<trkpt lat="0" lon="0">\n        <time>2024-05-01T10:00:00Z</time>\n      </trkpt>' in found[2]
    assert '<trkpt lat="0" lon="0.01"></trkpt>' in found[2] and found[2].count("<time>") == 1


# -- handles

START = datetime(2024, 1, 1)
ASKED = [
    ("a", 1, 0, "prepare"), ("a", 2, 119, "use"), ("a", 3, 119.5, "use"), ("b", 4, 1, "prepare"), ("b", 5, 121, "use"), ("c", 6, 5, "use"),
    ("d", 7, 6, "prepare"), ("d", 8, 7, "release"), ("d", 9, 8, "use"), ("e", 10, 9, "prepare"), ("e", 11, 100, "prepare"), ("e", 12, 200, "use"), ("f", 13, 10, "prepare"), ("f", 14, 10, "use"),
]
ANSWERS = ["prepared", "ok", "expired_handle", "prepared", "expired_handle", "expired_handle", "prepared", "released", "expired_handle", "prepared", "prepared", "ok", "prepared", "ok"]


def _asked(spark, rows):
    return spark.createDataFrame([(h, i, START + timedelta(seconds=s), k) for h, i, s, k in rows], "handle string, request_id long, ts timestamp, kind string")


def test_handles_replayed(spark):
    rows = handles.replayed(_asked(spark, ASKED)).orderBy("request_id").collect()
    assert [r["answer"] for r in rows] == ANSWERS
    assert handles.replayed(_asked(spark, ASKED[:0])).count() == 0


def test_handles_expire_in_a_stream(spark, tmp_path):
    """Batch by batch, with timers between, the stream answers as the replay does."""
    for name, value in handles.STATE_STORE.items():
        spark.conf.set(name, value)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    late = [("z", 90, 1000, "use"), ("b", 91, 1001, "use")]
    try:
        for part in (ASKED[:0], [r for r in ASKED if r[2] < 50], [r for r in ASKED if r[2] >= 50], late):
            _asked(spark, part).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema("handle string, request_id long, ts timestamp, kind string").parquet(source)
            query = handles.answers(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination(120)
            state = query.lastProgress["stateOperators"][0] if query.lastProgress else {}
    finally:
        for name in handles.STATE_STORE:
            spark.conf.unset(name)
    rows = spark.read.parquet(out).orderBy("request_id").collect()
    assert [r["answer"] for r in rows] == [*ANSWERS, "expired_handle", "expired_handle"]
    assert state.get("numRowsTotal", 0) == 0


# -- deadlines


def test_a_deadline_cancels_jobs_and_deletes_tables(spark):
    here = lambda: set(Path(cluster.shared_dir(spark)).glob("limited-*"))
    before = here()
    slow = spark.range(0, 4, 1, 4).mapInPandas(lambda parts: (time.sleep(30) or p for p in parts), "id long")
    others: list[int] = []
    beside = threading.Thread(target=lambda: others.append(spark.range(1000).repartition(3).count()))
    with cluster.scope(spark):
        cluster.stored(spark.range(10), "warm")  # a cold session takes seconds for its first table
    began = time.time()
    with pytest.raises(DeadlineExceeded):
        with deadline(spark, 5.0):
            cluster.stored(spark.range(10), "limited")
            assert here() > before
            beside.start()
            slow.count()
    beside.join()
    assert time.time() - began < 25 and others == [1000] and here() == before
    with deadline(spark, 60.0) as budget:
        assert spark.range(5).count() == 5 and budget.left() > 0


def test_a_cancelled_write_leaves_nothing(spark):
    """Tasks that still write when their job is cancelled end before the folder goes."""
    slow = spark.range(0, 400, 1, 40).mapInPandas(lambda parts: (time.sleep(0.5) or p for p in parts), "id long")
    here = lambda: set(Path(cluster.shared_dir(spark)).glob("cut-*"))
    before = here()
    for seconds in (0.3, 1.0, 2.0):
        with pytest.raises(DeadlineExceeded), deadline(spark, seconds):
            cluster.stored(slow, "cut")
    time.sleep(2)
    assert here() == before


def test_other_errors_stay_and_budgets_end(spark):
    with pytest.raises(ValueError), deadline(spark, 60.0):
        raise ValueError("own")
    with pytest.raises(DeadlineExceeded), deadline(spark, 60.0) as budget:
        budget.cancel()
        budget.check()
    ended = Budget(0.0)
    with pytest.raises(DeadlineExceeded):
        ended.check()


def test_exported_elevations_read_back_as_they_were(spark):
    values = [12.349999999999998, 0.1, 33.333333333333336, 1234.5, 7.0, -0.25]
    points = F.array(*[F.struct(F.lit(40.0).alias("lat"), F.lit(-105.0).alias("lng"), F.lit(v).alias("elev")) for v in values])
    written = spark.range(1).select(formats.gpx(F.lit("A"), points).alias("xml"))
    (r,) = formats.parse_gpx(written).collect()
    assert [p["elev"] for p in r["points"]] == values
    assert all(f"<ele>{v}</ele>" in r["xml"] for v in ("0.1", "1234.5", "7", "-0.25"))
