"""Map scans, elevation providers, cache tiers, sinks, address search and outcomes."""

from __future__ import annotations

import json
import random
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from ridgeline.operators import cache, places, requests
from ridgeline.sources import elevations, map_scan, sinks
from ridgeline.sources.elevations import Provider

# -- map scan

WAYS = {
    "0_0": [{"type": "way", "id": 1, "nodes": [1, 2], "geometry": [{"lat": 0.01, "lon": 0.01}, {"lat": 0.06, "lon": 0.01}], "tags": {"highway": "path", "leisure": "park"}}, {"type": "node", "id": 9}],
    "1_0": [{"type": "way", "id": 1, "nodes": [1, 2], "geometry": [{"lat": 0.01, "lon": 0.01}, {"lat": 0.06, "lon": 0.01}], "tags": {"highway": "path", "leisure": "park"}}, {"type": "way", "id": 2, "tags": {"leisure": "garden"}}, {"type": "way", "id": 3, "tags": {"highway": "motorway"}}],
}


@pytest.fixture()
def mirrors(tmp_path):
    """The first has one broken answer and lacks another, the second has all."""
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
    (tmp_path / "a" / "0_0.json").write_text("<html>busy</html>")
    for tile, ways in WAYS.items():
        (tmp_path / "b" / f"{tile}.json").write_text(json.dumps({"elements": ways}))
    return [str(tmp_path / "a"), str(tmp_path / "b")]


def test_mirrors_are_tried_in_turn(spark, mirrors):
    rows = map_scan.scan_map(spark, mirrors, 0.0, 0.0, 0.1, 0.05).collect()
    assert sorted((r["tile"], r["mirror"], r["selector"], r["value"], json.loads(r["element"])["id"]) for r in rows) == [("0_0", 1, "highway", "path", 1), ("1_0", 1, "highway", "path", 1), ("1_0", 1, "leisure", "garden", 2)]
    with pytest.raises(Exception, match="no mirror answers for tile"):
        map_scan.scan_map(spark, mirrors[:1], 0.0, 0.0, 0.1, 0.05).collect()


def test_filters_are_pushed_into_the_scan(spark, mirrors):
    scanned = map_scan.scan_map(spark, mirrors, 0.0, 0.0, 0.1, 0.05)
    one = scanned.where((F.col("selector") == "leisure") & F.col("value").isin("garden", "meadow"))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Filter " not in plan.replace("PushedFilters", "") and [r["value"] for r in one.collect()] == ["garden"]
    # a tile that is filtered out is never asked for, so the broken mirror doesn't matter
    only = map_scan.scan_map(spark, [mirrors[1]], 0.0, 0.0, 9.0, 9.0).where("tile = '1_0'")
    assert only.count() == 2 and only.rdd.getNumPartitions() == 1
    assert scanned.where("selector = 'landuse' AND value = 'park'").count() == 0


def test_queries_ask_for_what_is_left():
    reader = map_scan.MapReader({"mirrors": "x", "south": 0, "west": 0, "north": 0.1, "east": 0.1})
    from pyspark.sql.datasource import EqualTo, In, IsNotNull

    left = list(reader.pushFilters([IsNotNull(("value",)), IsNotNull(("element",)), EqualTo(("selector",), "leisure"), In(("value",), ("park", "path"))]))
    assert left == [IsNotNull(("element",))] and reader.lists() == {"leisure": ("park",)}
    assert map_scan.tile_query(reader.partitions()[0], reader.lists()) == '[out:json][timeout:25];(way["leisure"~"^(park)$"](0.0000000,0.0000000,0.0500000,0.0500000););out body geom;'


def test_a_way_of_several_tiles_comes_once(spark, mirrors):
    from ridgeline.sources.overpass import parse_elements

    found = parse_elements(map_scan.as_answers(map_scan.scan_map(spark, mirrors, 0.0, 0.0, 0.1, 0.05))).orderBy("id").collect()
    assert [(r["id"], r["type"], r["nodes"]) for r in found] == [(1, "way", [1, 2]), (2, "way", None)]


class _Service(BaseHTTPRequestHandler):
    asked: list = []

    def do_POST(self):
        _Service.asked.append(self.rfile.read(int(self.headers["Content-Length"])))
        good = self.path == "/good"
        self.send_response(200 if good else 503)
        self.end_headers()
        self.wfile.write(json.dumps({"elements": WAYS["1_0"]}).encode() if good else b"overload")

    def log_message(self, *_):
        pass


def test_live_mirrors():
    """A service that answers 503 is passed over; the query is sent as a form."""
    server = HTTPServer(("127.0.0.1", 0), _Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        at = f"http://127.0.0.1:{server.server_port}"
        reader = map_scan.MapReader({"mirrors": f"{at}/busy;{at}/good", "south": 0.05, "west": 0, "north": 0.1, "east": 0.05})
        (batch,) = reader.read(reader.partitions()[0])
        assert batch.column("value").to_pylist() == ["path", "garden"] and batch.column("mirror").to_pylist() == [1, 1]
        assert len(_Service.asked) == 2 and all(x.startswith(b"data=%5Bout%3Ajson%5D") for x in _Service.asked)
    finally:
        server.shutdown()


# -- elevation providers


class Clock:
    """A clock that services move on."""

    now = 0.0

    def __call__(self):
        return Clock.now


def _service(milliseconds, fails_at=()):
    """Answers every batch with its size, after so many milliseconds each; batches given as ``fails_at`` break down."""
    calls = Counter()

    def ask(body, seconds):
        calls["n"] += 1
        took = milliseconds[min(calls["n"], len(milliseconds)) - 1] / 1000
        if took > seconds:
            Clock.now += seconds
            raise TimeoutError
        Clock.now += took
        if calls["n"] - 1 in fails_at:
            raise RuntimeError("503")
        points = body.split("&")[0].count(",") + 1 if body.startswith("latitude") else len(json.loads(body)["locations"])
        values = [float(i) for i in range(points)]
        return json.dumps({"elevation": values} if body.startswith("latitude") else {"results": [{"elevation": -1 - v} for v in values]})

    return ask


def _track(spark, n, request=1):
    return spark.range(n).select(F.lit(request).cast("long").alias("request_id"), F.col("id").alias("place"), (F.col("id") / 1000).alias("lat"), F.lit(-122.0).alias("lng"))


def _look_up(spark, points, *providers, **options):
    rows = elevations.look_up(points, list(providers), clock=Clock(), **options).collect()
    return {r["place"]: (r["elev"], r["service"]) for r in rows}


def test_batches_before_the_budget_ends_are_kept(spark):
    found = _look_up(spark, _track(spark, 101), Provider("open-meteo", _service([20, 500])), Provider("open-elevation", _service([1])), budget_ms=150)
    assert len(found) == 101 and sum(e is not None for e, _ in found.values()) == 100 and found[100] == (None, None)


def test_a_service_that_is_too_slow_gives_nothing(spark):
    assert _look_up(spark, _track(spark, 1), Provider("open-meteo", _service([500])), Provider("open-elevation", _service([1])), budget_ms=100) == {0: (None, None)}


def test_the_second_service_is_asked_for_the_rest(spark):
    found = _look_up(spark, _track(spark, 250), Provider("open-meteo", _service([1], fails_at=(1,))), Provider("open-elevation", _service([1])), budget_ms=1000)
    assert Counter(s for _, s in found.values()) == {"open-meteo": 100, "open-elevation": 150} and found[5] == (5.0, "open-meteo") and found[100] == (-1.0, "open-elevation")


def test_budgets_are_shared_and_points_are_capped(spark):
    found = _look_up(spark, _track(spark, 250), Provider("open-meteo", _service([60], fails_at=(1,))), Provider("open-elevation", _service([50])), budget_ms=150)
    assert sum(e is not None for e, _ in found.values()) == 100  # 120 ms are spent, 50 more are too many
    twice = _track(spark, 30).unionByName(_track(spark, 30).withColumn("place", F.col("place") + 100))
    assert sorted(_look_up(spark, twice, Provider("open-meteo", _service([1])), most=20)) == list(range(20))
    assert _look_up(spark, twice) == dict.fromkeys(range(30), (None, None))
    assert _look_up(spark, twice.limit(0), Provider("open-meteo", _service([1]))) == {}


# -- caches


def brute_cache(log, entries, memory_s, stored_s, policy):
    out, memory, table = {}, {}, {}
    for instance, request, key, now in sorted(log, key=lambda r: (r[3], r[1])):
        m, t = memory.setdefault(instance, {}), table.setdefault(instance, {})
        if key in m and m[key] > now:
            out[request] = ("memory_hit", 0)
            continue
        outcome = "stored_hit" if stored_s and t.get(key, now) > now else "miss"
        if stored_s and outcome == "miss":
            t[key] = now + stored_s
        if policy == "oldest":
            for k in [k for k, end in m.items() if end <= now]:
                del m[k]
        gone = 0
        while len(m) >= entries:
            gone += len(m) if policy == "clear" else 1
            m.clear() if policy == "clear" else m.pop(next(iter(m)))
        m[key] = now + memory_s
        out[request] = (outcome, gone)
    return out


@pytest.mark.parametrize("limits", [(4, 50, 200, "oldest"), (30, 600, 600, "oldest"), (5, 80, None, "clear"), (1, 10, 40, "oldest")])
def test_caches(spark, limits):
    rng = random.Random(str(limits))
    log = [(i % 5, i, f"k{rng.randrange(9)}", float(rng.randrange(900))) for i in range(1500)]
    df = spark.createDataFrame([(*r, 1) for r in log], "instance long, request_id long, cache_key string, at double, outcome int").repartition(3)
    assert {r["request_id"]: (r["outcome"], r["evicted"]) for r in cache.read_through(df, *limits).collect()} == brute_cache(log, *limits)


def test_caches_without_keys_and_times(spark):
    df = spark.createDataFrame([(None, 1, None, None), (None, 2, None, 1.0), (3, 3, None, None)], "instance long, request_id long, cache_key string, at double")
    assert {r["request_id"]: r["outcome"] for r in cache.read_user_answers(df).collect()} == {1: "miss", 2: "memory_hit", 3: "miss"}
    assert cache.read_through(df.limit(0)).count() == 0


# -- sinks


def _payload(name="Route", points=((40.1, -105.2), (40.3, -105.1)), **more):
    return json.dumps({"id": "client", "source": "generated", "name": name, "activity": "running", "routeType": "loop", "distanceKm": 4.5, "estimatedDurationMin": 30, "elevationGainM": 12, "geometry": [{"lat": a, "lng": b} for a, b in points]} | more)


def _batches(spark, requests_, candidates):
    return sinks.batch_tables(spark.createDataFrame(requests_, "request_id long, preferences string"), spark.createDataFrame(candidates, "request_id long, payload string"))


def _shown(spark, root):
    batches = {r["request_id"]: r for r in sinks.committed(spark, root, "batches", sinks.BATCHES).collect()}
    held = Counter(r["batch_id"] for r in sinks.committed(spark, root, "candidates", sinks.CANDIDATES).collect())
    return {k: (r["route_count"], held[r["batch_id"]], tuple(r["envelope"]) if r["envelope"] else None) for k, r in batches.items()}


def test_a_killed_and_repeated_write_leaves_one_batch(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "routes")
    tables = lambda: _batches(spark, [(1, "{}"), (2, "{}")], [(1, _payload()), (1, _payload(points=((41.0, -106.0), (39.0, -104.0))))])
    assert _shown(spark, root) == {}
    with monkeypatch.context() as m:  # the driver dies after the rows and before the manifest
        m.setattr(sinks._Folder, "create", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError, match="killed"):
            sinks.commit(root, "night-1", tables())
    assert _shown(spark, root) == {}
    assert sinks.commit(root, "night-1", tables()) and not sinks.commit(root, "night-1", tables())
    assert _shown(spark, root) == {1: (2, 2, (-106.0, 39.0, -104.0, 41.0)), 2: (0, 0, None)}
    assert len(sinks.vacuum(spark, root, ["batches", "candidates"])) == 1 and len(_shown(spark, root)) == 2
    assert sinks.vacuum(spark, root, ["batches", "candidates"]) == []


def test_of_two_writers_one_wins(spark, tmp_path):
    root, won = str(tmp_path / "routes"), []
    rows = [_batches(spark, [(i, "{}")], [(i, _payload())]) for i in (1, 2)]
    threads = [threading.Thread(target=lambda t=t: won.append(sinks.commit(root, "same", t))) for t in rows]
    [t.start() for t in threads], [t.join() for t in threads]
    assert sorted(won) == [False, True] and len(_shown(spark, root)) == 1


def test_a_bad_candidate_fails_the_whole_batch(spark, tmp_path):
    root = str(tmp_path / "routes")
    with pytest.raises(Exception, match="at least two points"):
        sinks.commit(root, "bad", _batches(spark, [(1, "{}")], [(1, _payload()), (1, _payload(points=((40.0, -105.0),)))]))
    assert _shown(spark, root) == {}


def test_saved_routes_get_ids_of_their_own(spark):
    rows = spark.createDataFrame([(1, _payload()), (2, _payload()), (3, _payload(id=7, notes="wet")), (4, "[1]"), (5, "{"), (6, None), (7, _payload(name=" "))], "route_key long, payload string").repartition(3)
    saved = {r["route_key"]: r for r in sinks.new_saved(rows).collect()}
    ids = [saved[k]["id"] for k in (1, 2, 3)]
    assert len(set(ids)) == 3 and all(x.startswith("saved-") and len(x) == 42 for x in ids)
    assert [json.loads(saved[k]["payload"])["id"] for k in (1, 2, 3)] == ids and saved[3]["notes"] == "wet" and saved[1]["notes"] is None
    assert all(saved[k]["error"] and saved[k]["id"] is None for k in (4, 5, 6, 7))


def test_drawn_values_outlive_what_drew_them(spark):
    """Two actions see the same values: they were drawn and stored before."""
    drawn = sinks.with_drawn(spark.range(500).repartition(8), "token", sinks.token)
    first, second = ({r["id"]: r["token"] for r in drawn.collect()} for _ in range(2))
    assert first == second and len(set(first.values())) == 500 and all(len(t) == 32 for t in first.values())


def test_share_hours_are_held(spark):
    rows = spark.createDataFrame([(1, None), (2, 1), (3, 2160), (4, 0), (5, 2161), (6, -3)], "route_key long, hours int").withColumn("user_id", F.lit(1))
    made = {r["route_key"]: r for r in sinks.new_shares(rows, F.expr("TIMESTAMP '2024-01-01 00:00:00'")).collect()}
    assert [str(made[k]["expires_at"]) for k in (1, 2, 3)] == ["2024-01-08 00:00:00", "2024-01-01 01:00:00", "2024-03-31 00:00:00"]
    assert all(made[k]["error"] == sinks.BAD_HOURS and made[k]["token"] is None and made[k]["expires_at"] is None for k in (4, 5, 6))
    assert len({made[k]["token"] for k in (1, 2, 3)}) == 3


# -- addresses


def test_search_for_many_texts(spark):
    rng = random.Random(4)
    names = ["".join(rng.choice("aab é") for _ in range(rng.randint(0, 9))) for _ in range(300)] + [None, "Ünter", "MAIN street", "main st"]
    texts = ["".join(rng.choice("aab é") for _ in range(rng.randint(0, 5))) for _ in range(200)] + [None, "  mAIN ", "zz", "x" * 201, "ü", "ünt"]
    want = []
    for q, said in enumerate(texts):
        said = said.strip(" ").lower() if said is not None else ""
        found = sorted((len(n), n.encode(), i) for i, n in enumerate(names) if n is not None and said in n.lower()) if 2 <= len(said) <= 200 else []
        want += [(q, i, n.decode(), k) for k, (_, n, i) in enumerate(found[:6], 1)]
    asked = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string").repartition(3)
    known = spark.createDataFrame(list(enumerate(names)), "id long, name string").repartition(3)
    assert sorted(tuple(r[c] for c in ("query_id", "id", "name", "rank")) for r in places.search_all(asked, known).collect()) == sorted(want)


# -- outcomes


def test_every_request_has_one_outcome(spark):
    asked = spark.createDataFrame([(1, True), (2, False), (3, None), (4, True), (5, True), (6, True)], "request_id long, good boolean")
    graphs = spark.createDataFrame([(1, 20, 9), (2, 20, 9), (4, 7, 30), (5, 8, 8)], "request_id long, edges long, nodes long")
    routes = spark.createDataFrame([(1,), (1,), (2,), (4,), (9,)], "request_id long")
    found = {r["request_id"]: (r["routes"], r["code"]) for r in requests.outcomes(asked, F.col("good"), graphs, routes).collect()}
    assert found == {1: (2, None), 2: (0, "malformed_input"), 3: (0, "malformed_input"), 4: (0, "insufficient_graph_data"), 5: (0, "no_route"), 6: (0, "insufficient_graph_data")}


def test_requests_without_a_start_begin_at_the_default(spark):
    rows = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 2.0), (3, 1.0, None)], "request_id long, start_lat double, start_lng double")
    assert [(r["start_lat"], r["start_lng"]) for r in requests.with_start(rows).orderBy("request_id").collect()] == [(1.0, 2.0), (40.0149, -105.2705), (40.0149, -105.2705)]


# -- stored tables


def test_scopes_are_those_of_their_threads(spark, tmp_path):
    """Two queries at once delete their own tables and no others; what is stored outside scopes goes when it is released."""
    from pathlib import Path

    from ridgeline import cluster

    cluster.release(spark)
    paths, barrier, kept = {}, threading.Barrier(2), {}

    def run(name, first):
        with cluster.scope(spark):
            df = cluster.stored(spark.range(10), f"of-{name}")
            paths[name] = Path(df.inputFiles()[0].removeprefix("file:").replace("///", "/")).parent
            barrier.wait(60)
            if first:
                return
            while paths[other].exists():  # the other scope has ended
                pass
            kept[name] = df.count()

    other = "one"
    threads = [threading.Thread(target=run, args=("one", True)), threading.Thread(target=run, args=("two", False))]
    [t.start() for t in threads], [t.join(120) for t in threads]
    assert kept == {"two": 10} and not any(p.exists() for p in paths.values())
    loose = cluster.stored(spark.range(3), "loose")
    folder = Path(loose.inputFiles()[0].removeprefix("file:").replace("///", "/")).parent
    assert loose.count() == 3 and cluster.release(spark) == 1 and not folder.exists() and cluster.release(spark) == 0
