"""Queries over long track files, the export of routes, and handles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridgeline.cluster import folder
from ridgeline.functions.geo import half_up, num
from ridgeline.functions.text import number_text
from ridgeline.plans.projection import half_up_sql, views
from ridgeline.plans.registry import query
from ridgeline.plans.track_queries import DIST
from ridgeline.sources import formats, long_tracks
from ridgeline.streaming import handles

C = F.col

# -- long files

#: Files that the tracks of all users are written to.
FILES = 8

_LONG = f"""SELECT file_no, count(*) AS points, CAST(sum(CAST({half_up_sql('lat * 1e6')} AS bigint)) AS bigint) AS lat, CAST(sum(CAST({half_up_sql('lng * 1e6')} AS bigint)) AS bigint) AS lng,
    CAST(coalesce(sum(greatest(tenths - before, 0)), 0) AS bigint) AS gain FROM
    (SELECT *, lag(tenths) OVER (PARTITION BY file_no ORDER BY user_id, seq) AS before FROM
     (SELECT CAST(user_id % {FILES} AS integer) AS file_no, user_id, seq, lat, lng, CAST({half_up_sql('elev * 10')} AS bigint) AS tenths FROM v_track)) GROUP BY file_no"""


def _written(spark, sf_dir, line, head, foot):
    """The tracks of all users in a few long files, one after another in each; the folder."""
    (t,) = views(spark, sf_dir, "v_track")
    rows = t.select((C("user_id") % FILES).cast("int").alias("file_no"), "user_id", "seq", line.alias("line"))
    ends = spark.range(FILES).select(C("id").cast("int").alias("file_no"))
    frame = [ends.select("file_no", F.lit(at).cast("long").alias("user_id"), F.lit(0).cast("long").alias("seq"), F.lit(text).alias("line")) for at, text in ((-1, head), (2**62, foot))]
    path = folder(spark, "tracks")
    every = rows.unionByName(frame[0]).unionByName(frame[1]).repartition("file_no").sortWithinPartitions("file_no", "user_id", "seq")
    every.select("file_no", "line").write.partitionBy("file_no").text(path)
    return path


def _totals(points):
    whole = lambda c: F.sum(half_up(C(c) * num(1e6)).cast("long")).alias(c)
    sums = points.groupBy("file_no").agg(whole("lat"), whole("lng"))
    climbed = long_tracks.climbs(points, "file_no").select("file_no", "points", half_up(C("gain_m") * 10).cast("long").alias("gain"))
    return climbed.join(sums, "file_no").select("file_no", "points", "lat", "lng", "gain")


def _elevation():
    return number_text(half_up(C("elev"), 1))


@query(_LONG)
def long_gpx_tracks(spark, sf_dir):
    """Long GPX files, read block by block: points and metres climbed of each."""
    ele = F.coalesce(F.concat(F.lit("\n<ele>"), _elevation(), F.lit("</ele>\n</trkpt>")), F.lit("</trkpt>"))
    line = F.concat(F.lit('<trkpt lat="'), number_text(C("lat")), F.lit('" lon="'), number_text(C("lng")), F.lit('">'), ele)
    return _totals(long_tracks.read_gpx_points(spark, _written(spark, sf_dir, line, "<gpx><trk><trkseg>", "</trkseg></trk></gpx>")))


@query(_LONG)
def long_kml_tracks(spark, sf_dir):
    """The same of KML files."""
    line = F.concat_ws(",", number_text(C("lng")), number_text(C("lat")), _elevation())
    return _totals(long_tracks.read_kml_points(spark, _written(spark, sf_dir, line, "<kml><name>A, b</name><LineString><coordinates>", "</coordinates></LineString></kml>")))


# -- export


@query(
    f"""WITH s AS (SELECT user_id, seq * 2e0 * 1000 AS metres, elev FROM v_track WHERE seq % 3 = 0 AND elev IS NOT NULL),
        q AS (SELECT q.*, (SELECT max(struct_pack(m := s.metres, e := s.elev)) FROM s WHERE s.user_id = q.user_id AND s.metres <= q.metres) AS lo,
          (SELECT min(struct_pack(m := s.metres, e := s.elev)) FROM s WHERE s.user_id = q.user_id AND s.metres > q.metres) AS hi FROM {DIST} q)
        SELECT user_id, count(*) AS points, sum(CASE WHEN seq % 4 <> 0 THEN 1 ELSE 0 END)::bigint AS times, CASE WHEN user_id % 2 = 0 THEN strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') END AS saved,
          CAST(coalesce(sum(CAST({half_up_sql('coalesce(lo.e + (metres - lo.m) / (hi.m - lo.m) * (hi.e - lo.e), lo.e, hi.e) * 10')} AS bigint)), 0) AS bigint) AS tenths FROM q GROUP BY user_id HAVING count(*) >= 2"""
)
def gpx_export(spark, sf_dir):
    """Routes exported with elevations of their profiles, read back: points, times, and the sum of elevations in tenths."""
    (t,) = views(spark, sf_dir, "v_track")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    point = F.struct("seq", "lat", "lng", F.when(C("seq") % 4 != 0, iso).otherwise("yesterday").alias("time"))
    sample = F.when((C("seq") % 3 == 0) & C("elev").isNotNull(), F.struct((C("seq") * num(2)).alias("distance_km"), C("elev").alias("elev_m")))
    routes = t.groupBy("user_id").agg(F.array_sort(F.collect_list(point)).alias("geometry"), F.collect_list(sample).alias("profile"), F.max(iso).alias("last"))
    routes = routes.withColumns({"name": F.concat(F.lit("Track "), C("user_id").cast("string")), "saved_at": F.when(C("user_id") % 2 == 0, C("last")).otherwise("today")})
    read = formats.parse_gpx(formats.route_gpx(routes, "user_id").where(C("gpx").isNotNull()), "gpx")
    tenths = F.aggregate("points", F.lit(0).cast("long"), lambda total, p: total + F.coalesce(half_up(p["elev"] * 10).cast("long"), F.lit(0)))
    saved = F.regexp_extract("gpx", r"</name>\s*<time>([^<]*)</time>", 1)
    return read.select("user_id", F.size("points").cast("long").alias("points"), (F.regexp_count("gpx", F.lit("        <time>"))).cast("long").alias("times"), F.when(saved != "", saved).alias("saved"), tenths.alias("tenths"))


# -- handles

_KIND = "CASE event_type WHEN 'signup' THEN 'prepare' WHEN 'error' THEN 'release' ELSE 'use' END"
#: Seconds that a handle lives in these queries: a user's events are hours apart.
LONG_TTL_S = 12 * 3600


def handle_requests(events):
    """Events as requests for handles: a user's sign-up makes the handle, an error gives it up, all else uses it."""
    return events.select(C("user_id").cast("string").alias("handle"), C("event_id").alias("request_id"), C("ts").cast("timestamp").alias("ts"), F.expr(_KIND).alias("kind"))


@query(
    f"""SELECT handle, request_id, CASE kind WHEN 'prepare' THEN 'prepared' WHEN 'release' THEN 'released' ELSE CASE WHEN made_kind = 'prepare' AND epoch_ms(ts) < epoch_ms(made) + {LONG_TTL_S * 1000} THEN 'ok' ELSE 'expired_handle' END END AS answer FROM
        (SELECT *, lag(kind) OVER w AS made_kind, lag(ts) OVER w AS made FROM (SELECT CAST(user_id AS varchar) AS handle, event_id AS request_id, ts, {_KIND} AS kind FROM events) WINDOW w AS (PARTITION BY handle ORDER BY ts, request_id))"""
)
def handle_answers(spark, sf_dir):
    """What each request for a handle was told."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return handles.replayed(handle_requests(events), LONG_TTL_S).select("handle", "request_id", "answer")
