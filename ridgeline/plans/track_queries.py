"""Queries over ordered tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridgeline.functions.geo import half_up, num
from ridgeline.operators import tracks
from ridgeline.plans.projection import half_up_sql, haversine_sql, views
from ridgeline.plans.registry import query

C = F.col
_STEP = haversine_sql("lag(lat) OVER w", "lag(lng) OVER w", "lat", "lng")
DIST = f"""(SELECT *, CAST(sum(CAST(floor(step_m * 1000 + 0.5e0) AS bigint)) OVER (PARTITION BY user_id ORDER BY seq) AS bigint) / 1000e0 AS metres FROM
    (SELECT *, coalesce({half_up_sql(_STEP, 3)}, 0e0) AS step_m FROM v_track WINDOW w AS (PARTITION BY user_id ORDER BY seq)))"""
FILLED = f"""(SELECT *, coalesce(elev, lo_v + (hi_v - lo_v) * CASE WHEN hi_m - lo_m > 0 THEN (metres - lo_m) / (hi_m - lo_m) ELSE 0e0 END, lo_v, hi_v, 0e0) AS filled FROM
    (SELECT *, last_value(elev IGNORE NULLS) OVER b AS lo_v, last_value(CASE WHEN elev IS NOT NULL THEN metres END IGNORE NULLS) OVER b AS lo_m,
     first_value(elev IGNORE NULLS) OVER f AS hi_v, first_value(CASE WHEN elev IS NOT NULL THEN metres END IGNORE NULLS) OVER f AS hi_m FROM {DIST}
     WINDOW b AS (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY user_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)))"""
SPIKED = f"""(SELECT *, CASE WHEN abs(a - b) <= 4 AND abs(filled - (a + b) / 2) >= 10 THEN (a + b) / 2 ELSE filled END AS calm FROM
    (SELECT *, lag(filled) OVER w AS a, lead(filled) OVER w AS b FROM {FILLED} WINDOW w AS (PARTITION BY user_id ORDER BY seq)))"""
_G = tracks.gaussian(tracks.SIGMA)
_TOTAL = " + ".join(f"coalesce(lead(calm, {k}) OVER w * {g!r}e0, 0e0)" for k, g in _G.items())
_WEIGHT = " + ".join(f"CASE WHEN lead(calm, {k}) OVER w IS NOT NULL THEN {g!r}e0 ELSE 0e0 END" for k, g in _G.items())
SMOOTHED = f"(SELECT *, {half_up_sql(f'({_TOTAL}) / ({_WEIGHT})', 1)} AS soft FROM {SPIKED} WINDOW w AS (PARTITION BY user_id ORDER BY seq))"


def _track(spark, sf_dir):
    (t,) = views(spark, sf_dir, "v_track")
    return tracks.with_distance(t, "user_id")


def _smooth(spark, sf_dir):
    t = tracks.fill_missing(_track(spark, sf_dir), "user_id")
    t = tracks.remove_spikes(t, "user_id", "filled", "calm")
    return tracks.smooth(t, "user_id", "calm", "soft")


@query(f"SELECT user_id, count(*) AS points, {half_up_sql('max(metres)', 2)} AS metres FROM {DIST} GROUP BY user_id")
def track_distance(spark, sf_dir):
    return _track(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("points"), half_up(F.max("metres"), 2).alias("metres"))


@query(f"SELECT user_id, seq, {half_up_sql('filled', 6)} AS filled FROM {FILLED}")
def track_fill_missing(spark, sf_dir):
    return tracks.fill_missing(_track(spark, sf_dir), "user_id").select("user_id", "seq", half_up(C("filled"), 6).alias("filled"))


@query(f"SELECT user_id, seq, {half_up_sql('calm', 6)} AS calm FROM {SPIKED}")
def track_remove_spikes(spark, sf_dir):
    t = tracks.fill_missing(_track(spark, sf_dir), "user_id")
    return tracks.remove_spikes(t, "user_id", "filled", "calm").select("user_id", "seq", half_up(C("calm"), 6).alias("calm"))


@query(f"SELECT user_id, seq, soft FROM {SMOOTHED}")
def track_smooth(spark, sf_dir):
    return _smooth(spark, sf_dir).select("user_id", "seq", "soft")


@query(
    f"""SELECT user_id, {half_up_sql('min(soft)')} AS lowest, {half_up_sql('max(soft)')} AS highest, {half_up_sql('CAST(coalesce(sum(greatest(d, 0)), 0) AS bigint) / 10e0')} AS gain,
        {half_up_sql('CAST(coalesce(sum(greatest(-d, 0)), 0) AS bigint) / 10e0')} AS descent FROM
        (SELECT user_id, soft, CAST(floor((soft - lag(soft) OVER w) * 10 + 0.5e0) AS bigint) AS d FROM {SMOOTHED} WINDOW w AS (PARTITION BY user_id ORDER BY seq)) GROUP BY user_id"""
)
def track_profile_stats(spark, sf_dir):
    return tracks.profile_stats(_smooth(spark, sf_dir), "user_id", "soft")


_SAMPLED = f"(SELECT *, length / (n - 1) AS every FROM (SELECT *, least(500e0, greatest(2e0, floor(length / 2500e0) + 1)) AS n FROM (SELECT *, max(metres) OVER (PARTITION BY user_id) AS length, max(seq) OVER (PARTITION BY user_id) AS last_seq FROM {DIST})))"


@query(
    f"""SELECT user_id, i, {half_up_sql('lat', 6)} AS lat, {half_up_sql('lng', 6)} AS lng FROM (
        SELECT user_id, CASE WHEN seq = 1 THEN 0 ELSE CAST(n AS bigint) - 1 END AS i, lat, lng FROM {_SAMPLED} WHERE seq = 1 OR seq = last_seq
        UNION ALL SELECT user_id, i, plat + (i * every - pm) / step_m * (lat - plat), plng + (i * every - pm) / step_m * (lng - plng) FROM
        (SELECT *, unnest(range(CAST(floor(pm / every) AS bigint) + 1, least(CAST(floor(metres / every) AS bigint), CAST(n AS bigint) - 2) + 1)) AS i FROM
        (SELECT *, lag(lat) OVER w AS plat, lag(lng) OVER w AS plng, lag(metres) OVER w AS pm FROM {_SAMPLED} WINDOW w AS (PARTITION BY user_id ORDER BY seq)) WHERE step_m > 0))"""
)
def track_resample(spark, sf_dir):
    (t,) = views(spark, sf_dir, "v_track")
    found = tracks.resample(t, "user_id", 2500)
    return found.select("user_id", "i", half_up(C("lat"), 6).alias("lat"), half_up(C("lng"), 6).alias("lng"))


_ASKED = f"(SELECT user_id, k.k AS k, m * k.k / 7e0 - 100 AS metres FROM (SELECT user_id, max(metres) AS m FROM {DIST} GROUP BY user_id) JOIN (SELECT unnest(range(0, 9)) AS k) k ON true)"


@query(
    f"""WITH s AS (SELECT user_id, metres, min(elev) AS elev FROM {DIST} WHERE elev IS NOT NULL GROUP BY user_id, metres),
        q AS (SELECT q.*, (SELECT max(struct_pack(m := s.metres, e := s.elev)) FROM s WHERE s.user_id = q.user_id AND s.metres <= q.metres) AS lo,
          (SELECT min(struct_pack(m := s.metres, e := s.elev)) FROM s WHERE s.user_id = q.user_id AND s.metres > q.metres) AS hi FROM {_ASKED} q)
        SELECT user_id, k, {half_up_sql('coalesce(lo.e + (metres - lo.m) / (hi.m - lo.m) * (hi.e - lo.e), lo.e, hi.e)', 6)} AS elev FROM q"""
)
def elevation_asof(spark, sf_dir):
    t = _track(spark, sf_dir)
    samples = t.where(C("elev").isNotNull()).groupBy("user_id", "metres").agg(F.min("elev").alias("elev"))
    asked = t.groupBy("user_id").agg(F.max("metres").alias("m")).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(8).cast("long"))))
    asked = asked.select("user_id", "k", (C("m") * C("k") / num(7) - 100).alias("metres"))
    return tracks.elevation_at(samples, asked, "user_id").select("user_id", "k", half_up(C("elev"), 6).alias("elev"))


@query(
    """SELECT event_type, median(value) AS median, max(CASE WHEN k = CAST(floor((n - 1) * 0.95e0) AS bigint) THEN value END) AS p95, count(*) AS n FROM
       (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY event_type"""
)
def bench_median_p95(spark, sf_dir):
    from ridgeline.operators.summaries import median_p95

    return median_p95(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type", "value", "event_id")
