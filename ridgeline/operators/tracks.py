"""Operators on ordered tracks: elevation repair, smoothing, resampling, profiles.

A track is rows (key, seq, lat, lng, elev). Every operator is one window over (key, seq), so a
cascade of them sorts and shuffles once.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions.geo import half_up, haversine_m, num

# Sampling step, most samples, spike limits, smoothing width.
STEP_M, MOST_SAMPLES = 25.0, 500
SPIKE_GAP_M, SPIKE_SIZE_M = 4.0, 10.0
SIGMA = 4


def _order(key: str):
    return Window.partitionBy(key).orderBy("seq")


def with_distance(track: DataFrame, key: str) -> DataFrame:
    """Adds ``step_m`` (from the point before; 0 at first) and ``metres`` so far, in whole millimetres."""
    w = _order(key)
    step = haversine_m(F.lag("lat").over(w), F.lag("lng").over(w), F.col("lat"), F.col("lng"))
    track = track.withColumn("step_m", F.coalesce(half_up(step, 3), num(0)))
    millimetres = F.sum(half_up(F.col("step_m") * 1000).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return track.withColumn("metres", millimetres / num(1000))


def fill_missing(track: DataFrame, key: str, at: str = "metres", value: str = "elev", out: str = "filled") -> DataFrame:
    """Interpolates missing values along ``at``; holds the nearest at both ends; 0 if none is known."""
    before = _order(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = _order(key).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(at).alias("at"), F.col(value).alias("value")))
    lo, hi = F.last(known, ignorenulls=True).over(before), F.first(known, ignorenulls=True).over(after)
    track = track.withColumns({"_lo": lo, "_hi": hi})
    span = F.col("_hi.at") - F.col("_lo.at")
    share = F.when(span > 0, (F.col(at) - F.col("_lo.at")) / span).otherwise(num(0))
    between = F.col("_lo.value") + (F.col("_hi.value") - F.col("_lo.value")) * share
    return track.withColumn(out, F.coalesce(F.col(value), between, "_lo.value", "_hi.value", num(0))).drop("_lo", "_hi")


def remove_spikes(track: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Replaces a point far off two neighbours that agree by their mean. Neighbours are read before any change."""
    a, b, x = F.lag(value).over(_order(key)), F.lead(value).over(_order(key)), F.col(value)
    spike = (F.abs(a - b) <= SPIKE_GAP_M) & (F.abs(x - (a + b) / 2) >= SPIKE_SIZE_M)
    return track.withColumn(out, F.when(F.coalesce(spike, F.lit(False)), (a + b) / 2).otherwise(x))


def gaussian(sigma: int) -> dict[int, float]:
    return {k: math.exp(-(k * k) / (2.0 * sigma * sigma)) for k in range(-3 * sigma, 3 * sigma + 1)}


def smooth(track: DataFrame, key: str, value: str, out: str, sigma: int = SIGMA) -> DataFrame:
    """Gaussian mean over three sigmas to both sides, cut at the ends, to one decimal.

    The kernel is a sum of lags and leads over one window: no self join, no collected frames.
    """
    w, weight, total = _order(key), None, None
    for k, g in gaussian(sigma).items():
        x = F.lead(value, k).over(w)
        part, share = F.coalesce(x * num(g), num(0)), F.when(x.isNotNull(), num(g)).otherwise(num(0))
        total, weight = (part, share) if total is None else (total + part, weight + share)
    return track.withColumn(out, half_up(total / weight, 1))


def resample(track: DataFrame, key: str, step_m: float = STEP_M, most: int = MOST_SAMPLES) -> DataFrame:
    """Points at equal intervals along each track, its last point included: key, ``i``, lat, lng.

    Each step knows how far the track has come, so it emits the samples that fall into it by itself.
    """
    w = Window.partitionBy(key)
    length = F.max("metres").over(w)
    samples = F.least(num(most), F.greatest(num(2), F.floor(length / num(step_m)).cast("double") + 1))
    track = with_distance(track, key).withColumns({"_length": length, "_last": F.max("seq").over(w)})
    track = track.withColumn("_every", F.when(F.col("_length") > 0, F.col("_length") / (samples - 1))).withColumn("_samples", samples.cast("long"))
    lag = {c: F.lag(c).over(_order(key)) for c in ("lat", "lng", "metres")}
    track = track.withColumns({"_lat": lag["lat"], "_lng": lag["lng"], "_from": lag["metres"]})
    first = F.floor(F.col("_from") / F.col("_every")) + 1
    last = F.least(F.floor(F.col("metres") / F.col("_every")), F.col("_samples") - 2)
    steps = track.where((F.col("step_m") > 0) & (first <= last)).withColumn("i", F.explode(F.sequence(first, last)))
    share = (F.col("i") * F.col("_every") - F.col("_from")) / F.col("step_m")
    inner = steps.select(key, "i", (F.col("_lat") + share * (F.col("lat") - F.col("_lat"))).alias("lat"), (F.col("_lng") + share * (F.col("lng") - F.col("_lng"))).alias("lng"))
    ends = track.where((F.col("seq") == 1) | ((F.col("seq") == F.col("_last")) & (F.col("_length") > 0)))
    ends = ends.select(key, F.when(F.col("seq") == 1, F.lit(0)).otherwise(F.col("_samples") - 1).cast("long").alias("i"), "lat", "lng")
    return ends.unionByName(inner)


def profile_stats(track: DataFrame, key: str, value: str) -> DataFrame:
    """Lowest, highest, gain and descent of each track, in whole metres."""
    change = F.col(value) - F.lag(value).over(_order(key))
    tenths = half_up(change * 10).cast("long")
    return (
        track.withColumn("_d", tenths)
        .groupBy(key)
        .agg(
            half_up(F.min(value)).alias("lowest"),
            half_up(F.max(value)).alias("highest"),
            half_up(F.coalesce(F.sum(F.greatest("_d", F.lit(0))), F.lit(0)) / num(10)).alias("gain"),
            half_up(F.coalesce(F.sum(F.greatest(-F.col("_d"), F.lit(0))), F.lit(0)) / num(10)).alias("descent"),
        )
    )


def elevation_at(samples: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """As-of join with interpolation: the elevation of each asked distance, held at both ends.

    samples: key, metres, elev. asked: key, metres, and any other columns. One union, one window.
    """
    others = [c for c in asked.columns if c not in (key, "metres")]
    s = samples.select(key, "metres", "elev", F.lit(0).alias("_kind"), *[F.lit(None).alias(c) for c in others])
    q = asked.select(key, "metres", F.lit(None).cast("double").alias("elev"), F.lit(1).alias("_kind"), *others)
    order = Window.partitionBy(key).orderBy("metres", "_kind")
    known = F.when(F.col("_kind") == 0, F.struct("metres", "elev"))
    lo = F.last(known, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    hi = F.first(known, ignorenulls=True).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    both = s.unionByName(q).withColumns({"_lo": lo, "_hi": hi}).where("_kind = 1")
    span = F.col("_hi.metres") - F.col("_lo.metres")
    between = F.col("_lo.elev") + (F.col("metres") - F.col("_lo.metres")) / F.when(span > 0, span) * (F.col("_hi.elev") - F.col("_lo.elev"))
    return both.select(key, "metres", *others, F.coalesce(between, "_lo.elev", "_hi.elev").alias("elev"))

