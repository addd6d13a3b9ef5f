"""Mixing sources to target token counts by entropy balancing, with DataFrame functions only.

Each document d of size x_d gets a rate r_d in (0, 2), its expected number of copies. Among all
rates that meet the token constraint of every source, sum(x_d r_d) = target, the entropy-balanced
ones lie nearest to the prior rate 1: r_d = 2 / (1 + exp(-m x_d / mean)), exponentially tilted by
size and bounded by the most copies allowed. The multipliers m solve the convex dual, by Newton's
method kept inside a bracket: each iteration is one aggregation over the corpus' (source, size)
histogram, which is what the dual depends on. Rates are then rounded into whole copies by
systematic rounding along (size, hash) order, so that a source's error is below its largest
document; of a few starting points, each source takes the one that comes nearest to its target.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ridgeline.cluster import stored
from ridgeline.llm.common import null_safe, running_total, seeded_hash

#: Fixed-point unit of a rate: cumulated rates are exact integers, the same in any order of adding.
UNIT = 1_000_000
MAX_COPIES = 2
#: Starting points of the rounding that are tried.
STARTS = 64
#: Documents of one source and size that one task numbers, about.
SUB_ROWS = 1 << 16
#: Sources that a mixture may have; each is a number on the driver and a row of a broadcast table.
MAX_SOURCES = 10_000
#: Names of helper columns.
OWN = ("_size", "_h", "_one", "_sub", "_sum", "_before", "_number", "_rate", "_start", "_count", "_m", "_mean")


def water_fill(sizes: list[tuple[str | None, int]], weights: tuple[float, ...], share: float, cap: float = MAX_COPIES) -> dict[str | None, float]:
    """Target of each source: ``share`` of all sizes by weight, none above ``cap`` times its size.

    Sources run by code point, null last, and take the weights in turn. What a capped source can't
    take is shared again by weight among the others until none is above its cap.
    """
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size = dict(order)
    left, target, open_ = share * sum(size.values()), {}, [s for s, _ in order]
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if unit * weight[s] > cap * size[s]]
        if not full:
            return target | {s: unit * weight[s] for s in open_}
        for s in full:
            target[s] = float(cap * size[s])
            left -= target[s]
        open_ = [s for s in open_ if s not in full]
    return target


def _rate(size, multiplier, mean):
    return F.lit(float(MAX_COPIES)) / (F.lit(1.0) + F.exp(-multiplier * size / mean))


def solve_multipliers(hist: DataFrame, source: str, targets: list[tuple], iterations: int = 100, tolerance: float = 1e-9) -> list[tuple]:
    """(source, multiplier, mean size) of each source; one row a source stays on the driver.

    A source at its cap has an infinite multiplier (all rates 2), an empty target minus infinity. A
    source is settled within the tolerance, or when its multiplier can't move any more; if one is not
    after all iterations, that is an error.
    """
    spark = hist.sparkSession
    schema = StructType([StructField(source, StringType()), StructField("_m", DoubleType()), StructField("_mean", DoubleType())])
    state = {}
    for s, size, count, target in targets:
        fixed = math.inf if target >= MAX_COPIES * size * (1 - 1e-12) else -math.inf if target <= 0 else None
        state[s] = {"m": fixed if fixed is not None else 0.0, "lo": -math.inf, "hi": math.inf, "mean": max(size / max(count, 1), 1e-9), "target": target, "done": fixed is not None}
    for _ in range(iterations):
        live = [(s, x["m"], x["mean"]) for s, x in state.items() if not x["done"]]
        if not live:
            break
        table = F.broadcast(spark.createDataFrame(live, schema))  # one row a source of the mixture
        rate = _rate(F.col("_size"), F.col("_m"), F.col("_mean"))
        slope = F.col("_size") / F.col("_mean") * rate * (F.lit(1.0) - rate / MAX_COPIES)
        found = (
            null_safe(hist, table, [source])
            .groupBy(source)
            .agg(F.sum(F.col("_count") * F.col("_size") * rate).alias("got"), F.sum(F.col("_count") * F.col("_size") * slope).alias("slope"))
            .collect()
        )
        for row in found:
            x, gap = state[row[source]], row["got"] - state[row[source]]["target"]
            if abs(gap) <= tolerance * x["target"]:
                x["done"] = True
                continue
            x["hi" if gap > 0 else "lo"] = x["m"]
            step = x["m"] - gap / row["slope"] if row["slope"] > 0 else math.nan
            if not x["lo"] < step < x["hi"]:
                lo, hi = x["lo"], x["hi"]
                step = (lo + hi) / 2 if math.isfinite(lo + hi) else (x["m"] * 2 + 1 if gap < 0 else x["m"] * 2 - 1)
            x["done"] = step == x["m"]
            x["m"] = step
    if unsettled := [s for s, x in state.items() if not x["done"]]:
        raise RuntimeError(f"no multiplier for {unsettled} after {iterations} iterations")
    return [(s, x["m"], x["mean"]) for s, x in state.items()]


def entropy_mix(docs: DataFrame, size: str = "size", source: str = "source", key: str = "doc_id", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, seed: int = 29) -> DataFrame:
    """Adds ``source_size``, ``target`` (the source's, in the unit of ``size``) and ``copies`` (0 to 2).

    Sizes are whole numbers, null counting 0; documents of size 0 keep
    the prior rate, one copy. A null source is a source of its own. Rows that agree in key are
    interchangeable. Input columns named as a result, or after this operator's own, are dropped.
    An empty table gives an empty table. A mixture of more than ``MAX_SOURCES`` sources is an error.
    """
    spark = docs.sparkSession
    sized = docs.drop("source_size", "target", "copies", *OWN).withColumn("_size", F.coalesce(F.col(size), F.lit(0)).cast("long"))
    hist = stored(sized.groupBy(source, "_size").agg(F.count("*").alias("_count")), "size-histogram")
    totals = hist.groupBy(source).agg(F.sum(F.col("_count") * F.col("_size")).alias("s"), F.sum("_count").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"a mixture has at most {MAX_SOURCES} sources")
    targets = water_fill([(r[source], r["s"]) for r in totals], weights, share)
    solved = {s: (m, mean) for s, m, mean in solve_multipliers(hist, source, [(r[source], r["s"], r["n"], targets[r[source]]) for r in totals])}
    schema = StructType([StructField(source, StringType()), StructField("source_size", LongType()), StructField("target", DoubleType()), StructField("_m", DoubleType()), StructField("_mean", DoubleType())])
    mixture = F.broadcast(spark.createDataFrame([(r[source], r["s"], float(targets[r[source]]), *solved[r[source]]) for r in totals], schema))  # one row a source
    tilted = F.round(_rate(F.col("_size"), F.col("_m"), F.col("_mean")) * UNIT).cast("long")
    rates = null_safe(hist, mixture, [source]).withColumn("_rate", F.when(F.col("_size") == 0, F.lit(UNIT)).otherwise(tilted))
    start = Window.partitionBy(source).orderBy("_size").rowsBetween(Window.unboundedPreceding, -1)
    rates = rates.withColumn("_start", F.coalesce(F.sum(F.col("_count") * F.col("_rate")).over(start), F.lit(0)))
    # copies of a size telescope, so the words that a starting point gives come from the histogram
    given = lambda u: f"_size * ((_start + _count * _rate + {u}) div {UNIT} - (_start + {u}) div {UNIT})"
    points = [k * UNIT // STARTS for k in range(STARTS)]
    tried = rates.groupBy(source).agg(F.first("target").alias("target"), *[F.sum(F.expr(given(u))).alias(f"_{k}") for k, u in enumerate(points)])
    miss = F.array(*[F.struct(F.abs(F.col(f"_{k}") - F.col("target")).alias("miss"), F.lit(u).alias("u")) for k, u in enumerate(points)])
    rates = null_safe(rates, tried.select(source, F.array_min(miss)["u"].alias("_u")), [source])
    rates = rates.select(source, "_size", "source_size", "target", "_rate", "_count", (F.col("_start") + F.col("_u")).alias("_start"))
    hashed = sized.withColumns({"_h": seeded_hash(seed, F.col(key)), "_one": F.lit(1).cast("long")})
    # documents of one source and size run by hash; the larger the group, the more ranges of it
    ranged = null_safe(hashed, rates, [source, "_size"]).withColumn("_sub", F.expr(f"_h div ({2**60} div (_count div {SUB_ROWS} + 1) + 1)"))
    numbered = running_total(ranged, [source, "_size"], "_sub", ["_h", key], "_one", "_number")
    low = F.expr(f"(_start + _number * _rate) div {UNIT}")
    high = F.expr(f"(_start + (_number + 1) * _rate) div {UNIT}")
    return numbered.withColumn("copies", (high - low).cast("int")).drop(*OWN)
