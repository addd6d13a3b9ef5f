"""Summary statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions.geo import num


def median_p95(samples: DataFrame, key: str, value: str, tie: str) -> DataFrame:
    """Median, the value at index floor(0.95 (n - 1)) of the sorted values, and the count.

    Both order statistics come from histograms of equal values, which combine on the map side, so a
    group never has to sit in one task; only its distinct values are ordered.
    """
    counts = samples.groupBy(key, value).agg(F.count(tie).alias("_c"))
    upto = Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumns({"_end": F.sum("_c").over(upto), "_n": F.sum("_c").over(Window.partitionBy(key))})

    def at(index):
        return F.min(F.when(F.col("_end") > index, F.col(value)))

    low, high = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)
    found = ranked.groupBy(key).agg(at(low).alias("_a"), at(high).alias("_b"), at(F.floor((F.col("_n") - 1) * num(0.95))).alias("p95"), F.max("_n").alias("n"))
    return found.select(key, ((F.col("_a") + F.col("_b")) / 2).alias("median"), "p95", "n")
