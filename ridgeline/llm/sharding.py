"""Sharding by proportional stratified interleaving, with DataFrame functions only.

Rows are shuffled by a seeded hash and ranked within their source; a row of rank r among the n rows
of its source gets the fractional rank (2r - 1) / 2n. Sorted by it, the sources are interleaved in
proportion all along the order, so cutting the order into equal runs gives shards that all match
the mixture. Neither a source nor the whole table is ever sorted in one task: ranks come from
bucket sums (``running_total``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import RANK_BUCKETS, null_safe, running_total, seeded_hash

#: Names of helper columns.
OWN = ("_h", "_one", "_bucket", "_rank", "_n", "_frac", "_b", "_before", "_all", "_pos", "_sum")


def stratified_shards(
    docs: DataFrame, shards: int = 16, seed: int = 17, stratum: str = "source", key: str = "doc_id", ties: tuple[str, ...] = (), buckets: int = RANK_BUCKETS
) -> DataFrame:
    """Adds ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in its shard).

    Shard sizes differ by one row at most. A null stratum is a stratum of its own. The shuffle hashes
    key and ``ties``, so rows of one key, or without one, are spread as far as their ties differ; rows
    that agree in all of them are interchangeable. ``buckets`` decides how many rows a task sorts at
    once, not the result. Input columns named shard or slot,
    or after this operator's own (``_h`` and the like), are dropped. An empty table stays empty.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    width = 2**60 // buckets + 1
    hashed = docs.drop("shard", "slot", *OWN).withColumns({"_h": seeded_hash(seed, F.col(key), *map(F.col, ties)), "_one": F.lit(1).cast("long")})
    hashed = hashed.withColumn("_bucket", F.floor(F.col("_h") / F.lit(width)).cast("int"))
    totals = hashed.groupBy(stratum).agg(F.sum("_one").alias("_n"))
    order = ["_h", key, *ties]
    ranked = running_total(hashed, [stratum], "_bucket", order, "_one", "_rank")
    ranked = null_safe(ranked, totals, [stratum])
    placed = ranked.withColumn("_frac", (F.col("_rank") * 2 + 1) / (F.col("_n") * 2).cast("double"))
    placed = placed.withColumn("_bucket", F.floor(F.col("_frac") * buckets).cast("int"))
    # one row a bucket; the last running total is the number of rows
    sums = placed.groupBy("_bucket").agg(F.sum("_one").alias("_sum"))
    run = Window.orderBy("_bucket")
    offsets = sums.select(
        F.col("_bucket").alias("_b"),
        (F.sum("_sum").over(run) - F.col("_sum")).alias("_before"),
        F.sum("_sum").over(run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"),
    )
    inside = Window.partitionBy("_bucket").orderBy("_frac", F.col(stratum).asc_nulls_last(), *order)
    position = placed.join(offsets, placed["_bucket"] == offsets["_b"]).withColumn("_pos", F.col("_before") + F.row_number().over(inside) - 1)
    shard = F.expr(f"_pos * {shards} div _all")
    return (
        position.withColumn("shard", shard.cast("int"))
        .withColumn("slot", (F.col("_pos") - F.expr(f"(shard * _all + {shards - 1}) div {shards}")).cast("long"))
        .drop(*OWN)
    )
