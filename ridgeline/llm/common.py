"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of characters other than space and ASCII control white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Hash buckets of a distributed running total. Each bucket is sorted in one task, and one row
#: a bucket (and group) goes through the small table of offsets.
RANK_BUCKETS = 4096

#: Bytes of text that a Python task turns into its own objects at a time.
PART_BYTES = 4 << 20


def by_bytes(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut by size: each part holds at most ``limit`` bytes of the column, or one row."""
    for batch in batches:
        upto = np.cumsum(np.asarray(pc.binary_length(batch.column(column)).fill_null(0), np.int64))
        at = 0
        while at < len(batch):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded_hash(seed: int, *cols: Column) -> Column:
    """60 bits of md5 over the seed and the columns: the same number in any SQL engine."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi join in which null keys match each other; keeps the left keys only."""
    other = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    on = None
    for k in keys:
        c = left[k].eqNullSafe(other[f"_r_{k}"])
        on = c if on is None else on & c
    return left.join(other, on, how).drop(*[f"_r_{k}" for k in keys])


def running_total(df: DataFrame, groups: list[str], bucket: str, order: list, value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` (long) over all earlier rows of the group, this row excluded.

    Rows run by (bucket, order). The bucket sums are made with map-side partial aggregation, their
    running totals over one small row a bucket; the rows themselves are sorted bucket by bucket, so
    a group that holds a third of the table is spread over its buckets.
    """
    sums = df.groupBy(*groups, bucket).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*groups, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = null_safe(df, offsets, [*groups, bucket])
    return joined.withColumn(out, F.col("_before") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_before")
