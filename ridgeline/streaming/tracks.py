"""Structured Streaming over track points and request lines (an extension; the batch forms lead)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

REQUEST = "request_id long, activity string, route_type string, target_distance_km double, target_duration_min double, start_lat double, start_lng double"


def read_points(spark: SparkSession, path: str, schema: str = "user_id long, ts timestamp, lat double, lng double, elev double") -> DataFrame:
    """Points from a folder of Parquet files, a few files a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(path)


def windowed_stats(points: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Points, lowest and highest elevation of each user and window; later points than ``late`` are dropped."""
    return (
        points.withWatermark("ts", late)
        .groupBy("user_id", F.window("ts", window).alias("w"))
        .agg(F.count("*").alias("points"), F.min("elev").alias("lowest"), F.max("elev").alias("highest"))
        .select("user_id", F.col("w.start").alias("start"), "points", "lowest", "highest")
    )


def outings(points: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a user: points with no pause above ``gap``."""
    return (
        points.withWatermark("ts", late)
        .groupBy("user_id", F.session_window("ts", gap).alias("s"))
        .agg(F.count("*").alias("points"))
        .select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "points")
    )


def answer_lines(spark: SparkSession, source: str, answer: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Requests as JSON lines in, answers as JSON lines out, a micro-batch at a time.

    The batch number names the output, so a batch that is repeated after a failure replaces itself.
    """
    lines = spark.readStream.schema(REQUEST).json(source)

    def write(batch: DataFrame, number: int) -> None:
        answer(batch).write.mode("overwrite").json(f"{sink}/batch={number}")

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
