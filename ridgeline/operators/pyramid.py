"""Nearest targets at any distance by a pyramid of cell counts.

Targets are counted by cell at several levels, each cell with the box of its targets. A point starts
with the few cells of the top level and descends: at every level, the cells that surely hold enough
targets bound how far the k-th nearest can be, and cells that begin beyond that are dropped. So a
point reads a few cells a level and the targets of a few of the smallest, however far it is from any.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.cluster import stored
from ridgeline.functions.geo import EARTH_M, haversine_m, num

#: Levels from top to bottom: cells of 180 / 2**level by 360 / 2**level degrees. A cell has at most 64 below it.
LEVELS = (2, 5, 8, 11, 14, 17)
#: Metres by which bounds may be off, for rounding.
SLACK_M = 0.01


def _cell(lat: Column, lng: Column, level: int) -> tuple[Column, Column]:
    n = 1 << level
    y = F.least(F.floor((lat + 90) / 180 * n), F.lit(n - 1)).cast("long")
    return y, F.pmod(F.floor((lng + 180) / 360 * n), F.lit(n)).cast("long")


def _counted(targets: DataFrame) -> list[DataFrame]:
    """A table a level, top first: y, x (cell), py, px (cell above), n, and the box of its targets."""
    box = [F.min("south").alias("south"), F.min("west").alias("west"), F.max("north").alias("north"), F.max("east").alias("east")]
    y, x = _cell(F.col("to_lat"), F.col("to_lng"), LEVELS[-1])
    lng = F.pmod(F.col("to_lng") + 180, num(360)) - 180
    own = targets.select(y.alias("y"), x.alias("x"), F.lit(1).cast("long").alias("n"), F.col("to_lat").alias("south"), lng.alias("west"), F.col("to_lat").alias("north"), lng.alias("east"))
    tables = []
    for level, above in zip(LEVELS[::-1], [*LEVELS[-2::-1], LEVELS[0]]):
        step = level - above
        own = own.groupBy("y", "x").agg(F.sum("n").alias("n"), *box)
        own = stored(own.withColumns({"py": F.shiftright("y", step), "px": F.shiftright("x", step)}), f"cells-{level}")
        tables.append(own)
        own = own.select(F.col("py").alias("y"), F.col("px").alias("x"), "n", "south", "west", "north", "east")
    return tables[::-1]


def _bounds() -> tuple[Column, Column]:
    """(least, greatest) metres from a point (lat, lng) to anything in a box, rounded apart."""
    lat, lng, (south, west, north, east) = F.col("lat"), F.col("lng"), map(F.col, ("south", "west", "north", "east"))
    up = F.radians(F.greatest(south - lat, lat - north, num(0)))
    turned = lambda d: F.least(F.pmod(d, num(360)), num(360) - F.pmod(d, num(360)))
    own = F.pmod(lng + 180, num(360)) - 180
    aside = F.when(own.between(west, east), num(0)).otherwise(F.radians(F.least(turned(west - own), turned(own - east))))
    # to a meridian: straight to it where it is less than a quarter turn away, else over the pole
    over = F.when(aside < math.pi / 2, F.asin(F.least(num(1), F.sin(aside) * F.cos(F.radians(lat))))).otherwise(num(math.pi / 2) - F.abs(F.radians(lat)))
    half = F.radians(north - south) / 2 + F.radians(east - west) / 2 * F.cos(F.radians(F.when((south <= 0) & (north >= 0), num(0)).otherwise(F.least(F.abs(south), F.abs(north)))))
    # all of a box is within half of its middle; for large boxes the bounds of its sides are the better ones
    middle = haversine_m(lat, lng, (south + north) / 2, (west + east) / 2)
    least = F.greatest(num(EARTH_M) * F.greatest(up, over), middle - num(EARTH_M) * half)
    greatest = middle + num(EARTH_M) * half
    return least - num(SLACK_M), greatest + num(SLACK_M)


def _within(candidates: DataFrame, key: str, most: int) -> DataFrame:
    """The cells that may hold one of a point's ``most`` nearest targets."""
    least, greatest = _bounds()
    c = candidates.withColumns({"_lo": least, "_hi": greatest})
    sure = F.sum("n").over(Window.partitionBy(key).orderBy("_hi").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    # without enough targets in all, every cell stays
    reach = F.min(F.when(F.col("_sure") >= most, F.col("_hi"))).over(Window.partitionBy(key))
    return c.withColumn("_sure", sure).withColumn("_reach", reach).where(F.col("_reach").isNull() | (F.col("_lo") <= F.col("_reach"))).drop("_lo", "_hi", "_sure", "_reach")


def nearest_pairs(points: DataFrame, targets: DataFrame, key: str, most: int) -> DataFrame:
    """(key, lat, lng, all of targets, metres): for every point at least its ``most`` nearest targets, and few others.

    points: key (unique), lat, lng. targets: to_lat, to_lng and any other columns. Rows without a place meet nothing.
    """
    placed = targets.where(F.col("to_lat").between(-90, 90) & F.col("to_lng").isNotNull() & ~F.isnan("to_lng"))
    levels = _counted(placed)
    cell = ("y", "x", "n", "south", "west", "north", "east")
    top = F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in cell]) for r in levels[0].select(*cell).orderBy("y", "x").collect()])  # at most 16 cells
    here = points.where(F.col("lat").isNotNull() & F.col("lng").isNotNull()).select(key, "lat", "lng")
    if not levels[0].take(1):
        return here.limit(0).join(placed.limit(0).withColumn("metres", num(0)))
    kept = _within(here.select(key, "lat", "lng", F.inline(top)), key, most)
    for below in levels[1:]:
        inner = below.select(*cell, "py", "px")
        kept = _within(kept.select(key, "lat", "lng", F.col("y").alias("py"), F.col("x").alias("px")).join(inner, ["py", "px"]).drop("py", "px"), key, most)
    y, x = _cell(F.col("to_lat"), F.col("to_lng"), LEVELS[-1])
    return kept.select(key, "lat", "lng", "y", "x").join(placed.withColumns({"y": y, "x": x}), ["y", "x"]).drop("y", "x").withColumn("metres", haversine_m(F.col("lat"), F.col("lng"), F.col("to_lat"), F.col("to_lng")))
