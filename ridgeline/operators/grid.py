"""Cells of the globe for spatial equi joins, at any latitude and across the date line.

Rows of cells have a fixed height in degrees. Each row is cut into as many whole cells as keep their
width, at the row's edge nearer to a pole, at least as large as the height is on the ground. So a
circle of a cell's height touches about nine cells everywhere, and cells wrap at the date line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.geo import num

#: Metres in a degree of latitude, rounded down, so that reaches in degrees are rounded up.
METRES_PER_DEGREE = 110_000.0


def height(metres: float) -> float:
    """Height in degrees of cells that are at least so many metres high."""
    return metres / METRES_PER_DEGREE


def _around(y: Column, degrees: float) -> Column:
    """Number of cells in row y."""
    edge = F.least(num(90), F.greatest(F.abs(y * num(degrees)), F.abs((y + 1) * num(degrees))))
    return F.greatest(F.lit(1), F.floor(num(360) * F.cos(F.radians(edge)) / num(degrees))).cast("long")


def cell(lat: Column, lng: Column, degrees: float) -> Column:
    """struct<y, x>: the cell in which a point lies."""
    y = F.floor(lat / num(degrees)).cast("long")
    around = _around(y, degrees)
    return F.struct(y.alias("y"), F.pmod(F.floor((lng + 180) * around / 360).cast("long"), around).alias("x"))


def cover(south: Column, west: Column, north: Column, east: Column, degrees: float) -> Column:
    """array<struct<y, x>>: the cells that a box touches, each once. West may lie below -180, east above 180."""
    rows = F.sequence(F.floor(F.greatest(south, num(-90)) / num(degrees)).cast("long"), F.floor(F.least(north, num(90)) / num(degrees)).cast("long"))

    def of_row(y: Column) -> Column:
        around = _around(y, degrees)
        low = F.floor((west + 180) * around / 360).cast("long")
        high = F.least(F.floor((east + 180) * around / 360).cast("long"), low + around - 1)
        return F.transform(F.sequence(low, high), lambda x: F.struct(y.alias("y"), F.pmod(x, around).alias("x")))

    return F.flatten(F.transform(rows, of_row))


def widened(south: Column, west: Column, north: Column, east: Column, metres: float) -> tuple[Column, Column, Column, Column]:
    """The box grown by a distance on every side; a box that then holds a pole goes around the globe."""
    reach = height(metres)
    edge = F.greatest(F.abs(south), F.abs(north))
    ratio = F.sin(F.radians(num(min(reach, 90.0)))) / F.cos(F.radians(edge))
    sideways = F.when(edge + num(reach) >= 90, num(180)).otherwise(F.degrees(F.asin(F.least(num(1), ratio))))
    return south - num(reach), west - sideways, north + num(reach), east + sideways


def spread(shapes: DataFrame, box: tuple[Column, Column, Column, Column], metres: float, degrees: float, out: str = "_cell") -> DataFrame:
    """A row for each cell within reach of a row's box (south, west, north, east).

    The grown box is a projection of its own below the explode, which keeps the generated code small.
    """
    names = ("_south", "_west", "_north", "_east")
    grown = shapes.withColumns(dict(zip(names, widened(*box, metres))))
    return grown.withColumn(out, F.explode(cover(*map(F.col, names), degrees))).drop(*names)


def line_spread(lines: DataFrame, line: tuple[str, str, str, str], metres: float, degrees: float, out: str = "_cell") -> DataFrame:
    """A row for each cell within ``metres`` of a row's line (columns lat1, lng1, lat2, lng2), each once.

    In each row of cells only the stretch of the line that comes within reach of the row counts, so a
    slanting line lies in the cells along it, not in all of its box. Lines are straight in degrees and
    don't cross the date line; cells do.
    """
    lat1, lng1, lat2, lng2 = map(F.col, line)
    reach = num(height(metres))
    south, north, least = F.least(lat1, lat2), F.greatest(lat1, lat2), F.least(lng1, lng2)
    sideways = least - widened(south, least, north, least, metres)[1]
    rows = F.sequence(F.floor(F.greatest(south - reach, num(-90)) / num(degrees)).cast("long"), F.floor(F.least(north + reach, num(90)) / num(degrees)).cast("long"))
    by_row = lines.withColumn("_sideways", sideways).withColumn("_y", F.explode(rows))
    # the stretch of the line, from 0 to 1, that lies in the row grown by the reach
    at = lambda lat: F.least(num(1), F.greatest(num(0), (lat - lat1) / (lat2 - lat1)))
    level = lat1 == lat2
    one, other = (at(x) for x in (F.col("_y") * num(degrees) - reach, (F.col("_y") + 1) * num(degrees) + reach))
    by_row = by_row.withColumns({"_a": F.when(level, num(0)).otherwise(one), "_b": F.when(level, num(1)).otherwise(other), "_around": _around(F.col("_y"), degrees)})
    by_row = by_row.withColumns({"_p": lng1 + (lng2 - lng1) * F.col("_a"), "_q": lng1 + (lng2 - lng1) * F.col("_b")})
    column = lambda lng: F.floor((lng + 180) * F.col("_around") / 360).cast("long")
    ends = by_row.withColumns({"_low": column(F.least("_p", "_q") - F.col("_sideways")), "_high": column(F.greatest("_p", "_q") + F.col("_sideways"))})
    found = ends.withColumn("_x", F.explode(F.sequence("_low", F.least(F.col("_high"), F.col("_low") + F.col("_around") - 1))))
    cell_ = F.struct(F.col("_y").alias("y"), F.pmod("_x", "_around").alias("x"))
    return found.withColumn(out, cell_).drop("_sideways", "_y", "_a", "_b", "_around", "_p", "_q", "_low", "_high", "_x")
