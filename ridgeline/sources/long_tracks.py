"""GPX and KML files of any size: points as rows, a file read by as many tasks as it has blocks.

No row holds a file. GPX is cut where a point's tag opens, KML at commas, so a piece is as small as a
point. Where a piece stands is its file, block and place in the block; parts of blocks are numbered by
themselves and shifted by the counts of those before them, one small row a part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.cluster import spread, stored
from ridgeline.functions.geo import half_up, num

#: Bits of the number of pieces of a part: what one task numbers at once doesn't grow with the blocks.
PART_BITS = 16
#: Points whose rises one task sums in order.
STRETCH = 1 << 16


def _pieces(spark: SparkSession, paths: str | list[str], separator: str) -> DataFrame:
    """(value, file, block, at) and the folder's partition columns: texts between separators, in order of (block, at)."""
    read = spark.read.option("lineSep", separator).text(paths)
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")]
    return read.select("*", *place)


def _running(df: DataFrame, order: list[str], **amounts: Column) -> DataFrame:
    """Adds the sum of each amount over the file up to each row, that row included. The first column of the order is a whole number."""
    part = ["file", "block", "_part"]
    df = spread(df.withColumn("_part", F.shiftright(order[0], PART_BITS)), *part)
    inside = Window.partitionBy(*part).orderBy(*order)
    earlier = Window.partitionBy("file").orderBy("block", "_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*part).agg(*[F.sum(a).alias(f"_{name}") for name, a in amounts.items()])
    before = totals.select(*part, *[F.coalesce(F.sum(f"_{name}").over(earlier), F.lit(0)).alias(f"_{name}") for name in amounts])
    summed = df.withColumns({name: F.sum(a).over(inside) for name, a in amounts.items()})
    return summed.join(before, part).withColumns({name: F.col(name) + F.col(f"_{name}") for name in amounts}).drop("_part", *[f"_{name}" for name in amounts])


def _numbered(points: DataFrame, order: list[str]) -> DataFrame:
    """Points in range, numbered from 1 in their file."""
    valid = points.where(F.col("lat").between(-90, 90) & F.col("lng").between(-180, 180))
    return _running(valid, order, seq=F.lit(1)).drop("block", *order)


def read_gpx_points(spark: SparkSession, paths: str | list[str], element: str = "trkpt") -> DataFrame:
    """(file, seq, lat, lng, elev) and partition columns: the ``element`` points of GPX files.

    ``element`` is the tag as written, ``rtept`` for routes, with a prefix where files have one. A point without an
    elevation, or with one that is no number, has null; points out of range or without a number are dropped. Files
    without points give no row. Points inside XML comments count.
    """
    pieces = _pieces(spark, paths, f"<{element}")
    tag = F.regexp_extract("value", r"^(\s[^<>]*)>", 1)
    attribute = lambda name: F.regexp_extract("_tag", rf"""\s{name}\s*=\s*["']\s*([^"']*?)\s*["']""", 1).try_cast("double")
    body = F.when(~F.col("_tag").endswith("/"), F.substring_index("value", f"</{element}", 1))
    elev = F.regexp_extract(body, r"<(?:\w+:)?ele\s*>\s*([^<]*?)\s*<", 1).try_cast("double")
    points = pieces.withColumn("_tag", tag).where("_tag <> ''").withColumns({"lat": attribute("lat"), "lng": attribute("lon"), "elev": elev})
    return _numbered(points.drop("value", "_tag"), ["at"])


def read_kml_points(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, seq, lat, lng, elev) and partition columns: all lng,lat[,alt] of the lines of KML files.

    Coordinates outside ``LineString`` are left out, as are those that are no numbers or out of range. White space
    parts coordinates and may be of any kind. Files without lines give no row.
    """
    pieces = _pieces(spark, paths, ",")
    # what follows a comma at once goes on with the coordinate before it; every later word begins one
    first = F.regexp_extract("value", r"^([^\s<>]*)", 1)
    rest = F.substr("value", F.char_length("_first") + 1)
    words = F.regexp_extract_all("_rest", F.lit(r"<[^>]*>|[^\s<>]+"), F.lit(0))
    # a comma after white space or a tag has an empty coordinate before it
    words = F.when(F.col("_rest").rlike(r"[\s>]$"), F.concat(words, F.array(F.lit("")))).otherwise(words)
    cut = pieces.withColumn("_first", first).withColumn("_rest", rest)
    tokens = cut.select("*", F.posexplode(F.concat(F.array("_first"), words)).alias("i", "token")).drop("value", "_first", "_rest")
    opens = lambda name: F.col("token").rlike(rf"^<(\w+:)?{name}(\s[^>]*[^/>]|\s*)>$").cast("int") - F.col("token").rlike(rf"^</(\w+:)?{name}\s*>$").cast("int")
    begins = ((F.col("i") > 0) & ~F.col("token").startswith("<")).cast("int")
    placed = _running(tokens, ["at", "i"], tuple=begins, line=opens("LineString"), inside=opens("coordinates"))
    parts = spread(placed.where("line > 0 AND inside > 0 AND NOT startswith(token, '<')"), "file", "tuple")
    others = [c for c in parts.columns if c not in ("file", "block", "at", "i", "token", "tuple", "line", "inside")]
    place = F.row_number().over(Window.partitionBy("file", "tuple").orderBy("block", "at", "i"))
    part = lambda k: F.max(F.when(F.col("_k") == k, F.col("token"))).try_cast("double")
    kept = parts.withColumn("_k", place).where("_k <= 3").groupBy("file", "tuple", *others)
    points = kept.agg(F.min("block").alias("block"), part(2).alias("lat"), part(1).alias("lng"), part(3).alias("elev"))
    return _numbered(stored(points, "points"), ["tuple"])  # numbering reads them twice


def climbs(points: DataFrame, *also: str) -> DataFrame:
    """(file, also, points, gain_m): how many points each file has and the sum of its rises, a rise from or to a point without
    elevation being 0. Files are cut into stretches; each holds the last point of the one before it too."""
    at = F.col("seq") - 1
    stretch = F.floor(at / STRETCH)
    held = points.withColumn("_part", F.explode(F.when(at % STRETCH == STRETCH - 1, F.array(stretch, stretch + 1)).otherwise(F.array(stretch))))
    rise = F.greatest(F.col("elev") - F.lag("elev").over(Window.partitionBy("file", "_part").orderBy("seq")), num(0))
    own = F.floor((F.col("seq") - 1) / STRETCH) == F.col("_part")
    sums = held.withColumn("_rise", rise).where(own).groupBy("file", *also)
    return sums.agg(F.count("*").alias("points"), half_up(F.coalesce(F.sum("_rise"), num(0)), 2).alias("gain_m"))
