"""GPX and KML: writing and reading routes as XML text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.geo import half_up, num
from ridgeline.functions.text import escape_xml, exact_text, number_text
from ridgeline.operators.profiles import iso_time
from ridgeline.operators.tracks import elevation_at, with_distance

CREATOR = "ridgeline"


def gpx(name: Column, points: Column, saved_at: Column | None = None, timed: bool = False) -> Column:
    """GPX 1.1 of array<struct<lat, lng, elev>>; a null elevation leaves ``ele`` out. ``saved_at`` (ISO text) is the file's time;
    with ``timed``, points have a ``time`` (ISO text) too. A null time is left out."""

    def element(tag: str, text: Column, indent: str) -> Column:
        return F.coalesce(F.concat(F.lit(f"{indent}<{tag}>"), text, F.lit(f"</{tag}>")), F.lit(""))

    def point(p: Column) -> Column:
        inner = element("ele", exact_text(p["elev"]), "\n        ")
        if timed:
            inner = F.concat(inner, element("time", p["time"], "\n        "))
        end = F.when(inner == "", F.lit("</trkpt>")).otherwise(F.lit("\n      </trkpt>"))
        return F.concat(F.lit('      <trkpt lat="'), number_text(p["lat"]), F.lit('" lon="'), number_text(p["lng"]), F.lit('">'), inner, end)

    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<gpx version="1.1" creator="{CREATOR}" xmlns="http://www.topografix.com/GPX/1/1">\n'
    title = F.concat(F.lit("<name>"), escape_xml(name), F.lit("</name>\n"))
    time = F.lit("") if saved_at is None else F.coalesce(F.concat(F.lit("    <time>"), saved_at, F.lit("</time>\n")), F.lit(""))
    return F.concat(
        F.lit(f"{head}  <metadata>\n    "), title, time, F.lit("  </metadata>\n  <trk>\n    "), title, F.lit("    <trkseg>\n"),
        F.array_join(F.transform(points, point), "\n"), F.lit("\n    </trkseg>\n  </trk>\n</gpx>\n"),
    )


def route_gpx(routes: DataFrame, key: str) -> DataFrame:
    """(key, gpx): routes as GPX whose elevations come from the profile, by the distance along the line.

    routes: a unique ``key``, name, saved_at (text or null), geometry array<struct<lat, lng, time>>, profile
    array<struct<distance_km, elev_m>> in any order. Between two samples the elevation is interpolated, beyond the ends it is
    that of the end; samples without a number are left out, and without samples there is no elevation. A null name is
    empty, times that are not ISO are left out. Routes of under two points, or with a point without a number, give null.
    """
    asked = routes.select(key, F.posexplode("geometry").alias("pos", "_p")).select(key, "pos", "_p.lat", "_p.lng", "_p.time")
    asked = with_distance(asked.withColumnRenamed("pos", "seq"), key)
    samples = routes.select(key, F.explode("profile").alias("_s")).select(key, (F.col("_s.distance_km") * 1000).alias("metres"), F.col("_s.elev_m").alias("elev"))
    found = elevation_at(samples.dropna(subset=["metres", "elev"]), asked.select(key, "metres", "seq", "lat", "lng", "time"), key)
    point = F.struct("seq", "lat", "lng", "elev", iso_time(F.col("time")).alias("time"))
    good = (F.count("*") >= 2) & (F.count("*") == F.count(F.col("lat") + F.col("lng")))
    lines = found.groupBy(key).agg(F.when(good, F.array_sort(F.collect_list(point))).alias("_line"))
    text = gpx(F.coalesce("name", F.lit("")), F.col("_line"), iso_time(F.col("saved_at")), timed=True)
    return routes.select(key, "name", "saved_at").join(lines, key, "left").select(key, text.alias("gpx"))


def kml(name: Column, points: Column) -> Column:
    """KML with one line of lng,lat,alt; a null elevation is altitude 0."""

    def point(p: Column) -> Column:
        return F.concat_ws(",", number_text(p["lng"]), number_text(p["lat"]), number_text(F.coalesce(p["elev"], num(0))))

    head = '<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2">\n  <Document>\n    <name>'
    return F.concat(
        F.lit(head), escape_xml(name), F.lit("</name>\n    <Placemark>\n      <LineString>\n        <coordinates>"), F.array_join(F.transform(points, point), " "),
        F.lit("</coordinates>\n      </LineString>\n    </Placemark>\n  </Document>\n</kml>\n"),
    )


def _track(lat: Column, lng: Column, elev: Column) -> Column:
    """array<struct<lat, lng, elev>> from three aligned lists; points that are no numbers in range are dropped."""
    rows = F.transform(
        F.arrays_zip(lat.alias("a"), lng.alias("b"), elev.alias("c")),
        lambda z: F.struct(z["a"].try_cast("double").alias("lat"), z["b"].try_cast("double").alias("lng"), z["c"].try_cast("double").alias("elev")),
    )
    return F.filter(rows, lambda p: F.coalesce(p["lat"].between(-90, 90) & p["lng"].between(-180, 180), F.lit(False)))


def parse_gpx(documents: DataFrame, column: str = "xml") -> DataFrame:
    """Adds ``name``, ``points`` and ``gain_m``; ``points`` is null unless two or more are valid."""
    x = F.col(column)
    path = "//*[local-name()='trkpt' or local-name()='rtept']"
    lat, lng = F.xpath(x, F.lit(f"{path}/@lat")), F.xpath(x, F.lit(f"{path}/@lon"))
    # one value a point, empty where it has no elevation
    elevations = F.xpath(x, F.lit(f"{path}/*[local-name()='ele']/text()"))
    whole = F.when(F.size(elevations) == F.size(lat), elevations).otherwise(F.array_repeat(F.lit(None).cast("string"), F.size(lat)))
    found = documents.withColumn("name", F.get(F.xpath(x, F.lit("//*[local-name()='name']/text()")), F.lit(0)))
    return _finished(found, _track(lat, lng, whole))


def parse_kml(documents: DataFrame, column: str = "xml") -> DataFrame:
    """Adds ``name``, ``points`` and ``gain_m`` from all lines' lng,lat[,alt] tokens."""
    x = F.col(column)
    text = F.array_join(F.xpath(x, F.lit("//*[local-name()='LineString']/*[local-name()='coordinates']/text()")), " ")
    parts = F.transform(F.filter(F.split(F.trim(text), r"\s+"), lambda t: t != ""), lambda t: F.split(t, ","))
    pick = lambda i: F.transform(parts, lambda p: F.get(p, F.lit(i)))
    found = documents.withColumn("name", F.get(F.xpath(x, F.lit("//*[local-name()='name']/text()")), F.lit(0)))
    return _finished(found, _track(pick(1), pick(0), pick(2)))


def _finished(df: DataFrame, points: Column) -> DataFrame:
    df = df.withColumn("points", points).withColumn("points", F.when(F.size("points") >= 2, F.col("points")))
    rises = F.zip_with(
        F.slice("points", F.lit(1), F.greatest(F.size("points") - 1, F.lit(0))), F.slice("points", F.lit(2), F.greatest(F.size("points") - 1, F.lit(0))), lambda a, b: F.greatest(F.coalesce(b["elev"] - a["elev"], num(0)), num(0))
    )
    return df.withColumn("gain_m", half_up(F.aggregate(rises, num(0), lambda t, v: t + v)))
