"""A map service as a Spark data source: tiles are partitions, tag lists are pushed down, mirrors are tried in turn.

``spark.read.format("map_tiles")`` asks for one tile after another of a box. Filters on ``selector`` and
``value`` become the query that a mirror is asked, so fewer ways come back; filters on ``tile`` leave
out whole partitions. A mirror is a folder of recorded answers (``<tile>.json``) or the address of a
service. What one can't answer the next is asked for; a tile that none answers is an error.

This module is pickled by value, so workers need nothing but Python and pyarrow.
"""

from __future__ import annotations

import json
import math
import sys
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull

# The ways that a query asks for, by tag, in the order in which a way's first match counts.
SELECTORS = {
    "highway": ("footway", "path", "cycleway", "pedestrian", "residential", "living_street", "track", "service", "unclassified", "tertiary", "secondary", "primary"),
    "leisure": ("park", "garden", "nature_reserve", "recreation_ground"),
    "landuse": ("forest", "grass", "meadow", "recreation_ground", "village_green", "cemetery"),
    "natural": ("wood", "scrub", "grassland", "heath", "water"),
}
TIMEOUT_S = 25

SCHEMA = "tile string, mirror int, selector string, value string, element string"
_ARROW = pa.schema([("tile", pa.string()), ("mirror", pa.int32()), ("selector", pa.string()), ("value", pa.string()), ("element", pa.string())])
#: Columns that are filtered in the scan; they are never null.
_WHOLE = (("selector",), ("value",), ("tile",))
#: Elements of a record batch.
BATCH = 4096


@dataclass(frozen=True)
class Tile(InputPartition):
    """A box of the map; its name gives its south-west corner in units of its side."""

    name: str
    south: float
    west: float
    north: float
    east: float


def tiles(south: float, west: float, north: float, east: float, side: float) -> list[Tile]:
    """The tiles of a grid of ``side`` degrees that the box touches; boxes don't cross the date line."""
    rows = range(math.floor(south / side), max(math.floor(south / side) + 1, math.ceil(north / side)))
    columns = range(math.floor(west / side), max(math.floor(west / side) + 1, math.ceil(east / side)))
    return [Tile(f"{i}_{j}", i * side, j * side, (i + 1) * side, (j + 1) * side) for i in rows for j in columns]


def tile_query(tile: Tile, lists: dict[str, tuple[str, ...]]) -> str:
    """The query text for the ways of a tile that carry one of the listed tags."""
    box = f"({tile.south:.7f},{tile.west:.7f},{tile.north:.7f},{tile.east:.7f})"
    ways = "".join(f'way["{tag}"~"^({"|".join(values)})$"]{box};' for tag, values in lists.items())
    return f"[out:json][timeout:{TIMEOUT_S}];({ways});out body geom;"


def first_match(tags: dict) -> tuple[str, str] | None:
    """(tag, value) of the first list that the tags are in."""
    return next(((tag, tags[tag]) for tag, values in SELECTORS.items() if tags.get(tag) in values), None)


def _ask(mirror: str, tile: Tile, query: str, timeout: float) -> list[dict]:
    if mirror.startswith(("http://", "https://")):
        body = urllib.parse.urlencode({"data": query}).encode()
        request = urllib.request.Request(mirror, body, {"Content-Type": "application/x-www-form-urlencoded;charset=UTF-8", "User-Agent": "ridgeline"})
        with urllib.request.urlopen(request, timeout=timeout) as answer:  # other codes than 2xx raise
            text = answer.read()
    else:
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(mirror) if "://" in mirror else (fs.LocalFileSystem(), mirror.removeprefix("file:"))
        with files.open_input_stream(f"{path}/{tile.name}.json") as stream:
            text = stream.read()
    found = json.loads(text)["elements"]
    if not isinstance(found, list):
        raise ValueError("elements are no list")
    return found


class MapReader(DataSourceReader):
    def __init__(self, options: dict):
        box = [float(options[k]) for k in ("south", "west", "north", "east")]
        self.mirrors = [m for m in options["mirrors"].split(";") if m]
        self.timeout = float(options.get("timeout", TIMEOUT_S))
        self.tiles = tiles(*box, float(options.get("side", 0.05)))
        #: Allowed values of a column, of those that are restricted.
        self.only: dict[str, frozenset] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute in _WHOLE:
                allowed = frozenset([f.value] if isinstance(f, EqualTo) else f.value)
                column = f.attribute[0]
                self.only[column] = self.only.get(column, allowed) & allowed
            elif not (isinstance(f, IsNotNull) and f.attribute in _WHOLE):
                yield f

    def lists(self) -> dict[str, tuple[str, ...]]:
        """The tag lists that are left to ask for."""
        kept = {tag: tuple(v for v in values if v in self.only.get("value", values)) for tag, values in SELECTORS.items() if tag in self.only.get("selector", SELECTORS)}
        return {tag: values for tag, values in kept.items() if values}

    def partitions(self) -> list[Tile]:
        return [t for t in self.tiles if self.lists() and t.name in self.only.get("tile", {t.name})]

    def read(self, tile: Tile) -> Iterator[pa.RecordBatch]:
        lists, failures = self.lists(), []
        if tile is None or not lists:  # no partition is left
            return
        for number, mirror in enumerate(self.mirrors):
            try:
                elements = _ask(mirror, tile, tile_query(tile, lists), self.timeout)
                break
            except Exception as error:  # whatever a mirror does wrong, the next may do right
                failures.append(f"{mirror}: {error}")
        else:
            raise RuntimeError(f"no mirror answers for tile {tile.name}: {'; '.join(failures)}")
        rows = []
        for e in elements:
            match = first_match(e.get("tags") or {}) if isinstance(e, dict) else None
            if match and match[1] in lists.get(match[0], ()):
                rows.append((tile.name, number, *match, json.dumps(e)))
        for at in range(0, len(rows), BATCH):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[at : at + BATCH]), _ARROW.types)], schema=_ARROW)


class MapTiles(DataSource):
    """Options: ``mirrors`` (separated by semicolons, in the order in which they are asked), ``south``, ``west``, ``north``,
    ``east``, ``side`` of a tile in degrees (0.05) and ``timeout`` in seconds (25)."""

    @classmethod
    def name(cls) -> str:
        return "map_tiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MapReader:
        return MapReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to the session and lets Spark push filters into it."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MapTiles)


def scan_map(spark: SparkSession, mirrors: list[str], south: float, west: float, north: float, east: float, side: float = 0.05) -> DataFrame:
    """Elements of the box's tiles: tile, mirror (the one that answered), selector, value, element (JSON text).

    A way that lies in several tiles comes once a tile. Elements that no tag list names are left out.
    """
    register(spark)
    options = {"mirrors": ";".join(mirrors), "south": south, "west": west, "north": north, "east": east, "side": side}
    return spark.read.format("map_tiles").options(**options).load()


def as_answers(scanned: DataFrame) -> DataFrame:
    """The scan as answers that ``overpass.parse_elements`` reads, a way of several tiles once."""
    way = F.struct(F.get_json_object("element", "$.type"), F.get_json_object("element", "$.id"))
    once = scanned.groupBy(way.alias("way")).agg(F.min_by("element", "tile").alias("element"))
    return once.select(F.concat(F.lit('{"elements":['), "element", F.lit("]}")).alias("json"))


def record_answers(answers: DataFrame, folder: str) -> int:
    """Writes answers (tile, json), one row a tile, as a mirror's folder ``<tile>.json``; the number of tiles. A repeated
    task writes the same file again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))
        files.create_dir(path, recursive=True)
        for batch in batches:
            for tile, text in zip(batch.column("tile").to_pylist(), batch.column("json").to_pylist()):
                with files.open_output_stream(f"{path}/{tile}.json") as stream:
                    stream.write(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)])], names=["n"])

    return answers.select("tile", "json").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
