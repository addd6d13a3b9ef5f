"""Sinks: batches of generated routes that appear once and whole, saved routes and shares under ids of their own.

A commit writes the rows of all its tables into folders named by an attempt, and then creates one
manifest file named by the commit. Creating fails if the file exists, so of any number of attempts,
retries and rivals, one wins; readers see the folders that manifests name and nothing else. An
attempt that dies before leaves folders that nobody reads and ``vacuum`` removes.

Ids and tokens are random. They are drawn in tasks and stored before anything uses them, so a lost
task or a second action can't draw them anew.
"""

from __future__ import annotations

import base64
import json
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.cluster import spread, stored
from ridgeline.functions.text import linestring_geojson
from ridgeline.operators.payloads import read_routes

# Hours that a share lives, if nothing is said, and at most; bytes of a token; what a refusal says.
SHARE_HOURS, MOST_SHARE_HOURS, TOKEN_BYTES = 168, 2160, 24
BAD_HOURS = f"expiresInHours must be between 1 and {MOST_SHARE_HOURS}."


class _Folder:
    """The commits below one root of any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._gateway, self.root = spark._jvm, spark.sparkContext._gateway, root.rstrip("/")
        self._files = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, below: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{below}" if below else self.root)

    def manifest(self, commit: str) -> str | None:
        path = self.path(f"_commits/{commit}")
        if not self._files.exists(path):
            return None
        stream = self._files.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, commit: str, text: str) -> bool:
        """Creates the manifest of a commit; false if there is one."""
        self._files.mkdirs(self.path("_commits"))
        draft = self.path(f"_drafts/{commit}-{uuid.uuid4().hex}")
        stream = self._files.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:  # a manifest is never seen half written: it is renamed into its place, and this renaming replaces nothing
            hadoop = self._jvm.org.apache.hadoop.fs
            options = self._gateway.new_array(hadoop.Options.Rename, 0)
            hadoop.FileContext.getFileContext(self._files.getUri()).rename(self._files.makeQualified(draft), self._files.makeQualified(self.path(f"_commits/{commit}")), options)
            return True
        except Exception as error:
            self._files.delete(draft, False)
            if self._files.exists(self.path(f"_commits/{commit}")):
                return False
            raise error

    def names(self, below: str) -> list[str]:
        path = self.path(below)
        return [s.getPath().getName() for s in self._files.listStatus(path)] if self._files.exists(path) else []

    def delete(self, below: str) -> None:
        self._files.delete(self.path(below), True)


def commit(root: str, name: str, tables: dict[str, DataFrame] | Callable[[], dict[str, DataFrame]]) -> bool:
    """Writes the tables as one commit of this name. False, and nothing written, if the name is taken already.

    A repeated call, after a failure anywhere or beside another driver, leaves the rows of one attempt. tables may be
    a function that makes them; it is called only if they are to be written.
    """
    spark = SparkSession.active() if callable(tables) else next(iter(tables.values())).sparkSession
    folder = _Folder(spark, root)
    if folder.manifest(name) is not None:
        return False
    tables = tables() if callable(tables) else tables
    attempt = uuid.uuid4().hex
    for table, rows in tables.items():
        rows.write.parquet(f"{folder.root}/{table}/{attempt}")
    return folder.create(name, json.dumps({"attempt": attempt, "tables": sorted(tables)}))


def committed(spark: SparkSession, root: str, table: str, schema: str) -> DataFrame:
    """The rows of a table from all commits, with ``commit``, the name of theirs."""
    folder = _Folder(spark, root)
    out = spark.createDataFrame([], schema).withColumn("commit", F.lit(""))
    manifests = {name: json.loads(folder.manifest(name)) for name in sorted(folder.names("_commits"))}
    paths = {m["attempt"]: name for name, m in manifests.items() if table in m["tables"]}
    if not paths:
        return out
    rows = spark.read.schema(schema).parquet(*[f"{folder.root}/{table}/{attempt}" for attempt in paths])
    attempt = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    named = F.create_map(*[F.lit(x) for pair in paths.items() for x in pair])
    return rows.withColumn("commit", named[attempt])


def vacuum(spark: SparkSession, root: str, tables: list[str]) -> list[str]:
    """Removes the folders of attempts that no manifest names; no commit may be under way. Their names."""
    folder = _Folder(spark, root)
    kept = {json.loads(folder.manifest(name))["attempt"] for name in folder.names("_commits")}
    gone = [(t, a) for t in tables for a in folder.names(t) if a not in kept]
    for table, attempt in gone:
        folder.delete(f"{table}/{attempt}")
    folder.delete("_drafts")
    return sorted({a for _, a in gone})


# -- ids


def _drawn(name: str, draw):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([draw() for _ in range(len(batch))], pa.string())], names=[*batch.schema.names, name])

    return run


def token() -> str:
    """24 random bytes as 32 characters that are safe in addresses."""
    return base64.urlsafe_b64encode(os.urandom(TOKEN_BYTES)).decode().rstrip("=")


def with_drawn(rows: DataFrame, name: str, draw) -> DataFrame:
    """The rows, stored, with a random text a row; drawn once, whatever is computed later or again."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return stored(rows.mapInArrow(_drawn(name, draw), f"{kinds}, `{name}` string"), name)


# -- generated batches


def envelope(points: Column) -> Column:
    """struct<west, south, east, north> of an array of points; null without points."""
    lat, lng = F.transform(points, lambda p: p["lat"]), F.transform(points, lambda p: p["lng"])
    box = F.struct(F.array_min(lng).alias("west"), F.array_min(lat).alias("south"), F.array_max(lng).alias("east"), F.array_max(lat).alias("north"))
    return F.when(F.size(points) > 0, box)


BATCHES = "batch_id string, request_id long, preferences string, route_count long, envelope struct<west: double, south: double, east: double, north: double>"
CANDIDATES = "batch_id string, route_id string, source string, name string, activity string, route_type string, distance_km double, minutes int, gain_m double, line string, payload string"


def batch_tables(requests: DataFrame, candidates: DataFrame) -> dict[str, DataFrame]:
    """The two tables of generated batches. requests: request_id, preferences (JSON text). candidates: request_id, payload, or
    these as ``read_routes`` has read them, which are not read again.

    Each request is a batch under an id of its own, also without candidates: its envelope covers all its routes'
    points and is null where they have none. A candidate that breaks a rule of ``read_routes``, or has fewer than two points,
    makes the whole write fail, as half a batch is none.
    """
    named = with_drawn(requests.select("request_id", "preferences"), "batch_id", lambda: str(uuid.uuid4()))
    routes = candidates if "error" in candidates.columns else stored(read_routes(candidates.select("request_id", "payload")), "batch-candidates")
    if bad := routes.where("error IS NOT NULL").select("error").first():
        raise ValueError(bad["error"])
    box = envelope(F.col("geometry"))
    boxes = routes.withColumn("box", box).groupBy("request_id").agg(F.count("*").alias("n"), F.min("box.west").alias("west"), F.min("box.south").alias("south"), F.max("box.east").alias("east"), F.max("box.north").alias("north"))
    whole = F.when(F.col("west").isNotNull(), F.struct("west", "south", "east", "north"))
    batches = named.join(boxes, "request_id", "left").select("batch_id", "request_id", "preferences", F.coalesce("n", F.lit(0)).cast("long").alias("route_count"), whole.alias("envelope"))
    rows = routes.join(named.select("request_id", "batch_id"), "request_id")
    fields = ("source", "name", "activity", "route_type", "distance_km", "minutes", "gain_m")
    return {"batches": batches, "candidates": rows.select("batch_id", F.col("id").alias("route_id"), *fields, linestring_geojson(F.col("geometry")).alias("line"), "payload")}


# -- saved routes and shares


def new_saved(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Payloads as rows to save, stored: ``id`` (the server's, saved- and a random UUID, in the payload too), the fields
    of ``read_routes``, ``error``, ``notes``. What a client calls a route repeats, so its id is never kept; a payload that
    breaks a rule has an error and no id."""
    drawn = with_drawn(spread(payloads), "new_id", lambda: f"saved-{uuid.uuid4()}").withColumn("_v", F.try_parse_json(F.col(column)))
    members = F.variant_get(F.col("_v"), "$", "map<string,variant>")
    is_object = F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False))
    own = F.map_concat(F.map_filter(members, lambda k, _: k != "id"), F.create_map(F.lit("id"), F.col("new_id").cast("variant")))
    renamed = stored(drawn.withColumn(column, F.when(is_object, F.to_json(own)).otherwise(F.col(column))).drop("_v"), "renamed")
    found = read_routes(renamed, column)
    found = found.withColumn("notes", F.when(F.col("error").isNull(), F.get_json_object(column, "$.notes"))).drop("new_id")
    return stored(found, "saved-routes")


def new_shares(asked: DataFrame, now: Column) -> DataFrame:
    """Shares to store: the columns of ``asked`` (route_key, user_id, hours), ``token``, ``expires_at``, ``error``.

    Hours are 168 where they are null; below 1 or above 2160 they are an error, and there is no token.
    """
    hours = F.coalesce("hours", F.lit(SHARE_HOURS))
    bad = ~hours.between(1, MOST_SHARE_HOURS)
    drawn = with_drawn(asked.withColumn("error", F.when(bad, BAD_HOURS)), "token", token)
    expires = now + F.make_dt_interval(F.lit(0), hours.cast("int"))
    return drawn.withColumns({"expires_at": F.when(F.col("error").isNull(), expires), "token": F.when(F.col("error").isNull(), F.col("token"))})
