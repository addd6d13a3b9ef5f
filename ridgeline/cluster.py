"""What the driver sets up for executors: the package itself, and a shared folder."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_own_dir: dict[str, str] = {}
#: Tables of the innermost scope of this thread or task; each has its own.
_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)
_unscoped: list[str] = []


def ship_package(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors of the session's application, once."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        archive = shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="ridgeline-")) / root.name), "zip", root.parent, root.name)
        context.addPyFile(archive)
        _shipped.add(context.applicationId)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs in one process (local tests) a temporary folder
    stands in; executors elsewhere could not read it, so a cluster without the setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = tempfile.mkdtemp(prefix="ridgeline-")
    return _own_dir[app]


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    Cuts the lineage: a lost executor costs the tasks that run, not what came before. The table
    stays until the innermost ``scope`` around the call ends; without one, until ``release``.
    """
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession) -> int:
    """How many tasks share heavy work: the session's shuffle partitions, and at least two for each core."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt over ``tasks``, by the keys if there are any.

    Without keys: for work that is heavy by the row, as tables of few bytes a row come in few splits. With keys: for
    aggregations of nearly as many groups as rows, which then hold the groups of one part and none of a whole split.
    The number is fixed, so parts aren't joined again by their compressed size.
    """
    return df.repartition(tasks(df.sparkSession), *keys)


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for files that live as long as a ``stored`` table."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    scoped = _scope.get()
    (_unscoped if scoped is None else scoped).append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared file system."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables stored inside, at its end. Results that read them must be written before.

    A scope is that of its thread: queries in other threads keep their tables.
    """
    tables: list[str] = []
    token = _scope.set(tables)
    try:
        yield
    finally:
        _scope.reset(token)
        for path in tables:
            delete(spark, path)


def release(spark: SparkSession) -> int:
    """Deletes the tables that were stored outside scopes so far, once the results that read them are written; their number."""
    gone = 0
    while _unscoped:
        delete(spark, _unscoped.pop())
        gone += 1
    return gone
