"""Centroid clustering with partial-distance search.

Vectors are turned into integers, so every distance, sum and mean is exact and no result depends on
the order of rows, partitions or retries. Each round is one pass over the stored integer vectors:
tasks assign their rows, add them up by centroid, and send one row a centroid and batch into a
map-side combined aggregation. What reaches the driver is bounded by the number of centroids and
components, so a cluster that holds a third of all vectors costs no task more than any other.

The search follows the dimensions from high to low variance. A vector's candidate is the centroid
nearest in the first block of dimensions, whose whole distance is the first bound. Then each
centroid adds block after block, and drops the vectors whose sum is strictly above their best so
far; those that finish all dimensions replace the best if they are nearer, or as near under a
smaller number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.cluster import stored

#: Dimensions that are added before the next comparison with the best distance.
BLOCK = 8

#: Scaled components must stay below this, so that squared distances fit 64 bits.
LARGEST = 1 << 27

#: Vectors that are compared at a time.
ROWS = 8192


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(len(column), width)


def _integers(width: int, scale: int):
    """Kept vectors as integers: those of ``width`` components, none null or non-finite."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            right = pa.array(np.asarray(lists.value_lengths().fill_null(-1)) == width)
            sized, ids = lists.filter(right), batch.column("vec").filter(right)
            plain = sized.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(sized), width)
            kept = np.isfinite(plain).all(axis=1)
            with np.errstate(over="ignore"):
                scaled = np.floor(plain[kept] * scale)
            if scaled.size and np.abs(scaled).max() >= LARGEST:
                raise ValueError(f"a component of {np.abs(scaled).max() / scale:g}; squared distances of such vectors exceed 64 bits")
            offsets = pa.array(np.arange(len(scaled) + 1, dtype=np.int32) * width)
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(kept)), pa.ListArray.from_arrays(offsets, pa.array(scaled.astype(np.int32).ravel()))], names=["vec", "vector"])

    return run


def assign(vectors: np.ndarray, centroids: np.ndarray, order: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(centroid, squared distance) of every vector; of equally near centroids, the smaller number.

    ``order`` lists the dimensions from high to low variance.
    """
    x, c = np.ascontiguousarray(vectors[:, order]), centroids[:, order]
    n, width = x.shape
    first = np.stack([np.square(x[:, :block] - one[:block]).sum(axis=1) for one in c], axis=1)
    best = first.argmin(axis=1)
    distance = np.square(x - c[best]).sum(axis=1)
    for k, one in enumerate(c):
        alive = np.flatnonzero((first[:, k] <= distance) & (best != k))
        total = first[alive, k]
        for at in range(block, width, block):
            if not len(alive):
                break
            total = total + np.square(x[alive, at : at + block] - one[at : at + block]).sum(axis=1)
            near = total <= distance[alive]
            alive, total = alive[near], total[near]
        nearer = (total < distance[alive]) | (k < best[alive])
        alive, total = alive[nearer], total[nearer]
        best[alive], distance[alive] = k, total
    return best, distance


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            yield batch.slice(at, ROWS)


def _sums(centroids: np.ndarray, order: np.ndarray):
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            x = _matrix(part.column("vector"), width)
            best, _ = assign(x, centroids, order)
            by = np.argsort(best, kind="stable")
            found, begin = np.unique(best[by], return_index=True)
            sums = np.add.reduceat(x[by], begin, axis=0) if len(found) else np.zeros((0, width), np.int64)
            counts = np.bincount(best, minlength=k)[found]
            offsets = pa.array(np.arange(len(found) + 1, dtype=np.int32) * width)
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(counts.astype(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(sums.ravel()))], names=["cluster", "n", "sums"])

    return run


def _assigned(centroids: np.ndarray, order: np.ndarray):
    width = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            best, distance = assign(_matrix(part.column("vector"), width), centroids, order)
            yield pa.RecordBatch.from_arrays([part.column("vec"), pa.array(best.astype(np.int32)), pa.array(distance)], names=["vec", "cluster", "distance"])

    return run


def _variance_order(vectors: DataFrame, width: int) -> np.ndarray:
    """Dimensions from high to low variance, exact sums over all vectors; ties by number."""
    moments = vectors.select(F.posexplode("vector").alias("dim", "x")).groupBy("dim").agg(
        F.count("*").alias("n"), F.sum(F.col("x").cast("decimal(20,0)")).alias("s"), F.sum((F.col("x").cast("long") * F.col("x")).cast("decimal(20,0)")).alias("q")
    )
    spread = {r["dim"]: int(r["n"]) * int(r["q"]) - int(r["s"]) ** 2 for r in moments.collect()}  # one row a dimension
    return np.array(sorted(range(width), key=lambda d: (-spread.get(d, 0), d)))


def fit(vectors: DataFrame, centroids: np.ndarray, order: np.ndarray, rounds: int) -> np.ndarray:
    """Centroids after ``rounds`` of assignment and exact floored means; empty ones stay."""
    centroids, width = centroids.copy(), centroids.shape[1]
    for _ in range(rounds):
        parts = vectors.select("vector").mapInArrow(_sums(centroids, order), "cluster int, n long, sums array<long>")
        sums = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[d].cast("decimal(28,0)")).alias(f"s{d}") for d in range(width)])
        for row in sums.collect():  # one row a centroid
            centroids[row["cluster"]] = [int(row[f"s{d}"]) // int(row["n"]) for d in range(width)]
    return centroids


def starts(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors of the least SHA-256 of ``seed:vec``; null ids last, ties by components."""
    hashed = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("vec").cast("string")), 256)
    rows = vectors.orderBy(F.col("vec").isNull(), hashed, "vector").limit(k).collect()
    return np.array([r["vector"] for r in rows], np.int64)


def centroid_clusters(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 40, rounds: int = 5, width: int = 64, scale: int = 256, seed: int = 2) -> DataFrame:
    """One row per kept vector: vec (key), cluster, distance (squared), cluster_inertia, inertia, centroid (array<long>).

    A vector is kept if it has exactly ``width`` components, none null or non-finite; its components
    become floor(scale * x). Null keys stay null; repeated keys and rows are vectors of their own.
    With fewer than ``k`` kept vectors there are as many centroids. A component whose scaled size
    reaches 2**27 is an error, as its distances don't fit 64 bits. Columns besides key and vector
    are ignored. An empty table, or one without kept vectors, gives an empty table.
    """
    plain = vectors.select(F.col(key).alias("vec"), F.col(vector).alias("vector"))
    kept = stored(plain.mapInArrow(_integers(width, scale), "vec long, vector array<int>"), "vectors")
    first = starts(kept, k, seed)
    if not len(first):
        return kept.select("vec", *[F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid", "array<long>"))])
    order = _variance_order(kept, width)
    centroids = fit(kept, first, order, rounds)
    found = stored(kept.mapInArrow(_assigned(centroids, order), "vec long, cluster int, distance long"), "assignments")
    by_cluster = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # one row a centroid
    total = sum(r["cluster_inertia"] for r in by_cluster)
    summary = [(r["cluster"], r["cluster_inertia"], total, [int(x) for x in centroids[r["cluster"]]]) for r in by_cluster]
    table = found.sparkSession.createDataFrame(summary, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return found.join(F.broadcast(table), "cluster").select("vec", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
