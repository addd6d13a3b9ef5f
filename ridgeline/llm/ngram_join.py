"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets.

Texts with equal n-gram sets form a class, found by one aggregation on a digest of the set. A class
has an id of its own, and keys of documents take no part in the join: they may be null or repeat.
Classes are joined: each gets ``bands`` band hashes of ``rows`` minima each, counts chosen for the
target recall at the threshold, and meets the others of its buckets. A pair is verified in the first
bucket that both share and nowhere else.

Buckets of up to ``CROWD`` members, whose pairs number at most CROWD / 2 a member, go through a join
on the band hash. A larger one, a big group of near copies, is settled in two steps:

* Cores. Its most connected member leads it. Jaccard distances obey the triangle inequality, so
  members within half the threshold's distance of one leader are linked with each other for
  certain: a core of k members adds k - 1 links to each, after k comparisons instead of k * k / 2.
* Tiles. Members outside the bucket's main core meet all others. Tiles of bounded size meet in tasks
  of their own, which verify blocks of pairs by sorted merges and return one row a class and tile
  (its number of links, and one link of each connected run), never the pairs.

Groups come from repeated min-label steps with pointer jumping, each written to the shared folder.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.cluster import stored
from ridgeline.llm import units

N = 5
THRESHOLD = 0.8
RECALL = 0.995
CROWD = 48
#: N-grams of the members of a tile, about; a task holds the sets of two tiles.
TILE = 1 << 19

_U = np.uint64


def choose_bands(threshold: float, recall: float, max_rows: int = 8) -> tuple[int, int]:
    """(bands, rows): the most selective banding of at most 72 minima whose recall at the threshold is met."""
    for rows in range(max_rows, 0, -1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))) if threshold < 1 else 1
        if bands * rows <= 72:
            return bands, rows
    raise ValueError("no banding of 72 minima meets this recall")


def ngram_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct n-gram codes of each row. A text of 1 to n - 1 words is one n-gram; without words, none."""
    codes, _, _, by_row = units.words(data, offsets)
    windows = units.Windows(codes)
    grams = windows.every(n) if len(codes) >= n else codes[:0]
    for a, b in zip(by_row[:-1], by_row[1:]):
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        else:
            yield windows.between(np.array([a]), np.array([b])) if b > a else np.zeros(0, _U)


def _constants(bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(7001))
    return rng.integers(1, 2**64, bands * rows, dtype=_U) | _U(1), rng.integers(0, 2**64, bands * rows, dtype=_U)


def band_hashes(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """One row of band hashes for each set; sets may not be empty."""
    factor, shift = _constants(bands, rows)
    sizes = np.array([len(s) for s in sets])
    at, flat = np.cumsum(sizes) - sizes, np.concatenate(sets)
    out = np.zeros((len(sets), bands), _U)
    for k in range(bands * rows):
        x = flat * factor[k] + shift[k]
        x ^= x >> _U(32)
        least = np.minimum.reduceat(x, at)
        out[:, k // rows] = units.mix(out[:, k // rows] ^ least)
    return out ^ (np.arange(bands, dtype=_U) * _U(0xA24BAED4963EE407))  # bands don't meet


_SKETCH = pa.schema([("doc", pa.int64()), ("mark", pa.int64()), ("digest", pa.int64()), ("digest2", pa.int64()), ("size", pa.int32()), ("bands", pa.list_(pa.int64()))])


def _digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, the same in any order."""
    with np.errstate(over="ignore"):
        return np.array([s.sum(dtype=_U) for s in sets], _U).view(np.int64), np.array([units.mix(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U) for s in sets], _U).view(np.int64)


def _sketches(n: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in units.slices(batch.column("text")):
                sets = list(ngram_sets(data, offsets, n))
                full = [i for i, s in enumerate(sets) if len(s)]
                table = np.zeros((len(sets), bands), _U)
                if full:
                    table[full] = band_hashes([sets[i] for i in full], bands, rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc").slice(at, len(sets)),
                        batch.column("mark").slice(at, len(sets)),
                        *map(pa.array, _digests(sets)),
                        pa.array(np.array([len(s) for s in sets], np.int32)),
                        pa.array([list(x) if len(s) else [] for x, s in zip(table.view(np.int64), sets)], pa.list_(pa.int64())),
                    ],
                    schema=_SKETCH,
                )

    return run


def _sets(n: int):
    """The sets of texts whose digest is the one asked for (``mark``, by which they came, is 64 bits only).
    Of the repeated rows of a task, one is cut into words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[int] = set()
        for batch in batches:
            ids, seen = batch.column("id").to_pylist(), set()
            several = {x for x, k in Counter(ids).items() if k > 1}
            fresh = [i for i, x in enumerate(ids) if x not in found and (x not in several or not ((y := (x, batch.column("text")[i].as_py())) in seen or seen.add(y)))]
            batch = batch.take(pa.array(fresh, pa.int64()))
            for at, data, offsets in units.slices(batch.column("text")):
                sets = list(ngram_sets(data, offsets, n))
                wanted = [np.asarray(batch.column(c).slice(at, len(sets))) for c in ("digest", "digest2", "size")]
                good = np.array([len(s) for s in sets]) == wanted[2]
                for x, y in zip(_digests(sets), wanted):
                    good &= x == y
                pick = np.flatnonzero(good)
                ids = np.asarray(batch.column("id").slice(at, len(sets)))[pick]
                found.update(ids.tolist())
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([sets[i].tobytes() for i in pick], pa.binary())], names=["id", "grams"])

    return run


def _jaccard(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(shared, united) n-grams of two sets."""
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared, len(both) - shared


def _verify(similar):
    """Keeps the pairs whose numbers of shared and united n-grams are ``similar``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("left_grams"), batch.column("right_grams")
            good = np.array([similar(*_jaccard(np.frombuffer(x.as_py(), _U), np.frombuffer(y.as_py(), _U))) for x, y in zip(left, right)], bool)
            pick = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pick) for c in ("a", "b")], names=["a", "b"])

    return run


def _with_sets(pairs: DataFrame, grams: DataFrame) -> DataFrame:
    left = grams.select(F.col("id").alias("a"), F.col("grams").alias("left_grams"))
    return pairs.join(left, "a").join(grams.select(F.col("id").alias("b"), F.col("grams").alias("right_grams")), "b")


def _tile_links(threshold: float):
    """Links between the members of two tiles of one bucket (or within one), counted by member. Members
    of one core are known to be linked and are not counted here."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["tile", "id"], ignore_index=True)
        doc, core, band = part["id"].to_numpy(), part["core"].to_numpy(), int(part["band"].iloc[0])
        tile, sets = part["tile"].to_numpy(), [np.frombuffer(x, _U) for x in part["grams"]]
        bands = np.stack(part["bands"].to_numpy())
        one_tile = bool(part["low"].iloc[0] == part["high"].iloc[0])
        if not one_tile and tile[0] == tile[-1]:  # nothing was dealt to the other tile
            return pd.DataFrame({"id": doc[:0], "links": doc[:0], "root": doc[:0]})
        other = np.arange(len(doc)) if one_tile else np.flatnonzero(tile != tile[0])
        sizes = np.array([len(s) for s in sets])
        # one column of a 0/1 table for each n-gram of the right side
        flat = np.concatenate([sets[j] for j in other])
        grams, column = np.unique(flat, return_inverse=True)
        owner = np.repeat(np.arange(len(other)), sizes[other])
        order = np.argsort(column, kind="stable")
        begin = np.searchsorted(column[order], np.arange(len(grams) + 1))
        held = owner[order]
        links, tree = np.zeros(len(doc), np.int64), []
        for i in range(len(doc)) if one_tile else np.flatnonzero(tile == tile[0]):
            place = np.searchsorted(grams, sets[i])
            place = place[(place < len(grams)) & (grams[np.minimum(place, len(grams) - 1)] == sets[i])]
            length = begin[place + 1] - begin[place]
            at = np.repeat(begin[place] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
            shared = np.bincount(held[at], minlength=len(other))
            near = shared >= threshold * (sizes[i] + sizes[other] - shared)
            near &= ~(bands[other][:, :band] == bands[i, :band]).any(axis=1)  # an earlier band has this pair
            near &= (core[other] != core[i]) | (core[i] < 0)
            if one_tile:
                near &= other > i
            found = other[near]
            links[i] += len(found)
            links[found] += 1
            if len(found):
                tree.append((doc[i], doc[found]))
        a = np.concatenate([np.full(len(f), d) for d, f in tree]) if tree else np.zeros(0, np.int64)
        b = np.concatenate([f for _, f in tree]) if tree else np.zeros(0, np.int64)
        root = _roots(doc, a, b)
        linked = links > 0
        return pd.DataFrame({"id": doc[linked], "links": links[linked], "root": root[linked]})

    return run


def _roots(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least id of each one's connected component within a tile pair."""
    order = np.argsort(doc)
    label = np.empty(len(doc), np.int64)
    label[order] = np.arange(len(doc))
    x, y = np.searchsorted(doc[order], a), np.searchsorted(doc[order], b)
    label = np.arange(len(doc))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    out = np.empty(len(doc), np.int64)
    out[order] = doc[order][label]
    return out


def connected(edges: DataFrame) -> DataFrame:
    """(doc, group): the least node of each connected component of edges (a, b), a != b.

    Each round, every node's parent becomes the least label seen across its edges, then that parent's
    own parent. Labels are aggregated on the map side, so a node with many edges costs one row a task.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("group")).withColumnRenamed("a", "doc"), "labels")
    while True:  # labels only sink, and a round that changes none is the last
        seen = both.join(label, both["b"] == label["doc"]).groupBy("a").agg(F.min("group").alias("seen"))
        low = label.join(seen, label["doc"] == seen["a"]).select("doc", "group", F.least("group", "seen").alias("low"))
        parent = label.select(F.col("doc").alias("low"), F.col("group").alias("jump"))
        new = low.join(parent, "low").select("doc", F.least("low", "jump").alias("new"), F.col("group").alias("old"))
        new = stored(new, "labels")
        label = new.select("doc", F.col("new").alias("group"))
        if not new.where("new <> old").take(1):
            return label


def _cores(met: DataFrame, grams: DataFrame, threshold: float) -> DataFrame:
    """(id, core), stored: members of crowded buckets that lie within half the threshold's distance of a leader."""
    crowd = met.where(F.col("n") > CROWD)
    weight = met.groupBy("id").agg(F.sum("n").alias("weight"))
    leaders = crowd.join(weight, "id").groupBy("code").agg(F.max(F.struct("weight", "id"))["id"].alias("b"))
    star = crowd.select(F.col("id").alias("a"), "code").join(leaders, "code").select("a", "b").distinct()
    half = (1 + threshold) / 2
    close = _with_sets(star, grams).mapInArrow(_verify(lambda shared, united: shared > half * united or shared == united), "a long, b long")
    return stored(close.groupBy("a").agg(F.min("b").alias("core")).withColumnRenamed("a", "id"), "cores")


def _bucket_pairs(met: DataFrame, grams: DataFrame, threshold: float) -> DataFrame:
    """(a, b), stored: linked pairs of the buckets that are not crowded, but for those of one core."""
    small = met.where(F.col("n") <= CROWD)
    left = small.select(F.col("id").alias("a"), "band", "code", F.col("size").alias("size_a"), F.col("bands").alias("bands_a"), F.col("core").alias("core_a"))
    right = small.select(F.col("id").alias("b"), "code", F.col("size").alias("size_b"), F.col("bands").alias("bands_b"), F.col("core").alias("core_b"))
    pairs = left.join(right, "code").where((F.col("a") < F.col("b")) & (F.least("size_a", "size_b") >= threshold * F.greatest("size_a", "size_b")))
    earlier = F.exists(F.arrays_zip(F.slice("bands_a", F.lit(1), F.col("band")), F.slice("bands_b", F.lit(1), F.col("band"))), lambda x: x["0"] == x["1"])
    pairs = pairs.where(~earlier & ((F.col("core_a") != F.col("core_b")) | (F.col("core_a") < 0))).select("a", "b")
    return stored(_with_sets(pairs, grams).mapInArrow(_verify(lambda shared, united: shared >= threshold * united), "a long, b long"), "links")


def _crowd_links(met: DataFrame, grams: DataFrame, threshold: float) -> DataFrame:
    """(id, links, root), stored: links of crowded buckets between members of different cores, or of none."""
    crowd = met.where(F.col("n") > CROWD)
    main = crowd.where("core >= 0").groupBy("code", "core").agg(F.count("*").alias("k"))
    main = main.groupBy("code").agg(F.max(F.struct("k", "core"))["core"].alias("main"))
    crowd = crowd.join(main, "code", "left").withColumn("inside", F.coalesce(F.col("core") == F.col("main"), F.lit(False)))
    # tiles of the rest come first, those of the main core after them; only the rest meets all
    held = crowd.groupBy("code").agg(*[F.ceil(F.sum(F.when(F.col("inside") == x, F.col("size")).otherwise(0)) / TILE).cast("int").alias(c) for c, x in (("rest", False), ("core_tiles", True))])
    tiled = crowd.join(held.where("rest > 0"), "code")
    own = F.when(F.col("inside"), F.col("core_tiles")).otherwise(F.col("rest"))
    tiled = tiled.withColumn("tile", (F.pmod(F.xxhash64("id"), own) + F.when(F.col("inside"), F.col("rest")).otherwise(0)).cast("int"))
    tiled = tiled.withColumn("with", F.explode(F.sequence(F.lit(0), F.when(F.col("inside"), F.col("rest")).otherwise(F.col("rest") + F.col("core_tiles")) - 1)))
    tiled = tiled.select("id", "code", "band", "bands", "core", "tile", F.least("tile", "with").alias("low"), F.greatest("tile", "with").alias("high"))
    found = tiled.join(grams, "id").groupBy("code", "low", "high").applyInPandas(_tile_links(threshold), "id long, links long, root long")
    return stored(found, "tile-links")


def ngram_jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per document: doc, ``copy_of``, ``copies``, ``links``, ``class_id``.

    copy_of: the least key with the same n-gram set, copies: how many rows have it.
    links: how many other n-gram sets have a Jaccard similarity of the threshold or more with this
    one (found with at least the target recall at the threshold, more above it; never a false one).
    class_id: the least key of the connected component.
    Null, empty and wordless texts have no n-grams: they link to nothing and are their own class.
    Every row gets a row: repeated ones are copies of each other, and different texts of one key,
    or of none, are linked and classed each by its own text. A null key stays null and is never the
    least; where a class has no other, copy_of and class_id are null. Columns besides key and text
    are ignored, whatever their names. An empty table gives an empty table. Ties and the order of
    rows decide nothing. A text is held whole in its task, and so are two tiles of n-gram sets.
    """
    bands, rows = choose_bands(threshold, recall)
    texts = docs.select(F.col(key).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("mark", F.xxhash64("doc", "text"))
    sketches = stored(texts.mapInArrow(_sketches(n, bands, rows), "doc long, mark long, digest long, digest2 long, size int, bands array<long>"), "sketches")
    own = ["digest", "digest2", "size"]
    # copies have the same band hashes, so any of them will do
    classes = sketches.where("size > 0").groupBy(*own).agg(F.min("doc").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.min("mark").alias("mark"))
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    members = classes.select("id", "size", "bands", F.posexplode("bands").alias("band", "code"))
    buckets = members.groupBy("code").agg(F.count("*").alias("n")).where("n > 1")
    met = stored(members.join(buckets, "code"), "band-members")

    # sets of the classes that meet another one, each from one of its texts
    needed = classes.join(met.select("id").distinct(), "id", "left_semi").select("id", "mark", *own)
    grams = texts.select("mark", "text").join(needed, "mark").select("id", *own, "text").mapInArrow(_sets(n), "id long, grams binary")
    grams = stored(grams.dropDuplicates(["id"]), "ngram-sets")

    cores = _cores(met, grams, threshold)
    met = met.join(cores, "id", "left").withColumn("core", F.coalesce("core", F.lit(-1)))
    linked, dense = _bucket_pairs(met, grams, threshold), _crowd_links(met, grams, threshold)

    sizes = cores.groupBy("core").agg((F.count("*") - 1).alias("links"))
    counts = linked.select(F.explode(F.array("a", "b")).alias("id"), F.lit(1).cast("long").alias("links"))
    counts = counts.unionByName(dense.select("id", "links")).unionByName(cores.join(sizes, "core").select("id", "links"))
    counts = counts.groupBy("id").agg(F.sum("links").alias("links"))
    edges = linked.unionByName(dense.select(F.col("id").alias("a"), F.col("root").alias("b"))).unionByName(cores.select(F.col("id").alias("a"), F.col("core").alias("b")))
    groups = connected(edges.where("a <> b")).withColumnRenamed("doc", "id")
    least = groups.join(classes.select("id", "rep"), "id").groupBy("group").agg(F.min("rep").alias("class_id"))
    groups = groups.join(least, "group").select("id", "class_id")
    found = classes.select("id", *own, "rep", "copies").join(counts, "id", "left").join(groups, "id", "left").drop("id")
    joined = sketches.select("doc", *own).join(found, own, "left")
    return joined.select(
        "doc",
        F.coalesce("rep", "doc").alias("copy_of"),
        F.coalesce("copies", F.lit(1)).alias("copies"),
        F.coalesce("links", F.lit(0)).alias("links"),
        F.coalesce("class_id", "rep", "doc").alias("class_id"),
    )
