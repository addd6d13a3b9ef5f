"""Suffix-array dedup by blockwise construction with a difference cover.

Seeds filter first, suffixes are sorted after. The seeds of ``repeats`` prove most suffixes unique
(their anchor stands once) and find spans that are equal as a whole; later copies of such a span are
removed by that equality, without sorting. What is left, the first copy of every distinct span whose
anchor stands in other spans too, is where repeats begin and end inside spans. Its suffixes are
dealt into blocks by anchor, so equal suffixes always meet in one block, and each block's suffix
array is built bucket by bucket:

* a difference-cover sample of the block (positions whose residue modulo 31 is in the cover) is
  ranked once, by 32 bytes and then by doubling: a sample and the sample one or two periods on;
* suffixes fall into buckets by their first two bytes; one bucket at a time is sorted on its first
  32 bytes only, which bounds the memory that a sort takes;
* suffixes that still tie are ordered by the precomputed ranks: any two positions have a common
  offset below 31 at which both are sampled.

Neighbours of the suffix array that agree in ``window`` bytes form a class; all but its earliest
member are removed. Blocks hold a bounded number of suffixes. An anchor with more distinct spans
than a block may hold would be an unbounded group in one task, so it leaves the blocks and is
settled by an aggregation over its windows, which Spark combines on the map side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm import units
from ridgeline.llm.common import by_bytes
from ridgeline.llm.repeats import NO_KEY, byte_units, keyed, one_each, repeated_spans, span_classes, with_ranges, with_spans

WINDOW = 100
SEED = 48
#: Distinct spans a block holds on average, and the most that one anchor may bring into it.
BLOCK_SPANS = 4096

# A perfect difference set, whose differences give every residue modulo 31.
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)

#: SHIFT[a, b]: the least offset that takes positions of residues a and b into the cover.
SHIFT = np.array([[next(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER) for b in range(PERIOD)] for a in range(PERIOD)])
#: INTO[a]: the least offset that takes a position of residue a into the cover.
INTO = SHIFT.diagonal()
#: Bytes of a suffix that a bucket is sorted on before ties go to the ranks; more than a period.
DEPTH = 32


def _padded_words(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Bytes at .. at + depth of each suffix as big-endian words, one column each; zeros past the end."""
    padded = np.concatenate((text, np.zeros(depth, np.uint8)))
    return sliding_window_view(padded, depth)[at].view(">u8").astype(np.uint64)


def _order(columns: np.ndarray) -> np.ndarray:
    return np.lexsort(columns.T[::-1])


def _dense(new: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Ranks from 0 of the places of an order, one higher wherever ``new`` is true."""
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.cumsum(new)
    return ranks


def cover_ranks(text: np.ndarray, window: int) -> np.ndarray:
    """Rank of every sampled position by at least ``window`` bytes from it, -1 elsewhere; equal strings share one."""
    ranks = np.full(len(text) + PERIOD, -1, np.int64)
    sampled = np.flatnonzero(np.isin(np.arange(len(text)) % PERIOD, COVER))
    if not len(sampled):
        return ranks
    columns = _padded_words(text, sampled, DEPTH)
    order = _order(columns)
    new = np.zeros(len(order), bool)
    new[1:] = (columns[order[1:]] != columns[order[:-1]]).any(axis=1)
    own, step = _dense(new, order), PERIOD
    while True:
        ranks[sampled] = own
        if step >= window:
            return ranks
        ahead = sampled + step  # a whole number of periods on: sampled too, or past the end
        pair = own * (len(own) + 1) + np.where(ahead < len(text), ranks[np.minimum(ahead, len(text) - 1)], -1) + 1
        order = np.argsort(pair, kind="stable")
        new[1:] = pair[order[1:]] != pair[order[:-1]]
        own, step = _dense(new, order), 2 * step


def _order_ties(bucket: np.ndarray, tie: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The bucket with each run of suffixes that tie (``tie``: with the next) ordered by the ranks.

    In a run, suffixes of one residue and rank are one; what is left is sorted by exchanges of
    neighbours, all runs of the bucket together.
    """
    run = np.concatenate(([0], np.cumsum(~tie[:-1])))
    residue = bucket % PERIOD
    rank = ranks[bucket + INTO[residue]]
    order = np.lexsort((rank, residue, run))
    new = np.ones(len(order), bool)
    new[1:] = (run[order[1:]] != run[order[:-1]]) | (residue[order[1:]] != residue[order[:-1]]) | (rank[order[1:]] != rank[order[:-1]])
    member = np.cumsum(new) - 1  # of each place of the order, its group
    at = bucket[order[new]]  # one suffix a group
    group, own = np.arange(len(at)), run[order[new]]
    pairs = np.flatnonzero(own[1:] == own[:-1])
    parity, calm = 0, 0
    while calm < 2:
        left = pairs[(pairs & 1) == parity]
        a, b = at[left], at[left + 1]
        shift = SHIFT[a % PERIOD, b % PERIOD]
        wrong = left[ranks[a + shift] > ranks[b + shift]]
        for x in (at, group):
            x[wrong], x[wrong + 1] = x[wrong + 1], x[wrong]
        calm, parity = 0 if len(wrong) else calm + 1, 1 - parity
    place = np.empty(len(group), np.int64)
    place[group] = np.arange(len(group))
    return bucket[order[np.argsort(place[member], kind="stable")]]


def sorted_suffixes(text: np.ndarray, suffixes: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The suffixes of one block in suffix-array order, a bucket at a time, and which of them agree
    with the next in the bytes that a bucket is sorted on."""
    ranks = cover_ranks(text, window)
    lead = text[suffixes].astype(np.int64) << 8 | text[np.minimum(suffixes + 1, len(text) - 1)]
    by_lead = np.argsort(lead, kind="stable")
    edges = np.flatnonzero(np.diff(lead[by_lead])) + 1
    for bucket in np.split(suffixes[by_lead], edges):
        tie = np.zeros(len(bucket), bool)
        if len(bucket) > 1:
            columns = _padded_words(text, bucket, DEPTH)
            order = _order(columns)
            bucket, columns = bucket[order], columns[order]
            tie[:-1] = (columns[1:] == columns[:-1]).all(axis=1)
            tied = tie.copy()
            tied[1:] |= tie[:-1]
            if tied.any():
                bucket[tied] = _order_ties(bucket[tied], tie[tied], ranks)
        yield bucket, tie


def later_copies(text: np.ndarray, suffixes: np.ndarray, doc: np.ndarray, place: np.ndarray, window: int) -> np.ndarray:
    """Mask of the suffixes whose first ``window`` bytes also start at an earlier (doc, place)."""
    late = np.zeros(len(suffixes), bool)
    index = np.empty(len(text), np.int64)
    index[suffixes] = np.arange(len(suffixes))
    for bucket, tie in sorted_suffixes(text, suffixes, window):
        same = _agreeing(text, bucket, tie, window)
        if not same.any():
            continue
        inside = same.copy()
        inside[1:] |= same[:-1]
        own, kind = index[bucket[inside]], np.cumsum(~np.concatenate(([False], same[:-1])))[inside]
        order = np.lexsort((place[own], doc[own], kind))
        own, kind = own[order], kind[order]
        first = np.ones(len(own), bool)
        first[1:] = kind[1:] != kind[:-1]
        earliest = own[first][np.cumsum(first) - 1]
        late[own] = (doc[own] != doc[earliest]) | (place[own] != place[earliest])
    return late


def _agreeing(text: np.ndarray, bucket: np.ndarray, tie: np.ndarray, window: int) -> np.ndarray:
    """Which suffixes agree with the next in ``window`` bytes, checked byte by byte."""
    same, windows = np.zeros(len(bucket), bool), sliding_window_view(text, window)
    tied = np.flatnonzero(tie)
    for at in range(0, len(tied), 1 << 14):
        left = tied[at : at + (1 << 14)]
        same[left] = (windows[bucket[left]] == windows[bucket[left + 1]]).all(axis=1)
    return same


def _block(window: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        # a span's windows start at its first bytes; the rest is what the last window needs
        text = np.frombuffer(b"".join(part["bytes"]), np.uint8)
        count = part["count"].to_numpy(np.int64)
        size = count - 1 + window
        begin = np.cumsum(size) - size
        inner = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        suffixes = np.repeat(begin, count) + inner
        place = np.repeat(part["first"].to_numpy(np.int64), count) + inner
        doc = np.repeat(part["doc"].to_numpy(np.int64), count)
        late = later_copies(text, suffixes, doc, place, window)
        return pd.DataFrame({"row": np.repeat(part["row"].to_numpy(np.int64), count)[late], "doc": doc[late], "first": place[late].astype(np.int32), "count": np.ones(int(late.sum()), np.int32)})

    return run


#: Of one row a span.
_SPAN_BYTES = pa.schema([("row", pa.int64()), ("doc", pa.int64()), ("anchor", pa.int64()), ("crowded", pa.bool_()), ("first", pa.int32()), ("count", pa.int32()), ("bytes", pa.binary())])


def _span_bytes(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            text = batch.column("text").cast(pa.large_string())
            offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text)]
            data, lists = memoryview(text.buffers()[2]), batch.column("spans")
            row = np.repeat(np.arange(len(text)), np.asarray(lists.value_lengths(), np.int64))
            span = lists.flatten()
            first, size = np.asarray(span.field("first"), np.int64), np.asarray(span.field("count"), np.int64) - 1 + window
            start = offsets[row] + first
            raw = b"".join([data[a:b] for a, b in zip(start.tolist(), (start + size).tolist())])
            upto = np.append(0, np.cumsum(size)).astype(np.int32)
            cut = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(upto), pa.py_buffer(raw)])
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(take), batch.column("owner").take(take), *[span.field(c) for c in ("anchor", "crowded", "first", "count")], cut], schema=_SPAN_BYTES
            )

    return run


def repeated_byte_ranges(rows: DataFrame, window: int = WINDOW, seed: int = SEED, block_spans: int = BLOCK_SPANS) -> DataFrame:
    """(row, doc, first, count): starts of windows whose bytes also start earlier in (doc, place) order."""
    spans = repeated_spans(rows, byte_units, window, seed)
    classes, kinds = span_classes(spans)
    # all windows of a later copy of a span start earlier; those of the first are compared one by one
    at = classes.where("copies > 1").select("anchor", "class", F.col("at.doc").alias("d"), F.col("at.first").alias("f"))
    later = (F.col("doc") != F.col("d")) | (F.col("first") != F.col("f"))
    whole = spans.join(at, ["anchor", "class"]).where(later).select("row", "doc", "first", "count")
    edges = classes.join(kinds, "anchor")
    blocks = max(1, -(-(kinds.agg(F.sum("kinds")).first()[0] or 0) // block_spans))
    found = with_spans(rows, edges.select("at.row", "at.doc", F.struct("anchor", (F.col("kinds") > block_spans).alias("crowded"), "at.first", "at.count").alias("span")))
    found = found.mapInArrow(_span_bytes(window), "row long, doc long, anchor long, crowded boolean, first int, count int, bytes binary")
    block = F.pmod(F.xxhash64("anchor"), F.lit(blocks)).cast("int")
    sorted_ = found.where("NOT crowded").groupBy(block.alias("block")).applyInPandas(_block(window), "row long, doc long, first int, count int")
    single = found.where("crowded").select("row", "doc", "anchor", F.posexplode(F.sequence(F.lit(0), F.col("count") - 1)).alias("i", "j"), "first", "bytes")
    single = single.select("row", "doc", "anchor", (F.col("first") + F.col("j")).alias("first"), F.expr(f"substring(bytes, j + 1, {window})").alias("bytes"))
    single = single.withColumn("code", F.sha2("bytes", 256)).drop("bytes")
    earliest = single.groupBy("anchor", "code").agg(F.min(F.struct("doc", "first")).alias("at"))
    crowded = single.join(earliest, ["anchor", "code"]).where((F.col("doc") != F.col("at.doc")) | (F.col("first") != F.col("at.first")))
    return whole.unionByName(sorted_).unionByName(crowded.select("row", "doc", "first", F.lit(1).alias("count")))


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in units.slices(batch.column("text")):
                n = len(offsets) - 1
                gone = units.covered(batch.column("ranges").slice(at, n), offsets, window)
                removed = np.append(0, np.cumsum(gone))[offsets]
                opens = gone.copy()
                opens[1:] &= ~gone[:-1]
                inner = offsets[:-1][np.diff(offsets) > 0]
                opens[inner] = gone[inner]  # a run ends with its document
                runs = np.append(0, np.cumsum(opens))[offsets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").slice(at, n), pa.array(np.diff(offsets)), pa.array(np.diff(removed)), pa.array(np.diff(runs)), units.pieces(data, ~gone, offsets, pa.binary())],
                    names=["doc", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    return run


def suffix_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, seed: int = SEED, block_spans: int = BLOCK_SPANS) -> DataFrame:
    """One row per document: doc, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (remaining bytes).

    A byte is removed if a window of ``window`` bytes that covers it also starts earlier: in a
    document of a smaller key, or earlier in the same one. Repeated rows count as one document, so
    neither makes the other go. A null key comes before all others. Null text counts as empty; texts
    below a window are kept whole. Columns besides key and text are ignored, whatever their names.
    Remaining bytes can split a character, so they are binary. An empty table gives an empty table.
    A text is held whole in its task.
    """
    if not 1 <= seed <= window or window < PERIOD + DEPTH:
        raise ValueError(f"a window has {PERIOD + DEPTH} bytes or more and a seed at most as many")
    rows = keyed(docs, key, text)
    once, _ = one_each(rows)
    return with_ranges(rows, repeated_byte_ranges(once, window, seed, block_spans)).mapInArrow(_cut(window), "doc long, n_bytes long, n_removed long, n_spans long, kept binary")
