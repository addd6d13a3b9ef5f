"""Substring dedup by seed and extend: words of passages that repeat in the corpus are removed.

Documents are joined on winnowed anchors, matches are extended both ways from the anchor, and the
repeats over the length threshold, merged into maximal runs of covered words, are cut out. See
``repeats`` for the steps and why no pairs are formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.cluster import stored
from ridgeline.llm import units
from ridgeline.llm.repeats import keyed, one_each, repeated_spans, span_classes, with_ranges, with_spans, word_units

WINDOW = 35
SEED = 6

_WINDOW_ROW = pa.schema([("row", pa.int64()), ("doc", pa.int64()), ("first", pa.int32()), ("anchor", pa.int64()), ("code", pa.int64()), ("copies", pa.int64())])


def _single_windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row_id, doc, lists = np.asarray(batch.column("row")), np.asarray(batch.column("owner")), batch.column("spans")
            for at, data, offsets in units.slices(batch.column("text")):
                codes, by_row = word_units(data, offsets)
                windows = units.Windows(codes)
                for i in range(len(offsets) - 1):
                    spans = lists[at + i].values
                    first, count, copies, anchor = (np.asarray(spans.field(x), np.int64) for x in ("first", "count", "copies", "anchor"))
                    starts = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
                    code = windows.between(by_row[i] + starts, by_row[i] + starts + window)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(starts), row_id[at + i])),
                            pa.array(np.full(len(starts), doc[at + i])),
                            pa.array(starts.astype(np.int32)),
                            pa.array(np.repeat(anchor, count)),
                            pa.array(code.view(np.int64)),
                            pa.array(np.repeat(copies, count)),
                        ],
                        schema=_WINDOW_ROW,
                    )

    return run


def repeated_word_ranges(rows: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(row, doc, first, count): starts of windows whose word sequence also starts elsewhere."""
    spans = repeated_spans(rows, word_units, window, seed)
    classes, kinds = span_classes(spans)
    copied = classes.where("copies > 1").select("anchor", "class")
    whole = spans.join(copied, ["anchor", "class"], "left_semi").select("row", "doc", "first", "count")
    edges = classes.join(kinds, "anchor").select("at.row", "at.doc", F.struct("at.first", "at.count", "copies", "anchor").alias("span"))
    windows = with_spans(rows, edges).mapInArrow(_single_windows(window), "row long, doc long, first int, anchor long, code long, copies long")
    windows = stored(windows, "single-windows")
    # a window of a span without copies is repeated if another distinct span holds it
    again = windows.groupBy("anchor", "code").agg(F.count("*").alias("n")).where("n > 1").select("anchor", "code")
    single = windows.where("copies = 1").join(again, ["anchor", "code"], "left_semi").select("row", "doc", "first", F.lit(1).alias("count"))
    return whole.unionByName(single)


def _cut(window: int, also: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in units.slices(batch.column("text")):
                n = len(offsets) - 1
                _, start, end, by_row = units.words(data, offsets)
                gone = units.covered(batch.column("ranges").slice(at, n), by_row, window)
                kept = np.flatnonzero(~gone)
                # bytes of kept words, and one space after each but a row's last
                change = np.bincount(start[kept], minlength=len(data) + 1) - np.bincount(end[kept], minlength=len(data) + 1)
                mask, plain = np.cumsum(change[: len(data)]) > 0, data.copy()
                row = np.searchsorted(by_row, kept, "right") - 1
                spaced = end[kept[:-1][row[1:] == row[:-1]]]
                mask[spaced], plain[spaced] = True, 0x20
                removed = np.append(0, np.cumsum(gone))[by_row]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").slice(at, n), pa.array(np.diff(by_row).astype(np.int64)), pa.array(np.diff(removed)), units.pieces(plain, mask, offsets, pa.string())] + [batch.column(c).slice(at, n) for c in also],
                    names=["doc", "n_words", "n_removed", "kept_text", *also],
                )

    return run


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, seed: int = SEED, also: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc, ``n_words``, ``n_removed``, ``kept_text`` (kept words joined by one space), columns ``also``.

    A word is removed if a window of ``window`` words that covers it also starts anywhere else, in
    the same document or another. Repeated rows are copies of each other, so they lose all windows.
    Null and empty texts have no words. Texts shorter than a window are kept whole. A null key stays
    null. Columns besides key, text and ``also`` are ignored; a ``text`` in ``also`` is empty for null. An empty table gives an empty table.
    """
    if not 1 <= seed <= window:
        raise ValueError("a seed has 1 to window words")
    if taken := {"doc", "row", "owner", "ranges", "n_words", "n_removed", "kept_text"} & set(also):
        raise ValueError(f"columns named as results can't be carried along: {sorted(taken)}")
    rows = keyed(docs, key, text, also)
    once, twins = one_each(rows)
    ranges = repeated_word_ranges(once, window, seed)
    if twins is not None:  # all windows of a repeated row start elsewhere
        every = twins.select("row", F.col("owner").alias("doc"), F.lit(0).alias("first"), F.lit(2**31 - 1).alias("count"))
        ranges = ranges.join(twins.withColumnRenamed("owner", "doc"), ["row", "doc"], "left_anti").unionByName(every)
    extra = "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in also)
    return with_ranges(rows, ranges).mapInArrow(_cut(window, also), f"doc long, n_words long, n_removed long, kept_text string{extra}")

