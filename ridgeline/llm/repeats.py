"""Exact search for repeated windows of a corpus: what the two substring operators share.

1. Seeds. Each window chooses one of its seeds by winnowing; the windows that chose one anchor form
   its span. Equal windows always lie in spans of equal anchors.
2. Join. Anchors found once are dropped: one partially aggregated count, one join on the anchor.
3. Classes. Spans of equal content are counted together, so thousands of copies of a passage
   become one row on the map side.
4. Extension. Only where an anchor stands in spans that differ (edges of passages, near copies) are
   single windows compared, one row a distinct span.

No pair of documents is ever formed. A document is identified by its key and a hash of its text:
documents of different keys never meet, whatever their hashes. Equal rows are one document with a
number of copies: their text is searched once, so they cost no more than their number. Spans and
windows are equal if both the 64-bit fingerprint of their anchor and the 64-bit one of their own
units are. Words take part by 64-bit hashes, which are mixed in steps of eight bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.cluster import stored
from ridgeline.llm import units


#: Stands for a null key where documents are ordered.
NO_KEY = -(2**63)


def byte_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return data, offsets


def word_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = units.words(data, offsets)
    return found[0], found[3]


def keyed(docs: DataFrame, key: str, text: str, also: tuple[str, ...] = ()) -> DataFrame:
    """doc (key), text (null as empty), row and owner (identity of the document; owner is never null) and the columns ``also``."""
    text_ = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).alias("doc"), text_.alias("text"), *[c for c in also if c != "text"]).withColumns({"row": F.xxhash64("doc", "text"), "owner": F.coalesce("doc", F.lit(NO_KEY))})


_SPAN = pa.schema([("row", pa.int64()), ("doc", pa.int64()), ("anchor", pa.int64()), ("class", pa.int64()), ("first", pa.int32()), ("count", pa.int32())])


def span_rows(rows: DataFrame, to_units: Callable, window: int, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row_id, doc = np.asarray(batch.column("row")), np.asarray(batch.column("doc").fill_null(NO_KEY))
            for at, data, offsets in units.slices(batch.column("text")):
                codes, by_row = to_units(data, offsets)
                for row, anchor, kind, first, count in units.spans(codes, by_row, window, seed):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(row_id[at + row]), pa.array(doc[at + row]), pa.array(anchor.view(np.int64)), pa.array(kind.view(np.int64)), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32))],
                        schema=_SPAN,
                    )

    return rows.mapInArrow(run, "row long, doc long, anchor long, class long, first int, count int")


def repeated_spans(rows: DataFrame, to_units: Callable, window: int, seed: int) -> DataFrame:
    """Spans whose anchor stands in more than one span of the corpus, stored."""
    spans = span_rows(rows, to_units, window, seed)
    again = spans.select("anchor").groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    again = stored(again, "repeated-anchors")  # a table, so that the join can be split at frequent anchors
    return stored(spans.join(again, "anchor", "left_semi"), "repeated-spans")


def span_classes(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, kinds), stored. classes: one row per distinct span, its ``copies`` and first place ``at``.
    kinds: anchors that stand in more than one distinct span, and in how many.

    Both are tables of their own so that a join between them is one that Spark can split where an
    anchor is frequent.
    """
    classes = spans.groupBy("anchor", "class").agg(F.count("*").alias("copies"), F.min(F.struct("doc", "first", "row", "count")).alias("at"))
    classes = stored(classes, "span-classes")
    kinds = classes.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    return classes, stored(kinds, "span-kinds")


def one_each(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(rows, each document once; the (row, owner) that stand in several rows, stored, or None where none do)."""
    twins = stored(rows.groupBy("row", "owner").agg(F.count("*").alias("n")).where("n > 1").select("row", "owner"), "repeated-rows")
    if not twins.take(1):
        return rows, None
    plain = ["row", "owner", "doc", "text"]
    again = rows.select(*plain).join(twins, ["row", "owner"], "left_semi").groupBy("row", "owner").agg(F.first("doc").alias("doc"), F.first("text").alias("text"))
    again = stored(again.select(*plain), "repeated-texts")
    return rows.select(*plain).join(twins, ["row", "owner"], "left_anti").unionByName(again), twins


def _lists(rows: DataFrame, value: str | Column, name: str) -> DataFrame:
    """Lists by document of a table with row and doc (``NO_KEY`` for null), made of documents that stand once;
    so a document's text bounds its list."""
    return rows.groupBy("row", F.col("doc").alias("owner")).agg(F.collect_list(value).alias(name))


def with_ranges(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Every row with its ``ranges`` array<struct<first, count>>, null where it has none."""
    return rows.join(_lists(ranges, F.struct("first", "count"), "ranges"), ["row", "owner"], "left")


def with_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """The rows that have ``spans``, with the list of them.

    Joined as ``with_ranges`` joins and with all columns, so that the texts are shuffled once for both.
    """
    return rows.join(_lists(spans, "span", "spans"), ["row", "owner"])
