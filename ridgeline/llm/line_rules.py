"""Quality rules: base statistics of each document and cross-document line frequency by host.

Lines are normalised (lower case, digits as 0, single spaces) and hashed. For each host, the number
of distinct documents that hold a line is counted. A line above the host's limit is boilerplate and
is removed; a document that keeps too few of its words is depleted and rejected. The limit is a
share of the host's documents, but never below nor above two absolute numbers: a small host needs
some evidence, and a large one can't hide boilerplate behind its size.

Python sees each text twice: in a narrow stage that keeps numbers only, and where the lines over the
limit are cut out, after one shuffle that brings each text its lines. Counting explodes lines into
(host, line) hashes, a line once a document, which are pre-aggregated before they are shuffled, so
neither a host with a third of all documents nor a line that all share meets in one task. Hashes
have 64 bits: a line is removed by mistake if it collides with one of its host's frequent lines, and
those are few.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.cluster import stored
from ridgeline.llm.common import WORD, by_bytes, null_safe

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
PROFILE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<line: long, words: int>>"
_LINES = pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int32())]))
_words, _symbols, _digits = re.compile(WORD).findall, re.compile(r"[#*$%&|<>]").findall, re.compile("[0-9]")


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def _line(words: list[str]) -> int:
    """The hash of a line in its normal form."""
    return _hash(_digits.sub("0", " ".join(words).lower()))


def without_lines(text: str, gone: set[int]) -> str:
    """The text without the lines whose hashes are in ``gone``; lines without words stay."""
    return "\n".join(line for line in text.split("\n") if not ((own := _words(line)) and _line(own) in gone))


def repeated_words(words: list[str]) -> int:
    """Words that lie in a 3-word window found twice or more in the text, the first one included."""
    windows = list(zip(words, words[1:], words[2:]))
    seen: set = set()
    again = {w for w in windows if w in seen or seen.add(w)}
    if not again:
        return 0
    covered, upto = 0, 0
    for i, w in enumerate(windows):
        if w in again:
            covered += i + 3 - max(i, upto)
            upto = i + 3
    return covered


def profile(text: str | None) -> tuple:
    """The columns of PROFILE for one text; null counts as a text without words."""
    text = text or ""
    words, seen, dup, lines = _words(text), set(), 0, Counter()
    for line in text.split("\n"):
        own = _words(line)
        if own:
            dup += line in seen
            seen.add(line)
            lines[_line(own)] += len(own)
    return len(words), sum(map(len, words)), len(_symbols(text)), dup, repeated_words(words), [{"line": k, "words": n} for k, n in lines.items()]


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches):
        table = pa.table(batch)
        found = [profile(x.as_py()) for x in table["text"]]
        columns = list(zip(*found)) if found else [[] for _ in range(6)]
        out = table.drop_columns(["text"])
        for name, values in zip(STATISTICS, columns):
            out = out.append_column(name, pa.array(values, pa.int64()))
        out = out.append_column("lines", pa.array(columns[5], _LINES))
        yield from out.to_batches()


def _kept_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in by_bytes([batch]):
            gone, text = part.column("gone").to_pylist(), part.column("text")
            if any(gone):
                text = pa.array([without_lines(t or "", set(g)) if g else t for t, g in zip(text.to_pylist(), gone)], text.type)
            rest = [c for c in part.schema.names if c not in ("gone", "text")]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in rest], text], names=[*rest, "kept_text"])


def line_rules(
    docs: DataFrame,
    key: str = "doc_id",
    host: str = "source",
    text: str = "text",
    min_documents: int = 20,
    max_share: float = 0.005,
    max_documents: int = 10_000,
    min_words: int = 50,
    max_repeat_share: float = 0.5,
    min_kept_share: float = 0.5,
    also: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: key, host, columns ``also``, the base statistics, ``removed_words``, ``base_failed``, ``kept``, ``kept_text``.

    A line is removed where more documents of the host hold it than ``max_share`` of the host's
    documents, at least ``min_documents`` and at most ``max_documents``. Every row is a document, so
    copies count. ``kept_text`` is the text without those lines, the others joined by newlines; a text
    that loses none is unchanged, null ones stay null. A document is rejected if it fails the base rules
    or keeps less than ``min_kept_share`` of its words. Null text: no words, so it fails the base rules. A
    null host is a host of its own; repeated rows each get a row, null keys stay null. Columns besides
    key, host, text and ``also`` are ignored, whatever their names. An empty table gives an empty table.
    Memory follows the longest text of a task.
    """
    results = {*STATISTICS, "removed_words", "base_failed", "kept", "kept_text", "row", "gone", "key", "host", "text"}
    if taken := results & set(also):
        raise ValueError(f"columns named as results can't be carried along: {sorted(taken)}")
    slim = docs.select(F.col(key).alias("key"), F.col(host).alias("host"), F.col(text).alias("text"), *also)
    # a row by its hash: equal rows have equal statistics and lose equal lines
    slim = slim.withColumn("row", F.xxhash64(*[x for c in ("key", "host", "text") for x in (F.col(c).isNull(), F.col(c))]))
    host_type = slim.schema["host"].dataType.simpleString()
    rows = stored(slim.select("row", "host", "text").mapInArrow(_profiles, f"row long, host {host_type}, {PROFILE}"), "line-profiles")
    lines = rows.select("row", "host", F.explode("lines").alias("l")).select("row", "host", "l.line", "l.words")
    counts = lines.groupBy("host", "line").agg(F.count("*").alias("documents")).where(F.col("documents") > min_documents)
    hosts = rows.groupBy("host").agg(F.count("*").alias("host_documents"))
    limit = F.least(F.greatest(F.lit(float(min_documents)), max_share * F.col("host_documents")), F.lit(float(max_documents)))
    over = null_safe(counts, hosts, ["host"]).where(F.col("documents") > limit).select("host", "line")
    removed = null_safe(lines, over, ["host", "line"]).groupBy("row").agg(F.collect_set(F.struct("line", "words")).alias("lost"))
    statistics = rows.groupBy("row").agg(*[F.first(c).alias(c) for c in STATISTICS]).join(removed, "row", "left")
    lost = F.aggregate("lost", F.lit(0).cast("long"), lambda total, x: total + x["words"])
    statistics = statistics.select("row", *STATISTICS, F.coalesce(lost, F.lit(0)).cast("long").alias("removed_words"), F.col("lost")["line"].alias("gone"))
    joined = slim.join(statistics, "row").drop("row")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema if f.name not in ("gone", "text"))
    cut = joined.mapInArrow(_kept_texts, f"{kinds}, kept_text string")
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") > max_repeat_share * F.col("n_words"))
    depleted = F.col("n_words") - F.col("removed_words") < min_kept_share * F.col("n_words")
    return cut.withColumns({"base_failed": failed, "kept": ~failed & ~depleted}).withColumnsRenamed({"key": key, "host": host})
