"""Corpus pipeline: quality rules, near-duplicate join, substring dedup, mixing, packing.

Any column may be null, and ids may repeat: decisions go by row, a hash of all its columns, so no row
decides for another and only equal rows share a decision. Ties go to the least id, then the least row
hash. Columns besides those of documents are left out. Empty tables give empty tables.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it to the shared
folder and rereads it as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.cluster import delete, scope, shared_dir, ship_package
from ridgeline.llm import packing
from ridgeline.llm.common import word_count
from ridgeline.llm.line_rules import line_rules
from ridgeline.llm.mixing import entropy_mix
from ridgeline.llm.ngram_join import ngram_jaccard_join
from ridgeline.llm.queries import document_tokens
from ridgeline.llm.substring_dedup import substring_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def _identified(docs: DataFrame) -> DataFrame:
    """Documents with ``_row``, a hash of the whole row: ids may be null or repeat, and only equal rows share it."""
    parts = [x for c in COLUMNS for x in (F.col(c).isNull(), F.col(c))]
    return _documents(docs).withColumn("_row", F.xxhash64(*parts))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that too many documents of their source hold are cut out; documents that fail the base rules, or
    keep under half of their words, go. Null and empty texts fail. ``n_chars`` follows where a text changes."""
    ship_package(spark)
    kept = line_rules(_documents(docs), also=("lang", "n_chars")).where("kept")
    n_chars = F.when(F.col("removed_words") > 0, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return _documents(kept.withColumn("n_chars", n_chars).withColumnRenamed("kept_text", "text"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: that of the least id, nulls last. Equal rows stay once;
    texts without words are no copies of each other."""
    ship_package(spark)
    docs = _identified(docs)
    classes = ngram_jaccard_join(docs, key="_row").select(F.col("doc").alias("_row"), "class_id").distinct()
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    kept = classes.join(docs.select("_row", "doc_id").distinct(), "_row").groupBy("class_id").agg(F.min(order)["_row"].alias("_row"))
    return _documents(docs.dropDuplicates(["_row"]).join(kept, "_row", "left_semi"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated passages go; documents left without a word go too. Texts without a repeated
    passage stay as they are, null and empty ones as well."""
    ship_package(spark)
    cut = substring_dedup(docs.withColumn("_null", F.col("text").isNull()), also=("doc_id", "lang", "source", "_null", "text"))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).when(~F.col("_null"), F.col("text"))
    cut = cut.where((F.col("n_removed") == 0) | (F.col("kept_text") != "")).withColumn("text", text)
    return _documents(cut.withColumn("n_chars", F.char_length("text").cast("long")))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come 0, 1 or 2 times, so that sources reach their target sizes.
    Texts without words stay once. Equal rows come together, their copies summed."""
    ship_package(spark)
    docs = _identified(docs)
    rates = entropy_mix(docs.select("_row", "doc_id", "source", word_count(F.col("text")).alias("size"))).groupBy("_row").agg(F.sum("copies").cast("int").alias("copies"))
    joined = docs.dropDuplicates(["_row"]).join(rates.where("copies > 0"), "_row")  # equal rows come together
    return _documents(joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 1024-token sequences, every one filled in proportion to the mixture.
    Each row is a document; a null or empty text is its end id alone."""
    ship_package(spark)
    return packing.pack_mixture(document_tokens(docs)).withColumnRenamed("doc", "doc_id")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("entropy mixing", mixed_sources),
    ("mixture packing", packed),
]

#: Tokenizing is not expressible in SQL; tests compare the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage stored for itself goes when its rows are written,
    and these go when the next stage's are."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES):
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}/{i}"
        with scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
