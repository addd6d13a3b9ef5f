"""Queries opN_<name>: each operator with production parameters over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import language_crf, packing
from ridgeline.llm.centroids import centroid_clusters
from ridgeline.llm.common import read_table, word_count
from ridgeline.llm.gif_media import read_media, store_texts
from ridgeline.llm.license_scan import license_scan
from ridgeline.llm.line_rules import line_rules
from ridgeline.llm.mixing import entropy_mix
from ridgeline.llm.ngram_join import ngram_jaccard_join
from ridgeline.llm.personal_data import find_personal_data
from ridgeline.llm.repair import damaged_and_repaired
from ridgeline.llm.sharding import stratified_shards
from ridgeline.llm.substring_dedup import substring_dedup
from ridgeline.llm.suffix_dedup import suffix_dedup

# Fixed value: the one added token of the 50k byte-level vocabulary.
SPECIALS = {"<|endoftext|>": 50256}


def op1_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = language_crf.identify(docs, language_crf.fit(docs))
    return found.select("doc_id", language_crf.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.to_json("words").alias("words"))


def op2_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = read_media(store_texts(read_table(spark, sf_dir, "documents")))
    ms = F.aggregate("frames", F.lit(0).cast("long"), lambda total, f: total + f["delay_ms"])
    times = F.struct(F.size("frames").alias("frames"), ms.alias("ms"), F.col("histogram"))
    return media.select(
        F.col("doc").alias("doc_id"),
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32, 32)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.to_json(times).alias("feature"),
    )


def document_tokens(docs: DataFrame) -> DataFrame:
    """Token table of documents under the public 50k byte-level vocabulary.

    Its tokenizer file names the ids; its ranks file gives the same ones several times faster.
    """
    import public_tokenizers

    return packing.token_table(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, SPECIALS)


def op3_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_mixture(document_tokens(read_table(spark, sf_dir, "documents")))
    return pieces.withColumnRenamed("doc", "doc_id")


def op4_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_rules(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words", kept_hash().alias("kept_sha256"))


def kept_hash() -> Column:
    return F.sha2(F.coalesce("kept_text", F.lit("")), 256)


def page_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line rules over raw pages, one tag a line, by registered domain: markup that a site repeats goes, and
    pages of which less than 0.85 is left are template."""
    domain = F.element_at(F.split("url", "/"), 3)
    pages = read_table(spark, sf_dir, "pages").select("page_id", F.substring_index(domain, ".", -2).alias("site"), F.replace(F.col("html"), F.lit(">"), F.lit(">\n")).alias("text"))
    found = line_rules(pages, "page_id", "site", min_kept_share=0.85)
    return found.select("page_id", "site", "n_words", "removed_words", "base_failed", "kept", kept_hash().alias("kept_sha256"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read_table(spark, sf_dir, "documents")).select("doc_id", "license", "dice", "license_units")


def op6_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    found = entropy_mix(docs)
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op7_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    found = stratified_shards(docs, 16, ties=("size", "text_crc32"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_jaccard_join(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), "class_id", F.col("links").alias("n_links"), "copy_of", F.col("copies").alias("n_copies"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = damaged_and_repaired(read_table(spark, sf_dir, "conversations"))
    return found.select(F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroid_clusters(read_table(spark, sf_dir, "embeddings"))
    text = F.array_join(F.col("centroid").cast("array<string>"), ",")
    return found.select(F.col("vec").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", F.sha2(text, 256).alias("centroid_sha256"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_language_crf, op2_gif_media, op3_mixture_packing, op4_line_rules, op5_license_scan, op6_entropy_mix, op7_stratified_shards, op8_substring_dedup, op9_suffix_dedup, op10_ngram_jaccard_join, op11_conversation_repair, op12_centroid_clusters, op13_personal_data, page_line_rules)
}
