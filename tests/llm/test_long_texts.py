"""All operators on texts that span several slices, beside short ones."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from ridgeline.llm import language_crf as crf
from ridgeline.llm import units
from ridgeline.llm.gif_media import read_media, store_texts
from ridgeline.llm.license_scan import license_scan
from ridgeline.llm.line_rules import line_rules
from ridgeline.llm.ngram_join import ngram_jaccard_join
from ridgeline.llm.packing import pack_mixture
from ridgeline.llm.queries import document_tokens
from ridgeline.llm.substring_dedup import substring_dedup
from ridgeline.llm.suffix_dedup import suffix_dedup
from tests.conftest import SF
from tests.llm.test_repeats import brute_bytes, brute_join, brute_words, pairs, result


@pytest.fixture(scope="module")
def long_docs(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 8))) for _ in range(4000)]
    novel = " ".join(rng.choice(words) for _ in range(120_000))
    assert len(novel) > 2 * units.SLICE
    texts = [novel, novel[: 3 * len(novel) // 4] + " other end", " ".join(novel.split(" ")[5000:5200]), "short one", None, "z" * 700_000, " " * 600_000, "\n".join(["a line of text"] * 40_000)]
    rows = [(i, t, "en" if i % 2 else "de", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def test_exact_operators(long_docs):
    rows = pairs(long_docs)
    found = sorted((r["doc"], r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup(long_docs).collect())
    assert found == brute_words(rows, 35)
    found = sorted((r["doc"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup(long_docs).collect())
    assert found == brute_bytes(rows, 100)
    assert result(ngram_jaccard_join(long_docs)) == brute_join(rows)


def test_row_operators(long_docs):
    texts = dict(pairs(long_docs))
    for r in read_media(store_texts(long_docs)).select("doc", "n_bytes", "payload").collect():
        raw = (texts[r["doc"]] or "").encode()
        assert bytes(r["payload"][: len(raw)]) == raw and r["n_bytes"] == len(raw)
    found = {r["doc_id"]: r for r in crf.identify(long_docs, crf.fit(long_docs, longest=1 << 22)).collect()}
    assert found[0]["lang_pred"] in ("de", "en") and sum(w["words"] for w in found[0]["words"]) == len(texts[0].split()) and found[6]["lang_pred"] == "und"
    assert {r["doc_id"]: r["n_words"] for r in line_rules(long_docs).collect()} == {i: len((t or "").split()) for i, t in texts.items()}
    assert license_scan(long_docs).where("license IS NULL").count() == len(texts)
    tokens = document_tokens(long_docs)
    total = Counter()
    for r in pack_mixture(tokens).collect():
        total[r["doc"]] += r["length"]
    assert total == Counter({r["doc"]: r["n_tokens"] for r in tokens.collect()})


def test_stages(spark, long_docs):
    docs = long_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert np.sum([r["length"] for r in docs.collect()]) > 100_000


def test_random_texts_with_few_letters(spark):
    """Random data over small alphabets, where repeats overlap: both ways of settling an anchor agree with brute force."""
    rng = random.Random(12)
    rows = [(i, "".join(rng.choice("ab" if i % 2 else "a" * 30 + "b") for _ in range(rng.randint(0, 900)))) for i in range(40)]
    rows += [(100 + i, rows[i][1][50:400] + rows[i + 1][1][:300]) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for spans in (1, 4096):
        found = sorted((r["doc"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup(df, block_spans=spans).collect())
        assert found == brute_bytes(rows, 100)
