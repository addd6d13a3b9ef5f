"""Operators 3, 6 and 7."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ridgeline.llm import mixing, packing
from ridgeline.llm.common import word_count
from ridgeline.llm.queries import SPECIALS, document_tokens
from ridgeline.llm.sharding import stratified_shards
from tests.llm.conftest import WORDS


def check_layout(pieces):
    windows = defaultdict(list)
    for p in pieces:
        windows[p["sequence_id"]].append((p["offset"], p["length"]))
    assert sorted(windows) == list(range(len(windows)))
    sizes = []
    for spans in windows.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        sizes.append(at)
    assert max(sizes, default=0) <= packing.WINDOW and sum(s < packing.WINDOW for s in sizes) <= 1


def test_packing_keeps_every_token(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = packing.pack_mixture(document_tokens(docs)).collect()
    check_layout(pieces)
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p["doc"]].append(p)
    rows = docs.collect()
    times = Counter(r["doc_id"] for r in rows)
    for r in rows:
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        own = Counter((p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]) for p in by_doc[r["doc_id"]])
        covered = np.zeros(len(ids), int)
        for (start, length, crc, total), n in own.items():
            assert total == len(ids) and crc == zlib.crc32(ids[start : start + length].tobytes())
            covered[start : start + length] += n
        assert (covered == times[r["doc_id"]]).all()


def test_ids_equal_the_tokenizer_files():
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(3)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, SPECIALS)
    alphabet = "ab É日\n\t'sré  .,!1234567890  <|endoftext|>"
    texts = ["", "<|endoftext|>", "x<|endoftext|> y", "don't  we'll\r\n\n a", *["".join(rng.choice(alphabet) for _ in range(200)) for _ in range(200)]]
    texts += [" " * 2_000_000, "x" + " \n" * 60_000 + "y", "a" * 1_000_000, "ab\u3000" * 100_000, "\u3000" * 60_000, "-" * 300_000, "no space" + "é1" * 200_000]
    for t in texts:
        assert encode(t).tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_packing_by_weights(spark):
    """A target mixture other than the corpus' own: every window follows it until a queue is dry."""
    rows = [(i, f"word{i} " * 400, ["a", "b", None][i % 3]) for i in range(90)]
    tokens = document_tokens(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    pieces = packing.pack_mixture(tokens, {"a": 6, "b": 3, None: 1}).collect()
    check_layout(pieces)
    source, totals = {i: s for i, _, s in rows}, Counter()
    per = defaultdict(Counter)
    for p in pieces:
        per[p["sequence_id"]][source[p["doc"]]] += p["length"]
        totals[source[p["doc"]]] += p["length"]
    dry = int(totals["a"] // (0.6 * packing.WINDOW))
    for w in range(dry - 1):
        assert all(abs(per[w][s] - share * packing.WINDOW) <= 2 for s, share in (("a", 0.6), ("b", 0.3), (None, 0.1)))
    with pytest.raises(ValueError):
        packing.pack_mixture(tokens, {"a": 1})


def placed(schedule, queue, start, end):
    parts = list(schedule.place(np.array([queue]), np.array([start]), np.array([end])))
    return [np.concatenate(x) for x in zip(*parts)][1:] if parts else [np.zeros(0, np.int64)] * 4


def test_windows_follow_the_target_mixture():
    tokens, weights = [400_000, 150_000, 90_000], [5, 3, 2]
    schedule = packing.Schedule(tokens, weights)
    per = np.zeros((2000, 3), int)
    for q, n in enumerate(tokens):
        _, length, window, _ = placed(schedule, q, 0, n)
        np.add.at(per, (window, q), length)
    # until the first queue is dry, each window, and all windows so far, have their share to within two tokens
    dry = min(np.flatnonzero(per[:, q])[-1] for q in range(3))
    wanted = np.array(weights) / 10 * packing.WINDOW
    assert np.abs(per[:dry] - wanted).max() <= 2
    assert np.abs(np.cumsum(per, axis=0)[:dry] - wanted * np.arange(1, dry + 1)[:, None]).max() <= 2


@pytest.mark.parametrize("share", [1e-3, 1e-5, 1e-7, 1e-9])
def test_small_shares_are_spread(share):
    """A source of 1,000 tokens has them evenly over all windows, however large the corpus is."""
    small = 1000
    large = round(small / share) - small
    schedule = packing.Schedule([large, small, 7 * small])
    _, length, window, _ = placed(schedule, 1, 0, small)
    assert length.sum() == small and window.max() <= schedule.end // packing.WINDOW
    target = packing.WINDOW * small / (large + 8 * small)
    assert np.abs(np.cumsum(length) - (window + 1) * target).max() <= 2 and length.max() <= target + 2
    assert np.diff(window).max(initial=0) <= 2 / target + 2
    # a stretch in the middle of the large queue
    first, length, window, _ = placed(schedule, 0, large // 2, large // 2 + 50_000)
    assert length.sum() == 50_000 and first[0] == large // 2 and np.abs(length[1:-1] - packing.WINDOW * large / (large + 8 * small)).max() <= 2


def test_ten_thousand_sources():
    import pickle

    rng = np.random.default_rng(7)
    tokens = rng.integers(1, 10**7, 10_000).tolist()
    for weights in (None, rng.integers(1, 100, 10_000).tolist()):
        schedule = packing.Schedule(tokens, weights)
        assert len(pickle.dumps(schedule)) < 2_000_000 and len(schedule.start) <= 8
        if weights is None:
            assert len(pickle.dumps(schedule)) < 1_000_000
        base = [*schedule.base, np.array(tokens)]
        assert all((a <= b).all() for a, b in zip(base, base[1:])) and [int(b.sum()) for b in base] == [*schedule.start, schedule.end]
        for q in (0, 5000, 9999):
            begin = max(0, tokens[q] - 20_000)
            first, length, window, offset = placed(schedule, q, begin, tokens[q])
            assert (first == begin + np.cumsum(length) - length).all() and length.sum() == tokens[q] - begin and (np.diff(window) >= 0).all() and (offset + length).max() <= packing.WINDOW


def test_muldiv():
    rng = np.random.default_rng(1)
    a, b, c = (rng.integers(1, 2 ** rng.integers(1, 46, 4000)) for _ in range(3))
    b = np.minimum(b, c)
    add = rng.integers(-(2**45), 2**45, 4000)
    want = [(int(x) * int(y) + int(z)) // int(w) for x, y, z, w in zip(a, b, add, c)]
    assert packing.muldiv(a, b, c, add).tolist() == want


@pytest.mark.parametrize("weights", [None, "given"])
@pytest.mark.parametrize("tokens", [[1], [1023], [1024], [1025, 1], [0, 5, 0], [10**6, 1, 1, 1], [7] * 50, list(range(1, 40))])
def test_schedule_places_every_token(tokens, weights):
    given = None if weights is None else [1 + (7 * i) % 11 for i in range(len(tokens))]
    schedule, seen = packing.Schedule(tokens, given), []
    for q, n in enumerate(tokens):
        if n:
            first, length, window, offset = placed(schedule, q, 0, n)
            assert (first == np.cumsum(length) - length).all() and length.sum() == n
            seen += [{"sequence_id": int(w), "offset": int(o), "length": int(x)} for w, o, x in zip(window, offset, length)]
            assert placed(schedule, q, n // 3, n)[1].sum() == n - n // 3
    check_layout(seen)
    assert schedule.end == sum(tokens)


def test_entropy_mix(docs):
    sized = docs.withColumn("size", word_count(docs["text"]))
    rows = mixing.entropy_mix(sized).collect()
    size = Counter()
    for r in docs.collect():
        size[r["source"]] += len(WORDS(r["text"] or ""))
    targets = mixing.water_fill(list(size.items()), (5, 2, 1), 1.5)
    assert abs(sum(targets.values()) - 1.5 * sum(size.values())) < 1e-6
    taken, largest = Counter(), Counter()
    for r in rows:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(targets[r["source"]]) and 0 <= r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in size:
        assert abs(taken[s] - targets[s]) <= largest[s]
    again = Counter((r["doc_id"], r["copies"]) for r in mixing.entropy_mix(sized).collect())
    assert again == Counter((r["doc_id"], r["copies"]) for r in rows)


def test_water_fill_shares_the_excess():
    targets = mixing.water_fill([("b", 100), ("a", 10), (None, 1000)], (5, 2, 1), 1.5)
    assert targets["a"] == 20 and targets["b"] == 200 and targets[None] == pytest.approx(1665 - 220)


def test_rates_solve_the_dual(spark):
    hist = spark.createDataFrame([("a", 10, 50), ("a", 100, 20), ("a", 1000, 3)], "source string, _size long, _count long")
    (_, m, mean), *_ = mixing.solve_multipliers(hist, "source", [("a", 5500, 73, 4100.0)])
    total = sum(n * s * 2 / (1 + np.exp(-m * s / mean)) for s, n in ((10, 50), (100, 20), (1000, 3)))
    assert total == pytest.approx(4100.0, rel=1e-8)


def test_stratified_shards(docs):
    rows = stratified_shards(docs, 4, ties=("text",)).collect()
    shards = defaultdict(list)
    for r in rows:
        shards[r["shard"]].append(r)
    sizes = [len(v) for v in shards.values()]
    assert set(shards) == set(range(4)) and max(sizes) - min(sizes) <= 1 and len(rows) == docs.count()
    total = Counter(r["source"] for r in rows)
    for own in shards.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        got = Counter(r["source"] for r in own)
        assert all(abs(got[s] - n / 4) <= 2 for s, n in total.items())
    # the definition: fractional ranks of seeded-shuffled rows, cut into equal runs
    assert Counter((r["doc_id"], r["shard"]) for r in rows) == Counter((r["doc_id"], r["shard"]) for r in stratified_shards(docs.repartition(7), 4, ties=("text",)).collect())


def test_unsettled_multipliers_are_an_error(spark):
    hist = spark.createDataFrame([("a", 10, 50), ("a", 100, 20)], "source string, _size long, _count long")
    with pytest.raises(RuntimeError):
        mixing.solve_multipliers(hist, "source", [("a", 2500, 70, 1234.0)], iterations=1)


def test_large_groups_of_one_size(spark, monkeypatch):
    """Documents of one source and size are numbered in ranges of their hash; the ranges don't change the result."""
    df = spark.range(3000).selectExpr("id AS doc_id", "'a' AS source", "cast(1 + id % 3 AS long) AS size")
    whole = Counter((r["doc_id"], r["copies"]) for r in mixing.entropy_mix(df, share=0.7).collect())
    monkeypatch.setattr(mixing, "SUB_ROWS", 100)
    assert Counter((r["doc_id"], r["copies"]) for r in mixing.entropy_mix(df, share=0.7).collect()) == whole


def test_empty_and_null_tables(no_docs, keyless):
    for df, n in ((no_docs, 0), (keyless, 5)):
        assert stratified_shards(df, 4).count() == n
        assert mixing.entropy_mix(df.withColumn("size", word_count(df["text"]))).count() == n
        assert packing.pack_mixture(document_tokens(df)).count() >= n
