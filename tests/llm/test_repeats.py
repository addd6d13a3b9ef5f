"""Operators 8, 9 and 10 against brute force."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pytest

from ridgeline.llm import repeats, units
from ridgeline.llm import suffix_dedup as sd
from ridgeline.llm.ngram_join import choose_bands, ngram_jaccard_join
from ridgeline.llm.substring_dedup import substring_dedup
from ridgeline.llm.suffix_dedup import suffix_dedup
from tests.llm.conftest import WORDS


def brute_words(rows, window):
    words = [WORDS(t or "") for _, t in rows]
    starts = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if starts[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((doc, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out)


def brute_bytes(rows, window):
    seen, out = set(), []
    for doc, t in sorted(set(rows)):
        raw, gone = (t or "").encode(), None
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - window + 1):
            part = raw[i : i + window]
            if part in seen:
                gone[i : i + window] = True
            seen.add(part)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        runs = int((gone & ~np.concatenate(([False], gone[:-1]))[: len(gone)]).sum())
        out += [(doc, len(raw), int(gone.sum()), runs, kept)] * rows.count((doc, t))
    return sorted(out)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


@pytest.mark.parametrize("window", [35, 12])
def test_substring_dedup(docs, window):
    found = sorted((r["doc"], r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup(docs, window=window).collect())
    assert found == brute_words(pairs(docs), window)


@pytest.mark.parametrize("window,crowd", [(100, 4096), (100, 2), (70, 4096)])
def test_suffix_dedup(docs, window, crowd):
    found = sorted((r["doc"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup(docs, window=window, block_spans=crowd).collect())
    assert found == brute_bytes(pairs(docs), window)


def test_blocks_are_suffix_arrays():
    rng = np.random.default_rng(1)
    text = rng.integers(97, 99, 3000).astype(np.uint8)
    text[1500:2200] = text[200:900]
    suffixes = np.arange(2800)
    order = np.concatenate([bucket for bucket, _ in sd.sorted_suffixes(text, suffixes, 100)])
    keys = [text[i : i + 100].tobytes() for i in order]
    assert sorted(order) == list(suffixes) and keys == sorted(keys)
    late = sd.later_copies(text, suffixes, np.zeros(2800, int), suffixes, 100)
    first = {}
    for i in suffixes:
        first.setdefault(text[i : i + 100].tobytes(), i)
    assert [i for i in suffixes if late[i]] == [i for i in suffixes if first[text[i : i + 100].tobytes()] != i]


def test_difference_cover():
    assert {(a - b) % sd.PERIOD for a in sd.COVER for b in sd.COVER} == set(range(sd.PERIOD))


def brute_join(rows, n=5, threshold=0.8):
    sets = {}
    for doc, t in rows:
        w = WORDS(t or "")
        sets[doc] = frozenset(tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))) if w else frozenset()
    rep = {}
    for doc in sorted(sets):
        if sets[doc]:
            rep.setdefault(sets[doc], doc)
    copy_of = {d: rep.get(s, d) for d, s in sets.items()}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links, distinct = defaultdict(int), sorted(rep.items(), key=lambda x: x[1])
    for i, (s, a) in enumerate(distinct):
        for t, b in distinct[i + 1 :]:
            shared = len(s & t)
            if shared >= threshold * (len(s) + len(t) - shared):
                links[a] += 1
                links[b] += 1
                parent[max(root(a), root(b))] = min(root(a), root(b))
    count = Counter(copy_of[d] for d, _ in rows)
    return sorted((d, copy_of[d], count[copy_of[d]], links[copy_of[d]], root(copy_of[d])) for d, _ in rows)


def result(df):
    return sorted((r["doc"], r["copy_of"], r["copies"], r["links"], r["class_id"]) for r in df.collect())


def test_ngram_join(docs):
    assert result(ngram_jaccard_join(docs)) == brute_join(pairs(docs))


def test_ngram_join_sample(sample):
    assert result(ngram_jaccard_join(sample)) == brute_join(pairs(sample))


@pytest.mark.parametrize("edits", [(2, 2), (4, 9), (1, 14), (0, 30)])
def test_ngram_join_of_a_large_group(spark, monkeypatch, edits):
    """A group above the crowd limit goes through cores and tiles, and loses no link."""
    from ridgeline.llm import ngram_join

    monkeypatch.setattr(ngram_join, "CROWD", 6)
    monkeypatch.setattr(ngram_join, "TILE", 900)
    rng, rows = np.random.default_rng(sum(edits)), []
    base = [f"w{i}" for i in range(300)]
    for i in range(60):
        words = list(base)
        for k in rng.integers(0, 300, rng.integers(edits[0], edits[1] + 1)):
            words[k] = f"x{rng.integers(0, 4)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(ngram_join.ngram_jaccard_join(df)) == brute_join(rows)


def test_ngram_join_of_null_and_repeated_keys(spark):
    """Links and classes go by text: a key may be null, or stand for several texts."""
    base = [f"w{i}" for i in range(100)]
    near = lambda k: " ".join([*base[:-1], f"x{k}"])
    far = lambda k: " ".join([*(f"v{i}" for i in range(99)), f"x{k}"])
    rows = [(5, near(1)), (5, far(1)), (6, near(2)), (7, far(2)), (None, near(3)), (None, "only here and nowhere else at all"), (8, near(2)), (8, near(2))]
    found = Counter(result_null_safe(ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))))
    assert found == Counter([(5, 5, 1, 2, 5), (5, 5, 1, 1, 5), (6, 6, 3, 2, 5), (7, 7, 1, 1, 5), (None, None, 1, 2, 5), (None, None, 1, 0, None), (8, 6, 3, 2, 5), (8, 6, 3, 2, 5)])


def result_null_safe(df):
    return [(r["doc"], r["copy_of"], r["copies"], r["links"], r["class_id"]) for r in df.collect()]


def morse(n):
    """The Thue-Morse word of 2**n letters and its complement: sums over powers of an odd base can't tell them apart."""
    bits = [bin(i).count("1") % 2 for i in range(2**n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [5, 10, 11])
def test_long_words_differ(spark, n):
    """Twenty shared words on both sides of words that only differ in all their letters: no window is shared."""
    one, other = morse(n)
    left, right = [f"l{i}" for i in range(20)], [f"r{i}" for i in range(20)]
    rows = [(1, " ".join([*left, one, *right])), (2, " ".join([*left, other, *right]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r["doc"], r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup(df).collect())
    assert found == brute_words(rows, 35) and [x[2] for x in found] == [0, 0]
    assert result(ngram_jaccard_join(df)) == brute_join(rows)


def test_windows_of_two_words_in_turn(spark):
    """Windows and spans over two words, or two bytes, in Thue-Morse order."""
    one, other = (" ".join(x) for x in morse(11))
    rows = [(1, one), (2, other), (3, "x " + one[:300]), (4, morse(10)[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r["doc"], r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup(df).collect()) == brute_words(rows, 35)
    assert sorted((r["doc"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup(df).collect()) == brute_bytes(rows, 100)


def test_fingerprints_tell_windows_apart():
    rng = np.random.default_rng(3)
    codes = units.BYTE_CODES[np.concatenate([[int(c) for c in morse(9)[0].replace("a", "0").replace("b", "1")], rng.integers(0, 3, 700)])]
    raw, windows = codes.tobytes(), units.Windows(codes)
    for size in (1, 2, 3, 5, 31, 32, 48, 100, 257):
        found = defaultdict(set)
        for i, code in enumerate(windows.every(size).tolist()):
            found[raw[8 * i : 8 * (i + size)]].add(code)
        assert all(len(x) == 1 for x in found.values()) and len(set.union(*found.values())) == len(found)
        start = np.arange(len(codes) - size + 1)
        assert (windows.between(start, start + size) == windows.every(size)).all()


@pytest.mark.parametrize("copies", [3, 5000])
def test_many_equal_rows(spark, copies):
    """Equal rows cost in proportion to their number: a document's spans are listed once."""
    rng = np.random.default_rng(5)
    text = " ".join(f"w{i}" for i in rng.integers(0, 10**6, 120))
    rows = [(1, text)] * copies + [(0, text[100:]), (2, " ".join(text.split()[40:80])), (None, text), (None, text)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    words = Counter((r["doc"], r["n_words"], r["n_removed"]) for r in substring_dedup(df).collect())
    assert words == Counter({(1, 120, 120): copies, (0, len(text[100:].split()), len(text[100:].split()) - (text[99] != " ")): 1, (2, 40, 40): 1, (None, 120, 120): 2})
    once = [(d if d is not None else -1, t) for d, t in dict.fromkeys(rows)]
    want = {d: x[1:] for d, *x in ((r[0], *r) for r in brute_bytes(once, 100))}
    found = Counter((r["doc"], r["n_bytes"], r["n_removed"]) for r in suffix_dedup(df).collect())
    assert found == Counter({(d if d >= 0 else None, *want[d][:2]): (copies if d == 1 else 2 if d < 0 else 1) for d in want})
    keyed = repeats.keyed(df, "doc_id", "text")
    once, twins = repeats.one_each(keyed)
    assert once.count() == 4 and twins.count() == 2
    joined = ngram_jaccard_join(df).where("doc = 1")
    assert {(r["copies"], r["copy_of"]) for r in joined.collect()} == {(copies + 2, 1)}


def test_chunks_of_a_long_text(spark, monkeypatch):
    """Texts are cut into chunks of windows; no window is lost or found twice."""
    rng = np.random.default_rng(9)
    texts = ["".join(rng.choice(list("abc "), n)) for n in (900, 400, 50, 0)]
    texts += [texts[0][200:700] + texts[1][:200], texts[0][:333]]
    for chunk in (7, 64, 1 << 20):
        monkeypatch.setattr(units, "CHUNK", chunk)
        found = []
        for to_units, window in ((repeats.byte_units, 20), (repeats.word_units, 6)):
            data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            codes, by_row = to_units(data, offsets)
            starts = sorted((int(r), int(f) + i) for row, _, _, first, count in units.spans(codes, by_row, window, 4) for r, f, c in zip(row, first, count) for i in range(c))
            assert starts == [(r, i) for r in range(len(texts)) for i in range(int(by_row[r + 1] - by_row[r]) - window + 1)]


def test_banding_meets_its_recall():
    for threshold, recall in ((0.8, 0.995), (0.9, 0.99), (0.5, 0.9)):
        bands, rows = choose_bands(threshold, recall)
        assert 1 - (1 - threshold**rows) ** bands >= recall - 1e-9


@pytest.mark.parametrize("operator", [substring_dedup, suffix_dedup, ngram_jaccard_join])
def test_empty_and_null_tables(operator, no_docs, keyless):
    assert operator(no_docs).count() == 0
    assert operator(keyless).count() == 5
