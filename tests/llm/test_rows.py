"""Operators 1, 2, 4 and 5, which look at each document by itself, and the pipeline."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from ridgeline.llm import gif_media as gif
from ridgeline.llm import language_crf as crf
from ridgeline.llm import license_scan as ls
from ridgeline.llm.line_rules import line_rules
from tests.conftest import SF
from tests.llm.conftest import WORDS

# -- language


def test_held_out_accuracy(sample):
    model = crf.fit(sample)
    rows = crf.identify(sample, model).join(sample.select("doc_id", "lang"), "doc_id").withColumn("held", crf.held_out(F.col("doc_id"))).where("held").collect()
    assert len(rows) > 20 and np.mean([r["lang_pred"] == r["lang"] for r in rows]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_chain_by_enumeration():
    """Forward-backward gives the posteriors of all label sequences."""
    rng = np.random.default_rng(0)
    model = crf.Model(["a", "b"], np.zeros((1 << crf.BITS, 2)), np.zeros(0, np.uint64), np.zeros((1, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    scores = rng.normal(size=(7, 2))
    gamma, both, log = model.posteriors(scores, np.array([0, 4, 4, 7]), pairs=True)
    pair_total = np.zeros((2, 2))
    for a, b in ((0, 4), (4, 7)):
        weights = {}
        for code in range(2 ** (b - a)):
            y = [code >> i & 1 for i in range(b - a)]
            s = model.initial[y[0]] + sum(scores[a + i, k] for i, k in enumerate(y)) + sum(model.transition[p, q] for p, q in zip(y, y[1:]))
            weights[tuple(y)] = np.exp(s)
        z = sum(weights.values())
        for i in range(b - a):
            assert gamma[a + i, 1] == pytest.approx(sum(w for y, w in weights.items() if y[i]) / z)
        assert log[a:b].sum() == pytest.approx(np.log(z))
        for y, w in weights.items():
            for p, q in zip(y, y[1:]):
                pair_total[p, q] += w / z
    assert both == pytest.approx(pair_total)


def test_code_switching_changes_labels(sample):
    rows = [r for r in sample.collect() if r["lang"] in ("en", "de") and len(r["text"]) > 200]
    model = crf.train([r["text"] for r in rows], [r["lang"] for r in rows])
    en, de = (next(r["text"] for r in rows if r["lang"] == x)[:600] for x in ("en", "de"))
    words = crf.featurize([f"{en} {de}"])
    gamma = model.posteriors(model.scores(words), words.by_text)[0]
    labels = [model.labels[k] for k in gamma.argmax(axis=1)]
    half = len(crf.featurize([en]).at)
    assert np.mean([x == "en" for x in labels[:half]]) > 0.9 and np.mean([x == "de" for x in labels[half:]]) > 0.9


def test_short_runs_are_labelled(sample):
    """Runs of a few words of another language are found, after training on whole texts and spliced runs."""
    rows = [r for r in sample.collect() if r["lang"] in ("en", "de") and len(r["text"]) > 200]
    model = crf.train([r["text"] for r in rows[10:]], [r["lang"] for r in rows[10:]])
    en, de = ([w for r in rows[:10] if r["lang"] == x for w in r["text"].split()] for x in ("en", "de"))
    pieces = [(" ".join((de if i % 2 else en)[i * 5 : i * 5 + 5]), "de" if i % 2 else "en") for i in range(12)]
    truth = [lang for text, lang in pieces for _ in crf.featurize([text]).at]
    words = crf.featurize([" ".join(t for t, _ in pieces)])
    gamma = model.posteriors(model.scores(words), words.by_text)[0]
    assert np.mean([model.labels[k] == t for k, t in zip(gamma.argmax(axis=1), truth)]) > 0.85
    _, counts = model.label_words([" ".join(t for t, _ in pieces)])
    assert counts.sum() == len(truth) and counts.min() >= 0.3 * len(truth)


def test_blocks_of_a_chain():
    """A chain cut into blocks has the posteriors of one that is not."""
    rng = np.random.default_rng(2)
    model = crf.Model(["a", "b", "c"], np.zeros((1 << crf.BITS, 3)), np.zeros(0, np.uint64), np.zeros((1, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    scores, by_text = rng.normal(size=(500, 3)) * 3, np.array([0, 0, 130, 131, 400, 500])
    for x, y in zip(model.posteriors(scores, by_text, True, block=7), model.posteriors(scores, by_text, True)):
        assert x == pytest.approx(y)


def test_gradients_by_finite_differences():
    rng = np.random.default_rng(4)
    texts = ["der hund und the dog", "the dog and die katze", "le chat"]
    codes = np.unique(crf.featurize(texts).codes)
    model = crf.Model(["a", "b"], rng.normal(size=(1 << crf.BITS, 2)) * 0.1, codes[:3], rng.normal(size=(4, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    sequences = [[("der hund und", 0), ("the dog", 1)], [("the dog and", 1), ("die katze", 0)], [("", 0)], [("le chat", 0)]]
    _, words, grads = crf.gradients(model, sequences)
    assert words == 12
    for name, grad in grads.items():
        table = getattr(model, name)
        for place in [tuple(p) for p in np.argwhere(grad)[:6]]:
            old, found = table[place], []
            for step in (1e-5, -1e-5):
                table[place] = old + step
                found.append(crf.gradients(model, sequences)[0])
            table[place] = old
            assert (found[0] - found[1]) / 2e-5 == pytest.approx(grad[place], abs=1e-5)


def test_only_letters_have_a_language(spark, sample):
    texts = ["½ ² Ⅷ", "123 --- !!", "a½", "日本", None]
    rows = crf.identify(spark.createDataFrame([(i, t, "x", 1.0) for i, t in enumerate(texts)], "doc_id long, text string, lang_pred string, score double"), crf.fit(sample)).collect()
    assert [r["lang_pred"] == "und" for r in sorted(rows)] == [True, True, False, False, True]


def test_language_edges(spark, docs, no_docs, keyless):
    model = crf.fit(docs)
    rows = {r["doc_id"]: r for r in crf.identify(docs, model).collect()}
    assert all((r["lang_pred"] == "und") == (r["doc_id"] in (0, 1, 2)) for r in rows.values())
    assert rows[0]["score"] == 0
    assert crf.identify(no_docs, crf.fit(no_docs)).count() == 0
    assert {r["lang_pred"] for r in crf.identify(keyless, crf.fit(no_docs)).collect()} == {"und"}


# -- GIF


@pytest.mark.parametrize("least", [2, 4, 8])
def test_lzw_round_trip(least):
    rng = random.Random(least)
    frames = [bytes(rng.randrange(1 << least) if rng.random() < p else 1 for _ in range(n)) for n in (0, 1, 2, 576, 9000, 60000) for p in (0.0, 0.3, 1.0)]
    for samples, stream in zip(frames, gif.pack_codes([gif.lzw_codes(f, least) for f in frames], least)):
        assert gif.lzw_decode(stream, least, len(samples)) == samples


def _gif(frames, width=2, height=2, colours=((0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255))):
    import struct

    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0x81, 0, 0), bytes(c for x in colours for c in x)]
    for left, top, w, h, pixels, disposal, hidden, interlaced in frames:
        out += [b"\x21\xf9\x04", struct.pack("<BHB", disposal << 2 | (hidden is not None), 5, hidden or 0), b"\0"]
        stream = gif.pack_codes([gif.lzw_codes(bytes(pixels), 2)], 2)[0]
        out += [b"\x2c", struct.pack("<HHHHB", left, top, w, h, 0x40 if interlaced else 0), b"\x02", bytes([len(stream)]), stream, b"\0"]
    return b"".join([*out, b";"])


def test_disposal_and_transparency():
    frames = list(gif.decode_gif(_gif([(0, 0, 2, 2, [1, 1, 1, 1], 1, None, False), (1, 0, 1, 2, [2, 0], 2, 0, False), (0, 0, 1, 1, [3], 3, None, False), (0, 1, 1, 1, [2], 0, None, False)])))
    shown = [[tuple(p) for p in f.canvas.reshape(-1, 4).tolist()] for f in frames]
    red, green, blue, none = (255, 0, 0, 255), (0, 255, 0, 255), (0, 0, 255, 255), (0, 0, 0, 0)
    assert shown == [[red] * 4, [red, green, red, red], [blue, none, red, none], [red, none, green, none]]
    assert [f.delay_ms for f in frames] == [50] * 4 and [f.transparent for f in frames] == [False, True, False, False]


def test_damaged_frames_are_errors(spark):
    """A code stream with too few samples, and a sample that the palette doesn't have, are told, not painted over."""
    good = _gif([(0, 0, 2, 2, [1, 0, 1, 0], 0, None, False)])
    short = _gif([(0, 0, 2, 2, [1, 0, 1], 0, None, False)])
    two_colours = lambda data: data[:10] + b"\x80" + data[11:19] + data[25:]
    beyond = two_colours(_gif([(0, 0, 2, 2, [1, 0, 3, 0], 0, None, False)]))
    rows = [(i, bytearray(x)) for i, x in enumerate((good, two_colours(good), short, beyond))]
    found = gif.read_media(spark.createDataFrame(rows, "doc long, media binary")).orderBy("doc").collect()
    assert [r["error"] for r in found] == [None, None, "a frame with too few samples", "a sample beyond the palette"]
    assert [len(r["frames"]) for r in found] == [1, 1, 0, 0] and bytes(found[0]["payload"]) == b"\1\0\1\0"
    stored = gif.store_texts(spark.createDataFrame([(1, "some text")], "doc_id long, text string")).first()["media"]
    at = bytes(stored).index(b"\x2c\0\0\0\0") + 11  # the first block of the first frame's codes
    cut = bytes(stored)[:at] + b"\3" + bytes(stored)[at + 1 : at + 4] + b"\0;"
    (r,) = gif.read_media(spark.createDataFrame([(1, bytearray(cut))], "doc long, media binary")).collect()
    assert r["error"] == "a frame with too few samples"


def test_interlaced_rows():
    pixels = [[r % 4] * 2 for r in range(16)]
    order = [*range(0, 16, 8), *range(4, 16, 8), *range(2, 16, 4), *range(1, 16, 2)]
    (frame,) = gif.decode_gif(_gif([(0, 0, 2, 16, [x for r in order for x in pixels[r]], 0, None, True)], 2, 16))
    assert frame.indices.tolist() == pixels


# The bytes of a published sample image, ten by ten pixels of four colours.
SAMPLE_GIF = "4749463839610a000a00910000ffffffff00000000ff00000021f90400000000002c000000000a000a000002168c2d99872a1cdc33a00275ec95faa8de608c04914c01003b"


def slow_lzw(stream: bytes, least: int) -> list[int]:
    """A decoder of its own: one bit and one code at a time."""
    bits = [byte >> i & 1 for byte in stream for i in range(8)]
    clear, at, out, width, table, previous = 1 << least, 0, [], least + 1, {}, None
    while at + width <= len(bits):
        code = sum(bits[at + i] << i for i in range(width))
        at += width
        if code == clear:
            table, width, previous = {i: [i] for i in range(clear)} | {clear: [], clear + 1: []}, least + 1, None
        elif code == clear + 1:
            break
        else:
            entry = table[code] if code in table else previous + previous[:1]
            if previous is not None and len(table) < 4096:
                table[len(table)] = previous + entry[:1]
                if len(table) == 1 << width and width < 12:
                    width += 1
            out += entry
            previous = entry
    return out


def test_a_published_image():
    (frame,) = gif.decode_gif(bytes.fromhex(SAMPLE_GIF))
    top, edge, low = [1] * 5 + [2] * 5, [1] * 3 + [0] * 4 + [2] * 3, [2] * 3 + [0] * 4 + [1] * 3
    assert frame.indices.tolist() == [top] * 3 + [edge] * 2 + [low] * 2 + [top[::-1]] * 3
    assert frame.canvas[0, 0].tolist() == [255, 0, 0, 255] and frame.canvas[9, 0].tolist() == [0, 0, 255, 255]


def test_streams_decode_elsewhere():
    rng = random.Random(9)
    for n in (1, 576, 5000, 30000):
        samples = bytes(rng.randrange(256) if rng.random() < 0.4 else 7 for _ in range(n))
        assert bytes(slow_lzw(gif.pack_codes([gif.lzw_codes(samples)])[0], 8)) == samples


def test_media_columns_are_replaced(spark):
    given = gif.store_texts(spark.createDataFrame([(1, "abc")], "doc_id long, text string")).selectExpr("*", "1 AS payload", "2 AS frames", "3 AS histogram", "4 AS error", "5 AS other")
    (row,) = gif.read_media(given).select("payload", "frames", "histogram", "error", "other", "doc").collect()
    assert bytes(row["payload"][:3]) == b"abc" and row["other"] == 5 and row["error"] is None


def test_media_keeps_every_byte(docs, no_docs, keyless, spark):
    media = gif.read_media(gif.store_texts(docs)).collect()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    for r in media:
        raw = texts[r["doc"]]
        assert r["payload"][: len(raw)] == raw and set(r["payload"][len(raw) :]) <= {255} and len(r["payload"]) % 576 == 0 and len(r["payload"]) > 0
        assert len(r["frames"]) == len(r["payload"]) // 576 and sum(r["histogram"]) == len(r["payload"]) and r["n_bytes"] == len(raw) and r["error"] is None
        assert [f["start_ms"] for f in r["frames"]] == [40 * i for i in range(len(r["frames"]))]
    assert gif.read_media(gif.store_texts(no_docs)).count() == 0 and gif.read_media(gif.store_texts(keyless)).count() == 5
    bad = spark.createDataFrame([(1, bytearray(b"GIF89a")), (2, bytearray(b"no")), (3, None)], "doc long, media binary")
    assert [r["error"] is None for r in gif.read_media(bad).orderBy("doc").collect()] == [False, False, True]


# -- quality rules


def brute_rules(rows, min_documents=20, max_share=0.005, max_documents=10_000):
    normal = lambda line: re.sub("[0-9]", "0", " ".join(WORDS(line)).lower())
    holders, hosts = {}, Counter()
    for i, r in enumerate(rows):
        hosts[r["source"]] += 1
        for line in (r["text"] or "").split("\n"):
            if WORDS(line):
                holders.setdefault((r["source"], normal(line)), set()).add(i)
    out = []
    for r in rows:
        text = r["text"] or ""
        words = WORDS(text)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        count, covered = Counter(windows), set()
        for i, w in enumerate(windows):
            if count[w] > 1:
                covered |= {i, i + 1, i + 2}
        lines = [x for x in text.split("\n") if WORDS(x)]
        removed = sum(len(WORDS(x)) for x in lines if len(holders[r["source"], normal(x)]) > min(max(min_documents, max_share * hosts[r["source"]]), max_documents))
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        over = lambda x: bool(WORDS(x)) and len(holders[r["source"], normal(x)]) > min(max(min_documents, max_share * hosts[r["source"]]), max_documents)
        left = None if r["text"] is None else "\n".join(x for x in text.split("\n") if not over(x))
        out.append((r["doc_id"], len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed, not failed and len(words) - removed >= 0.5 * len(words), removed, left))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words", "kept_text")


@pytest.mark.parametrize("limits", [{}, {"min_documents": 2, "max_share": 0.1}, {"min_documents": 2, "max_share": 0.5, "max_documents": 4}])
def test_line_rules(docs, limits):
    assert sorted((tuple(r[c] for c in COLUMNS) for r in line_rules(docs, **limits).collect()), key=repr) == brute_rules(docs.collect(), **limits)


def test_common_lines_are_removed(spark):
    shared = "Subscribe to our list 2024"
    letters = lambda k: "".join("abcdefghij"[int(x)] for x in str(k))
    rows = [(i, f"{shared}\n" + " ".join(f"{letters(i)}x{letters(j)}" for j in range(60 if i % 2 else 5)) + f"\n{shared.upper()}", "h") for i in range(60)]
    found = line_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_words=5).collect()
    assert all(shared.lower() not in r["kept_text"].lower() and r["kept_text"].count("x") in (5, 60) for r in found)
    assert {r["removed_words"] for r in found} == {10} and all(r["kept"] == bool(r["doc_id"] % 2) for r in found)


def test_line_rules_edges(no_docs, keyless):
    assert line_rules(no_docs).count() == 0
    assert [r["kept"] for r in line_rules(keyless).collect()].count(False) == 3


# -- licences


def brute_license(text):
    text, best, units = text or "", None, 0
    known, single = ls.known_bigrams(ls.TEMPLATES)
    normal = lambda t: re.sub(r"[^\w]+|_+", " ", t.lower()).split()
    grams = lambda words: {f"{a} {b}" for a, b in zip(words, words[1:])}
    lines = [normal(x) for x in text.split("\n")]
    all_units, run, broken = [grams(x) for x in lines], [], False
    most = 2 * (max(ls.size_bounds(len(set(ls.bigrams(t))), 0.8)[1] for t in ls.TEMPLATES.values()) + 1)
    for words in [*lines, None]:
        own = grams(words or [])
        if words is not None and (not words or (words[0] in single if len(words) == 1 else 2 * len(own & set(known)) >= len(own))):
            run.append(words)
            continue
        broken |= words is not None
        parts = []
        for before, line in zip([[], *run], run):
            if line:
                parts = [*parts[:-1], [*parts[-1], line]] if before else [*parts, [line]]
        flat = lambda some: [w for p in some for line in p for w in line]
        if sum(map(len, parts)) > 1:
            all_units.append(grams(flat(parts)))
            for a in range(len(parts)):
                for b in range(a + 1, len(parts) + 1):
                    if b - a < len(parts) and sum(map(len, parts[a:b])) > 1 and len(flat(parts[a:b])) <= most:
                        all_units.append(grams(flat(parts[a:b])))
        run = []
    if broken and len(lines) > 1:
        all_units.append(grams([x for w in lines for x in w]))
    for own in all_units:
        top = None
        for name, template in ls.TEMPLATES.items():
            other = set(ls.bigrams(template))
            if own:
                dice = 2.0 * len(own & other) / (len(own) + len(other))
                if dice >= 0.8 and (top is None or (dice, name) > top):
                    top = (dice, name)
        if top:
            units += 1
            best = max(best or top, top)
    return best[1] if best else None, best[0] if best else None, units


def test_license_scan(spark, sample, docs, no_docs, keyless):
    extra = [(900 + i, f"some words\n{t}\nmore words here" if i % 2 else t) for i, t in enumerate(ls.TEMPLATES.values())]
    extra += [(990, "Licensed under the Apache License, Version 3.0."), (991, "released UNDER the -- mit license"), (992, ls.TEMPLATES["mit-grant"][:-40])]
    for df in (sample.select("doc_id", "text"), docs, spark.createDataFrame(extra, "doc_id long, text string")):
        for r in ls.license_scan(df).collect():
            name, dice, units = brute_license(r["text"])
            assert (r["license"], r["license_units"]) == (name, units) and (r["dice"] == pytest.approx(dice) if dice else r["dice"] is None)
    assert ls.license_scan(no_docs).count() == 0 and ls.license_scan(keyless).count() == 5


def test_license_at_the_threshold(spark):
    """Scores of exactly 0.8 at the least and largest size that can reach it."""
    lines = ("Copyright. All rights reserved.", "All rights reserved 2024", "Released under the MIT License by Acme")
    for r in ls.license_scan(spark.createDataFrame([(x,) for x in lines], "text string")).collect():
        assert (r["license"], r["dice"], r["license_units"]) == brute_license(r["text"]) and r["dice"] == 0.8
    for n in range(1, 200):
        own = [m for m in range(1, 400) if 2.0 * min(n, m) / (n + m) >= 0.8]
        assert ls.size_bounds(n, 0.8) == (own[0], own[-1])


def test_wrapped_licences_in_long_documents(spark):
    """A licence wrapped into a comment is found among lines of code."""
    import textwrap

    code, rows = [f"value{i} = compute(item{i}, {i})" for i in range(60)], []
    for name in ("mit-text", "bsd-3-clause-text", "apache-2.0-header", "gpl-notice", "isc-text", "zlib-text"):
        for width, mark in ((78, ""), (60, "# "), (72, " * ")):
            body = [mark + x for x in textwrap.wrap(ls.TEMPLATES[name], width)]
            rows.append((name, "\n".join([f"{mark}Copyright 2024 Someone Else", mark.rstrip(), *body[:3], mark.rstrip(), *body[3:], "", *code])))
    for row in ls.license_scan(spark.createDataFrame(rows, "name string, text string")).collect():
        assert row["license"] == row["name"] and row["dice"] > 0.9
        assert (row["license"], row["dice"], row["license_units"]) == brute_license(row["text"])


@pytest.mark.parametrize("mark", ["", "# "])
def test_licences_side_by_side(spark, mark):
    """Two whole licences with a blank line between are both found, in any order."""
    import textwrap

    wrapped = {n: "\n".join(mark + x for x in textwrap.wrap(ls.TEMPLATES[n], 78)) for n in ("mit-text", "bsd-3-clause-text", "isc-text", "gpl-notice", "apache-2.0-header")}
    rows = [(a, b, f"{x}\n{mark.rstrip()}\n{y}") for a, x in wrapped.items() for b, y in wrapped.items() if a != b]
    rows += [(a, "", f"{x}\n\n{x}\n\n\n{x}") for a, x in wrapped.items()]
    for r in ls.license_scan(spark.createDataFrame(rows, "a string, b string, text string")).collect():
        assert r["license"] in (r["a"], r["b"]) and r["dice"] == 1.0 and r["license_units"] >= 2
        assert (r["license"], r["dice"], r["license_units"]) == brute_license(r["text"])


def test_license_columns_are_replaced(spark):
    given = spark.createDataFrame([("All rights reserved.", "x", 1, "y", "z")], "text string, license string, _m int, _lines string, other string")
    (row,) = ls.license_scan(given).collect()
    assert row.asDict() == {"text": "All rights reserved.", "license": "proprietary", "dice": 1.0, "license_units": 1, "other": "z"}


def test_license_scan_is_native_and_narrow(docs):
    plan = ls.license_scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange") <= 1  # that of the fixture


# -- pipeline


def test_pipeline(spark, sample, tmp_path):
    docs, kept = sample, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == sample.columns
    rules = {r[0]: r[9] for r in brute_rules(sample.collect()) if r[7]}
    assert {r["doc_id"]: r["text"] for r in kept["quality rules"].collect()} == rules
    assert all(r["n_chars"] == len(r["text"]) for r in kept["quality rules"].collect())
    from tests.llm.test_repeats import brute_join, brute_words

    left = [(r["doc_id"], r["text"]) for r in kept["quality rules"].collect()]
    one = {d for d, *_, root in brute_join(left) if d == root}
    assert {r["doc_id"] for r in kept["n-gram jaccard join"].collect()} == one
    cut = {d: text for d, _, n, text in brute_words([x for x in left if x[0] in one], 35) if n}
    for r in kept["substring dedup"].collect():
        assert r["text"] == cut.get(r["doc_id"], dict(left)[r["doc_id"]]) and r["n_chars"] == len(r["text"])
    final = corpus_pipeline.run(spark, SF)
    assert sorted(final.collect()) == sorted(kept["mixture packing"].collect())
    tokens = {(r["doc"], r["n_tokens"]): 0 for r in corpus_pipeline.document_tokens(before).collect()}
    for r in final.collect():
        tokens[r["doc_id"], r["doc_tokens"]] += r["length"]
    copies = Counter(r["doc_id"] for r in before.collect())
    assert all(n == size * copies[d] for (d, size), n in tokens.items())


@pytest.mark.parametrize("repeated", ["keyless", "docs"])
def test_stages_go_by_row(spark, request, repeated):
    """Null and repeated ids: no stage loses a document or multiplies rows."""
    from tests.llm.test_repeats import brute_join

    given = request.getfixturevalue(repeated).withColumn("n_chars", F.col("n_chars").cast("long"))
    rows = given.collect()
    stages = {name: [tuple(r) for r in stage(spark, given, SF).collect()] for name, stage in corpus_pipeline.STAGES[:4]}
    own = lambda r: (r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"])
    kept = Counter(own(r) for r, b in ((r, brute_rules([r])[0]) for r in rows) if b[7])
    assert Counter(stages["quality rules"]) == kept
    roots = {root for *_, root in brute_join([(i, r["text"]) for i, r in enumerate(rows)])}
    assert len(stages["n-gram jaccard join"]) == len(roots)
    assert not Counter(stages["n-gram jaccard join"]) - Counter(map(own, rows))
    assert len(stages["substring dedup"]) <= len(rows)
    sizes = Counter(r["doc_id"] for r in rows)
    assert all(n <= 2 * sizes[d] for d, n in Counter(r[0] for r in stages["entropy mixing"]).items())


def test_rejected_and_repeated_rows(spark):
    """A rejected row takes none of its id along; a row that occurs twice stays once; a unique one without an id stays."""
    long = lambda k: " ".join(f"{k}w{'abcdefghij'[i % 10]}x{i}" for i in range(80))
    rows = [(None, "too short", "en", "a", 9), (None, long("p"), "en", "a", 1), (7, long("q"), "en", "b", 1), (7, long("q"), "en", "b", 1), (8, "short", "en", "b", 5), (8, long("r"), "en", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, SF)
    assert Counter((r["doc_id"], r["text"]) for r in docs.collect()) == Counter([(None, long("p")), (7, long("q")), (8, long("r"))])
