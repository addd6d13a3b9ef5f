"""Operators 11 to 13: conversation repair, centroid clusters, personal data."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest

from ridgeline.llm import centroids as cc
from ridgeline.llm import personal_data as pii
from ridgeline.llm import queries, repair
from tests.conftest import SF

# -- conversations

NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
CONVERSATIONS = "conv_id long, turn long, role string, text string, cost double, audit int"


def damaged(rows):
    for conv, turn, role, text in rows:
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if code == 1 else " " if text is None else text
        text = re.sub("[.!?]", "", text) if code == 2 else text
        role = "user" if code == 4 else " " if role is None else role
        yield from [(conv, turn, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)


def cheapest(rows, faults):
    """(cost, audit, repaired rows) by a search over edit strings in order of cost, then text."""
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, q, out = heapq.heappop(heap)
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == len(rows) and q in ("", "a"):
            return cost, audit, out
        moves = [(role, NEXT[q].get(role[0])) for role in ("user", "assistant")]
        for role, to in moves:
            if to:
                heapq.heappush(heap, (cost + 3, audit + "I", i, to, (*out, f"{role}:")))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, q, out))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                if to := NEXT[q].get(role[:1]):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, to, (*out, f"{role}:{text}")))
                for role, to in moves:
                    if to:
                        heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, to, (*out, f"{role}:{text}")))


def brute_repair(rows):
    by = {conv: [] for conv, *_ in rows}
    for conv, *row in damaged(rows):
        by[conv].append(tuple(row))
    out = {}
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns, seen, faults = [r[0] for r in own if r[0] is not None], set(), []
        for _, role, text in own:
            inside = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not inside else "duplicate" if (role, text) in seen else "truncated" if inside[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[1][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, fixed = cheapest([r[1:] for r in own], faults)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(fixed).encode()).hexdigest())
    return out


def repaired(df, **limits):
    columns = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    rows = repair.damaged_and_repaired(df, **limits).collect()
    assert len({r["conv"] for r in rows}) == len(rows)
    return {r["conv"]: tuple(r[c] for c in columns) for r in rows}


def conversations(spark, seed=3, convs=120):
    """Null ids, turns, roles and texts, ties, repeated rows, other roles, columns named as results."""
    rng, rows = random.Random(seed), []
    for conv in [None, *range(convs)]:
        n = rng.choice([1, 2, 3, 5, 8, 20, 40])
        for _ in range(n):
            role = rng.choice(["user", "user", "assistant", "assistant", "system", "tool", "", None, "ux"])
            rows.append((conv, rng.choice([None, *range(n + 3)]), role, rng.choice(["Hi.", "ok", "", None, " \t", "yes!", "b? ", "日本。", "so.\n"])))
    return rows, spark.createDataFrame([(*r, 1.0, 2) for r in rows], CONVERSATIONS).repartition(3)


@pytest.mark.parametrize("long", [8192, 3])
def test_repair(spark, long):
    rows, df = conversations(spark)
    assert repaired(df, long=long) == brute_repair(rows)


def test_repair_of_the_sample(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    assert repaired(df) == brute_repair([tuple(r) for r in df.collect()])


def test_a_conversation_of_many_rows(spark):
    """A third of all rows in one conversation, one row repeated without end, a text of a megabyte."""
    rng = random.Random(8)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"t{rng.randrange(900)}.") for t in range(3000)] + [(1, 7, "user", "same.")] * 2000
    rows += [(None, None, "user", "same.")] * 500 + [(2, 0, "user", "x" * 1_000_000 + "."), (2, 1, "assistant", "y.")]
    df = spark.createDataFrame([(*r, 0.0, 0) for r in rows], CONVERSATIONS).repartition(4)
    assert repaired(df, long=400) == brute_repair(rows)


def test_repair_of_an_empty_table(spark):
    assert repaired(spark.createDataFrame([], CONVERSATIONS)) == {}


def test_all_rows_dropped(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    found = repaired(spark.createDataFrame([(gone, 0, "user", "Hi.", 0.0, 0)], CONVERSATIONS))
    assert found == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


# -- clusters


def brute_clusters(rows, k, rounds, width):
    kept = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[i]) for x in zip(*groups[i])] if i in groups else c for i, c in enumerate(centroids)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = {}
    for _, c, d in found:
        inertia[c] = inertia.get(c, 0) + d
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), centroids[c]) for i, c, d in found), key=repr)


VECTORS = "vec_id long, embedding array<float>, cluster string, inertia double"


def clusters(df, **options):
    return sorted((tuple(r) for r in cc.centroid_clusters(df, **options).collect()), key=repr)


def vectors(seed=1, n=150, width=12):
    """Null ids, components and vectors, wrong lengths, infinities, repeated rows and ties."""
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.integers(-3, 4, width) / 256).tolist()) for i in range(n)] + [(i, rng.normal(size=width).tolist()) for i in range(n, 2 * n)]
    rows += [(900, None), (901, []), (902, [0.5] * (width - 1)), (903, [0.5] * (width - 1) + [None]), (904, [float("nan")] * width), (905, [float("inf")] * width)]
    return rows + [(None, [0.25] * width), (None, [0.5] * width), rows[3], rows[3], (3, [0.75] * width), (3, [-0.75] * width)]


def test_clusters(spark):
    rows = vectors()
    df = spark.createDataFrame([(*r, "x", 0.0) for r in rows], VECTORS).repartition(5)
    assert clusters(df, k=9, rounds=4, width=12) == brute_clusters(rows, 9, 4, 12)


def test_fewer_vectors_than_centroids(spark):
    rows = vectors()[:3]
    assert clusters(spark.createDataFrame([(*r, "x", 0.0) for r in rows], VECTORS), k=9, width=12) == brute_clusters(rows, 9, 5, 12)
    assert clusters(spark.createDataFrame([], VECTORS)) == []
    assert clusters(spark.createDataFrame([(1, None, "x", 0.0)], VECTORS)) == []


def test_search_finishes_what_it_must():
    """Partial distances give the full search's result, ties included, for any block and order."""
    rng = np.random.default_rng(4)
    x, c = rng.integers(-2, 3, (400, 10)), rng.integers(-2, 3, (30, 10))
    full = np.square(x[:, None] - c[None]).sum(axis=2)
    for block in (1, 3, 10, 64):
        best, distance = cc.assign(x, c, rng.permutation(10), block)
        assert (best == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()


def test_dimensions_run_from_high_to_low_variance(spark):
    df = spark.createDataFrame([(i, [1, i, -3 * i, 5]) for i in range(20)], "vec long, vector array<int>")
    assert cc._variance_order(df, 4).tolist() == [2, 1, 0, 3]


def test_components_beyond_the_bound_are_an_error(spark):
    with pytest.raises(Exception, match="exceed 64 bits"):
        clusters(spark.createDataFrame([(1, [1e30] * 64, "x", 0.0)], VECTORS))


# -- personal data

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def brute_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
            good = (True, all(int(p) <= 255 for p in m[0].split(".")) if kind == 1 else False, 14 <= len(digits) <= 19 and doubled % 10 == 0, 10 <= len(digits) <= 15)
            if good[kind]:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans():
    rng = random.Random(1)
    parts = "a|b.|@|c.d|.|-|+|1|23|255|256|4111111111111111|4111 1111 1111 1111|(|)| |é|+49|555-1234|1.2.3.4|%|_x|\n|378282246310005|日|[at]|[dot]|:|fe80::1|0001.2.3.255".split("|")
    for _ in range(20000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == brute_spans(text), text
        wide = pii.wide_spans(text, pii.base_spans(text))
        assert all(e <= start or f <= s for start, _, f in wide for s, _, e in pii.base_spans(text))


@pytest.mark.parametrize("text", ["a" * 2_000_000 + "@", "1" * 2_000_000, "1 " * 1_000_000, "(" * 2_000_000, "@" * 1_000_000, "+1 " * 500_000, "x.y" * 700_000 + "@b"])
def test_scans_are_linear(text):
    pii.spans_of(text)


def test_em_finds_the_reliable_labelers():
    rng = np.random.default_rng(2)
    truth = rng.random(4000) < 0.3
    right = np.array([0.95, 0.9, 0.8, 0.55])
    cast = np.where(rng.random((4000, 4)) < right, np.where(truth, 1, -1)[:, None], np.where(truth, -1, 1)[:, None])
    rows, n = np.unique(cast, axis=0, return_counts=True)
    model = pii.aggregate_votes(np.zeros(len(rows), np.int64), rows, n.astype(float))
    assert abs(model.prior[0] - 0.3) < 0.03
    assert np.abs(model.reliability[0, 1, :, 2] - right).max() < 0.05 and np.abs(model.reliability[0, 0, :, 0] - right).max() < 0.05


def personal(spark):
    rng = random.Random(6)
    word = lambda n: " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit"]) for _ in range(n))
    local = lambda: f"({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"
    texts = [f"{word(5)} phone +1 {local()} {word(4)}" for _ in range(60)] + [f"{word(3)} call {local()} {word(3)}" for _ in range(40)]
    texts += [f"token {rng.randrange(10**8, 10**9)}x{word(2)}" for _ in range(60)] + [f"{word(3)} mail {rng.choice('abc')}{i}@mail.example.com" for i in range(30)]
    texts += [f"write to j{i} [at] mail [dot] com {word(2)}" for i in range(20)]
    return spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_ip int, spans string").repartition(3)


def test_spans_are_added(spark):
    """Numbers without a plus and spelled addresses are added, identifiers after "token" are not."""
    rows = {r["doc"]: r for r in pii.find_personal_data(personal(spark)).collect()}
    kinds = lambda ids: [x.split(":")[0] for i in ids for x in rows[i]["spans"].split(",") if x and x not in rows[i]["base"].split(",")]
    assert kinds(range(60, 100)).count("phone") >= 36
    assert kinds(range(100, 160)) == []
    assert kinds(range(190, 210)).count("email") >= 16
    again = {r["doc"]: r for r in pii.find_personal_data(personal(spark).repartition(7)).collect()}
    assert again == rows


def test_personal_data(docs, no_docs, keyless, sample):
    assert pii.find_personal_data(no_docs).collect() == []
    assert sorted(r["spans"] for r in pii.find_personal_data(keyless).collect()) == [""] * keyless.count()
    for df in (docs, sample):
        texts = {}
        for r in df.collect():
            texts.setdefault(r["doc_id"], []).append(r["text"] or "")
        for r in pii.find_personal_data(df).collect():
            want = brute_spans(texts[r["doc"]][0])
            assert r["base"] == ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in want)
            assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[1] == i for x in want) for i in range(4)]
            assert set(filter(None, r["base"].split(","))) <= set(r["spans"].split(","))


def test_queries(spark):
    """The queries hold what the operators give, hashes included."""
    row = {r["doc_id"]: r for r in queries.op13_personal_data(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        base = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in brute_spans(r["text"] or ""))
        assert row[r["doc_id"]]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
    want = brute_repair([tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()])
    assert {r["conv_id"]: tuple(r)[1:] for r in queries.op11_conversation_repair(spark, SF).collect()} == want
