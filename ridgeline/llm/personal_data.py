"""Personal data by weak supervision: labelers vote on spans, EM weighs them, a classifier decides.

Four kinds of span are known. Base patterns find the certain ones, which always stay. Wider patterns
propose more: addresses spelled with (at) and (dot), addresses of version 6, card numbers with other
separators or lengths, phone numbers without a plus. Nobody labels these spans. Instead regular
expressions, gazetteers and context labelers vote yes, no or nothing on every span, and

1. the votes of the whole corpus are counted by (kind, votes), a table whose size is bounded by the
   number of labelers; expectation-maximisation estimates from it how reliable every labeler is and
   how likely every combination of votes is right;
2. these likelihoods label the spans; a logistic regression learns them from the shape of a span and
   the characters and words around it, from counts by pattern, again a bounded table;
3. a proposed span is added where the classifier gives it at least 1/2.

Texts are read once, in a narrow stage whose stored result holds spans only. Counts and sums are
whole numbers, so the model doesn't depend on the order of rows. All scans are linear in the text.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.cluster import stored
from ridgeline.llm.common import by_bytes

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

# -- base patterns. Repeats are possessive where what follows can't match a part of them.

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_domain = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++").match
_numeric = re.compile(r"[0-9(][0-9 ().-]*+").finditer
_ip = re.compile(r"[0-9]++(?:(\.[0-9]++)(\.[0-9]++)(\.[0-9]+))?")
_card = re.compile(r"[0-9](?:[ -]?[0-9])++")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").finditer
_digits = re.compile("[0-9]").findall

# -- wide patterns
_wide_phone = re.compile(r"\(?[0-9](?:[ ().-]{0,2}[0-9])++")
_wide_card = re.compile(r"[0-9](?:[ .-]{0,2}[0-9])++")
_wide_ip = re.compile(r":[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,6}+").finditer
_wide_at = re.compile(r"[\[({] ?(?:at|AT|@|arroba) ?[\])}] ?").finditer
_wide_host = re.compile(r"[A-Za-z0-9-]++(?: ?(?:\.|[\[({] ?(?:dot|DOT|punkt|point|punto) ?[\])}]) ?[A-Za-z0-9-]++)++").match
_HEX = "0123456789ABCDEFabcdef"

# Gazetteers and cue words of the labelers.
TOP_DOMAINS = frozenset("com org net edu gov info io de fr es uk eu at ch it nl be pt us ca mx br ar".split())
COUNTRY_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 354 358 380 420 421 971 972".split())
CUES = (
    frozenset("email mail e-mail correo courriel contact kontakt contacto write schreiben".split()),
    frozenset("ip host server address ipv4 ipv6 dirección adresse login".split()),
    frozenset("card visa mastercard amex credit karte kreditkarte carte tarjeta payment pan".split()),
    frozenset("phone tel telephone call mobile cell fax telefon handy téléphone teléfono móvil whatsapp".split()),
)
ANTI_CUES = frozenset("token key secret version isbn issn doi order invoice hash id sku serial build commit page pages year license lizenz licencia".split())


def luhn(digits: str) -> bool:
    """Whether a string of digits passes the Luhn check."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _emails(text: str) -> Iterator[tuple[int, int]]:
    low, at = 0, text.find("@")
    while at >= 0:
        start = low + len(text[low:at].rstrip(_LOCAL))
        host = _domain(text, at + 1) if start < at else None
        if host:
            yield start, host.end()
        low = host.end() if host else at + 1
        at = text.find("@", low)


def _numbers(text: str) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) of base addresses and cards, in order within each kind."""
    for segment in _numeric(text):
        if segment.end() - segment.start() < 7:
            continue
        for m in _ip.finditer(text, segment.start(), segment.end()):
            if m[1] and all(_small(p) for p in m[0].split(".")):
                yield IP, m.start(), m.end()
        for m in _card.finditer(text, segment.start(), segment.end()):
            if 14 <= m.end() - m.start() <= 37:
                digits = "".join(_digits(m[0]))
                if 14 <= len(digits) <= 19 and luhn(digits):
                    yield CARD, m.start(), m.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the certain spans, in order; leftmost matches of each kind, failing ones dropped."""
    found = [(s, EMAIL, e) for s, e in _emails(text)] + [(s, k, e) for k, s, e in _numbers(text)]
    found += [(m.start(), PHONE, m.end()) for m in _phone(text) if m.end() - m.start() >= 11 and 10 <= len(_digits(m[0])) <= 15]
    return sorted(found)


def wide_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of proposed spans, none of which touches a base span."""
    found = []
    for m in _wide_at(text):
        low = max(0, m.start() - 65)
        before = text[low : m.start()].rstrip(" ")
        name = len(before) - len(before.rstrip(_LOCAL))
        host = _wide_host(text, m.end())
        if name and host:
            found.append((low + len(before) - name, EMAIL, host.end()))
    for m in _wide_ip(text):
        head = text[max(0, m.start() - 4) : m.start()]
        found.append((m.start() - len(head) + len(head.rstrip(_HEX)), IP, m.end()))
    for segment in _numeric(text):
        if segment.end() - segment.start() < 7:
            continue
        for kind, pattern, least, most in ((CARD, _wide_card, 12, 19), (PHONE, _wide_phone, 7, 15)):
            for m in pattern.finditer(text, segment.start(), segment.end()):
                if least <= m.end() - m.start() <= 3 * most and least <= len(_digits(m[0])) <= most:
                    found.append((m.start(), kind, m.end()))
    starts, ends = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max, initial=0))
    return [s for s in sorted(found) if ends[bisect_left(starts, s[2])] <= s[0]]


# -- labelers: votes of 1 (yes), -1 (no) or 0 on a span

LABELERS = ("base", "shape", "check", "gazetteer", "cue", "anti_cue", "border")
_word = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_shapes = (
    re.compile(r"[^\[({]*[\[({].*[\])}].*\.?.*", re.S),
    re.compile(r"(?:[1-9]?[0-9]{1,2}\.){3}[1-9]?[0-9]{1,2}|[0-9A-Fa-f:]{15,}"),
    re.compile(r"[0-9]{4}([ .-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ .-]?)[0-9]{6}\2[0-9]{5}"),
    re.compile(r"\+.*|\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,5}", re.S),
)


def _gazetteer(kind: int, span: str, digits: str) -> int:
    if kind == EMAIL:
        return 1 if re.split(r"[^A-Za-z]+", span.lower().rstrip(")]} "))[-1] in TOP_DOMAINS else -1
    if kind == IP:
        return 0 if ":" in span else 1 if 1 <= int(span.split(".")[0][-3:]) <= 223 else -1
    if kind == CARD:
        return 1 if digits[0] in "3456" and digits[:2] not in ("32", "33", "61") else -1
    if span[0] == "+":
        return 1 if any(digits[:n] in COUNTRY_CODES for n in (1, 2, 3)) else -1
    return 1 if digits[0] == "0" or (len(digits) == 10 and digits[0] in "23456789") else 0


def votes(kind: int, base: bool, text: str, start: int, end: int, before: list[str]) -> tuple[int, ...]:
    """Each labeler's vote; ``before`` lists the lower-case words in the 40 characters before the span."""
    span = text[start:end]
    digits = "".join(_digits(span))
    if kind == CARD:
        check = 1 if luhn(digits) else -1
    elif kind == PHONE:
        check = 1 if 10 <= len(digits) <= 13 else -1
    elif kind == IP:
        check = 1 if span.count(":") in (0, 7) else -1
    else:
        check = 0
    beside = text[start - 1 : start] + text[end : end + 1] if start else text[end : end + 1]
    return (
        1 if base else 0,
        1 if _shapes[kind].fullmatch(span) else -1,
        check,
        _gazetteer(kind, span, digits),
        1 if any(w in CUES[kind] for w in before) else 0,
        -1 if any(w in ANTI_CUES for w in before) else 0,
        -1 if any(c.isalnum() or c in "_=#" for c in beside) else 0,
    )


# -- features of the classifier: small codes, one pattern number a span

_SIZES = (8, 6, 6, 6, 8, 3)  # digits, separators, character before, character after, word before, check
PATTERNS = len(KINDS) * int(np.prod(_SIZES))


def _side(c: str) -> int:
    return 0 if not c else 1 if c == " " else 2 if c.isspace() else 3 if c.isalpha() else 4 if c.isdigit() else 5


def features(kind: int, text: str, start: int, end: int, before: list[str], check: int) -> int:
    """Number of the span's pattern: kind, digits, separators, characters beside it, the word before it, the check's vote."""
    span = text[start:end]
    kinds = [c in span for c in " -.()"][:4]
    separators = 0 if not any(kinds) else 5 if sum(kinds) > 1 else 1 + kinds.index(True)
    word = 0 if not before else 1 + hashlib.blake2b(before[-1].encode(), digest_size=2).digest()[0] % 7
    codes = (min(7, len(_digits(span)) // 3), separators, _side(text[start - 1 : start] if start else ""), _side(text[end : end + 1]), word, check + 1)
    number = kind
    for size, code in zip(_SIZES, codes):
        number = number * size + code
    return number


def _design(patterns: np.ndarray) -> np.ndarray:
    """Columns of ones per pattern: a bias and one a feature value, each of the span's kind."""
    rest, columns = patterns.copy(), []
    for size in reversed(_SIZES):
        columns.append(rest % size)
        rest //= size
    base, width, out = 1, 1 + sum(_SIZES), [rest * (1 + sum(_SIZES))]
    for size, code in zip(_SIZES, reversed(columns)):
        out.append(rest * width + base + code)
        base += size
    return np.stack(out, axis=1)


@dataclass
class Model:
    """prior [kind], reliability [kind, class, labeler, vote + 1], weights of the classifier."""

    prior: np.ndarray
    reliability: np.ndarray
    weights: np.ndarray

    def likelihood(self, kind: np.ndarray, vote: np.ndarray) -> np.ndarray:
        """Probability that spans with these votes [n, labelers] are right."""
        logs = np.log(self.reliability)[kind[:, None], :, np.arange(vote.shape[1]), vote + 1].sum(axis=1)
        odds = logs[:, 1] - logs[:, 0] + np.log(self.prior[kind]) - np.log1p(-self.prior[kind])
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))

    def probability(self, patterns: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.weights[_design(patterns)].sum(axis=1)))


#: Pseudo-votes that hold a labeler to "better than chance" until the corpus says otherwise.
PRIOR_VOTES = 4.0


def aggregate_votes(kind: np.ndarray, vote: np.ndarray, count: np.ndarray, rounds: int = 50) -> Model:
    """EM over counted votes: each labeler's chances of its votes on right and on wrong spans, by kind."""
    held = np.zeros((2, 3))
    held[1] = PRIOR_VOTES * np.array([0.1, 0.5, 0.4])
    held[0] = PRIOR_VOTES * np.array([0.4, 0.5, 0.1])
    right = 1 / (1 + np.exp(-1.5 * vote.sum(axis=1)))  # votes counted alike, to begin with
    model = Model(np.full(len(KINDS), 0.5), np.zeros((len(KINDS), 2, vote.shape[1], 3)), np.zeros(0))
    for _ in range(rounds):
        for k in range(len(KINDS)):
            own = kind == k
            both = np.stack([(1 - right[own]) * count[own], right[own] * count[own]])
            model.prior[k] = (both[1].sum() + 1) / (both.sum() + 2)
            for v in range(3):
                model.reliability[k, :, :, v] = both @ (vote[own] == v - 1) + held[:, v, None]
        model.reliability /= model.reliability.sum(axis=3, keepdims=True)
        right = model.likelihood(kind, vote)
    return model


def train(patterns: np.ndarray, count: np.ndarray, right: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Weights of the regression by accelerated gradients; ``right`` is the expected number of right spans of ``count``."""
    width = len(KINDS) * (1 + sum(_SIZES))
    weights = ahead = np.zeros(width)
    columns, total = _design(patterns), max(1.0, float(count.sum()))
    for i in range(rounds):
        p = 1 / (1 + np.exp(-ahead[columns].sum(axis=1)))
        step = np.bincount(columns.ravel(), np.repeat(right - p * count, columns.shape[1]), width) - 0.5 * ahead
        new = ahead + step / (0.25 * columns.shape[1] * total + 0.5)
        weights, ahead = new, new + i / (i + 3) * (new - weights)
    return weights


# -- jobs

_SPAN = "array<struct<kind: int, start: int, end: int, votes: int, pattern: int, base: boolean>>"
_STRUCT = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("votes", pa.int32()), ("pattern", pa.int32()), ("base", pa.bool_())])


def spans_of(text: str) -> list[dict]:
    """Base and proposed spans of a text with their votes (in base 3) and patterns."""
    base = base_spans(text)
    out = []
    for sure, spans in ((True, base), (False, wide_spans(text, base))):
        for start, kind, end in spans:
            before = [w.lower() for w in _word.findall(text, max(0, start - 40), start)]
            cast = votes(kind, sure, text, start, end, before)
            code = 0
            for v in cast:
                code = code * 3 + v + 1
            pattern = features(kind, text, start, end, before, cast[LABELERS.index("check")])
            out.append({"kind": kind, "start": start, "end": end, "votes": code, "pattern": pattern, "base": sure})
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in by_bytes([batch]):
            spans = [spans_of(t or "") for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(spans, pa.list_(_STRUCT))], names=["doc", "spans"])


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc and its ``spans``, stored; null texts have none."""
    found = docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).mapInArrow(_scan, f"doc long, spans {_SPAN}")
    return stored(found, "spans")


def fit(scanned: DataFrame) -> Model:
    """Labeler reliabilities and the classifier, from all spans of the corpus.

    At most 4 * 3**7 rows of votes and ``PATTERNS`` rows of patterns reach the driver.
    """
    spans = scanned.select(F.explode("spans").alias("s")).select("s.*")
    counted = spans.groupBy("kind", "votes").agg(F.count("*").alias("n")).orderBy("kind", "votes").collect()
    kind, code, n = (np.array([r[c] for r in counted], np.int64) for c in ("kind", "votes", "n"))
    vote = np.stack([code // 3**i % 3 - 1 for i in range(len(LABELERS) - 1, -1, -1)], axis=1) if len(code) else np.zeros((0, len(LABELERS)), np.int64)
    model = aggregate_votes(kind, vote, n.astype(float))
    # whole millionths, so that sums don't depend on their order
    chance = [int(x) for x in np.round(model.likelihood(kind, vote) * 1e6)]
    table = scanned.sparkSession.createDataFrame(list(zip(kind.tolist(), code.tolist(), chance)), "kind int, votes int, chance long")
    by_pattern = spans.join(F.broadcast(table), ["kind", "votes"]).groupBy("pattern").agg(F.count("*").alias("n"), F.sum("chance").alias("right")).orderBy("pattern").collect()
    pattern, n, right = (np.array([r[c] for r in by_pattern], np.int64) for c in ("pattern", "n", "right"))
    model.weights = train(pattern, n.astype(float), right / 1e6)
    return model


def _spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def chosen(spans: list[dict], probability: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind, end) of base spans and of added ones: likely, and best where several overlap."""
    out = [(s["start"], s["kind"], s["end"]) for s in spans if s["base"]]
    last = -1
    likely = [(s["start"], -probability[s["pattern"]], s["kind"], s["end"]) for s in spans if not s["base"] and probability[s["pattern"]] >= 0.5]
    for start, _, kind, end in sorted(likely):
        if start >= last:
            out.append((start, kind, end))
            last = end
    return sorted(out)


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc, n_email, n_ip, n_card, n_phone (base spans), base (text), spans (text), added (count).

    ``base`` and ``spans`` list kind:start:end, in code points, end exclusive, by start, then kind; spans are
    the base ones and those that the classifier adds. Added spans touch no base span and not each other.
    Null and empty texts have no spans. Keys may be null or repeat; each row is a document. Columns
    besides key and text are ignored. An empty table gives an empty table.
    """
    scanned = scan(docs, key, text)
    probability = fit(scanned).probability(np.arange(PATTERNS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, base, every, added = [[] for _ in KINDS], [], [], []
            for spans in batch.column("spans").to_pylist():
                sure = sorted((s["start"], s["kind"], s["end"]) for s in spans if s["base"])
                final = chosen(spans, probability)
                for k, out in enumerate(counts):
                    out.append(sum(s[1] == k for s in sure))
                base.append(_spell(sure))
                every.append(_spell(final))
                added.append(len(final) - len(sure))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), *[pa.array(x, pa.int64()) for x in counts], pa.array(base, pa.string()), pa.array(every, pa.string()), pa.array(added, pa.int64())],
                names=["doc", *[f"n_{k}" for k in KINDS], "base", "spans", "added"],
            )

    return scanned.mapInArrow(run, "doc long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string, added long")
