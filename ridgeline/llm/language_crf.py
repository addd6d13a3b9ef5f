"""Word-level language identification by a linear-chain conditional random field.

Each word is an observation, its language a state. State features are affixes (n-grams that touch a
word's edge), inner n-grams and a lexicon of frequent words; transitions between languages are
learned, so a run of foreign words inside a text can switch and switch back. Training maximises the
conditional likelihood (forward-backward, AdaGrad) on a bounded, documented sample of labelled rows,
and on sequences spliced from runs of words of those rows, from which the transitions learn how
often code-switched text changes its language. Prediction runs forward-backward over every whole
text and labels each word by its posterior; a text's language is that with the largest mean posterior.

Features are hashed from bytes and summed with array operations over a slice of texts at a time;
the chains of a slice advance in step. Chains are cut into blocks that advance together: a block's
transfer matrix tells what reaches the next one. The model is a few MB and ships with the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm import units
from ridgeline.llm.common import by_bytes

#: Most labelled rows that training takes, the least by seeded hash, and the longest of them in
#: bytes; together they bound what reaches the driver.
TRAIN_ROWS, TRAIN_BYTES = 1200, 1 << 16
#: Spliced sequences for each training text, and the most words of a run in them.
SPLICES, RUN = 0.25, 12
#: Words of a block of a chain.
BLOCK = 1024
LEXICON = 4096
BITS = 16
EPOCHS = 3
BATCH = 64
UNKNOWN = "und"

_U = np.uint64
_letter = regex.compile(r"\p{L}").search
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(0x80, 256)]] = True
_EDGE = 1


@dataclass
class Words:
    """Hashed features of the words of some texts."""

    grams: np.ndarray  # feature of every n-gram, words one after another
    at: np.ndarray  # first n-gram of each word
    affixes: np.ndarray  # two a word: four units at its start, and at its end
    codes: np.ndarray  # of whole words
    by_text: np.ndarray  # offsets of the texts' words


def _bucket(code: np.ndarray, kind: int) -> np.ndarray:
    return (((code << _U(4)) | _U(kind)) * _U(0x9E3779B97F4A7C15) >> _U(64 - BITS)).astype(np.int64)


def featurize(texts: list[str]) -> Words:
    """Words are runs of ASCII letters and non-ASCII bytes of the lower-cased text."""
    raw = [t.lower().encode() for t in texts]
    offsets = np.append(0, np.cumsum([len(r) for r in raw])).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    marked = np.where(_INSIDE[data], data, np.uint8(0x20))
    codes, start, end, by_text = units.words(marked, offsets)
    n = len(start)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, none.reshape(0, 2), codes, by_text)
    length = end - start
    size = length + 2
    begin = np.cumsum(size) - size
    padded = np.full(int(size.sum()) + 3, _EDGE, _U)
    inner = np.arange(int(length.sum())) + np.repeat(2 * np.arange(n) + 1, length)
    padded[inner] = marked[marked != 0x20]
    two = padded[:-1] << _U(8) | padded[1:]
    three = two[:-1] << _U(8) | padded[2:]
    four = three[:-1] << _U(8) | padded[3:]
    # word i has size - 1 bigrams and size - 2 trigrams, side by side
    per = 2 * size - 3
    at = np.cumsum(per) - per
    grams = np.empty(int(per.sum()), np.int64)
    k2, k3 = size - 1, size - 2
    local2 = np.arange(int(k2.sum())) - np.repeat(np.cumsum(k2) - k2, k2)
    local3 = np.arange(int(k3.sum())) - np.repeat(np.cumsum(k3) - k3, k3)
    grams[np.repeat(at, k2) + local2] = _bucket(two[np.repeat(begin, k2) + local2], 2)
    grams[np.repeat(at + k2, k3) + local3] = _bucket(three[np.repeat(begin, k3) + local3], 3)
    affixes = np.stack((_bucket(four[begin], 4), _bucket(four[np.maximum(begin, begin + size - 4)], 5)), axis=1)
    return Words(grams, at, affixes, codes, by_text)


def _in_step(size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For runs of these sizes that advance together, the longest first: (runs longer than t, rows before step t, rank of each run)."""
    order = np.argsort(-size, kind="stable")
    rank = np.empty(len(size), np.int64)
    rank[order] = np.arange(len(size))
    live = np.searchsorted(-size[order], -np.arange(int(size.max()) if len(size) else 0), "left")
    return live, np.append(0, np.cumsum(live)), rank


def _transfers(local: np.ndarray, begin: np.ndarray, size: np.ndarray, part: np.ndarray, move: np.ndarray) -> np.ndarray:
    """For each of some blocks, the matrix that takes what enters it to what stands at its last word, up to a factor."""
    n, (live, off, rank) = len(move), _in_step(size[part])
    inner = np.arange(int(size[part].sum())) - np.repeat(np.cumsum(size[part]) - size[part], size[part])
    here = np.empty((len(inner), n))
    here[off[inner] + np.repeat(rank, size[part])] = local[np.repeat(begin[part], size[part]) + inner]
    found = np.eye(n) * here[: live[0]][:, None, :]
    for t, m in enumerate(live[1:], 1):
        step = (found[:m].reshape(-1, n) @ move).reshape(m, n, n) * here[off[t] : off[t] + m][:, None, :]
        if t % 8 == 0:
            step /= (step.reshape(m, -1) @ np.ones(n * n))[:, None, None]
        found[:m] = step
    return found[rank]


@dataclass
class Model:
    labels: list[str]
    state: np.ndarray  # hashed feature, label
    lexicon: np.ndarray  # sorted codes of frequent words
    words: np.ndarray  # lexicon entry (the last: none), label
    transition: np.ndarray
    initial: np.ndarray

    def entries(self, codes: np.ndarray) -> np.ndarray:
        place = np.searchsorted(self.lexicon, codes)
        known = (place < len(self.lexicon)) & (self.lexicon[np.minimum(place, len(self.lexicon) - 1)] == codes) if len(self.lexicon) else np.zeros(len(codes), bool)
        return np.where(known, place, len(self.lexicon))

    def scores(self, w: Words) -> np.ndarray:
        if not len(w.at):
            return np.zeros((0, len(self.labels)))
        total = np.stack([np.add.reduceat(self.state[:, k][w.grams], w.at) for k in range(len(self.labels))], axis=1)
        return total + self.state[w.affixes].sum(axis=1) + self.words[self.entries(w.codes)]

    def posteriors(self, scores: np.ndarray, by_text: np.ndarray, pairs: bool = False, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        """(posterior of every word, summed posterior of neighbouring labels, log-likelihood scale of every word)."""
        n, length = scores.shape[1], np.diff(by_text)
        blocks = -(-length // block)
        text = np.repeat(np.arange(len(length)), blocks)
        number = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        size = np.minimum(length[text] - number * block, block)
        shift = scores.max(axis=1, keepdims=True) if len(scores) else scores
        local, move, one = np.exp(scores - shift), np.exp(self.transition), np.ones(n)
        # what enters each block from the left, and what leaves it to the right
        entry, leave = np.tile(np.exp(self.initial), (len(text), 1)), np.ones((len(text), n))
        part = np.flatnonzero(blocks[text] > 1)
        if len(part):
            transfer = dict(zip(part.tolist(), _transfers(local, by_text[:-1][text] + number * block, size, part, move)))
            for k in part[number[part] > 0]:
                through = entry[k - 1] @ transfer[k - 1]
                entry[k] = through / through.sum() @ move
            for k in part[number[part] > 0][::-1]:
                back = move @ (transfer[k] @ leave[k])
                leave[k - 1] = back / back.sum()
        # one row a word, by place in the block and then by block, the longest first: a step is a slice
        live, off, rank = _in_step(size)
        at = off[np.arange(len(scores)) - np.repeat(np.cumsum(size) - size, size)] + np.repeat(rank, size)
        here, alpha, beta, scale = np.empty_like(local), np.empty_like(local), np.empty_like(local), np.ones(len(scores))
        here[at] = local
        came = np.empty_like(entry)
        came[rank] = entry
        for t, m in enumerate(live):
            own = slice(off[t], off[t] + m)
            a = here[own] * (came if t == 0 else alpha[off[t - 1] : off[t - 1] + m] @ move)
            scale[own] = a @ one
            alpha[own] = a / scale[own, None]
        last = off[size - 1] + rank
        beta[last] = leave / (alpha[last] * leave).sum(axis=1, keepdims=True)
        for t in range(len(live) - 2, -1, -1):
            ahead = slice(off[t + 1], off[t + 1] + live[t + 1])
            beta[off[t] : off[t] + live[t + 1]] = (here[ahead] * beta[ahead] / scale[ahead, None]) @ move.T
        both = None
        if pairs:
            inner = np.ones(len(scores), bool)
            inner[by_text[1:][length > 0] - 1] = False
            left, right = at[:-1][inner[:-1]], at[1:][inner[:-1]]
            both = alpha[left].T @ (here[right] * beta[right] / scale[right][:, None]) * move
        return (alpha * beta)[at], both, np.log(scale[at]) + (shift[:, 0] if len(scores) else 0)

    def label_words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(mean posterior of each label over the words of each text, number of words of each label)."""
        w = featurize(texts)
        n = len(self.labels)
        gamma = self.posteriors(self.scores(w), w.by_text)[0]
        owner = np.repeat(np.arange(len(texts)), np.diff(w.by_text))
        sums = np.stack([np.bincount(owner, gamma[:, k], len(texts)) for k in range(n)], axis=1)
        words = np.bincount(owner * n + gamma.argmax(axis=1), minlength=len(texts) * n).reshape(-1, n)
        return sums / np.maximum(np.diff(w.by_text), 1)[:, None], words


def splice(texts: list[str], labels: np.ndarray, count: int, seed: int) -> list[list[tuple[str, int]]]:
    """Code-switched sequences: runs of words from texts of different labels, taken in turn at random."""
    rng = np.random.Generator(np.random.PCG64(seed))
    words = [t.split() for t in texts]
    pools = [p for k in range(int(labels.max()) + 1) if (p := [i for i in np.flatnonzero(labels == k) if words[i]])]
    found: list[list[tuple[str, int]]] = []
    while len(pools) > 1 and len(found) < count:
        sequence, pool = [], -1
        for _ in range(int(rng.integers(2, 7))):
            pool = int(rng.choice([k for k in range(len(pools)) if k != pool]))
            i = pools[pool][int(rng.integers(len(pools[pool])))]
            start, run = int(rng.integers(len(words[i]))), int(rng.integers(1, RUN + 1))
            sequence.append((" ".join(words[i][start : start + run]), int(labels[i])))
        found.append(sequence)
    return found


def gradients(model: Model, sequences: list[list[tuple[str, int]]]) -> tuple[float, int, dict[str, np.ndarray]]:
    """(log-likelihood, words, its gradients) of sequences of (run of words, label)."""
    n = len(model.labels)
    w = featurize([t for s in sequences for t, _ in s])
    by_sequence = w.by_text[np.append(0, np.cumsum([len(s) for s in sequences]))]
    label = np.repeat(np.array([k for s in sequences for _, k in s], np.int64), np.diff(w.by_text))
    scores = model.scores(w)
    gamma, both, log = model.posteriors(scores, by_sequence, pairs=True)
    error = -gamma
    error[np.arange(len(label)), label] += 1
    first = by_sequence[:-1][np.diff(by_sequence) > 0]
    inner = np.ones(len(label), bool)
    inner[first] = False
    steps = np.bincount(label[:-1][inner[1:]] * n + label[1:][inner[1:]], minlength=n * n).reshape(n, n)
    likelihood = scores[np.arange(len(label)), label].sum() + model.initial[label[first]].sum() + (steps * model.transition).sum() - log.sum()
    per = np.diff(np.append(w.at, len(w.grams)))
    entries = model.entries(w.codes)
    return float(likelihood), len(label), {
        "state": np.stack([np.bincount(w.grams, np.repeat(error[:, k], per), 1 << BITS) + np.bincount(w.affixes.ravel(), np.repeat(error[:, k], 2), 1 << BITS) for k in range(n)], axis=1),
        "words": np.stack([np.bincount(entries, error[:, k], len(model.lexicon) + 1) for k in range(n)], axis=1),
        "transition": steps - both,
        "initial": error[first].sum(axis=0),
    }


def train(texts: list[str], langs: list[str], epochs: int = EPOCHS, rate: float = 0.3, lexicon: int = LEXICON, splices: float = SPLICES, seed: int = 3) -> Model:
    """Fits a model. The words of a text carry its label, those of a spliced sequence the labels of
    their runs. With one label or none, that label always wins."""
    labels = sorted(set(langs))
    n = len(labels)
    codes, counts = np.unique(featurize(texts).codes, return_counts=True)
    frequent = np.sort(codes[np.lexsort((codes, -counts))[:lexicon]])
    model = Model(labels, np.zeros((1 << BITS, n)), frequent, np.zeros((len(frequent) + 1, n)), np.zeros((n, n)), np.zeros(n))
    if n < 2:
        return model
    squares = {k: np.full_like(getattr(model, k), 1e-2) for k in ("state", "words", "transition", "initial")}
    rng = np.random.Generator(np.random.PCG64(seed))
    truth = np.array([labels.index(x) for x in langs])
    sequences = [[(t, int(k))] for t, k in zip(texts, truth)] + splice(texts, truth, int(splices * len(texts)), seed)
    for _ in range(epochs):
        order = rng.permutation(len(sequences))
        for b in range(0, len(order), BATCH):
            _, size, grads = gradients(model, [sequences[i] for i in order[b : b + BATCH]])
            for k, g in grads.items() if size else ():
                g = g / size - 1e-7 * getattr(model, k)
                squares[k] += g * g * 1e4
                getattr(model, k)[...] += rate * g * 1e2 / np.sqrt(squares[k])
    return model


def held_out(key: Column) -> Column:
    """True for the fold that never trains: crc32 of the key as text is a multiple of 5."""
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = TRAIN_ROWS, longest: int = TRAIN_BYTES) -> Model:
    """Trains on at most ``rows`` labelled rows of ``docs`` outside the held-out fold, of at most
    ``longest`` bytes each: those of the least seeded hash of the key. Rows without key, label or
    text don't train. Without any, the model has no label and finds none."""
    labelled = docs.where(F.col(lang).isNotNull() & ~held_out(F.col(key)))
    # rows of a least hash that a few times the wanted number are expected below: what reaches the
    # driver follows neither the rows nor the partitions of the table
    share = min(1.0, 4 * rows / max(labelled.count(), 1))
    most = int(-(2**63) + share * (2**64 - 1))
    hashed = labelled.where(F.octet_length(text) <= longest).select(F.col(text).alias("t"), F.col(lang).alias("l"), F.xxhash64(F.lit(11), key).alias("h"), F.col(key).alias("k"))
    sample = hashed.where(F.col("h") <= F.lit(min(most, 2**63 - 1))).orderBy("h", "k", "t").limit(rows).collect()
    return train([r["t"] for r in sample], [r["l"] for r in sample])


def _predict(model: Model, key: str):
    kinds = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            known = np.array([bool(model.labels) and _letter(t) is not None for t in texts])
            mean, words = model.label_words(texts) if model.labels else (np.zeros((len(texts), 1)), np.zeros((len(texts), 0), int))
            found = [model.labels[k] if x else UNKNOWN for k, x in zip(mean.argmax(axis=1), known)]
            score = np.where(known, np.clip(mean.max(axis=1), 0, 1), 0.0)
            counts = [[{"lang": model.labels[k], "words": w} for k, w in enumerate(row) if w] if x else [] for row, x in zip(words.tolist(), known)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, pa.string()), pa.array(score), pa.array(counts, kinds)], names=[key, "lang_pred", "score", "words"])

    return run


def identify(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: key, ``lang_pred``, ``score`` (mean posterior of its words), ``words``.

    words: how many words have which language, array<struct<lang, words>> by language; text that
    switches has several. Null texts and texts without a letter (Unicode category L) give ``und``, 0
    and no words. Equal languages go to the first by name. Only the text is read: other columns are
    ignored, whatever their names. Repeated rows have a row each, equal texts equal values; a null
    key stays null; an empty table stays empty. A task holds one long text, or a few MB of others.
    """
    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = slim.schema["key"].dataType.simpleString()
    return slim.mapInArrow(_predict(model, key), f"`{key}` {kind}, lang_pred string, score double, words array<struct<lang: string, words: long>>")
