"""Mixture-controlled packing: deficit round-robin over source queues into fixed token windows.

Documents of a source form a queue in seeded order, each as its token ids and an end id. Every
window takes from each queue its share of the target mixture; fractions that a window can't hold
stay as deficits and are paid in the next ones. Deficits are exact: the queues are the leaves of a
tree, light ones deep, and each node merges its two sides by the rounded multiple of their weights, so
how much of a queue the first p tokens hold is one whole-number product and quotient a level. No
share is too small for that. It makes the round-robin, which is sequential by nature, a lookup that
each partition answers for its own documents, with deficits carried across windows and partitions.
When a queue runs dry, the others share by weight.

The driver holds one number a source and phase, no rows; there are few phases where there are many sources.
"""

from __future__ import annotations

import base64
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.cluster import stored
from ridgeline.llm.common import RANK_BUCKETS, by_bytes, null_safe, running_total

WINDOW = 1024
END_ID = 0
#: A run of white space of this length goes to the tokenizer file's reader: the ranks file's one
#: backtracks over it and gives up at about a million characters.
SPACE_RUN = 50_000


#: Tokens of all queues, and weights in all, must stay below this.
MOST = 1 << 46
#: Numbers of a schedule: it has at most so many phases times queues, but 8 phases always.
PHASE_NUMBERS = 80_000
#: Windows and tokens that are placed at a time.
PLACES = 1 << 20


def muldiv(a: np.ndarray, b: np.ndarray, c: np.ndarray, add: np.ndarray | int = 0) -> np.ndarray:
    """floor((a * b + add) / c) of whole numbers 0 <= a, b, c < 2**46 and any add of that size, without overflow."""
    turns, rest = np.divmod(a, c)
    down, add = np.divmod(add, c)
    out, left = np.zeros_like(rest), np.zeros_like(rest)
    for shift in (32, 16, 0):
        up, left = np.divmod((left << 16) + rest * (b >> shift & 0xFFFF), c)
        out = (out << 16) + up
    return turns * b + out + down + (left + add) // c


def tree(weights: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(parent, side) of the nodes of a tree over the queues, which are its first nodes: the two lightest nodes are
    joined first, so no inner node outweighs its sibling by more than two to one. side 1: the right child."""
    heap = [(w, i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    parent, side = np.full(2 * len(weights) - 1, -1), np.zeros(2 * len(weights) - 1, np.int64)
    for node in range(len(weights), 2 * len(weights) - 1):
        (v, left), (w, right) = heapq.heappop(heap), heapq.heappop(heap)
        parent[[left, right]], side[right] = node, 1
        heapq.heappush(heap, (v + w, node))
    return parent, side


class Paths:
    """The way from the root to every queue in one phase: per level the weights of the node and of its left child, and the
    side; short ways end in levels that change nothing."""

    def __init__(self, weights: np.ndarray, parent: np.ndarray, side: np.ndarray):
        k = len(weights)
        total = np.append(weights, np.zeros(k - 1, np.int64))
        for node in range(2 * k - 2):  # children come before their parents
            total[parent[node]] += total[node]
        ways, at = [], np.arange(k)
        while (parent[at] >= 0).any():
            up = np.where(parent[at] >= 0, parent[at], at)
            moved = up != at
            own = np.where(side[at] == 1, total[up] - total[at], total[at])
            ways.append((np.where(moved, total[up], 1), np.where(moved, own, 1), np.where(moved, side[at], 0)))
            at = up
        # a way that is shorter than others is padded at its start, where weights of 1 of 1 change nothing
        self.total, self.left, self.side = (np.array([w[i] for w in reversed(ways)], np.int64).reshape(len(ways), k) for i in range(3))

    def counts(self, queue: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of the queue, tokens of the queues before it) among the first p."""
        before = np.zeros_like(p)
        for total, left, side in zip(self.total, self.left, self.side):
            w = total[queue]
            low = muldiv(p, left[queue], np.maximum(w, 1), w // 2)
            right = side[queue] == 1
            before, p = before + np.where(right, low, 0), np.where(right, p - low, low)
        return p, before

    def upto(self, queue: np.ndarray, i: np.ndarray) -> np.ndarray:
        """The least p of which i >= 1 tokens are the queue's."""
        for total, left, side in zip(self.total[::-1], self.left[::-1], self.side[::-1]):
            w, own, right = total[queue], left[queue], side[queue] == 1
            half, rest = w // 2, np.maximum(w - own, 1)
            own = np.maximum(own, 1)
            i = np.where(right, muldiv(i - 1, w, rest, half) + 1, muldiv(i, w, own, own - 1 - half))
        return i


class Schedule:
    """Where every token of every queue goes. A phase begins where queues run dry: ``start`` (tokens placed before), ``base``
    (tokens of each queue before), ``weights`` (0 for dry queues). The last phase takes what is left in proportion, so all of it ends together."""

    def __init__(self, tokens: list[int], weights: list[int] | None = None, window: int = WINDOW):
        self.window, self.tokens = window, np.array(tokens, np.int64)
        wanted = self.tokens if weights is None else np.maximum(np.array(weights, np.int64), 1)
        if sum(map(int, tokens)) >= MOST or sum(map(int, wanted)) >= MOST:
            raise ValueError("2**46 or more tokens, or weights in all")
        self.parent, self.side = tree([int(w) for w in wanted]) if len(tokens) else (np.zeros(0, np.int64),) * 2
        self.start, self.base, self.weights, self._paths = [], [], [], {}
        base, start, every = np.zeros_like(self.tokens), 0, np.arange(len(tokens))
        most = max(8, PHASE_NUMBERS // max(1, len(tokens)))
        while (base < self.tokens).any():
            left = self.tokens - base
            last = len(self.start) == most - 1
            own = left if last else np.where(left > 0, wanted, 0)
            self.start.append(start)
            self.base.append(base)
            self.weights.append(own)
            live = every[left > 0]
            ways = self.paths(len(self.start) - 1)
            length = int(left.sum()) if weights is None or last or len(live) == 1 else int(ways.upto(live, left[live]).min())
            taken = ways.counts(every, np.full(len(every), length))[0] if len(live) > 1 else left
            base, start = base + np.where(left > 0, taken, 0), start + length
        self.end = start

    def paths(self, phase: int) -> Paths:
        if phase not in self._paths:
            self._paths[phase] = Paths(self.weights[phase], self.parent, self.side)
        return self._paths[phase]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_paths": {}}

    def place(self, queue: np.ndarray, begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Pieces of the stretches [begin, end) of queues: (stretch, first token in the queue, length, window, place in the window)."""
        whole = np.maximum(1, -(-(end - begin) // PLACES))  # longer stretches are placed in parts
        of = np.repeat(np.arange(len(queue)), whole)
        begin = begin[of] + PLACES * (np.arange(len(of)) - np.repeat(np.cumsum(whole) - whole, whole))
        queue, end = queue[of], np.minimum(begin + PLACES, end[of])
        for phase, start in enumerate(self.start):
            base = self.base[phase][queue]
            after = self.base[phase + 1] if phase + 1 < len(self.base) else self.tokens
            stop = self.start[phase + 1] if phase + 1 < len(self.start) else self.end
            low, high = np.maximum(begin, base) - base, np.minimum(end, after[queue]) - base
            for own in self._parts(np.flatnonzero(low < high), high - low):
                yield from self._placed(self.paths(phase), start, stop, of[own], queue[own], low[own], high[own], base[own])

    @staticmethod
    def _parts(own: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
        upto = np.cumsum(size[own])
        at = 0
        while at < len(own):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PLACES, "right")))
            yield own[at:to]
            at = to

    def _placed(self, ways: Paths, start: int, stop: int, own: np.ndarray, queue: np.ndarray, low: np.ndarray, high: np.ndarray, base: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        first, last = ((start + ways.upto(queue, x) - 1) // self.window for x in (low + 1, high))
        # a stretch has tokens in every window from its first to its last, or in fewer windows than it has tokens
        dense = last - first < high - low
        count = np.where(dense, last - first + 1, high - low)
        which = np.repeat(np.arange(len(own)), count)
        step = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        sparse = ~dense[which]
        w = first[which] + step
        if sparse.any():
            w[sparse] = (start + ways.upto(queue[which[sparse]], low[which[sparse]] + step[sparse] + 1) - 1) // self.window
            keep = np.ones(len(w), bool)
            keep[1:] = (which[1:] != which[:-1]) | (w[1:] != w[:-1])
            which, w = which[keep], w[keep]
        p, q = np.maximum(w * self.window, start) - start, np.minimum((w + 1) * self.window, stop) - start
        (a, before), (b, upto) = ways.counts(queue[which], p), ways.counts(queue[which], q)
        begin, end = np.maximum(low[which], a), np.minimum(high[which], b)
        offset = (start + p) % self.window + upto - before + begin - a
        good = begin < end
        yield tuple(x[good] for x in (own[which], begin + base[which], end - begin, w, offset))


def _ranks(ranks_path: str, pattern: str, specials: dict[str, int]):
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    if max([*ranks.values(), *specials.values()]) >= 1 << 16:
        raise ValueError("ids must fit 16 bits")
    return tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens=specials)


class Encoder:
    """Ids of a byte-level vocabulary that is given twice, as ranks and as a tokenizer file, with equal ids."""

    def __init__(self, tokenizer_path: str, ranks_path: str, pattern: str, specials: dict[str, int]) -> None:
        self.tokenizer_path, self.ranks, self.tokenizer = tokenizer_path, _ranks(ranks_path, pattern, specials), None
        self.long_space = re.compile(r"\s{%d}" % SPACE_RUN).search

    def __call__(self, text: str) -> np.ndarray:
        if len(text) >= SPACE_RUN and self.long_space(text):
            if self.tokenizer is None:
                from tokenizers import Tokenizer

                self.tokenizer = Tokenizer.from_file(self.tokenizer_path)
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.ranks.encode_to_numpy(text, allowed_special="all")


def _tokenize(*vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(*vocabulary)
        for batch in by_bytes(batches):
            table = pa.table(batch)
            ids = [np.append(encode(t or ""), END_ID).astype(np.uint16) for t in table["text"].to_pylist()]
            out = table.drop_columns(["text"]).append_column("n_tokens", pa.array([len(x) for x in ids], pa.int64()))
            yield from out.append_column("ids", pa.array([x.tobytes() for x in ids], pa.binary())).to_batches()

    return run


def token_table(
    docs: DataFrame, tokenizer_path: str, ranks_path: str, pattern: str, specials: dict[str, int], key: str = "doc_id", source: str = "source", text: str = "text"
) -> DataFrame:
    """doc, source, ``row_id``, ``n_tokens`` and ``ids`` (16-bit little-endian, the end id last), stored.

    The other arguments describe a byte-level vocabulary of at most 65,536 ids, as a tokenizer file
    and as ranks, pattern and added tokens; both give the same ids, the ranks several times faster.
    A null or empty text has the end id only. Repeated rows have a row each, an empty table none.
    Columns besides key, source and text are ignored, whatever their names.
    """
    slim = docs.select(F.col(key).alias("doc"), F.col(source).alias("source"), F.col(text).alias("text"))
    tokens = slim.mapInArrow(_tokenize(tokenizer_path, ranks_path, pattern, specials), "doc long, source string, n_tokens long, ids binary")
    return stored(tokens.withColumn("row_id", F.monotonically_increasing_id()), "tokens")


_PIECES = pa.schema([(n, pa.int64()) for n in ("doc", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def _pieces(schedule: Schedule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "ids"):
            doc, ids = batch.column("doc"), batch.column("ids")
            queue, at, n = (np.asarray(batch.column(c), np.int64) for c in ("queue", "at", "n_tokens"))
            texts = [np.frombuffer(x.as_py(), "<u2").astype("<u4") for x in ids]
            for which, first, length, window, offset in schedule.place(queue, at, at + n):
                start = first - at[which]
                crc = [zlib.crc32(texts[i][a:b]) for i, a, b in zip(which.tolist(), start.tolist(), (start + length).tolist())]
                yield pa.RecordBatch.from_arrays([doc.take(pa.array(which)), *map(pa.array, (start, length, np.array(crc, np.int64), n[which], window, offset))], schema=_PIECES)

    return run


def pack_mixture(tokens: DataFrame, weights: dict[str | None, int] | None = None, window: int = WINDOW) -> DataFrame:
    """Pieces of a ``token_table``: doc, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every window but the last is full. weights: target proportions of the sources as whole numbers;
    by default those of the corpus, so all queues end together. A null source is a queue of its own.
    Repeated rows are packed each, null keys stay null. An empty table gives no pieces. A queue runs
    by a hash of key and row id, so rows of one key or without one are spread as all others are.
    Weights are given for every source of the table; the driver holds one number a source and phase. A
    queue's part of any stretch of windows is within four tokens of its target, whatever its share, until
    a queue runs dry; mixtures of more than 280 sources are held to for 8 or more such phases,
    after which what is left is taken in proportion. There may be 2**46 tokens.
    """
    totals = tokens.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()  # one row a source
    totals.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    order = [r["source"] for r in totals]
    if weights is not None and (missing := [s for s in order if s not in weights]):
        raise ValueError(f"no weight for the sources {missing}")
    schedule = Schedule([r["n"] for r in totals], None if weights is None else [weights[s] for s in order], window)
    slim = tokens.select("row_id", "doc", "source", "n_tokens").withColumn("h", F.xxhash64("doc", "row_id"))
    slim = slim.withColumn("bucket", F.pmod("h", F.lit(RANK_BUCKETS)).cast("int"))
    placed = running_total(slim, ["source"], "bucket", ["h", "doc", "row_id"], "n_tokens", "at")
    if order:
        queues = tokens.sparkSession.createDataFrame([(s, i) for i, s in enumerate(order)], "source string, queue int")
        placed = null_safe(placed, queues, ["source"])  # one row a source
    else:
        placed = placed.withColumn("queue", F.lit(0))
    joined = placed.select("row_id", "queue", "at").join(tokens.select("row_id", "doc", "n_tokens", "ids"), "row_id")
    return joined.mapInArrow(_pieces(schedule), "doc long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
