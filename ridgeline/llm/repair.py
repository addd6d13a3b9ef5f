"""Conversation structure repair by a time-major tensor DP.

A conversation is repaired if the initials of its roles read ``(s?(ua)+)?``. Four states follow that
pattern: nothing yet, after s, after u, after a. Edits move between them: keep a row (0), rerole it
(3), delete it (4), insert a row without text (3); a truncated row that stays costs 3 more. The
cheapest edits are found for many conversations at once: rows lie in arrays [turn, conversation], a
bucket holds conversations of about one length, and backward costs [turn, conversation, state] are
filled turn by turn for the whole bucket. The trace walks forward over the stored costs, also for
the whole bucket, and takes the ASCII-least of the edits that stay cheapest, so ties have one result.

Rows are shuffled once, by conversation, and sorted inside partitions; a task streams them and holds
the conversations of one batch. Conversations of more than ``LONG`` rows take the same kernel in
blocks of bounded size: each block's costs from every state to every state are a 4 x 4 matrix, the
matrices of a conversation give the costs at the ends of its blocks, and blocks are traced by
themselves from the state that the block before ends in. Only the last step, the hash of a whole
repaired text, is serial; it streams over pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.cluster import stored
from ridgeline.llm.common import WORD, null_safe, running_total

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3

#: Rows of a conversation that are repaired in one piece, and rows of a block of a longer one.
LONG = 8192

#: Array cells (turns x conversations) of a bucket.
CELLS = 1 << 18

# States: 0 nothing yet, 1 after s, 2 after u, 3 after a. Initials: 0 s, 1 u, 2 a, 3 any other.
_FAR = 1 << 60
_NEXT = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])  # [state, initial]
_TO = np.array([2, 2, 3, 2])  # the state after an inserted or reroled row
_ROLE = np.array(["user", "user", "assistant", "user"], object)
_END = np.array([0, 2 * INSERT, INSERT, 0], np.int64)  # inserts that finish the pattern
_D, _I, _K, _R = (ord(x) for x in "DIKR")

EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text after the damage that crc32(conv:turn) % 20 decides; nulls count as one space.

    0 drops a row, 1 empties its text, 2 removes its ``.``, ``!`` and ``?``, 3 repeats it next to itself
    under the same turn, 4 gives it the role user.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(space(conv), F.lit(":"), space(turn)).cast("binary")) % 20
    found = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), space(role).alias("role"), space(text).alias("text"), code.alias("code")).where("code <> 0")
    found = found.withColumns({
        "role": F.when(F.col("code") == 4, "user").otherwise(F.col("role")),
        "text": F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")),
    })
    copies = F.explode(F.array_repeat(F.lit(1), F.when(F.col("code") == 3, 2).otherwise(1)))
    return found.select("conv", "turn", "role", "text", copies.alias("copy")).drop("copy")


def _flags() -> dict[str, Column]:
    """blank: no character but white space; open: the last such character is none of ``.!?``."""
    stripped = F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     "))
    start = F.substring("role", 1, 1)
    return {
        "blank": stripped == "",
        "open": (stripped != "") & ~F.substring(stripped, -1, 1).isin(".", "!", "?"),
        "initial": F.when(start == "s", 0).when(start == "u", 1).when(start == "a", 2).otherwise(3).cast("int"),
    }


# -- kernel: arrays are [turn, conversation]; rows beyond a conversation's length are padding


def backward(initial: np.ndarray, must_go: np.ndarray, truncated: np.ndarray, length: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Least costs [turn + 1, conversation, state] from before each row to the costs ``end`` [conversation, state]."""
    turns, n = initial.shape
    costs = np.empty((turns + 1, n, 4), np.int64)
    costs[turns] = end
    for t in range(turns - 1, -1, -1):
        after = costs[t + 1]
        best = after + DELETE
        stays = np.where(must_go[t], _FAR, TRUNCATED * truncated[t])
        for q in range(4):
            best[:, q] = np.minimum(best[:, q], after[:, _TO[q]] + stays + REROLE)
            to = _NEXT[q, initial[t]]
            best[:, q] = np.minimum(best[:, q], np.where(to >= 0, after[np.arange(n), to] + stays + KEEP, _FAR))
        for _ in range(2):  # inserts before the row; a third one would come back to a state left before
            best = np.minimum(best, best[:, _TO] + INSERT)
        costs[t] = np.where((t < length)[:, None], np.minimum(best, _FAR), end)
    return costs


def trace(costs: np.ndarray, initial: np.ndarray, must_go: np.ndarray, truncated: np.ndarray, length: np.ndarray, state: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edits [step, conversation] as ASCII codes with 0 at the end, states before them, states at the end).

    Each step takes the ASCII-least edit (D, I, K, R) on a cheapest way. Where ``last`` is false, a
    trace ends with its last row: what is inserted there belongs to the next block.
    """
    n = len(length)
    at, state, everyone = np.zeros(n, np.int64), state.copy(), np.arange(n)
    edits, states = [], []
    while True:
        going = at < length
        more = going | (last & (state > 0) & (state < 3))
        if not more.any():
            break
        row = np.minimum(at, np.maximum(length - 1, 0))
        here, after = costs[at, everyone], costs[np.minimum(at + 1, costs.shape[0] - 1), everyone]
        least = np.where(going, here[everyone, state], _END[state])
        to = _TO[state]
        kept = _NEXT[state, initial[row, everyone]]
        stays = np.where(must_go[row, everyone] | ~going, _FAR, TRUNCATED * truncated[row, everyone])
        delete = going & (after[everyone, state] + DELETE == least)
        insert = more & (np.where(going, here[everyone, to], _END[to]) + INSERT == least)
        keep = (kept >= 0) & (after[everyone, kept] + stays + KEEP == least)
        edit = np.select([~more, delete, insert, keep], [0, _D, _I, _K], _R)
        edits.append(edit)
        states.append(state)
        state = np.select([edit == 0, edit == _D, edit == _K], [state, state, kept], to)
        at = at + ((edit != 0) & (edit != _I))
    if not edits:
        return np.zeros((0, n), np.int64), np.zeros((0, n), np.int64), state
    return np.stack(edits), np.stack(states), state


def buckets(length: np.ndarray) -> Iterator[np.ndarray]:
    """Conversations in buckets of about one length, each of at most ``CELLS`` cells (or one conversation)."""
    order = np.argsort(length, kind="stable")
    at = 0
    while at < len(order):
        most = max(1, 2 * int(length[order[at]]))
        to = at + int(np.searchsorted(length[order[at:]], most, "right"))
        to = min(to, at + max(1, CELLS // most))
        yield order[at:to]
        at = to


class _Block:
    """Rows of some conversations, sorted, with the offsets of each conversation."""

    def __init__(self, batch: pa.RecordBatch, offsets: np.ndarray):
        self.offsets, self.length = offsets, np.diff(offsets)
        self.initial, self.blank, self.open = (np.asarray(batch.column(c)) if c == "initial" else batch.column(c).to_numpy(zero_copy_only=False) for c in ("initial", "blank", "open"))
        self.roles, self.texts = batch.column("role"), batch.column("text")

    def cube(self, picked: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
        """The columns as arrays [turn, conversation] of the picked conversations."""
        length = self.length[picked]
        turn = np.arange(max(1, int(length.max(initial=0))))[:, None]
        row = np.where(turn < length, self.offsets[picked] + turn, 0)
        return [c[row] if len(c) else np.zeros(row.shape, c.dtype) for c in columns]

    def duplicates(self) -> np.ndarray:
        """Rows whose role and text stand in an earlier row of their conversation."""
        keys = np.repeat(np.arange(len(self.length)), self.length)
        for column in (self.roles, self.texts):
            code = np.asarray(column.dictionary_encode().indices, np.int64)
            keys = np.unique(keys * (code.max(initial=0) + 1) + code, return_inverse=True)[1]
        out = np.ones(len(keys), bool)
        out[np.unique(keys, return_index=True)[1]] = False
        return out


def _spelled(block: _Block, i: int, edits: np.ndarray, states: np.ndarray) -> list[str]:
    """The rows that conversation i has after its edits, as ``role:text``."""
    lines, row = [], int(block.offsets[i])
    for edit, state in zip(edits.tolist(), states.tolist()):
        if edit == _I:
            lines.append(f"{_ROLE[state]}:")
            continue
        if edit == _K:
            lines.append(f"{block.roles[row].as_py()}:{block.texts[row].as_py()}")
        elif edit == _R:
            lines.append(f"{_ROLE[state]}:{block.texts[row].as_py()}")
        row += 1
    return lines


def _faults(block: _Block, duplicate: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's first fault: blank, then duplicate, then truncated."""
    duplicate = duplicate & ~block.blank
    return block.blank, duplicate, block.open & ~block.blank & ~duplicate


def _per(offsets: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Number of true flags by conversation."""
    return np.diff(np.append(0, np.cumsum(flags))[offsets])


def _illegal(block: _Block) -> np.ndarray:
    """Adjacent pairs by conversation whose initials are not su, ua or au."""
    a, b = block.initial[:-1], block.initial[1:]
    wrong = ~(((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1)))
    inner = np.ones(len(wrong), bool)
    cut = block.offsets[1:-1] - 1
    inner[cut[(cut >= 0) & (cut < len(inner))]] = False
    return _per(block.offsets, np.append(False, wrong & inner)) if len(block.initial) else np.zeros(len(block.length), np.int64)


_RESULT = "blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_NAMES = ["conv", "first_turn", "last_turn", "turns", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256", "repaired"]


def _repaired(block: _Block) -> list[pa.Array]:
    """Columns blank .. repaired, one row a conversation."""
    blank, duplicate, truncated = _faults(block, block.duplicates())
    n = len(block.length)
    cost, audits, lines = np.zeros(n, np.int64), [""] * n, [[]] * n
    for picked in buckets(block.length):
        length = block.length[picked]
        initial, must_go, cut = block.cube(picked, block.initial, blank | duplicate, truncated)
        start = np.zeros(len(picked), np.int64)
        costs = backward(initial, must_go, cut, length, np.broadcast_to(_END, (len(picked), 4)))
        cost[picked] = costs[0, :, 0]
        edits, states, _ = trace(costs, initial, must_go, cut, length, start, np.ones(len(picked), bool))
        for j, i in enumerate(picked.tolist()):
            steps = int((edits[:, j] != 0).sum())
            audits[i] = edits[:steps, j].astype(np.uint8).tobytes().decode()
            lines[i] = _spelled(block, i, edits[:steps, j], states[:steps, j])
    texts = ["\n".join(x) for x in lines]
    sums = [hashlib.sha256(x.encode()).hexdigest() for x in texts]
    return [pa.array(x) for x in (_per(block.offsets, blank), _per(block.offsets, duplicate), _per(block.offsets, truncated), _illegal(block), cost)] + [pa.array(audits, pa.string()), pa.array(sums), pa.array(texts, pa.string())]


def _borders(batch: pa.RecordBatch) -> np.ndarray:
    """Offsets of the conversations of a sorted batch."""
    conv, null = np.asarray(batch.column("conv").fill_null(0)), np.asarray(batch.column("conv").is_null())
    change = np.flatnonzero((conv[1:] != conv[:-1]) | (null[1:] != null[:-1])) + 1
    return np.concatenate([[0], change, [len(batch)]]) if len(batch) else np.zeros(1, np.int64)


def _whole_conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches cut between conversations, with offsets; at most one conversation is carried over."""
    carried = None
    for batch in batches:
        if carried is not None:
            batch = pa.Table.from_batches([carried, batch]).combine_chunks().to_batches()[0]
        if not len(batch):
            continue
        offsets = _borders(batch)
        carried = batch.slice(offsets[-2])
        if len(offsets) > 2:
            yield batch.slice(0, offsets[-2]), offsets[:-1]
    if carried is not None and len(carried):
        yield carried, _borders(carried)


def _turns(batch: pa.RecordBatch, offsets: np.ndarray) -> list[pa.Array]:
    """First, last and number of distinct turns of each conversation; null where all are null."""
    null, turn = np.asarray(batch.column("turn").is_null()), np.asarray(batch.column("turn").fill_null(0))
    first = offsets[:-1] + _per(offsets, null)  # nulls come first
    none = first == offsets[1:]
    new = ~null
    new[1:] &= (turn[1:] != turn[:-1]) | null[:-1]
    new[first[~none]] = True
    return [pa.array(x, mask=none) for x in (turn[np.minimum(first, len(turn) - 1)], turn[offsets[1:] - 1], _per(offsets, new))]


def _repair_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, offsets in _whole_conversations(batches):
        conv = batch.column("conv").take(pa.array(offsets[:-1]))
        yield pa.RecordBatch.from_arrays([conv, *_turns(batch, offsets), *_repaired(_Block(batch, offsets))], names=_NAMES)


# -- conversations of any length, in blocks


def _arrays(part: pa.Table) -> tuple[_Block, list[np.ndarray], list[np.ndarray]]:
    """(block, its blank, duplicate and truncated rows, the kernel's arrays) of one block's rows."""
    part = part.sort_by("place").combine_chunks()
    block = _Block(part.to_batches()[0], np.array([0, len(part)]))
    blank, duplicate, truncated = _faults(block, part.column("again").to_numpy())
    return block, [blank, duplicate, truncated], block.cube(np.array([0]), block.initial, blank | duplicate, truncated)


def _between(key: tuple, part: pa.Table) -> pa.Table:
    """A block's counts and least costs from each state (rows) to each state (columns)."""
    block, faults, arrays = _arrays(part)
    unit = np.where(np.eye(4, dtype=bool), 0, _FAR)
    four = [np.repeat(a, 4, axis=1) for a in arrays]
    matrix = backward(*four, np.repeat(block.length, 4), unit)[0].T
    values = [key[0].as_py(), key[1].as_py(), *[int(x.sum()) for x in faults], int(_illegal(block)[0]), int(block.initial[0]), int(block.initial[-1]), matrix.ravel().tolist()]
    return pa.table([pa.array([v], t) for v, t in zip(values, (pa.int64(), pa.int64(), *[pa.int64()] * 4, pa.int32(), pa.int32(), pa.list_(pa.int64())))], names=_BETWEEN)


_BETWEEN = ["conv", "block", "blank", "duplicate", "truncated", "illegal", "head", "tail", "matrix"]


def _ends(key: tuple, blocks: pa.Table) -> pa.Table:
    """Costs at the end of each block of one conversation, from its blocks' matrices."""
    blocks = blocks.sort_by("block")
    end, out = _END, []
    for matrix in reversed(blocks.column("matrix").to_pylist()):
        out.append(end.tolist())
        end = (np.array(matrix).reshape(4, 4) + end).min(axis=1)
        for _ in range(2):
            end = np.minimum(end, end[_TO] + INSERT)
    out.reverse()
    last = np.arange(len(out)) == len(out) - 1
    return pa.table([blocks.column("conv"), blocks.column("block"), pa.array(out, pa.list_(pa.int64())), pa.array(last), pa.array(np.full(len(out), int(end[0])))], names=["conv", "block", "ends", "last", "cost"])


def _leads(key: tuple, part: pa.Table) -> pa.Table:
    """The state in which a block ends, for each state in which it may begin."""
    block, _, arrays = _arrays(part)
    length = block.length
    four = [np.repeat(a, 4, axis=1) for a in arrays]
    end = np.repeat(np.array([part.column("ends")[0].as_py()], np.int64), 4, axis=0)
    costs = backward(*four, np.repeat(length, 4), end)
    state = trace(costs, *four, np.repeat(length, 4), np.arange(4), np.repeat(part.column("last")[0].as_py(), 4))[2]
    return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([key[1].as_py()], pa.int64()), pa.array([state.tolist()], pa.list_(pa.int64()))], names=["conv", "block", "leads"])


def _entries(key: tuple, blocks: pa.Table) -> pa.Table:
    """The state in which each block of one conversation begins."""
    blocks = blocks.sort_by("block")
    state, out = 0, []
    for leads in blocks.column("leads").to_pylist():
        out.append(state)
        state = leads[state]
    return pa.table([blocks.column("conv"), blocks.column("block"), pa.array(out, pa.int64())], names=["conv", "block", "entry"])


def _pieces(key: tuple, part: pa.Table) -> pa.Table:
    """A block's edits and repaired rows."""
    block, _, arrays = _arrays(part)
    length = block.length
    end = np.array([part.column("ends")[0].as_py()], np.int64)
    costs = backward(*arrays, length, end)
    edits, states, _ = trace(costs, *arrays, length, np.array([part.column("entry")[0].as_py()]), np.array([part.column("last")[0].as_py()]))
    audit = edits[:, 0].astype(np.uint8).tobytes().decode()
    lines = _spelled(block, 0, edits[:, 0], states[:, 0])
    return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([key[1].as_py()], pa.int64()), pa.array([audit]), pa.array(["\n".join(lines)]), pa.array([len(lines) > 0])], names=["conv", "block", "audit", "repaired", "any"])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 by conversation over its pieces, streamed: a task holds one batch."""
    names, current, digest, some = ["conv", "repaired_sha256"], (), None, False
    for batch in batches:
        for conv, piece, has in zip(batch.column("conv").to_pylist(), batch.column("repaired").to_pylist(), batch.column("any").to_pylist()):
            if current != (conv,):
                if current:
                    yield pa.RecordBatch.from_arrays([pa.array(list(current), pa.int64()), pa.array([digest.hexdigest()])], names=names)
                current, digest, some = (conv,), hashlib.sha256(), False
            if has:
                digest.update(("\n" if some else "").encode() + piece.encode())
                some = True
    if current:
        yield pa.RecordBatch.from_arrays([pa.array(list(current), pa.int64()), pa.array([digest.hexdigest()])], names=names)


def _long_repaired(rows: DataFrame, length: int) -> DataFrame:
    """Conversations of any length, in blocks of ``length`` rows. Repeated rows are found by equal (role, text)."""
    # equal rows of one turn become one row with its copies, so that a row repeated without end is no hot key
    counted = rows.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("copies"))
    nullable = F.struct(F.col("turn").isNotNull(), "turn")  # nulls first
    counted = stored(counted.withColumns({"pair": F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256), "bucket": F.coalesce(F.floor(F.col("turn") / length), F.lit(-(2**62)))}), "long-turns")
    first = counted.groupBy("conv", "pair").agg(F.min(nullable)["turn"].alias("first"))
    marked = null_safe(counted, first, ["conv", "pair"])
    placed = running_total(marked, ["conv"], "bucket", ["turn", "role", "text"], "copies", "before")
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))
    placed = placed.withColumn("copy", copy).withColumn("place", F.col("before") + F.col("copy"))
    again = (F.col("copy") > 0) | ~F.col("turn").eqNullSafe(F.col("first"))
    blocks = stored(placed.select("conv", "role", "text", "place", again.alias("again"), F.floor(F.col("place") / length).alias("block")).withColumns(_flags()), "long-blocks")
    between = stored(blocks.groupBy("conv", "block").applyInArrow(_between, "conv long, block long, blank long, duplicate long, truncated long, illegal long, head int, tail int, matrix array<long>"), "long-matrices")
    ends = stored(between.groupBy("conv").applyInArrow(_ends, "conv long, block long, ends array<long>, last boolean, cost long"), "long-ends")
    ended = null_safe(blocks, ends, ["conv", "block"])
    leads = stored(ended.groupBy("conv", "block").applyInArrow(_leads, "conv long, block long, leads array<long>"), "long-leads")
    entries = leads.groupBy("conv").applyInArrow(_entries, "conv long, block long, entry long")
    pieces = stored(null_safe(ended, entries, ["conv", "block"]).groupBy("conv", "block").applyInArrow(_pieces, "conv long, block long, audit string, repaired string, any boolean"), "long-pieces")
    sums = pieces.select("conv", "block", "repaired", "any").repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(_hashes, "conv long, repaired_sha256 string")
    audits = pieces.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("block", "audit"))).alias("parts")).select("conv", F.array_join(F.col("parts")["audit"], "").alias("audit"))
    # a pair of rows on both sides of a border is looked at here
    border = between.select("conv", (F.col("block") + 1).alias("block"), "tail")
    pair = (F.col("tail") * 4 + F.col("head")).isin(*[a * 4 + b for a, b in ((0, 1), (1, 2), (2, 1))])
    crossing = null_safe(between.select("conv", "block", "head"), border, ["conv", "block"]).groupBy("conv").agg(F.sum((~pair).cast("long")).alias("crossing"))
    counts = between.groupBy("conv").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")])
    counts = null_safe(counts, crossing, ["conv"], "left").withColumn("illegal", F.col("illegal") + F.coalesce("crossing", F.lit(0))).drop("crossing")
    turns = counted.groupBy("conv").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))
    distinct = counted.where("turn IS NOT NULL").select("conv", "turn").distinct().groupBy("conv").agg(F.count("*").alias("turns"))
    out = null_safe(null_safe(turns, distinct, ["conv"], "left"), counts, ["conv"])
    cost = ends.where("last").select("conv", "cost")
    for part in (cost, audits, sums):
        out = null_safe(out, part, ["conv"])
    return out.withColumn("repaired", F.lit(None).cast("string"))


def repair_conversations(rows: DataFrame, long: int = LONG) -> DataFrame:
    """Repairs damaged rows (conv, turn, role, text; roles and texts not null), one row per conversation:
    conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, repaired.

    Rows are taken by turn, nulls first, then role and text. gaps: last turn - first turn + 1 - distinct
    turns, nulls ignored, 0 if all are null. Each row's first fault counts: blank, duplicate (role and
    text stand in an earlier row), truncated. illegal: adjacent initials other than su, ua, au. audit: the
    cheapest edits' initials in order, of equally cheap ones the ASCII-least. ``repaired`` is the text
    whose hash is given, null where a conversation has over ``long`` rows (its hash is of the whole text
    all the same). A null conv is a conversation of its own. An empty table gives an empty table.
    """
    many = stored(rows.groupBy("conv").agg(F.count("*").alias("n")).where(F.col("n") > long).select("conv"), "long-conversations")
    columns = f"conv long, first_turn long, last_turn long, turns long, {_RESULT}, repaired string"
    some = bool(many.limit(1).count())
    short = null_safe(rows, many, ["conv"], "left_anti") if some else rows
    flagged = short.select("conv", "turn", "role", "text").withColumns(_flags())
    found = flagged.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").mapInArrow(_repair_batches, columns)
    if some:
        found = found.unionByName(_long_repaired(null_safe(rows, many, ["conv"], "left_semi"), long))
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0).cast("long"))
    return found.select("conv", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256", "repaired")


def damaged_and_repaired(conversations: DataFrame, conv: str = "conv_id", long: int = LONG) -> DataFrame:
    """``repair_conversations`` of the damaged rows, with every original conversation: zeros, an empty audit
    and the hash of the empty text where no row is left."""
    found = repair_conversations(damage(conversations, conv), long)
    every = conversations.select(F.col(conv).alias("conv")).distinct()
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return null_safe(every, found, ["conv"], "left").withColumns(zero | {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.lit(EMPTY_SHA256))})
