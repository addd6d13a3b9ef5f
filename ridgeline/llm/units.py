"""Vectorised views of text columns: bytes, words, window fingerprints and winnowed anchors.

Everything works on the UTF-8 buffer of an Arrow column in slices of bounded size, so a task never
holds more than one slice (or one document, if that is longer) in expanded form.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view

#: Bytes of text that are expanded at a time.
SLICE = 1 << 18

#: Starts of windows that are hashed and winnowed at a time; longer texts are cut there.
CHUNK = 1 << 20

#: Bytes of a word that are hashed in step with those of all others; longer words by BLAKE2b.
WORD_BYTES = 64

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODES = _rng.integers(1, 2**64, 256, dtype=_U) | _U(1)
#: ASCII white space, which separates words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: By number of bytes: the bits of a little-endian 8-byte word that they fill.
_FILLED = np.array([(1 << 8 * n) - 1 for n in range(9)], _U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix64's finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of each row's text in them) for runs of rows; null counts as empty."""
    if not len(column):
        return
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start byte, end byte) of every word, and the words' offsets by row."""
    inside = ~SPACE[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    full = offsets[:-1] < offsets[1:]
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    starts[first], ends[last] = inside[first], inside[last]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    by_row = np.searchsorted(start, offsets)
    if not len(start):
        return np.zeros(0, _U), start, end, by_row
    return _word_codes(data, start, end), start, end, by_row


def _word_codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of words: eight bytes a step, each step mixed with all before (no sum, no product of places)."""
    length = end - start
    codes = mix(length.astype(_U) * _U(0xD6E8FEB86659FD93))
    eight = sliding_window_view(np.concatenate((data, np.zeros(8, np.uint8))), 8)
    own = np.flatnonzero(length <= WORD_BYTES)
    for at in range(0, WORD_BYTES, 8):
        own = own[length[own] > at]
        if not len(own):
            break
        chunk = np.ascontiguousarray(eight[start[own] + at]).view("<u8").ravel() & _FILLED[np.minimum(length[own] - at, 8)]
        codes[own] = mix((codes[own] ^ chunk) + _U(0x9E3779B97F4A7C15))
    for i in np.flatnonzero(length > WORD_BYTES):
        codes[i] = int.from_bytes(blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return codes


class Windows:
    """64-bit fingerprints of windows of units: equal for equal windows, wherever they stand.

    A window of 2**k units is a mix of its two halves, any other one a mix of the two longest such
    windows that begin and end it, and of its length. Every step is non-linear, so no two sequences
    cancel out as they can in sums over powers of a base. Units are codes, or bytes, of which eight make
    one code as they stand. Levels of other sizes than those asked for are not kept.
    """

    def __init__(self, codes: np.ndarray):
        self.codes, self._levels = codes, {}

    def _level(self, k: int) -> np.ndarray:
        """Fingerprints of all windows of 2**k units, by start."""
        plain = self.codes.dtype == np.uint8
        if plain and k >= 3 and 3 not in self._levels:
            eight = sliding_window_view(self.codes, 8) if len(self.codes) >= 8 else np.zeros((0, 8), np.uint8)
            self._levels[3] = mix(np.ascontiguousarray(eight).view("<u8").ravel())
        if not plain or k < 3:
            self._levels.setdefault(0, BYTE_CODES[self.codes] if plain else self.codes)
        if k not in self._levels:
            below = max(i for i in self._levels if i < k)
            found = self._levels[below]
            for i in range(below, k):
                found = _joined(found[: -(1 << i)], found[1 << i :]) if len(found) > 1 << i else found[:0]
            self._levels[k] = found
        return self._levels[k]

    def every(self, size: int) -> np.ndarray:
        """Fingerprints of all windows of ``size`` units, by start."""
        k, n = size.bit_length() - 1, len(self.codes) - size + 1
        level = self._level(k)
        return _closed(level[:n], level[size - (1 << k) :][:n], np.array([size], _U))

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Fingerprints of the windows [start, end), which may not be empty."""
        size = end - start
        k = np.frexp(size.astype(float))[1] - 1
        out = np.empty(len(start), _U)
        for one in np.unique(k):
            own = np.flatnonzero(k == one)
            level = self._level(int(one))
            out[own] = _closed(level[start[own]], level[end[own] - (1 << int(one))], size[own].astype(_U))
        return out


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a * _U(0x9E3779B97F4A7C15)
    out += b
    out ^= out >> _U(29)
    out *= _U(0xBF58476D1CE4E5B9)
    return out


def _closed(a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    return mix(_joined(a, b) ^ (size * _U(0xD6E8FEB86659FD93)))


#: Bits of an anchor's place in a chunk; the rest order the seeds.
_PLACE = _U(28)


def winnow(seeds: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` seeds (at most 2**28 in all), the place of its least one, the leftmost of equals."""
    keys = (seeds >> _PLACE << _PLACE) | np.arange(len(seeds), dtype=_U)
    done, n = 1, len(keys)
    while done < width:
        step = min(done, width - done)
        keys = np.minimum(keys[: n - done - step + 1], keys[step : n - done + 1])
        done += step
    return (keys & _U((1 << int(_PLACE)) - 1)).astype(np.int64)


def spans(codes: np.ndarray, by_row: np.ndarray, window: int, seed: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Winnowed anchors of every row, each extended both ways to all windows that chose it.

    Tuples: row, anchor fingerprint, class (of the span's units and the anchor's place in them),
    first window (in the row), number of windows. Equal windows choose anchors at the same place in
    them, so equal windows are always found under one anchor fingerprint. ``codes`` are hashes of
    units, or bytes. A span ends where a chunk of ``CHUNK`` windows does, which makes two of it.
    """
    for low in range(0, len(codes) - window + 1, CHUNK):
        part = codes[low : low + CHUNK + window - 1]
        windows = Windows(part)
        seeds = windows.every(seed)
        chosen = winnow(seeds, window - seed + 1)  # by window start
        # starts of windows that lie within one row
        first = np.clip(by_row[:-1] - low, 0, len(chosen))
        count = np.maximum(np.clip(by_row[1:] - window + 1 - low, 0, len(chosen)) - first, 0)
        own = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        if not len(own):
            continue
        anchor, row = chosen[own], np.repeat(np.arange(len(count)), count)
        new = np.ones(len(own), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
        begin = np.flatnonzero(new)
        length = np.diff(np.append(begin, len(own)))
        start, anchor, row = own[begin], anchor[begin], row[begin]
        content = windows.between(start, start + length - 1 + window)
        yield row, seeds[anchor], mix(content + (anchor - start).astype(_U)), low + start - by_row[row], length


def covered(ranges: pa.ListArray, by_row: np.ndarray, window: int) -> np.ndarray:
    """Mask of the units of some rows, true where a window of a row's ranges lies.

    ranges: one list a row (null for none) of struct<first, count>: first window and number of windows.
    """
    n = int(by_row[-1])
    per = np.asarray(ranges.value_lengths().fill_null(0), np.int64)
    values = ranges.flatten()
    first, count = (np.asarray(values.field(k), np.int64) for k in (0, 1))
    row = np.repeat(np.arange(len(per)), per)
    long = by_row[row + 1] - by_row[row] >= window  # a shorter row has no window
    row, first, count = row[long], first[long], count[long]
    start = by_row[row] + first
    end = np.minimum(by_row[row + 1], start + count - 1 + window)
    change = np.bincount(start, minlength=n + 1) - np.bincount(end, minlength=n + 1)
    return np.cumsum(change[:n]) > 0


def pieces(data: np.ndarray, kept: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The kept bytes of each row as a binary or string array."""
    upto = np.append(0, np.cumsum(kept))
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(upto[offsets].astype(np.int32)), pa.py_buffer(data[kept].tobytes())])
