"""GIF columns: binary payloads stored as animated GIFs, decoded into timed frames with colour histograms.

The decoder reads GIF87a and GIF89a: LZW code streams with clear codes and growing code sizes, local
and global palettes, interlacing, transparency, and the disposal rules that say what a frame leaves
for the next one. The encoder stores 8-bit samples losslessly as palette indices, a fixed-size frame
at a time.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import by_bytes

WIDTH, HEIGHT = 24, 24
FRAME = WIDTH * HEIGHT
FILL = 255
DELAY_CS = 4
BINS = 64

#: 256 distinct colours: three bits of red and green, two of blue.
_i = np.arange(256)
PALETTE = np.stack(((_i >> 5) * 255 // 7, (_i >> 2 & 7) * 255 // 7, (_i & 3) * 85), axis=1).astype(np.uint8)


class GifError(ValueError):
    """The bytes are not a GIF that can be decoded."""


def _widths(least: int, n: int) -> np.ndarray:
    """Code sizes of the first n codes after a clear code, of ``least`` + 1 bits at first."""
    entries = (1 << least) + 2 + np.arange(n)  # table size when the code is read, plus one
    grown = np.ceil(np.log2(np.maximum(entries, 2))).astype(np.int64)
    return np.clip(grown, least + 1, 12)


_WIDTHS = {k: _widths(k, 4200) for k in range(1, 9)}
_BITS_BEFORE = {k: np.append(0, np.cumsum(w)) for k, w in _WIDTHS.items()}


def _layout(least: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bits before each code, code sizes) for the codes that can fill so many bits."""
    before, widths = _BITS_BEFORE[least], _WIDTHS[least]
    if bits > before[-1]:  # a full table that is used on: 12 bits from here
        more = (bits - int(before[-1])) // 12
        before = np.append(before, before[-1] + 12 * np.arange(1, more + 1))
        widths = np.append(widths, np.full(more, 12))
    return before, widths


def lzw_codes(samples: bytes, least: int = 8) -> list[int]:
    """Codes of the samples, an end code last. A full table is followed by a clear code."""
    clear, codes, table = 1 << least, [], {}
    append, get, free = codes.append, table.get, clear + 2
    rest = iter(samples)
    prefix = next(rest, None)
    for sample in rest:
        key = prefix << 8 | sample
        code = get(key)
        if code is None:
            append(prefix)
            prefix = sample
            if free < 4095:
                table[key] = free
                free += 1
            else:
                append(clear)
                table.clear()
                free = clear + 2
        else:
            prefix = code
    if prefix is not None:
        append(prefix)
    append(clear + 1)
    return codes


#: Frames that are encoded in step, and the longest that can't fill a code table.
IN_STEP, LONGEST = 256, 3800
#: Bytes of payload that are encoded at a time.
TOGETHER = 2 << 20


def lzw_codes_all(frames: np.ndarray) -> list[np.ndarray]:
    """``lzw_codes`` of 8-bit frames of equal size, a row each: all frames take a sample at a time."""
    count, size = frames.shape
    if size > LONGEST or not size:
        return [np.array(lzw_codes(f.tobytes()), np.uint16) for f in frames]
    entries = 258 + size
    table = np.zeros(IN_STEP * entries * 256, np.int16)  # (frame, prefix, sample) to code, 0: none
    found: list[np.ndarray] = []
    for low in range(0, count, IN_STEP):
        part = frames[low : low + IN_STEP].astype(np.int64)
        n = len(part)
        row, own = np.arange(n), np.arange(n) * (entries * 256)
        codes, filled, used = np.zeros((n, size + 2), np.uint16), np.zeros(n, np.int64), []
        prefix = part[:, 0]
        for t in range(1, size):
            sample = part[:, t]
            key = own + (prefix << 8) + sample
            code = table[key]
            new = np.flatnonzero(code == 0)
            at = filled[new]
            codes[new, at] = prefix[new]
            table[key[new]] = at + 258
            used.append(key[new])
            filled[new] = at + 1
            prefix = code.astype(np.int64)
            prefix[new] = sample[new]
        table[np.concatenate(used)] = 0
        codes[row, filled], codes[row, filled + 1] = prefix, 257
        found += [c[: k + 2] for c, k in zip(codes, filled)]
    return found


def pack_codes(frames: list[np.ndarray] | list[list[int]], least: int = 8) -> list[bytes]:
    """The code stream of each frame, after an opening clear code, least significant bit first."""
    if not frames:
        return []
    opening = np.array([1 << least], np.uint16)
    codes = np.concatenate([np.asarray(x, np.uint16) for f in frames for x in (opening, f)])
    size = np.array([len(f) + 1 for f in frames])
    end = np.cumsum(size)
    # a code's size depends on its number since the last clear code
    number = np.arange(len(codes))
    last = np.maximum.accumulate(np.where(codes == 1 << least, number, -1))
    since = number - np.concatenate(([0], last[:-1])) - 1
    widths = np.where(since < 0, least + 1, _WIDTHS[least][since])
    widths[end - size] = least + 1
    total = np.add.reduceat(widths, end - size)
    first_byte = np.append(0, np.cumsum(-(-total // 8)))
    before = np.cumsum(widths) - widths
    at = before + np.repeat(8 * first_byte[:-1] - before[end - size], size)
    # a code of at most 12 bits touches three bytes; no two codes share a bit, so sums are unions
    length, byte = int(first_byte[-1]), at >> 3
    shifted = codes.astype(np.int64) << (at & 7)
    filled = sum(np.bincount(byte + k, shifted >> 8 * k & 255, length + 2) for k in range(3))
    stream = filled[:length].astype(np.uint8).tobytes()
    return [stream[a:b] for a, b in zip(first_byte[:-1].tolist(), first_byte[1:].tolist())]


_ROOTS = {k: [bytes([i]) for i in range(1 << k)] + [b"", b""] for k in range(1, 9)}


def _grown(codes: list[int], least: int) -> list[bytes]:
    """The code table after these codes, which follow a clear code."""
    table = _ROOTS[least][:]
    if not codes:
        return table
    if codes[0] >= 1 << least:
        raise GifError("a code that is not in the table")
    append, previous = table.append, table[codes[0]]
    for code in codes[1 : 4097 - len(table)]:
        try:
            entry = table[code]
            append(previous + entry[:1])
        except IndexError:
            if code != len(table):
                raise GifError("a code that is not in the table") from None
            entry = previous + previous[:1]
            append(entry)
        previous = entry
    if max(codes) >= len(table):
        raise GifError("a code that is not in the table")
    return table


def lzw_decode(stream: bytes, least: int, size: int) -> bytes:
    """Samples of a code stream, at most ``size``."""
    if not 1 <= least <= 8:
        raise GifError("bad LZW code size")
    clear, data = 1 << least, np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.uint32)
    bit, total, out, got = 0, 8 * len(stream), [], 0
    before, widths = _layout(least, total)
    while bit + least + 1 <= total and got < size:
        # all codes up to a clear or end code have sizes that depend on their number only
        n = int(np.searchsorted(before, total - bit, "right")) - 1
        at = bit + before[:n]
        byte = at >> 3
        word = data[byte] | data[byte + 1] << 8 | data[byte + 2] << 16
        codes = (word >> (at & 7).astype(np.uint32)) & ((1 << widths[:n]) - 1).astype(np.uint32)
        stop = np.flatnonzero((codes == clear) | (codes == clear + 1))
        used = int(stop[0]) if len(stop) else n
        run = codes[:used].tolist()
        table = _grown(run, least)
        out += [table[code] for code in run]
        if not len(stop) or codes[used] == clear + 1:
            break
        got = sum(map(len, out))
        bit += int(before[used + 1])
    return b"".join(out)[:size]


def lzw_decode_all(streams: list[bytes], least: int, sizes: list[int]) -> list[bytes]:
    """``lzw_decode`` of many streams at once.

    Entry k of a code table is the k-th code's string and one more sample, so every string is a path
    of parents among the codes of its stream. Paths are followed for all streams together. Streams
    that clear their table on the way, or end early, are decoded one by one.
    """
    if not 1 <= least <= 8:
        raise GifError("bad LZW code size")
    clear, widths = 1 << least, _WIDTHS[least]
    data = np.frombuffer(b"".join(s + b"\0\0\0" for s in streams), np.uint8).astype(np.uint32)
    length = np.array([len(s) for s in streams], np.int64)
    begin = 8 * (np.cumsum(length + 3) - length - 3) + least + 1  # past the opening clear code
    count = np.minimum(np.searchsorted(_BITS_BEFORE[least], np.maximum(8 * length - least - 1, 0), "right") - 1, len(widths))
    base = np.cumsum(count) - count
    number = np.arange(int(count.sum())) - np.repeat(base, count)
    bit = np.repeat(begin, count) + _BITS_BEFORE[least][number]
    byte = bit >> 3
    word = data[byte] | data[byte + 1] << np.uint32(8) | data[byte + 2] << np.uint32(16)
    codes = ((word >> (bit & 7).astype(np.uint32)) & ((1 << widths[number]) - 1).astype(np.uint32)).astype(np.int64)
    opening = np.array([s[0] | (s[1] if len(s) > 1 else 0) << 8 for s in (x or b"\0" for x in streams)]) & (2 << least) - 1
    used = np.full(len(streams), -1)
    full = np.flatnonzero(count > 0)
    if len(full):
        stop = np.minimum.reduceat(np.where((codes == clear) | (codes == clear + 1), number, 1 << 30), base[full])
        ended = (stop < 1 << 30) & (opening[full] == clear)
        ended[ended] = codes[(base[full] + stop)[ended]] == clear + 1
        used[full[ended]] = stop[ended]
    # an entry must exist when it is used, and the first code of a stream is a sample
    kept = number < np.repeat(used, count)
    bad = kept & (codes >= clear + 2) & (codes - clear - 2 >= number)
    used[np.repeat(np.arange(len(streams)), count)[bad]] = -1
    kept = number < np.repeat(used, count)
    codes, number, used_ = codes[kept], number[kept], np.maximum(used, 0)
    base = np.repeat(np.cumsum(used_) - used_, used_)
    place = np.arange(len(codes))
    leaf = codes < clear
    parent = np.where(leaf, place, base + codes - clear - 2)
    depth, jump = (~leaf).astype(np.int64), parent
    while not leaf[jump].all():
        depth = depth + depth[jump]
        jump = jump[jump]
    first = codes[jump]
    last = np.where(leaf, codes, first[np.minimum(parent + 1, len(codes) - 1)]) if len(codes) else codes
    size = depth + 1
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    own, node = place, place
    while len(own):
        out[at[own] + depth[node]] = last[node]
        deeper = ~leaf[node]
        own, node = own[deeper], parent[node[deeper]]
    ends = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(used_))]
    whole = out.tobytes()
    return [whole[a:b][:n] if u >= 0 else lzw_decode(s, least, n) for s, n, u, a, b in zip(streams, sizes, used, ends[:-1].tolist(), ends[1:].tolist())]


def encode_gifs(payloads: list[bytes], width: int = WIDTH, height: int = HEIGHT, delay_cs: int = DELAY_CS) -> list[bytes]:
    """An animated GIF of each payload, whose frames hold its samples in turn; each fills whole frames."""
    frame = width * height
    if any(len(p) % frame for p in payloads):
        raise ValueError("samples do not fill whole frames")
    streams = iter(pack_codes(lzw_codes_all(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, frame))))
    head = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), PALETTE.tobytes(), b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0"]
    image = b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, delay_cs, 0) + b"\0\x2c" + struct.pack("<HHHHB", 0, 0, width, height, 0) + b"\x08"
    found = []
    for payload in payloads:
        parts = head[:]
        for stream in islice(streams, len(payload) // frame):
            parts.append(image)
            for k in range(0, len(stream), 255):
                block = stream[k : k + 255]
                parts += [bytes([len(block)]), block]
            parts.append(b"\0")
        found.append(b"".join([*parts, b";"]))
    return found


@dataclass
class Frame:
    indices: np.ndarray  # as stored, de-interlaced
    canvas: np.ndarray  # height x width x 4, what is shown
    delay_ms: int
    disposal: int
    transparent: bool


def _interlaced(height: int) -> np.ndarray:
    """Rows in the order in which an interlaced frame stores them."""
    return np.concatenate([np.arange(a, height, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])


@dataclass
class _Image:
    """One image block as the file has it."""

    left: int
    top: int
    width: int
    height: int
    interlaced: bool
    colours: np.ndarray
    least: int
    stream: bytes
    delay: int
    disposal: int
    hidden: int | None


def decode_gif(data: bytes) -> list[Frame]:
    """Frames in order, each with the canvas shown for its delay."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise GifError("no GIF header")
    try:
        width, height, images = _parse(data)
    except (IndexError, struct.error) as error:
        raise GifError("the file ends early") from error
    raw: dict[int, bytes] = {}
    for least in {i.least for i in images}:
        own = [k for k, i in enumerate(images) if i.least == least]
        raw |= zip(own, lzw_decode_all([images[k].stream for k in own], least, [images[k].width * images[k].height for k in own]))
    return _shown(width, height, images, raw)


def _parse(data: bytes) -> tuple[int, int, list[_Image]]:
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at, shared, images = 13, None, []

    def palette(flags: int) -> np.ndarray:
        nonlocal at
        n = 2 << (flags & 7)
        if at + 3 * n > len(data):
            raise GifError("the file ends early")
        colours = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
        return np.concatenate((colours, np.full((n, 1), 255, np.uint8)), axis=1)

    def blocks() -> bytes:
        nonlocal at
        out = []
        while n := data[at]:
            out.append(data[at + 1 : at + 1 + n])
            at += 1 + n
        at += 1
        return b"".join(out)

    if flags & 0x80:
        shared = palette(flags)
    delay, disposal, hidden = 0, 0, None
    while (kind := data[at]) != 0x3B:
        at += 1
        if kind == 0x21:
            label = data[at]
            at += 1
            body = blocks()
            if label == 0xF9:
                packed, delay, index = struct.unpack("<BHB", body[:4])
                disposal, hidden = packed >> 2 & 7, index if packed & 1 else None
            continue
        if kind != 0x2C:
            raise GifError("an unknown block")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at)
        at += 9
        colours = palette(flags) if flags & 0x80 else shared
        if colours is None:
            raise GifError("a frame without a palette")
        least = data[at]
        at += 1
        images.append(_Image(left, top, w, h, bool(flags & 0x40), colours, least, blocks(), delay, disposal, hidden))
        delay, disposal, hidden = 0, 0, None
    return width, height, images


def _shown(width: int, height: int, images: list[_Image], raw: dict[int, bytes]) -> list[Frame]:
    """Draws the images on the canvas, one after the other."""
    canvas, frames = np.zeros((height, width, 4), np.uint8), []
    for k, i in enumerate(images):
        if len(raw[k]) < i.width * i.height:
            raise GifError("a frame with too few samples")
        plane = np.frombuffer(raw[k], np.uint8, i.width * i.height).reshape(i.height, i.width)
        if plane.size and plane.max() >= len(i.colours):
            raise GifError("a sample beyond the palette")
        if i.interlaced:
            plane = plane[np.argsort(_interlaced(i.height))]
        before = canvas
        part = plane[: max(0, height - i.top), : max(0, width - i.left)]
        shown = i.colours.take(part, axis=0)
        if i.hidden is None and part.shape == canvas.shape[:2]:
            canvas = shown
        else:
            canvas = canvas.copy()  # the frame before keeps its own
            inside = canvas[i.top : i.top + i.height, i.left : i.left + i.width]
            seen = np.full(part.shape, True) if i.hidden is None else part != i.hidden
            inside[seen] = shown[seen]
        frames.append(Frame(plane, canvas, i.delay * 10, i.disposal, i.hidden is not None))
        if i.disposal == 2:
            canvas = canvas.copy()
            canvas[i.top : i.top + i.height, i.left : i.left + i.width] = 0
        elif i.disposal == 3:
            canvas = before
    return frames


def histograms(canvases: list[np.ndarray]) -> np.ndarray:
    """Opaque pixels by colour, two bits of each channel: one row for each canvas."""
    if not canvases:
        return np.zeros((0, BINS), np.int64)
    pixels = np.concatenate([c.reshape(-1, 4) for c in canvases])
    owner = np.repeat(np.arange(len(canvases)) * BINS, [c.shape[0] * c.shape[1] for c in canvases])
    bins = owner + (pixels[:, 0] >> 6 << 4 | pixels[:, 1] >> 6 << 2 | pixels[:, 2] >> 6)
    return np.bincount(bins[pixels[:, 3] > 0], minlength=BINS * len(canvases)).reshape(-1, BINS)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches):
        table = pa.table(batch)
        raw = [(t or "").encode() for t in table["text"].to_pylist()]
        full = [r + bytes([FILL]) * ((-len(r)) % FRAME or (0 if r else FRAME)) for r in raw]
        media, low = [], 0
        while low < len(full):  # a few MB of frames at a time
            high, size = low, 0
            while high < len(full) and size < TOGETHER:
                size += len(full[high])
                high += 1
            media += encode_gifs(full[low:high])
            low = high
        out = table.drop_columns(["text"]).append_column("n_bytes", pa.array(map(len, raw), pa.int64()))
        yield from out.append_column("media", pa.array(media, pa.binary())).to_batches()


def store_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, ``n_bytes`` of the UTF-8 text, ``media``: the text as a GIF of 24 x 24 frames, filled with 255.

    Null counts as empty; an empty text is one frame of fill. Repeated rows have a row each, equal
    texts equal media, and an empty table none. Columns besides key and text are ignored, whatever
    their names. A text is held whole in its task, others beside it only up to a few MB.
    """
    return docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).mapInArrow(_encode, "doc long, n_bytes long, media binary")


_FRAMES = pa.list_(pa.struct([("start_ms", pa.int64()), ("delay_ms", pa.int32()), ("disposal", pa.int32()), ("transparent", pa.bool_()), ("histogram", pa.list_(pa.int32()))]))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "media"):
        payloads, offsets, timing, bins, errors = [], [0], [], [], []
        for media in batch.column("media").to_pylist():
            found, error = [], None
            try:
                found = decode_gif(media) if media is not None else []
            except GifError as e:
                error = str(e)
            start = 0
            bins.append(histograms([f.canvas for f in found]))
            for f in found:
                timing.append((start, f.delay_ms, f.disposal, f.transparent))
                start += f.delay_ms
            payloads.append(b"".join(f.indices.tobytes() for f in found))
            offsets.append(len(timing))
            errors.append(error)
        start, delay, disposal, transparent = zip(*timing) if timing else ((), (), (), ())
        flat = pa.array(np.concatenate(bins).ravel().astype(np.int32) if bins else np.zeros(0, np.int32))
        hist = pa.ListArray.from_arrays(pa.array(np.arange(len(timing) + 1, dtype=np.int32) * BINS), flat)
        frames = pa.StructArray.from_arrays(
            [pa.array(start, pa.int64()), pa.array(delay, pa.int32()), pa.array(disposal, pa.int32()), pa.array(transparent, pa.bool_()), hist], fields=list(_FRAMES.value_type)
        )
        total = [b.sum(axis=0) for b in bins]
        out = pa.table(batch)
        out = out.append_column("payload", pa.array(payloads, pa.binary())).append_column("frames", pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), frames))
        out = out.append_column("histogram", pa.array(list(total), pa.list_(pa.int64()))).append_column("error", pa.array(errors, pa.string()))
        yield from out.to_batches()


READ = ("payload", "frames", "histogram", "error")


def read_media(stored: DataFrame) -> DataFrame:
    """Adds to a table with a ``media`` column: ``payload`` (samples of all frames), ``frames``
    (timing, disposal, transparency, colour histogram of what is shown), ``histogram`` (their sum)
    and ``error`` (null unless the bytes are no GIF, which then has no frames). Null media: no frames.

    Input columns of these names are replaced, all others stay. Repeated rows are read each; an
    empty table stays empty.
    """
    kept = stored.drop(*READ)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    frames = "array<struct<start_ms: long, delay_ms: int, disposal: int, transparent: boolean, histogram: array<int>>>"
    return kept.mapInArrow(_read, f"{schema}, payload binary, frames {frames}, histogram array<long>, error string")
