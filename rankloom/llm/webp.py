"""Lossless WebP: media columns to pixel arrays, and bytes to lossless WebP and back.

decode() reads any lossless WebP image: prefix codes, prefix code groups, back-references, colour cache, and the
predictor, cross-colour, subtract-green and palette transforms.  decode_many() decodes the literal runs of many images
in which one channel varies in lockstep, a symbol of each at a step, whatever their prefix codes; whatever else is in an
image goes through the same code as in decode().

encode_samples() stores bytes as grey pixels, a byte each, in images of at most ROWS rows.  An image of few different
bytes has a palette with several pixels in a sample; in others subtract-green leaves one channel, which is predicted from
the left or from above where that makes its symbols cheaper.  The prefix code is that of the image's own histogram, and a
run of equal symbols at the end is a back-reference.  Cross-colour and a colour cache never pay where all channels are
equal and a single one is coded, so only the decoder knows them.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 576
ROWS = 16
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)

# Fixed values of the format: the order in which lengths of the code length code are stored, and the offsets of the
# 120 nearest pixels as (columns left, rows up).
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3),
    (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3),
    (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5),
    (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7),
    (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7),
    (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6),
    (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
HASH = 0x1E35A7BD


class BitReader:
    """Bits of a byte string, least significant first; past the end they are 0, and so much past it that it must be an error fails."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def peek(self, n: int) -> int:
        start = self.at >> 3
        return (int.from_bytes(self.data[start : start + 8], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        found = self.peek(n) if n else 0
        self.at += n
        if self.at > 8 * len(self.data) + 64:
            raise ValueError("the WebP image ends early")
        return found


class PrefixCode:
    """A canonical prefix code: tables of symbols and lengths by the next `bits` bits."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if not len(used):
            raise ValueError("a prefix code without symbols")
        if len(used) == 1:
            self.bits, self.symbol, self.length = 0, used[:1].copy(), np.zeros(1, np.int64)
            return
        self.bits = int(lengths.max())
        order = used[np.lexsort((used, lengths[used]))]
        size = 1 << (self.bits - lengths[order].astype(np.int64))
        if size.sum() != 1 << self.bits:
            raise ValueError("a prefix code that isn't complete")
        symbol, length = np.repeat(order, size), np.repeat(lengths[order].astype(np.int64), size)
        flipped = _flipped(self.bits)
        self.symbol, self.length = symbol[flipped], length[flipped]

    def read(self, bits: BitReader) -> int:
        at = bits.peek(self.bits) if self.bits else 0
        bits.read(int(self.length[at]))
        return int(self.symbol[at])

    @property
    def only(self) -> int | None:
        """The symbol, if there is only one."""
        return None if self.bits else int(self.symbol[0])


def _reversed(x: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros_like(x)
    for k in range(bits):
        out |= ((x >> k) & 1) << (bits - 1 - k)
    return out


_flips: dict[int, np.ndarray] = {}


def _flipped(bits: int) -> np.ndarray:
    """All numbers of `bits` bits, the bits in reverse order."""
    if bits not in _flips:
        _flips[bits] = _reversed(np.arange(1 << bits), bits)
    return _flips[bits]


def _read_code(bits: BitReader, alphabet: int) -> PrefixCode:
    lengths = np.zeros(alphabet, np.int64)
    if bits.read(1):
        several, wide = bits.read(1), bits.read(1)
        symbols = [bits.read(8 if wide else 1), *([bits.read(8)] if several else [])]
        if max(symbols) >= alphabet:
            raise ValueError("a symbol outside the alphabet")
        lengths[symbols] = 1
        return PrefixCode(lengths)
    first = np.zeros(19, np.int64)
    for k in range(4 + bits.read(4)):
        first[CODE_LENGTH_ORDER[k]] = bits.read(3)
    code = PrefixCode(first)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    at, last = 0, 8
    while at < alphabet and left:
        left -= 1
        symbol = code.read(bits)
        if symbol < 16:
            lengths[at] = symbol
            at += 1
            last = symbol or last
            continue
        times, value = (3 + bits.read(2), last) if symbol == 16 else (3 + bits.read(3), 0) if symbol == 17 else (11 + bits.read(7), 0)
        if at + times > alphabet:
            raise ValueError("code lengths past the alphabet")
        lengths[at : at + times] = value
        at += times
    return PrefixCode(lengths)


def _prefixed(bits: BitReader, prefix: int) -> int:
    """The length or distance code that a prefix symbol and its extra bits stand for."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


@dataclass
class Stream:
    """What precedes the pixels of an entropy-coded image."""

    width: int
    height: int
    cache_bits: int = 0
    group_bits: int = 0
    groups: np.ndarray | None = None
    codes: list[list[PrefixCode]] = field(default_factory=list)


@dataclass
class Head:
    width: int
    height: int
    transforms: list[tuple]
    stream: Stream
    at: int


def _read_stream(bits: BitReader, width: int, height: int, top: bool) -> Stream:
    out = Stream(width, height)
    if bits.read(1):
        out.cache_bits = bits.read(4)
        if not 1 <= out.cache_bits <= 11:
            raise ValueError("a colour cache of an impossible size")
    groups = 1
    if top and bits.read(1):
        out.group_bits = bits.read(3) + 2
        inner = _sub_image(bits, -(-width >> out.group_bits), -(-height >> out.group_bits))
        out.groups = (inner >> 8) & 0xFFFF
        groups = int(out.groups.max()) + 1
    for _ in range(groups):
        out.codes.append([_read_code(bits, n) for n in (280 + (1 << out.cache_bits if out.cache_bits else 0), 256, 256, 256, 40)])
    return out


def _sub_image(bits: BitReader, width: int, height: int) -> np.ndarray:
    stream = _read_stream(bits, width, height, False)
    return np.array(_pixels(bits, stream, []), np.uint32).reshape(height, width)


def _pixels(bits: BitReader, stream: Stream, done: list[int]) -> list[int]:
    """The rest of the pixels (ARGB) after those done."""
    total, width = stream.width * stream.height, stream.width
    cache = [0] * (1 << stream.cache_bits) if stream.cache_bits else None
    shift, cached = 32 - stream.cache_bits, 0
    out = done
    while len(out) < total:
        at = len(out)
        group = stream.codes[0] if stream.groups is None else stream.codes[int(stream.groups[(at // width) >> stream.group_bits, (at % width) >> stream.group_bits])]
        symbol = group[0].read(bits)
        if symbol < 256:
            red, blue, alpha = group[1].read(bits), group[2].read(bits), group[3].read(bits)
            out.append(alpha << 24 | red << 16 | symbol << 8 | blue)
        elif symbol < 280:
            length = _prefixed(bits, symbol - 256)
            code = _prefixed(bits, group[4].read(bits))
            if code > 120:
                distance = code - 120
            else:
                x, y = NEAR[code - 1]
                distance = max(1, x + y * width)
            if distance > at or length > total - at:
                raise ValueError("a back-reference outside the image")
            for k in range(length):
                out.append(out[at - distance + k])
        else:
            while cached < at:
                cache[(HASH * out[cached] & 0xFFFFFFFF) >> shift] = out[cached]
                cached += 1
            out.append(cache[symbol - 280])
    return out


def _chunk(data: bytes) -> bytes:
    """The lossless chunk of a WebP file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at, end = 12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0])
    while at + 8 <= end:
        size = struct.unpack_from("<I", data, at + 4)[0]
        if data[at : at + 4] == b"VP8L":
            return data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no lossless image in the WebP file")


def read_head(chunk: bytes) -> Head:
    """Everything before the pixels of the main image."""
    bits = BitReader(chunk)
    if bits.read(8) != 0x2F:
        raise ValueError("not a lossless WebP image")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("an unknown version of lossless WebP")
    transforms, inner = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in [t[0] for t in transforms]:
            raise ValueError("a transform occurs twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            size = bits.read(3) + 2
            transforms.append((kind, inner, size, _sub_image(bits, -(-inner >> size), -(-height >> size))))
        elif kind == SUBTRACT_GREEN:
            transforms.append((kind, inner))
        else:
            colours = bits.read(8) + 1
            deltas = _sub_image(bits, colours, 1).view(np.uint8).reshape(colours, 4)
            table = np.cumsum(deltas, 0, dtype=np.uint8)
            packed = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
            transforms.append((kind, inner, packed, table))
            inner = -(-inner >> packed)
    stream = _read_stream(bits, inner, height, True)
    return Head(width, height, transforms, stream, bits.at)


# Pixels as (row, column, channel) arrays hold blue, green, red, alpha, as little-endian ARGB words do.


def _mean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + b) >> 1


def _select(left, top, corner):
    to_left, to_top = np.abs(top - corner).sum(), np.abs(left - corner).sum()
    return left if to_left < to_top else top


def _half(a, b):
    d = a - b
    return np.clip(a + (d + (d < 0)) // 2, 0, 255) if (d < 0).any() else np.clip(a + d // 2, 0, 255)


#: left, top, top right, top left to the prediction; modes 0 to 2 have no entry, being done by rows.
PREDICTIONS = {
    3: lambda left, top, right, corner: right,
    4: lambda left, top, right, corner: corner,
    5: lambda left, top, right, corner: _mean(_mean(left, right), top),
    6: lambda left, top, right, corner: _mean(left, corner),
    7: lambda left, top, right, corner: _mean(left, top),
    8: lambda left, top, right, corner: _mean(corner, top),
    9: lambda left, top, right, corner: _mean(top, right),
    10: lambda left, top, right, corner: _mean(_mean(left, corner), _mean(top, right)),
    11: lambda left, top, right, corner: _select(left, top, corner),
    12: lambda left, top, right, corner: np.clip(left + top - corner, 0, 255),
    13: lambda left, top, right, corner: _half(_mean(left, top), corner),
}
OPAQUE = np.array([0, 0, 0, 255], np.int64)


def _unpredict(pixels: np.ndarray, bits: int, modes: np.ndarray) -> np.ndarray:
    height, width, _ = pixels.shape
    out = pixels.astype(np.int64)
    out[0, 0] += OPAQUE
    out[0] = np.cumsum(out[0], 0) & 255
    for y in range(1, height):
        out[y, 0] = (out[y, 0] + out[y - 1, 0]) & 255
        for block in range(-(-width >> bits)):
            a, b = max(1, block << bits), min(width, (block + 1) << bits)
            mode = int((modes[y >> bits, block] >> 8) & 15)
            if a >= b:
                continue
            if mode in (0, 14, 15):
                out[y, a:b] = (out[y, a:b] + OPAQUE) & 255
            elif mode == 1:
                out[y, a:b] = (np.cumsum(out[y, a:b], 0) + out[y, a - 1]) & 255
            elif mode == 2:
                out[y, a:b] = (out[y, a:b] + out[y - 1, a:b]) & 255
            else:
                predict, above = PREDICTIONS[mode], out[y - 1]
                for x in range(a, b):
                    right = above[x + 1] if x + 1 < width else out[y, 0]
                    out[y, x] = (out[y, x] + predict(out[y, x - 1], above[x], right, above[x - 1])) & 255
    return out.astype(np.uint8)


def _uncross(pixels: np.ndarray, bits: int, elements: np.ndarray) -> np.ndarray:
    height, width, _ = pixels.shape
    element = np.repeat(np.repeat(elements, 1 << bits, 0)[:height], 1 << bits, 1)[:, :width]
    signed = lambda x: (x & 255).astype(np.uint8).view(np.int8).astype(np.int64)
    green = signed(pixels[..., 1].astype(np.int64))
    red = (pixels[..., 2] + ((signed(element) * green) >> 5)) & 255
    blue = (pixels[..., 0] + ((signed(element >> 8) * green) >> 5) + ((signed(element >> 16) * signed(red)) >> 5)) & 255
    return np.stack([blue, pixels[..., 1], red, pixels[..., 3]], 2).astype(np.uint8)


def _untransform(pixels: np.ndarray, transforms: list[tuple]) -> np.ndarray:
    for kind, width, *more in reversed(transforms):
        if kind == PREDICTOR:
            pixels = _unpredict(pixels, *more)
        elif kind == CROSS_COLOUR:
            pixels = _uncross(pixels, *more)
        elif kind == SUBTRACT_GREEN:
            pixels = pixels.copy()
            pixels[..., 0] += pixels[..., 1]
            pixels[..., 2] += pixels[..., 1]
        else:
            packed, table = more
            depth = 8 >> packed
            x = np.arange(width)
            index = (pixels[:, x >> packed, 1].astype(np.int64) >> (depth * (x & ((1 << packed) - 1)))) & ((1 << depth) - 1)
            whole = np.zeros((256, 4), np.uint8)
            whole[: len(table)] = table
            pixels = whole[index]
    return pixels


def _finish(head: Head, argb: list[int] | np.ndarray) -> np.ndarray:
    words = np.asarray(argb, np.uint32).astype("<u4").reshape(head.height, head.stream.width)
    return _untransform(words.view(np.uint8).reshape(head.height, head.stream.width, 4), head.transforms)[..., [2, 1, 0, 3]]


def decode(data: bytes) -> np.ndarray:
    """The pixels of a lossless WebP file: an array of rows, columns and red, green, blue, alpha."""
    chunk = _chunk(data)
    head = read_head(chunk)
    return _finish(head, _pixels(BitReader(chunk, head.at), head.stream, []))


#: The longest prefix code whose table goes in lockstep with others.
LOCKSTEP_BITS = 11


def decode_many(images: list[bytes]) -> list[np.ndarray]:
    """decode() of each image; those in which one channel varies, without colour cache and groups of codes, go in lockstep."""
    out: list[np.ndarray | None] = [None] * len(images)
    chunks, heads, together = [_chunk(x) for x in images], [], []
    for k, chunk in enumerate(chunks):
        head = read_head(chunk)
        heads.append(head)
        codes = head.stream.codes
        if len(codes) == 1 and not head.stream.cache_bits and codes[0][0].bits <= LOCKSTEP_BITS and all(c.only is not None for c in codes[0][1:4]):
            together.append(k)
        else:
            out[k] = _finish(head, _pixels(BitReader(chunk, head.at), head.stream, []))
    if together:
        _lockstep(together, chunks, heads, out)
    return out


def _lockstep(rows: list[int], chunks: list[bytes], heads: list[Head], out: list) -> None:
    size = {k: heads[k].stream.width * heads[k].stream.height for k in rows}
    rows = sorted(rows, key=lambda k: -size[k])
    totals = np.array([size[k] for k in rows])
    begin = np.cumsum([0] + [len(chunks[k]) for k in rows])
    data = np.frombuffer(b"".join(chunks[k] for k in rows) + bytes(8 + 2 * int(totals[0])), np.uint8)
    word = data[:-3].astype(np.uint32)
    for k in (1, 2, 3):
        word |= data[k : len(word) + k].astype(np.uint32) << np.uint32(8 * k)
    at = begin[:-1] * 8 + np.array([heads[k].at for k in rows])
    first = [heads[k].stream.codes[0][0] for k in rows]
    table = np.concatenate([(c.symbol << 5 | c.length).astype(np.uint16) for c in first])
    base = np.cumsum([0] + [1 << c.bits for c in first])[:-1]
    mask = np.array([(1 << c.bits) - 1 for c in first], np.uint32)
    green = np.zeros((int(totals[0]), len(rows)), np.uint8)
    stopped = np.full(len(rows), -1)
    where = np.zeros(len(rows), np.int64)
    active = np.searchsorted(-totals, -np.arange(int(totals[0])), "left")  # rows with more pixels than the step
    most = len(data) * 8 - 40
    for step in range(int(totals[0])):
        n = active[step]
        here = at[:n]
        entry = table[base[:n] + ((word[here >> 3] >> (here & 7).astype(np.uint32)) & mask[:n])]
        symbol = entry >> 5
        if symbol.max() > 255:
            for k in np.flatnonzero(symbol > 255):
                if stopped[k] < 0:
                    stopped[k], where[k] = step, here[k]
        green[step, :n] = symbol
        here += entry & 31
        np.minimum(here, most, out=here)
    for k, row in enumerate(rows):
        head = heads[row]
        rest = sum(c.only << s for c, s in zip(head.stream.codes[0][1:4], (16, 0, 24)))
        argb = green[: totals[k], k].astype(np.uint32) << np.uint32(8) | np.uint32(rest)
        if stopped[k] >= 0:
            bits = BitReader(chunks[row], int(where[k] - begin[k] * 8))
            argb = np.array(_pixels(bits, head.stream, argb[: stopped[k]].tolist()), np.uint32)
        out[row] = _finish(head, argb)


def code_lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """Lengths, of at most `most`, of a prefix code for symbols that occur so often; a single symbol has length 1."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) == 1:
        lengths[used] = 1
        return lengths
    weights, floor = counts[used].tolist(), 1
    while True:
        heap = sorted((max(w, floor), k) for k, w in enumerate(weights))
        up = [0] * (2 * len(used) - 1)
        for k in range(len(used), 2 * len(used) - 1):
            (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
            up[x] = up[y] = k
            heapq.heappush(heap, (a + b, k))
        depth = [0] * len(up)
        for k in range(len(up) - 2, -1, -1):
            depth[k] = depth[up[k]] + 1
        if max(depth[: len(used)]) <= most:
            lengths[used] = depth[: len(used)]
            return lengths
        floor *= 2


def _canonical(lengths: np.ndarray) -> np.ndarray:
    """The bits of each symbol's code, first bit lowest."""
    out, value, last = np.zeros(len(lengths), np.int64), 0, 0
    used = np.flatnonzero(lengths)
    for symbol in used[np.lexsort((used, lengths[used]))].tolist():
        n = int(lengths[symbol])
        value <<= n - last
        last = n
        out[symbol] = _flipped(n)[value]
        value += 1
    return out


class BitWriter:
    """Bits, least significant first."""

    def __init__(self):
        self.value, self.at = 0, 0

    def put(self, x: int, n: int) -> None:
        self.value |= x << self.at
        self.at += n

    def only(self, symbol: int) -> None:
        """A code of one symbol."""
        self.put(1 | (symbol > 1) << 2 | symbol << 3, 4 if symbol < 2 else 11)

    def code(self, counts: np.ndarray, most: int = LOCKSTEP_BITS) -> tuple[np.ndarray, np.ndarray]:
        """The code of symbols that occur so often: their bits and their numbers of bits."""
        used = np.flatnonzero(counts)
        if len(used) == 1 and used[0] < 256:
            self.only(int(used[0]))
            return np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
        lengths = code_lengths(counts, most)
        runs = []  # (symbol, extra, its bits)
        at, own = 0, lengths[: used[-1] + 1].tolist()
        while at < len(own):
            end = at + 1
            while end < len(own) and own[end] == own[at]:
                end += 1
            n = end - at
            if own[at]:
                runs += [(own[at], 0, 0)] * n
            else:
                while n >= 3:
                    k = min(n, 138)
                    runs.append((18, k - 11, 7) if k > 10 else (17, k - 3, 3))
                    n -= k
                runs += [(0, 0, 0)] * n
            at = end
        first = code_lengths(np.bincount([r[0] for r in runs], minlength=19), 7)
        bits = _canonical(first)
        last = max(CODE_LENGTH_ORDER.index(k) for k in np.flatnonzero(first).tolist())
        self.put(0, 1)
        self.put(max(0, last - 3), 4)
        for k in CODE_LENGTH_ORDER[: max(4, last + 1)]:
            self.put(int(first[k]), 3)
        n = len(runs) - 2
        wide = max(1, -(-max(1, n.bit_length()) // 2))
        self.put(1 | (wide - 1) << 1 | n << 4, 4 + 2 * wide)
        single = np.count_nonzero(first) == 1
        for symbol, extra, more in runs:
            if not single:
                self.put(int(bits[symbol]), int(first[symbol]))
            self.put(extra, more)
        return _canonical(lengths), lengths if np.count_nonzero(lengths) > 1 else np.zeros(len(lengths), np.int64)


def _length_symbol(length: int) -> tuple[int, int, int]:
    """Prefix symbol, extra bits and their number for a length."""
    if length <= 4:
        return length - 1, 0, 0
    x = length - 1
    high = x.bit_length() - 1
    second = (x >> (high - 1)) & 1
    return 2 * high + second, x & ((1 << (high - 1)) - 1), high - 1


#: Most different bytes of an image with a palette, and its pixels in a sample, as powers of 2.
PALETTES = ((2, 3), (4, 2), (16, 1))
#: Bytes by which predicted symbols must be cheaper.
LEAST_GAIN = 16


def _cost(counts: np.ndarray) -> float:
    """Bytes that symbols of these counts take, about."""
    counts = counts[counts > 0]
    return float((counts * (np.log2(counts.sum()) - np.log2(counts))).sum() / 8)


def _predicted(part: np.ndarray) -> tuple[int, np.ndarray]:
    """The predictor's mode, 0 for none, and the symbols that are left: 1 from the left, 2 from above."""
    from_left = np.diff(part, prepend=np.uint8(0))
    choices = {0: part}
    if len(part) > WIDTH:
        grid = part.reshape(-1, WIDTH)
        left = from_left.reshape(-1, WIDTH).copy()
        left[1:, 0] = grid[1:, 0] - grid[:-1, 0]  # a row's first pixel is predicted from above, the first row from the left
        above = left.copy()
        above[1:] = grid[1:] - grid[:-1]
        choices |= {1: left.ravel(), 2: above.ravel()}
    else:
        choices[1] = from_left
    costs = {mode: _cost(np.bincount(x, minlength=256)) + LEAST_GAIN * (mode > 0) for mode, x in choices.items()}
    mode = min(costs, key=lambda k: (costs[k], k))
    return mode, choices[mode]


def _encode(part: np.ndarray) -> bytes:
    """A lossless WebP image of grey samples, in rows of WIDTH."""
    bits = BitWriter()
    for x, n in ((0x2F, 8), (WIDTH - 1, 14), (len(part) // WIDTH - 1, 14), (0, 4)):
        bits.put(x, n)
    seen = np.flatnonzero(np.bincount(part, minlength=256))
    packed = next((k for most, k in PALETTES if len(seen) <= most), 0)
    if packed:
        bits.put(1 | PALETTE << 1 | len(seen) - 1 << 3, 11)
        deltas = np.diff(seen, prepend=0)
        bits.put(0, 1)
        codes = [bits.code(np.bincount(deltas, minlength=280)), *(bits.code(np.bincount(deltas, minlength=256)) for _ in range(2)), bits.code(np.bincount([255] + [0] * (len(seen) - 1), minlength=256))]
        bits.only(0)
        for k, d in enumerate(deltas.tolist()):
            for (code, length), x in zip(codes, (d, d, d, 0 if k else 255)):
                bits.put(int(code[x]), int(length[x]))
        depth, each = 8 >> packed, 1 << packed
        index = np.searchsorted(seen, part).reshape(-1, each)
        symbol, alpha = (index << depth * np.arange(each)).sum(1), 255
    else:
        mode, symbol = _predicted(part)
        alpha = 0 if mode else 255
        if mode:
            bits.put(1 | PREDICTOR << 1 | 7 << 3, 6)  # tiles of 512 pixels
            bits.put(0, 1)
            for x in (mode, 0, 0, 0, 0):
                bits.only(x)
        bits.put(1 | SUBTRACT_GREEN << 1, 3)
    bits.put(0, 3)  # no more transforms, no colour cache, one group of codes
    other = np.flatnonzero(symbol != symbol[-1])
    run = min(len(symbol) - (int(other[-1]) + 1 if len(other) else 0), 4097)
    literal, counts = symbol.astype(np.int64), None
    if run >= 8:
        literal = literal[: len(literal) - run + 1]
        prefix, extra, more = _length_symbol(run - 1)
    counts = np.bincount(literal, minlength=280)
    if run >= 8:
        counts[256 + prefix] += 1
    code, length = bits.code(counts)
    for x in (0, 0, alpha, 1):  # red, blue, alpha, and every distance is one pixel to the left
        bits.only(x)
    codes, lengths = code[literal], length[literal]
    if run >= 8:
        codes, lengths = np.append(codes, [code[256 + prefix], extra]), np.append(lengths, [length[256 + prefix], more])
    ends = np.cumsum(lengths) + bits.at
    at = ends - lengths
    size = -(-int(ends[-1]) // 8)
    data = np.zeros(size + 3, np.uint8)
    shifted = codes << (at & 7)
    for k in range(3):
        data += np.bincount((at >> 3) + k, (shifted >> (8 * k)) & 255, len(data) + 3).astype(np.uint8)[: len(data)]
    head = np.frombuffer(bits.value.to_bytes(-(-bits.at // 8), "little"), np.uint8)
    data[: len(head)] += head
    chunk = data[:size].tobytes()
    body = b"WEBPVP8L" + struct.pack("<I", len(chunk)) + chunk + b"\0" * (len(chunk) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def encode_samples(payload: bytes) -> list[bytes]:
    """Lossless WebP images whose grey samples are the payload, a positive multiple of WIDTH bytes."""
    x = np.frombuffer(payload, np.uint8)
    if not len(x) or len(x) % WIDTH:
        raise ValueError(f"a payload is a positive multiple of {WIDTH} bytes")
    return [_encode(x[a : a + WIDTH * ROWS]) for a in range(0, len(x), WIDTH * ROWS)]


def split_images(media: bytes) -> list[bytes]:
    """The files of which `media` is made up."""
    out, at = [], 0
    while at < len(media):
        size = 8 + struct.unpack_from("<I", media, at + 4)[0]
        out.append(media[at : at + size])
        at += size
    return out


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 500):
            part, sizes, media = batch.slice(a, 500), [], []
            for text in part.column(1).to_pylist():
                own = (text or "").encode()
                sizes.append(len(own))
                media.append(b"".join(encode_samples(own + b"\xff" * (-len(own) % WIDTH if own else WIDTH))))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each whole text (null: empty), as UTF-8 and filled with bytes 255 to a positive multiple of WIDTH, as lossless WebP.

    A row a row: repeated rows and null ids are rows of their own, equal texts have equal media, a text of any length is
    as many images as it takes, an empty table gives no rows, and other columns are ignored.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def sample_features(x: np.ndarray) -> str:
    """Rows, mean, deviation and mean step between neighbours of grey samples, exact to the digits shown."""
    n, whole = len(x), x.astype(np.int64)
    total, squares, steps = int(whole.sum()), int((whole * whole).sum()), int(np.abs(np.diff(whole)).sum())
    return f"rows={n // WIDTH};mean={total * 1000 // n};var={(squares * n - total * total) * 1000 // (n * n)};step={steps * 1000 // max(1, n - 1)}"


def _examine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, images, begin, size = [], [], [], 0

        def close():
            grey = [x[..., 1].ravel() for x in decode_many(images)]
            found = []
            for (doc_id, n_bytes, media), a, b in zip(rows, begin, [*begin[1:], len(images)]):
                x = np.concatenate(grey[a:b])
                payload = x.tobytes()
                found.append((doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), sample_features(x)))
            types = (*[pa.int64()] * 3, pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

        for doc_id, n_bytes, media in zip(*(c.to_pylist() for c in batch.columns)):
            own = split_images(media)
            rows.append((doc_id, n_bytes, media))
            begin.append(len(images))
            images += own
            size += len(media)
            if size > 6 << 20 or len(images) >= 4096:
                yield close()
                rows, images, begin, size = [], [], [], 0
        if rows:
            yield close()


def examine_media(stored: DataFrame) -> DataFrame:
    """What the stored bytes hold, read back: sizes, digests and features of each row of doc_id, n_bytes, media.

    A row a row, as in store_texts(); damaged media fail, as they are this module's own.
    """
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(_examine, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def _decode_column(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, media in zip(*(c.to_pylist() for c in batch.columns)):
            try:
                x = None if media is None else decode(media)
            except ValueError as e:
                x = str(e)
            bad, none = isinstance(x, str), not isinstance(x, np.ndarray)
            values = (key, None if none else x.shape[1], None if none else x.shape[0], None if none else x.tobytes(), x if bad else None)
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (batch.column(0).type, pa.int32(), pa.int32(), pa.binary(), pa.string()))], ["key", "width", "height", "rgba", "error"])


def pixels(media: DataFrame, key: str, column: str) -> DataFrame:
    """key, width, height and rgba (rows of four bytes a pixel) of a column of WebP files; null media give nulls, damaged ones an error."""
    own = media.select(F.col(key).alias("key"), F.col(column).cast("binary").alias("media"))
    return own.mapInArrow(_decode_column, f"key {own.schema['key'].dataType.simpleString()}, width int, height int, rgba binary, error string")
