"""Vectorised text primitives shared by the training-data operators.

Everything works straight on the UTF-8 bytes of Arrow string columns, a bounded number of bytes at a time, so no
Python object is made for a word.  A word is a maximal run of bytes other than space and 0x09-0x0D; null texts count
as empty.  Hashes are 64-bit and the same in every process.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), element by element."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE_CODE = mix64(np.arange(1, 257, dtype=_U) * _ODD)
_FOLDED_CODE = _BYTE_CODE[LOWER]
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(SLICE_BYTES, n)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=_U)
    return _powers


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets (one more than rows) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(data: np.ndarray, offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about `most` bytes; a longer row is a run of its own."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the index of each row's first word (one more than rows)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~IS_SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | cut[1:-1]
    ends = solid
    ends = ends & np.append(~solid[1:] | cut[1:-1], True)
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_counts(column) -> np.ndarray:
    """Words of each row."""
    data, offsets = utf8(column)
    out = np.zeros(len(offsets) - 1, np.int64)
    for a, b, part, ends in slices(data, offsets):
        out[a:b] = np.diff(words(part, ends)[2])
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word (A-Z lower-cased if `fold`) and the index of each row's first word."""
    starts, ends, first = words(data, offsets)
    if not len(starts):
        return np.zeros(0, _U), first
    power, inverse = _power_tables(len(data))
    total = (_FOLDED_CODE if fold else _BYTE_CODE)[data]
    total *= power[: len(data)]
    np.cumsum(total, out=total)
    value = total[ends - 1]
    value[1:] -= total[starts[1:] - 1]
    if starts[0]:
        value[:1] -= total[starts[0] - 1 : starts[0]]
    value *= inverse[starts]
    return mix64(value + (ends - starts).astype(_U) * _ODD), first


def _place(j: int) -> np.uint64:
    return mix64(np.array([j + 1000], _U))[0] | _U(1)


def shingles(word: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words of each row and the index of each row's first; a row of fewer words has one, of them all."""
    counts = np.diff(first)
    n = len(word)
    made = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    begin = np.concatenate(([0], np.cumsum(made)))
    out = np.zeros(begin[-1], _U)
    if n >= k:
        run = np.zeros(n - k + 1, _U)
        for j in range(k):
            run += word[j : n - k + 1 + j] * _place(j)
        full = counts >= k
        at = np.repeat(first[:-1][full] - begin[:-1][full], made[full]) + np.flatnonzero(np.repeat(full, made))
        out[np.repeat(full, made)] = run[at]
    for short in range(1, k):
        rows = np.flatnonzero(counts == short)
        if len(rows):
            value = np.full(len(rows), short, _U) * _ODD
            for j in range(short):
                value += word[first[rows] + j] * _place(j)
            out[begin[rows]] = value
    return mix64(out), begin


def distinct_shingles(column, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    data, offsets = utf8(column)
    for a, b, part, ends in slices(data, offsets):
        value, begin = shingles(*word_hashes(part, ends), k)
        for row in range(b - a):
            yield np.unique(value[begin[row] : begin[row + 1]])


#: The least and the largest size of a bitmap, as powers of 2, and its bits for each id in between.
LEAST_BITS, MOST_BITS, BITS_PER_ID = 16, 28, 32


def id_bits(ids: np.ndarray, bits: int) -> np.ndarray:
    """Places of ids in a bitmap."""
    return (mix64(ids.view(_U)) % _U(bits)).astype(np.int64)


def _id_places(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            at = id_bits(np.asarray(batch.column(0)), bits)
            np.bitwise_or.at(bitmap, at >> 3, (1 << (at & 7)).astype(np.uint8))
        used = np.flatnonzero(bitmap)
        yield pa.RecordBatch.from_arrays([pa.array([used.astype(np.uint32).tobytes()], pa.binary()), pa.array([bitmap[used].tobytes()], pa.binary())], ["at", "bits"])

    return run


def id_bitmap(ids, parts: int = 4) -> np.ndarray:
    """A bitmap of the first column (longs, none null) of a materialised DataFrame: it holds all ids, and some others by chance.

    Its size follows the number of ids, up to 2 ** MOST_BITS bits; with more ids, it holds more others.
    """
    bits = 1 << min(MOST_BITS, max(LEAST_BITS, (ids.count() * BITS_PER_ID).bit_length()))
    bitmap = np.zeros(bits // 8, np.uint8)
    for row in ids.coalesce(parts).mapInArrow(_id_places(bits), "at binary, bits binary").collect():  # at most `parts` bitmaps
        bitmap[np.frombuffer(row["at"], np.uint32)] |= np.frombuffer(row["bits"], np.uint8)
    return bitmap


def rows_with_id(docs, bitmap, inside: bool = True, column: str = "doc_id"):
    """The rows of a DataFrame whose `column` (long) the (broadcast) bitmap holds, or does not; null is not held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(column)).cast(pa.int64())
            at = id_bits(np.asarray(pc.fill_null(ids, 0)), len(bitmap.value) * 8)
            held = ((bitmap.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1) & np.asarray(pc.is_valid(ids))
            yield batch.filter(pa.array(held if inside else ~held))

    return docs.mapInArrow(releasing(run), docs.schema)


def releasing(run):
    """A function over batches that gives its worker's memory back at the end."""

    def own(batches):
        yield from run(batches)
        release()

    return own


def _steady() -> None:
    """Large arrays go back to the system as soon as they are freed, in this and in Arrow's memory."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        ctypes.CDLL("libc.so.6").mallopt(-3, 8 << 20)  # the size from which memory is mapped by itself, which else grows
    except (OSError, AttributeError):  # another C library
        pass


_steady()


def release() -> None:
    """Give memory that a worker no longer uses back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
