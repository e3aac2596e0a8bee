"""SentencePiece encoding that keeps, for every piece, the bytes of the text it stands for, and decoding.

A text is normalised first: from every character, the longest prefix that the model's compiled character map knows is
looked up in its double array, for a whole run of texts at a time, and each byte that comes out remembers where it came
from.  The library merges the normalised text, with its own normaliser turned off: the text falls into runs that
no merge can cross, of which only new ones are merged.  A piece's bytes in the normalised text are then projected through
the remembered places to the original text.

Models: byte-pair encoding with byte fallback, without user-defined or unused pieces; others are refused.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm import kernel
from rankloom.session import shared_dir

SPACE = "▁"
#: So many distinct runs are kept at most; runs of texts of more characters aren't.
MOST_RUNS, LONG = 1 << 18, 1 << 22
#: A model is sent to every executor; larger ones are refused.
MOST_MODEL_BYTES = 64 << 20
#: Kinds of pieces, and fields, in the model's file (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def _field(number: int, value: bytes) -> bytes:
    """A field of bytes, fewer than 128, of a message."""
    return bytes([number << 3 | 2, len(value)]) + value


class CharacterMap:
    """The compiled map of a model: a double array over UTF-8 bytes, and the texts that its values point to."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).astype(np.int64)
        self.pool = np.frombuffer(blob, np.uint8, offset=4 + size)
        ends = np.flatnonzero(self.pool == 0)
        self.length = lambda at: ends[np.searchsorted(ends, at)] - at

    @staticmethod
    def _step(unit: np.ndarray) -> np.ndarray:
        return unit >> 10 << ((unit & 512) >> 6)

    def longest(self, data: np.ndarray, starts: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each start, the bytes of the longest known prefix before its limit (0 if none) and where its text is."""
        length, value = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        rows = np.arange(len(starts))
        node = np.full(len(starts), self._step(self.units[:1])[0])
        depth = 0
        while len(rows):
            inside = starts[rows] + depth < limits[rows]
            rows, node = rows[inside], node[inside]
            byte = data[starts[rows] + depth].astype(np.int64)
            node = node ^ byte
            inside = node < len(self.units)
            rows, node, byte = rows[inside], node[inside], byte[inside]
            unit = self.units[node]
            known = unit & 0x800000FF == byte
            rows, node, unit = rows[known], node[known] ^ self._step(unit[known]), unit[known]
            depth += 1
            leaf = unit >> 8 & 1 == 1
            length[rows[leaf]] = depth
            value[rows[leaf]] = self.units[node[leaf]] & 0x7FFFFFFF
        return length, value


class Encoded(NamedTuple):
    """Ids of the pieces of a text, and the bytes of the text that each stands for: end exclusive."""

    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


class Model:
    """A model read from the bytes of its file."""

    def __init__(self, proto: bytes):
        import sentencepiece

        names, kinds, trainer, normaliser = [], [], {}, {}
        for number, value in _fields(proto):
            if number == 1:
                own = dict(_fields(value))
                names.append(own[1].decode())
                kinds.append(own.get(3, NORMAL))
            elif number in (2, 3):
                (trainer if number == 2 else normaliser).update(_fields(value))
        if trainer.get(3) != BPE or not trainer.get(35) or trainer.get(24) or {USER_DEFINED, UNUSED} & set(kinds):
            raise ValueError("the model must be a byte-pair encoding with byte fallback, without user-defined or unused pieces")
        self.begin, self.end = names.index("<s>"), names.index("</s>")
        self.map = CharacterMap(normaliser[2]) if normaliser.get(2) else None
        self.prefix, self.squeeze, self.escape = (bool(normaliser.get(n, 1)) for n in (3, 4, 5))
        #: Bytes of the text that each piece stands for, and of the character that a byte's piece begins (0: it goes on with one).
        self.size = np.array([0 if kind == BYTE else len(name.encode()) for name, kind in zip(names, kinds)])
        byte = [int(name[3:5], 16) if kind == BYTE else 128 for name, kind in zip(names, kinds)]
        self.opens = np.array([0 if b >> 6 == 2 else 1 if b < 128 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4 for b in byte])
        normal = [name for name, kind in zip(names, kinds) if kind == NORMAL]
        joined = {c for name in normal if len(name) > 1 for c in name}
        inner = "".join(map(re.escape, sorted(joined - {SPACE})))
        #: Runs of normalised text that no merge leaves, and a character that joins none; or nothing, where there is no such thing.
        self.run = re.compile(f"{SPACE}*[{inner}]+|{SPACE}+|[^{inner}{SPACE}]+") if inner and "\0" not in joined and all(SPACE not in name.lstrip(SPACE) for name in normal) else None
        self.runs: dict[str, bytes] = {}
        #: Decodes; and merges a text that is normalised already.
        self.decoder = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.merger = sentencepiece.SentencePieceProcessor(model_proto=proto + _field(3, _field(2, b"") + b"\x18\0\x20\0\x28\0"))

    def _merged(self, text: str) -> np.ndarray:
        """Ids of the pieces of a normalised text."""
        if self.run is None or len(text) > LONG:
            return self.merger.encode_as_numpy(text, num_threads=1).astype("<u4")
        runs = self.run.findall(text)
        new = set(runs).difference(self.runs)
        if len(self.runs) + len(new) > MOST_RUNS:
            self.runs.clear()
            new = set(runs)
        if new:
            ids = self.merger.encode_as_numpy("\0".join(new), num_threads=1).astype("<u4")
            ends = np.append(0, np.cumsum(self._sizes(ids)))
            stops = np.cumsum([len(run.encode()) + 1 for run in new])
            begin, end = np.searchsorted(ends, np.append(0, stops[:-1])), np.searchsorted(ends, stops - 1)
            packed = ids.tobytes()
            self.runs.update(zip(new, [packed[4 * a : 4 * b] for a, b in zip(begin.tolist(), end.tolist())]))
        return np.frombuffer(b"".join(map(self.runs.__getitem__, runs)), "<u4")

    def _sizes(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of normalised text for each piece; of the bytes of a character without a piece, the last stands for it."""
        size, opens = self.size[ids], self.opens[ids]
        first = np.flatnonzero(opens)
        size[first + opens[first] - 1] = opens[first]
        return size

    def _mapped(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What the map makes of texts: bytes, the place each came from, and where each one's step through the text began."""
        starts = np.flatnonzero(data & 0xC0 != 0x80)
        after = np.append(starts[1:], len(data))
        if self.map is None:
            return data, np.repeat(starts, after - starts), np.repeat(np.arange(len(starts)), after - starts)
        limits = offsets[np.searchsorted(offsets, starts, "right")]
        length, value = self.map.longest(data, starts, limits)
        used, covered = np.ones(len(starts), bool), 0
        for k in np.flatnonzero(length > after - starts):  # prefixes of several characters, in order
            if starts[k] >= covered:
                covered = starts[k] + length[k]
                used[k + 1 : np.searchsorted(starts, covered)] = False
        starts, length, value, own = starts[used], length[used], value[used], (after - starts)[used]
        known = length > 0
        size = own.copy()
        size[known] = self.map.length(value[known])
        source = np.concatenate([data, self.map.pool])
        begin = np.where(known, value + len(data), starts)
        steps = np.repeat(np.arange(len(starts)), size)
        at = np.arange(len(steps)) - np.repeat(np.cumsum(size) - size, size)
        return source[begin[steps] + at], starts[steps], steps

    def normalised(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The normalised bytes of texts, where each came from in `data`, and where each text's bytes begin."""
        raw, origin, steps = self._mapped(data, offsets)
        begins = np.searchsorted(origin, offsets[:-1])
        if self.squeeze and len(raw):  # spaces at the start of a step go if a space, or nothing, is before it
            blank = raw == 32
            first = np.flatnonzero(np.diff(steps, prepend=-1))
            open_step = np.append(False, blank[:-1])[first]
            open_step[np.isin(first, begins)] = True
            solid = np.cumsum(~blank)
            step = np.cumsum(np.diff(steps, prepend=-1) != 0) - 1
            leading = solid == (solid - ~blank)[first][step]
            kept = ~(blank & leading & open_step[step])
            raw, origin = raw[kept], origin[kept]
            begins = np.searchsorted(origin, offsets[:-1])
        if self.prefix:
            full = np.append(begins[1:], len(raw)) > begins
            raw = np.insert(raw, begins[full], 32)
            origin = np.insert(origin, begins[full], origin[begins[full]])
            begins = begins + np.append(0, np.cumsum(full)[:-1])
        begins = np.append(begins, len(raw))
        if self.escape:
            blank = raw == 32
            size = np.where(blank, 3, 1)
            ends = np.append(0, np.cumsum(size))
            raw, origin = np.repeat(raw, size), np.repeat(origin, size)
            for k, byte in enumerate(SPACE.encode()):
                raw[ends[:-1][blank] + k] = byte
            begins = ends[begins]
        return raw, origin, begins

    def encode(self, column) -> Iterator[Encoded]:
        """The pieces of each text of a string column; null is empty, bytes that are no UTF-8 are U+FFFD."""
        data, offsets = kernel.utf8(column)
        mark = (SPACE if self.escape else " ").encode()
        for _, _, part, ends in kernel.slices(data, offsets):
            part, ends = _valid(part, ends)
            raw, origin, begins = self.normalised(part, ends)
            for row in range(len(ends) - 1):
                own, places = raw[begins[row] : begins[row + 1]].tobytes(), origin[begins[row] : begins[row + 1]] - ends[row]
                last = ends[row + 1] - ends[row]
                while self.squeeze and own.endswith(mark):
                    own = own[: -len(mark)]
                    last = places[len(own)]
                places = np.append(places[: len(own)], last)
                ids = self._merged(own.decode())
                size = self._sizes(ids)
                end = np.cumsum(size)
                yield Encoded(ids, places[end - size], places[end])


def _valid(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    try:
        data.tobytes().decode()
        return data, offsets
    except UnicodeDecodeError:
        rows = [data[a:b].tobytes().decode(errors="replace").encode() for a, b in zip(offsets[:-1], offsets[1:])]
        return np.frombuffer(b"".join(rows), np.uint8), np.append(0, np.cumsum([len(r) for r in rows]))


_models: dict[bytes, Model] = {}


def loaded(proto: bytes) -> Model:
    """The model, kept in the worker."""
    key = hashlib.sha256(proto).digest()
    if key not in _models:
        _models[key] = Model(proto)
    return _models[key]


def _sent(docs: DataFrame, path: str):
    """The model's bytes for every executor, and a bound for batches."""
    proto = Path(path).read_bytes()
    if len(proto) > MOST_MODEL_BYTES:
        raise ValueError(f"the model has more than {MOST_MODEL_BYTES} bytes")
    shared_dir(docs.sparkSession)
    return docs.sparkSession.sparkContext.broadcast(proto)


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`id_column`, ids, starts and ends of every text: pieces without begin and end ids, as arrays of equal length.

    starts and ends are bytes of the original text, end exclusive; of the bytes of a character without a piece, the last has
    its span.  A null or empty text has empty arrays; ids may be null or repeated, a row in gives a row out; texts of any
    length are whole; an empty table gives none; other columns are left out.  `path` is read by the driver.
    """
    proto = _sent(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(proto.value)
        for batch in batches:
            for a in range(0, len(batch), 256):
                own = batch.slice(a, 256)
                found = list(model.encode(own.column(1)))
                first = np.append(0, np.cumsum([len(x.ids) for x in found])).astype(np.int32)
                arrays = [pa.ListArray.from_arrays(first, np.concatenate([np.zeros(0, np.int32), *(getattr(x, name) for x in found)]).astype(np.int32)) for name in Encoded._fields]
                yield pa.RecordBatch.from_arrays([own.column(0), *arrays], [id_column, *Encoded._fields])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text_column).mapInArrow(kernel.releasing(run), f"`{id_column}` {kind}, ids array<int>, starts array<int>, ends array<int>")


def decode(rows: DataFrame, path: str, id_column: str = "doc_id") -> DataFrame:
    """`id_column` and text of rows with `ids`, as the library's decode makes it; null and empty ids give an empty text."""
    proto = _sent(rows, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(proto.value)
        for batch in batches:
            texts = [model.decoder.decode([i for i in ids or [] if i is not None]) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t or "" for t in texts], pa.string())], [id_column, "text"])

    kind = rows.schema[id_column].dataType.simpleString()
    return rows.select(id_column, F.col("ids").cast("array<int>")).mapInArrow(kernel.releasing(run), f"`{id_column}` {kind}, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and spans_sha256 of every text, with begin and end ids.

    spans_sha256 is of the start and end of each piece in turn, as little-endian unsigned 32-bit integers.  Cases are as
    those of `encode`; an empty text has the two ids.
    """
    proto = _sent(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(proto.value)
        edges = [np.array([x], "<u4") for x in (model.begin, model.end)]
        for batch in batches:
            rows = []
            for x in model.encode(batch.column(1)):
                ids = np.concatenate([edges[0], x.ids, edges[1]])
                spans = np.stack([x.starts, x.ends], 1).astype("<u4")
                rows.append((len(ids), *(hashlib.sha256(b).hexdigest() for b in (ids.tobytes(), model.decoder.decode(ids.tolist()).encode(), spans.tobytes()))))
            columns = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0], pa.int64()), *(pa.array(c, pa.string()) for c in columns[1:])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(kernel.releasing(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")
