"""Cross-entropy difference scoring with a target and a background bigram model.

Both models have the same order, smoothing and vocabulary (all words of either corpus, V of them):

    p(w | v) = (count(v w) + MASS / V) / (count(v) + MASS)

A document's score is the mean, over its tokens, of the loss under the target model less that under the background
model: low for documents like the target.

Neither model is ever in one place.  The log of a probability is a term of the bigram less a term of its context, so the
occurrences of each bigram and context go to the cell that its hash names, are counted there, in both corpora, and what
comes back is summed for each document.  The number of cells grows with the texts and a task holds one at a time.

Keys that are everywhere don't travel: the MOST_HOT most frequent ones, as far as batches see them, are a table of a
bounded size; their occurrences are counted, and then looked up, where the texts are.  Which keys are in it decides how
evenly the cells are filled, never a count.  Counts are exact but for collisions of hashes: 64 bits in the
table, and 48 bits within a cell, which holds about as many keys at every size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm import kernel
from rankloom.session import shared_dir

MASS = 100.0
#: Stands for a null doc_id while sums travel.
NO_ID = -(1 << 63)
#: Bytes of text that a batch counts or sends at a time, and of text to each cell.
SENT_BYTES, CELL_BYTES = 6 << 20, 4 << 20
#: Keys that are looked up where the texts are, and how often a bigram occurs in a batch that proposes it.
MOST_HOT, PROPOSED = 1 << 15, 8
BIGRAM, CONTEXT = 0, 1
_U = np.uint64
_START = kernel.mix64(np.array([0xB05], _U))[0]


def _terms(column) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, hash of the bigram, hash of its context) of each token, and the hash of each row's last word, by runs of rows."""
    data, offsets = kernel.utf8(column)
    for a, b, own, ends in kernel.slices(data, offsets):
        word, first = kernel.word_hashes(own, ends)
        before = np.empty_like(word)
        before[1:] = word[:-1]
        full = np.diff(first) > 0
        before[first[:-1][full]] = _START
        yield np.repeat(np.arange(a, b), np.diff(first)), kernel.mix64(before * _U(0x9E3779B97F4A7C15) + word), kernel.mix64(before + _U(1)), kernel.mix64(word[first[1:][full] - 1] + _U(1))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, tuple]]:
    """Ids and joined terms of runs of rows of about SENT_BYTES of text."""
    for batch in batches:
        ids = np.asarray(batch.column(0))
        data, offsets = kernel.utf8(batch.column(1))
        for a, b, own, _ in kernel.slices(data, offsets, SENT_BYTES):
            if len(own):
                yield ids[a:b], tuple(map(np.concatenate, zip(*_terms(batch.column(1).slice(a, b - a)))))


def _cell(key: np.ndarray, cells: int) -> np.ndarray:
    """The cell of each key; keys in order have cells in order."""
    return ((key >> _U(32)) * _U(cells) >> _U(32)).astype(np.int64)


def _by_cell(key: np.ndarray, cells: int) -> Iterator[tuple[int, int, int]]:
    """(cell, begin, end) of sorted keys."""
    cell = _cell(key, cells)
    cut = np.flatnonzero(np.diff(cell)) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(cell)]):
        if b > a:
            yield int(cell[a]), a, b


def _seen(parts: int):
    """By partition: the contexts of a run of texts, last words too, and the bigrams that are frequent in it, with how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (_, bigram, context, last) in _runs(batches):
            key, at = np.unique(np.concatenate([context, last]), return_inverse=True)
            pair, times = np.unique(bigram, return_counts=True)
            many = times >= PROPOSED
            kind = np.concatenate([np.full(len(key), CONTEXT, np.int8), np.full(int(many.sum()), BIGRAM, np.int8)])
            times = np.concatenate([np.bincount(at[: len(context)], minlength=len(key)), times[many]]).astype(np.uint32)
            key = np.concatenate([key, pair[many]])
            order = np.argsort(key, kind="stable")
            key, kind, times = key[order], kind[order], times[order]
            rows = [(p, *(x[a:b].tobytes() for x in (key, kind, times))) for p, a, b in _by_cell(key, parts)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 3))], ["part", "keys", "kinds", "times"])

    return run


def _most(most: int):
    """Of a partition: its number of contexts, and its `most` most frequent keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, kind, total = np.zeros(0, _U), np.zeros(0, np.int8), np.zeros(0, np.int64)
        for batch in batches:
            rows = [[np.frombuffer(x, t) for x, t in zip(row, (_U, np.int8, np.uint32))] for row in zip(*(c.to_pylist() for c in batch.columns[1:]))]
            keys, kinds, times = (np.concatenate([own, *more]) for own, more in zip((key, kind, total), zip(*rows)))
            key, first, at = np.unique(keys, return_index=True, return_inverse=True)
            kind, total = kinds[first], np.bincount(at, times, len(key)).astype(np.int64)
        own = np.lexsort((key, -total))[:most]
        values = (int((kind == CONTEXT).sum()), key[own].tobytes(), kind[own].tobytes(), total[own].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int64(), *[pa.binary()] * 3))], ["n", "keys", "kinds", "times"])

    return run


_CHUNK = 4096


def _count(keys, target: bool):
    """How often each of the sorted keys occurs in a partition, by chunks of _CHUNK keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = keys.value[0]
        table, total = Names(names), np.zeros(len(names) + 1, np.int64)
        for _, (_, bigram, context, _) in _runs(batches):
            for key in (bigram, context):
                total += np.bincount(table.places(key), minlength=len(total))
        rows = [(k // _CHUNK, target, total[k : min(len(names), k + _CHUNK)].tobytes()) for k in range(0, len(names), _CHUNK)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.bool_(), pa.binary()))], ["chunk", "target", "times"])

    return run


def _packed_keys(key: np.ndarray, cells: int) -> bytes:
    """What tells the keys of a cell apart: the first 48 bits behind those that name the cell."""
    sub = key * _U(cells) >> _U(16)
    return (sub >> _U(16)).astype(np.uint32).tobytes() + sub.astype(np.uint16).tobytes()


def _unpacked_keys(packed: bytes) -> np.ndarray:
    n = len(packed) // 6
    return np.frombuffer(packed, np.uint32, n).astype(_U) << _U(16) | np.frombuffer(packed, np.uint16, n, 4 * n)


def _packed_ids(ids: np.ndarray) -> tuple[bytes, bytes]:
    """The least id and the distances from it, or nothing and the ids themselves if they are too far apart."""
    least = ids.min()
    if int(ids.max()) - int(least) < 1 << 32:
        return least.tobytes(), (ids - least).astype(np.uint32).tobytes()
    return b"", ids.tobytes()


def _unpacked_ids(least: bytes, ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, np.uint32).astype(np.int64) + np.frombuffer(least, np.int64)[0] if least else np.frombuffer(ids, np.int64)


class Names:
    """A lookup of sorted keys by their first BITS bits."""

    BITS = 20

    def __init__(self, names: np.ndarray):
        self.names = names
        self.start = np.searchsorted(names, np.arange(1 << self.BITS, dtype=_U) << _U(64 - self.BITS)).astype(np.int32)
        self.start = np.append(self.start, np.int32(len(names)))
        self.most = int(np.diff(self.start).max()) if len(names) else 0

    def places(self, key: np.ndarray) -> np.ndarray:
        """Where the keys are among the names; the number of names for others."""
        out = np.full(len(key), len(self.names), np.int64)
        first = (key >> _U(64 - self.BITS)).astype(np.int64)
        at, end, rows = self.start[first], self.start[first + 1], None
        for k in range(self.most):
            rows = np.flatnonzero(at < end) if rows is None else rows[at[rows] + k < end[rows]]
            same = self.names[at[rows] + k] == key[rows]
            out[rows[same]] = at[rows[same]] + k
        return out


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple[int, bool], np.ndarray] = {}
    for batch in batches:
        for chunk, target, times in zip(*(c.to_pylist() for c in batch.columns)):
            times = np.frombuffer(times, np.int64)
            total[chunk, target] = total[chunk, target] + times if (chunk, target) in total else times
    for (chunk, target), times in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((chunk, target, times.tobytes()), (pa.int32(), pa.bool_(), pa.binary()))], ["chunk", "target", "times"])


def _losses(kind: np.ndarray | int, counts: np.ndarray, vocabulary: int, mass: float) -> np.ndarray:
    """The terms of the loss that keys of these kinds and counts stand for."""
    return np.where(kind == BIGRAM, -np.log(counts + mass / vocabulary), np.log(counts + mass))


def hot_keys(docs: DataFrame, target: DataFrame, parts: int, most: int) -> tuple[int, np.ndarray, np.ndarray]:
    """The size of the vocabulary, and the sorted keys and kinds of about the `most` most frequent keys."""
    seen = docs.unionAll(target).mapInArrow(_seen(parts), "part int, keys binary, kinds binary, times binary")
    found = seen.repartitionById(parts, F.col("part")).mapInArrow(_most(-(-2 * most // parts)), "n long, keys binary, kinds binary, times binary").collect()  # at most about 2 * most keys
    keys, kinds, times = (np.concatenate([np.zeros(0, t), *(np.frombuffer(r[name], t) for r in found)]) for name, t in (("keys", _U), ("kinds", np.int8), ("times", np.int64)))
    own = np.lexsort((keys, -times))[:most]
    own = own[np.argsort(keys[own])]
    return max(1, sum(r["n"] for r in found) - 1), keys[own], kinds[own]  # the start of a text is a context, and no word


def hot_terms(docs: DataFrame, target: DataFrame, parts: int, vocabulary: int, mass: float, keys: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys and their terms under the target and the background model, from all their occurrences."""
    names = docs.sparkSession.sparkContext.broadcast((keys,))
    counted = docs.mapInArrow(_count(names, False), "chunk int, target boolean, times binary").unionAll(target.mapInArrow(_count(names, True), "chunk int, target boolean, times binary"))
    total = {True: np.zeros(len(keys), np.int64), False: np.zeros(len(keys), np.int64)}
    for row in counted.repartition(min(parts, 8), "chunk").mapInArrow(_added, "chunk int, target boolean, times binary").collect():  # two counts a key
        times = np.frombuffer(row["times"], np.int64)
        total[row["target"]][row["chunk"] * _CHUNK : row["chunk"] * _CHUNK + len(times)] += times
    return keys, _losses(kinds, total[True], vocabulary, mass), _losses(kinds, total[False], vocabulary, mass)


#: Occurrences of a cell's keys; rows of the kind KNOWN hold what is known of documents without a cell.
_SENT = "part int, cell int, kind int, target boolean, keys binary, least binary, times binary, ids binary"
KNOWN = 2


def _send(hot, target: bool, cells: int, parts: int):
    """Occurrences of what isn't hot by cell: keys by document for the background, keys alone for the target; and the sums of what is hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (*[pa.int32()] * 3, pa.bool_(), *[pa.binary()] * 4)
        names, *terms = hot.value
        table = Names(names)
        terms = [np.append(t, 0.0) for t in terms]
        for ids, (row, bigram, context, _) in _runs(batches):
            known, rows = [np.zeros(len(ids)), np.zeros(len(ids))], []
            for kind, key in ((BIGRAM, bigram), (CONTEXT, context)):
                place = table.places(key)
                if not target:
                    known = [k + np.bincount(row, t[place], len(ids)) for k, t in zip(known, terms)]
                rest = place == len(names)
                key, at = key[rest], np.zeros(int(rest.sum()), np.int64) if target else row[rest]
                order = np.argsort(key, kind="stable")  # rows are in order already
                key, at = key[order], at[order]
                fresh = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (at[1:] != at[:-1]))) if len(key) else np.zeros(0, np.int64)
                times = np.diff(np.append(fresh, len(key)))
                key, at = key[fresh], at[fresh]
                for cell, a, b in _by_cell(key, cells):
                    many = times[a:b]
                    least, own = (b"", b"") if target else _packed_ids(ids[at[a:b]])
                    rows.append((cell % parts, cell, kind, target, _packed_keys(key[a:b], cells), least, b"" if many.max() == 1 else many.astype(np.uint8 if many.max() < 256 else np.uint32).tobytes(), own))
            tokens = np.bincount(row, minlength=len(ids)).astype(np.int64)
            own = np.flatnonzero(tokens)
            if len(own) and not target:
                rows.append((int(kernel.mix64(ids[own[:1]].view(_U))[0] % _U(parts)), cells, KNOWN, False, tokens[own].tobytes(), known[0][own].tobytes(), known[1][own].tobytes(), ids[own].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [c.split()[0] for c in _SENT.split(", ")])

    return run


#: Sums that a task holds before it hands them on, or adds up those of the same documents.
MOST_SUMS = 1 << 20
_SUMS = (np.int64, np.int64, np.float64, np.float64)


def _merged(rows: list) -> list[np.ndarray]:
    """ids, tokens, target and background, a row an id."""
    ids, *values = (np.concatenate([np.zeros(0, t), *x]) for t, x in zip(_SUMS, zip(*rows)))
    ids, at = np.unique(ids, return_inverse=True)
    return [ids, *(np.bincount(at, v, len(ids)).astype(t) for v, t in zip(values, _SUMS[1:]))]


def _sum(vocabulary: int, mass: float, parts: int):
    """Partitions sorted by cell and kind to parts of the sums of each document; one cell and kind at a time is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, sums, own, held, aims = [], 0, None, [], []

        def flush():
            merged = _merged(out)
            out.clear()
            part = (kernel.mix64(merged[0].view(_U)) % _U(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            ends = np.searchsorted(part[order], np.arange(parts + 1))
            rows = [(p, *(x[order[ends[p] : ends[p + 1]]].tobytes() for x in merged)) for p in range(parts) if ends[p + 1] > ends[p]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 4))], ["part", "ids", "tokens", "target", "background"])

        def close() -> int:
            """The sums of the held occurrences."""
            if not held:
                aims.clear()
                return 0
            key = [_unpacked_keys(keys) for keys, *_ in held]
            many = np.concatenate([_many(times, len(k)) for k, (_, _, times, _) in zip(key, held)])
            ids = np.concatenate([_unpacked_ids(least, docs) for _, least, _, docs in held])
            held.clear()
            name, place = np.unique(np.concatenate(key), return_inverse=True)
            counts = [np.zeros(len(name) + 1, np.int64), np.bincount(place, many, len(name)).astype(np.int64)]
            for keys, times in aims:
                keys = _unpacked_keys(keys)
                place_of = np.minimum(np.searchsorted(name, keys), len(name) - 1)
                np.add.at(counts[0], np.where(name[place_of] == keys, place_of, len(name)), _many(times, len(keys)))
            aims.clear()
            terms = [_losses(own[1], c[: len(name)], vocabulary, mass) for c in counts]
            docs, at = np.unique(ids, return_inverse=True)
            out.append((docs, np.zeros(len(docs), np.int64), *(np.bincount(at, t[place] * many, len(docs)) for t in terms)))
            return len(docs)

        for batch in batches:
            for _, cell, kind, target, keys, least, times, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if own != (cell, kind):
                    sums += close()
                    own = (cell, kind)
                if kind == KNOWN:
                    ids = np.frombuffer(ids, np.int64)
                    out.append((ids, np.frombuffer(keys, np.int64), np.frombuffer(least, np.float64), np.frombuffer(times, np.float64)))
                    sums += len(ids)
                elif target:
                    aims.append((keys, times))
                else:
                    held.append((keys, least, times, ids))
                if sums > MOST_SUMS:
                    yield from flush()
                    sums = 0
        close()
        if out:
            yield from flush()
        kernel.release()

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of a partition's documents; no more is held than they are, and MOST_SUMS besides."""
    total, found, held = [np.zeros(0, t) for t in _SUMS], [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns[1:])):
            found.append([np.frombuffer(x, t) for x, t in zip(row, _SUMS)])
            held += len(found[-1][0])
            if held > MOST_SUMS:
                total, found, held = _merged([total, *found]), [], 0
    total = _merged([total, *found])
    for a in range(0, len(total[0]), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(x[a : a + (1 << 16)]) for x in total], ["doc_id", "n_tokens", "target", "background"])


def _many(times: bytes, n: int) -> np.ndarray:
    return (np.frombuffer(times, np.uint8 if len(times) == n else np.uint32) if times else np.ones(n, np.uint8)).astype(np.uint32)


def cross_entropy_difference(docs: DataFrame, target: DataFrame, mass: float = MASS, cell_bytes: int = CELL_BYTES, most_hot: int = MOST_HOT) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and score (their difference) of each doc_id of `docs` (doc_id, text).

    The background model is that of `docs`, the target model that of `target` (text).  Words are runs of bytes other than
    white space, A-Z lower-cased.  Rows that share a doc_id (null ids too) are one document; without tokens (null or blank
    text) its losses and score are null; an empty target leaves a uniform model; an empty `docs` gives no rows; texts of any
    length are scored whole; other columns are ignored.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    target = target.select(F.lit(0).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.select("text").unionAll(target.select("text")).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = parts * max(1, -(-size // (parts * cell_bytes)))
    vocabulary, keys, kinds = hot_keys(docs, target, parts, most_hot)
    hot = spark.sparkContext.broadcast(hot_terms(docs, target, parts, vocabulary, mass, keys, kinds))
    sent = docs.mapInArrow(_send(hot, False, cells, parts), _SENT).unionAll(target.mapInArrow(_send(hot, True, cells, parts), _SENT))
    partial = sent.repartitionById(parts, F.col("part")).sortWithinPartitions("cell", "kind").mapInArrow(_sum(vocabulary, mass, parts), "part int, ids binary, tokens binary, target binary, background binary")
    summed = partial.repartitionById(parts, F.col("part")).mapInArrow(_add, "doc_id long, n_tokens long, target double, background double")
    found = docs.select("doc_id").distinct().join(summed, "doc_id", "left")
    loss = lambda c: (F.col(c) / F.col("n_tokens"))
    return found.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), loss("target").alias("target_loss"), loss("background").alias("background_loss"), ((F.col("target") - F.col("background")) / F.col("n_tokens")).alias("score"))
