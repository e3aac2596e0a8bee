"""The best k vectors of each query within a task: cosines by matrix products of blocks, what may count by exact sums.

Products of blocks only leave out what is surely behind the k-th.  What is left is summed in the order of `stats.dot`, so scores
are those of the same pairs in Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.session import saved

DIGITS = 6
#: Cosines of a block.
BLOCK = 1 << 22
#: Bytes of query vectors that are broadcast at most.
MOST_BROADCAST = 64 << 20
#: By how much the products of blocks may differ from exact sums, amply.
NOISE = 1e-9
EMPTY = np.iinfo(np.int64).min
FOUND = "case_id long, doc_id long, score double"


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Arrays of equal length as rows."""
    own = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return own.flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors divided by their norms, summed in the order of `stats.norm`."""
    own, size = vectors.astype(float), np.zeros(len(vectors))
    for j in range(own.shape[1]):
        size += own[:, j] * own[:, j]
    return own / np.sqrt(size)[:, None]


def rounded(scores: np.ndarray) -> np.ndarray:
    """Scores in units of the last digit, rounded as Spark does, half up."""
    size = np.abs(scores) * 10.0**DIGITS
    out = np.floor(size + 0.5)
    for k in np.nonzero(np.abs(size - np.floor(size) - 0.5) < 1e-4)[0]:
        out[k] = int(Decimal(repr(float(abs(scores[k])))).scaleb(DIGITS).quantize(Decimal(1), ROUND_HALF_UP))
    return (np.sign(scores) * out).astype(np.int64)


class Best:
    """The k best vectors so far of each query, by rounded cosine and then the smaller id; a query's own id (`own`, if it isn't in `ids`) is left out."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, least: np.ndarray | None = None, own: np.ndarray | None = None):
        self.ids, self.queries, self.k, self.own = ids, queries, k, ids if own is None else own
        self.key = np.full((len(ids), k), EMPTY)
        self.doc, self.score = np.zeros((len(ids), k), np.int64), np.zeros((len(ids), k))
        self.floor = np.full(len(ids), -np.inf) if least is None else least - 0.5 * 10.0**-DIGITS - NOISE  # cosines below it can't count

    def offer(self, docs: np.ndarray, vectors: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Meet vectors with all queries, or those in `rows`."""
        rows = np.arange(len(self.ids)) if rows is None else rows
        step = max(1, BLOCK // max(1, len(docs)))
        for at in range(0, len(rows), step):
            self._block(docs, vectors, rows[at : at + step])

    def _block(self, docs: np.ndarray, vectors: np.ndarray, own: np.ndarray) -> None:
        cosines = self.queries[own] @ vectors.T
        cosines[self.own[own][:, None] == docs[None, :]] = -np.inf
        least = np.maximum(self.floor[own], -2.0)
        cold = np.nonzero(least == -2.0)[0]
        if len(cold) and len(docs) > self.k:
            place = len(docs) - self.k
            least[cold] = np.maximum(-2.0, np.partition(cosines[cold], place, axis=1)[:, place] - 10.0**-DIGITS - NOISE)
        q, d = np.nonzero(cosines >= least[:, None])
        if not len(q):
            return
        score = np.zeros(len(q))
        for j in range(vectors.shape[1]):
            score += self.queries[own[q], j] * vectors[d, j]
        touched, group = np.unique(q, return_inverse=True)
        mine = own[touched]
        known = self.key[mine] != EMPTY
        group = np.concatenate([np.nonzero(known)[0], group])
        key = np.concatenate([self.key[mine][known], rounded(score)])
        doc = np.concatenate([self.doc[mine][known], docs[d]])
        score = np.concatenate([self.score[mine][known], score])
        order = np.lexsort((doc, -key, group))
        group = group[order]
        place = np.arange(len(group)) - np.searchsorted(group, np.arange(len(touched)))[group]
        kept = place < self.k
        at = (mine[group[kept]], place[kept])
        self.key[at], self.doc[at], self.score[at] = key[order][kept], doc[order][kept], score[order][kept]
        last = self.key[mine, self.k - 1]
        self.floor[mine] = np.where(last == EMPTY, self.floor[mine], np.maximum(self.floor[mine], (last - 0.5) * 10.0**-DIGITS - NOISE))

    def batches(self, rows: int = 100_000) -> Iterator[pa.RecordBatch]:
        q, c = np.nonzero(self.key != EMPTY)
        for at in range(0, len(q), rows):
            i, j = q[at : at + rows], c[at : at + rows]
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[i]), pa.array(self.doc[i, j]), pa.array(self.score[i, j])], ["case_id", "doc_id", "score"])


def in_groups(asked: DataFrame, find: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`find` of the queries (case_id, q), a group at a time that may be broadcast; each group's result is saved if there are more than one."""
    size = asked.agg(F.sum(F.size("q") * 8 + 16)).first()[0] or 0
    groups = -(-size // MOST_BROADCAST)
    if groups <= 1:
        return find(asked)
    found = None
    for g in range(groups):
        part = saved(find(asked.where(F.pmod(F.xxhash64("case_id"), F.lit(groups)) == g)))
        found = part if found is None else found.unionByName(part)
    return found


def dealt(vectors: DataFrame) -> DataFrame:
    return vectors.repartition(max(vectors.sparkSession.sparkContext.defaultParallelism, 1), "doc_id")


def sent(asked: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, own ids and vectors of the queries (case_id, own_id, q)."""
    own = asked.select("case_id", "own_id", "q").toArrow()
    return own.column(0).to_numpy(), own.column(1).to_numpy(), matrix(own.column(2)) if len(own) else np.zeros((0, 1))


def scan(vectors: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """case_id, doc_id and score (not rounded), the best k of each task at least, of vectors (doc_id, v) and unit vectors (case_id, own_id, q) of one length."""
    spark, rows = vectors.sparkSession, dealt(vectors)

    def find(part: DataFrame) -> DataFrame:
        shared = spark.sparkContext.broadcast(sent(part))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, own, queries = shared.value
            best = Best(ids, queries, k, own=own)
            for batch in batches:
                if len(batch) and len(best.ids):
                    best.offer(batch.column(0).to_numpy(), unit(matrix(batch.column(1))))
            yield from best.batches()

        return rows.mapInArrow(run, FOUND)

    return in_groups(asked, find)


#: Units of scores that are no numbers: NaN is ahead of all others, null behind them.
NAN, NULL = 10**9, -(10**9)
AHEAD = "place int, at int, n long"


def units(scores: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Scores that Spark has rounded, in units of the last digit."""
    own = scores.to_numpy(zero_copy_only=False) if isinstance(scores, pa.Array) else scores.to_numpy()
    out = np.rint(np.nan_to_num(own) * 10.0**DIGITS).astype(np.int64)
    out[np.isnan(own)] = NAN
    out[scores.is_null().to_numpy(zero_copy_only=False) if isinstance(scores, pa.Array) else scores.is_null().to_numpy()] = NULL
    return out


def cosine_units(vectors: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Rounded cosines in units by vector and query; those that a product of blocks may round otherwise are summed exactly."""
    cosines = vectors @ queries.T
    size = np.abs(cosines) * 10.0**DIGITS
    d, q = np.nonzero(np.abs(size - np.floor(size) - 0.5) < NOISE * 10.0**DIGITS)
    score = np.zeros(len(d))
    for j in range(vectors.shape[1]):
        score += queries[q, j] * vectors[d, j]
    cosines[d, q] = score
    return rounded(cosines.ravel()).reshape(cosines.shape)


class Places:
    """Chosen documents of cases, numbered from 0, with their scores in units: their places among all that are counted.

    Order: score descending, doc_id.  A task keeps for each case how many documents lie between two chosen ones.
    """

    def __init__(self, cases: int, case: np.ndarray, doc: np.ndarray, score: np.ndarray):
        self.case, self.known = case, np.unique(doc)
        self.key = self.keys(score, doc) if len(doc) else np.zeros(0, np.int64)
        order = np.lexsort((self.key, case))
        self.sorted = np.split(self.key[order], np.searchsorted(case[order], np.arange(1, cases)))

    def keys(self, score: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Ascending as the order is: a document lies at a known one or between two."""
        at = np.searchsorted(self.known, docs)
        place = 2 * at + (self.known[np.minimum(at, len(self.known) - 1)] == docs)
        return -score * (2 * len(self.known) + 2) + (place if score.ndim == 1 else place[:, None])

    def tally(self) -> list[np.ndarray]:
        return [np.zeros(len(own) + 1, np.int64) for own in self.sorted]

    def count(self, tally: list[np.ndarray], c: int, keys: np.ndarray) -> None:
        if len(self.sorted[c]):
            tally[c] += np.bincount(np.searchsorted(self.sorted[c], keys, "right"), minlength=len(tally[c]))

    @staticmethod
    def batches(tally: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for c, own in enumerate(tally):
            at = np.flatnonzero(own)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), c, np.int32)), pa.array(at.astype(np.int32)), pa.array(own[at])], ["place", "at", "n"])

    def ranks(self, counted: DataFrame) -> np.ndarray:
        """Ranks of the chosen documents, from what the tasks' tallies hold (place, at, n)."""
        tally = self.tally()
        sums = counted.groupBy("place", "at").agg(F.sum("n").alias("n")).toArrow()
        for c, at, n in zip(*(x.to_numpy() for x in sums.columns)):
            tally[c][at] = n
        rank = np.zeros(len(self.case), np.int64)
        for c in np.unique(self.case):
            mine = self.case == c
            rank[mine] = 1 + np.cumsum(tally[c])[np.searchsorted(self.sorted[c], self.key[mine])]
        return rank


def ahead(vectors: DataFrame, asked: DataFrame, cases: np.ndarray, places: Places) -> DataFrame:
    """Tallies of all vectors (doc_id, v) for the queries (case_id, own_id, q) that are in `cases`, which are in ascending order."""
    spark, rows = vectors.sparkSession, dealt(vectors)
    kept = spark.sparkContext.broadcast(places)

    def find(part: DataFrame) -> DataFrame:
        ids, own, queries = sent(part)
        wanted = np.isin(ids, cases)
        shared = spark.sparkContext.broadcast((np.searchsorted(cases, ids[wanted]), own[wanted], queries[wanted]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (place, own, queries), places = shared.value, kept.value
            tally, step = places.tally(), max(1, BLOCK // 4 // max(1, len(place)))
            for batch in batches:
                for at in range(0, len(batch) if len(place) else 0, step):
                    part = batch.slice(at, step)
                    docs = part.column(0).to_numpy()
                    keys = places.keys(cosine_units(unit(matrix(part.column(1))), queries), docs)
                    met = np.isin(own, docs)
                    for i, c in enumerate(place):
                        places.count(tally, c, keys[docs != own[i], i] if met[i] else keys[:, i])
            yield from places.batches(tally)

        return rows.mapInArrow(run, AHEAD)

    return in_groups(asked, find)


def ahead_of_rows(scored: DataFrame, cases: np.ndarray, places: Places) -> DataFrame:
    """Tallies of rows (case_id, doc_id, score) that Spark has scored and rounded."""
    kept = scored.sparkSession.sparkContext.broadcast((cases, places))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cases, places = kept.value
        tally = places.tally()
        for batch in batches:
            case, keys = batch.column(0).to_numpy(), places.keys(units(batch.column(2)), batch.column(1).to_numpy())
            for own in np.intersect1d(case, cases):
                places.count(tally, np.searchsorted(cases, own), keys[case == own])
        yield from places.batches(tally)

    return scored.select("case_id", "doc_id", "score").mapInArrow(run, AHEAD)
