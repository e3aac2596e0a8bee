"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class is a Gaussian whose covariance is shrunk towards the pooled one and that towards a multiple of the identity;
its Cholesky factor is kept inverted, so a score is two products and a difference of Mahalanobis log-densities.  The fit
uses class counts, sums and sums of products over all labelled rows, added up where the rows are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm import kernel

FEATURES = ("words", "word_bytes", "letters", "upper", "digits", "marks", "rare_marks", "initials", "lines", "distinct", "top_word", "distinct_pairs", "mark_words")
THRESHOLD = 0.3
SHRINK = 0.1
RIDGE = 0.05

_BYTE = np.arange(256)
_UPPER = (_BYTE >= 65) & (_BYTE <= 90)
_DIGIT = (_BYTE >= 48) & (_BYTE <= 57)
_LETTERS = _UPPER | (_BYTE >= 97) & (_BYTE <= 122) | (_BYTE >= 128)
_MARK = ~_LETTERS & ~_DIGIT & ~kernel.IS_SPACE & (_BYTE > 32)
_RARE = _MARK & ~np.isin(_BYTE, np.frombuffer(b".,;:!?'\"()-", np.uint8))
_LINE = _BYTE == 10


def _logit(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.log((part + 0.5) / (np.maximum(whole - part, 0) + 0.5))


def statistics(column) -> np.ndarray:
    """FEATURES of each text: logarithms of counts and log-odds of shares; an empty text has those of zero counts."""
    data, offsets = kernel.utf8(column)
    out = np.zeros((len(offsets) - 1, len(FEATURES)))
    for a, b, own, ends in kernel.slices(data, offsets):
        starts, stops, first = kernel.words(own, ends)
        hashes, _ = kernel.word_hashes(own, ends)

        def count(kind: np.ndarray) -> np.ndarray:
            total = np.concatenate(([0], np.cumsum(kind[own])))
            return (total[ends[1:]] - total[ends[:-1]]).astype(np.float64)

        n = np.diff(first).astype(np.float64)
        letters, upper, digits, marks = count(_LETTERS), count(_UPPER), count(_DIGIT), count(_MARK)
        solid = np.diff(ends) - count(kernel.IS_SPACE)
        begins_upper = np.concatenate(([0], np.cumsum(_UPPER[own[starts]])))
        marked = np.concatenate(([0], np.cumsum(_MARK[own[starts]] & _MARK[own[stops - 1]])))
        distinct, top, pairs = np.zeros(b - a), np.zeros(b - a), np.zeros(b - a)
        for row in range(b - a):
            word = hashes[first[row] : first[row + 1]]
            if len(word):
                times = np.unique(word, return_counts=True)[1]
                distinct[row], top[row] = len(times), times.max()
                pairs[row] = len(np.unique(word[1:] * kernel._ODD + word[:-1]))
        out[a:b] = np.stack(
            [
                np.log1p(n), np.log((solid + 1) / (n + 1)), _logit(letters, solid), _logit(upper, letters), _logit(digits, solid), _logit(marks, solid), _logit(count(_RARE), solid),
                _logit(begins_upper[first[1:]] - begins_upper[first[:-1]], n), np.log1p(count(_LINE)) - np.log1p(n), _logit(distinct, n), _logit(top, n), _logit(pairs, np.maximum(n - 1, 0)), _logit(marked[first[1:]] - marked[first[:-1]], n),
            ], 1,
        )
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = statistics(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))], ["doc_id", "x"])


def features(docs: DataFrame) -> DataFrame:
    """doc_id and its statistics, over the whole text; a null text counts as empty."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_features, "doc_id long, x array<double>")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    d = len(FEATURES)
    total = np.zeros((2, 1 + d + d * d))
    for batch in batches:
        y = np.asarray(batch.column(0))
        x = np.asarray(batch.column(1).flatten()).reshape(-1, d)
        for k in (0, 1):
            own = x[y == k]
            total[k] += np.concatenate(([len(own)], own.sum(0), (own.T @ own).ravel()))
    yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["y", "sums"])


class Discriminant:
    """Means, inverted Cholesky factors and log-weights of two classes; None stands for a class that was never seen."""

    def __init__(self, classes: list[tuple[np.ndarray, np.ndarray, float] | None]):
        self.classes = classes

    @classmethod
    def fit(cls, sums: np.ndarray, shrink: float = SHRINK, ridge: float = RIDGE) -> Discriminant:
        """From a row of counts, sums and sums of products for each class."""
        d, n = len(FEATURES), sums[:, 0]
        means = [s[1 : d + 1] / max(s[0], 1) for s in sums]
        scatter = [s[d + 1 :].reshape(d, d) - s[0] * np.outer(m, m) for s, m in zip(sums, means)]
        pooled = sum(scatter) / max(n.sum(), 1)
        pooled = (1 - ridge) * pooled + ridge * (np.trace(pooled) / d + 1e-6) * np.eye(d)
        classes = []
        for k in (0, 1):
            if not n[k]:
                classes.append(None)
                continue
            covariance = (1 - shrink) * scatter[k] / n[k] + shrink * pooled
            factor = np.linalg.cholesky(covariance)
            classes.append((means[k], np.linalg.inv(factor), np.log(n[k] / n.sum()) - np.log(np.diag(factor)).sum()))
        return cls(classes)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1; 0.5 without any labels, and that of the only class seen."""
        if None in self.classes:
            return np.full(len(x), 0.5 if self.classes == [None, None] else float(self.classes[1] is not None))
        low, high = (weight - 0.5 * (((x - mean) @ inverse.T) ** 2).sum(1) for mean, inverse, weight in self.classes)
        return 1 / (1 + np.exp(np.clip(low - high, -700, 700)))


def train(documents: DataFrame, labels: DataFrame) -> Discriminant:
    """Fit on all rows of `documents` (doc_id, x) with a `quality` of 0 or 1 in `labels` (doc_id, quality); other labels and null ids teach nothing."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("y in (0, 1)")
    partial = documents.join(known, "doc_id").select("y", "x").mapInArrow(_sums, "y int, sums array<double>")
    total = np.zeros((2, 1 + len(FEATURES) + len(FEATURES) ** 2))
    for row in partial.select("y", F.posexplode("sums").alias("at", "v")).groupBy("y", "at").agg(F.sum("v").alias("v")).collect():  # two rows for each sum
        total[row["y"], row["at"]] = row["v"]
    return Discriminant.fit(total)


def score(documents: DataFrame, model: Discriminant, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted for rows of doc_id and x; nothing else is looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = model.score(np.asarray(batch.column(1).flatten()).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value), pa.array((value >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return documents.select("doc_id", "x").mapInArrow(run, "doc_id long, score double, predicted int")
