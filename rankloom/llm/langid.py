"""Language identification by nearest centroid.

A text is the normalised TF-IDF vector of its hashed byte n-grams; every language has several centroids, from spherical
k-means over a bounded sample of its labelled texts; the best cosine decides, and a text too far from every centroid,
for its length, is rejected.  Document frequencies come from all labelled texts, not from the sample, as means over
languages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm import kernel

DIMENSIONS = 8192
GRAMS = (2, 3, 4)
CENTROIDS = 3
#: Labelled texts of each language that k-means looks at, about.
SAMPLE = 1000
#: A text is rejected below this part of a low quantile of the cosines that labelled texts of its length have with their language.
SLACK = 0.4
QUANTILE = 0.05
#: Texts of a cluster with a smaller part of its language's sample are left out, as wrongly labelled, and the rest is
#: clustered again, at most this often.
LEAST_SHARE, TRIMS = 0.05, 4
#: A length with fewer labelled texts of a language has that language's lowest floor, or less if it is shorter than those.
LEAST_TEXTS = 40
#: A model holds centroids of each language; with more labels than this, training fails.
MOST_LANGUAGES = 4096
UNKNOWN = "und"
ROWS = 64

_U = np.uint64
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True
_FOLD = np.where(_LETTER, kernel.LOWER, np.uint8(32)).astype(np.uint8)


def _folded(data: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and the Latin-1 letters; one space for whatever is no letter."""
    out = _FOLD[data]
    if len(out) > 1:
        latin = np.flatnonzero(out[:-1] == 0xC3) + 1
        upper = latin[(out[latin] >= 0x80) & (out[latin] <= 0x9E) & (out[latin] != 0x97)]
        out[upper] += 32
    return out


def _counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hashed n-gram counts, a row each."""
    rows = len(offsets) - 1
    text = _folded(data).astype(_U)
    owner = np.repeat(np.arange(rows), np.diff(offsets))
    total = np.zeros(rows * DIMENSIONS, np.float32)
    for n in GRAMS:
        if len(text) < n:
            continue
        code = np.zeros(len(text) - n + 1, _U)
        blank = np.ones(len(code), bool)
        for j in range(n):
            part = text[j : len(code) + j]
            code = code * _U(257) + part
            blank &= part == 32
        code = ((code * _U(0x9E3779B97F4A7C15)) >> _U(64 - 13)).astype(np.int64)
        whole = (owner[: len(code)] == owner[n - 1 :]) & ~blank
        total += np.bincount((owner[: len(code)] * DIMENSIONS + code)[whole], minlength=rows * DIMENSIONS).astype(np.float32)
    return total.reshape(rows, DIMENSIONS)


def _matrices(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, counts, whether there is a letter) over bounded runs of rows."""
    for at in range(0, len(column), ROWS):
        part = column.slice(at, ROWS)
        data, offsets = kernel.utf8(part)
        for a, b, own, ends in kernel.slices(data, offsets):
            seen = np.concatenate(([0], np.cumsum(_ASCII_LETTER[own])))
            letter = seen[ends[1:]] > seen[ends[:-1]]
            for row in np.flatnonzero(~letter & (np.diff(ends) > 0)):
                letter[row] = any(map(str.isalpha, own[ends[row] : ends[row + 1]].tobytes().decode("utf-8", "replace")))
            yield at + a, at + b, _counts(own, ends), letter


def _normal(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts and document frequencies of each language of a partition."""
    found: dict[str, list] = {}
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        for a, b, counts, letter in _matrices(batch.column(1)):
            for lang in sorted(set(langs[a:b][letter])):
                own = letter & (langs[a:b] == lang)
                total = found.setdefault(lang, [0, np.zeros(DIMENSIONS, np.int64)])
                total[0] += int(own.sum())
                total[1] += (counts[own] > 0).sum(0)
    for lang, (n, df) in found.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([n]), pa.array([df.tolist()], pa.list_(pa.int64()))], ["lang", "n", "df"])
    kernel.release()


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[str, list] = {}
    for batch in batches:
        for lang, n, df in zip(*(c.to_pylist() for c in batch.columns)):
            total = found.setdefault(lang, [0, np.zeros(DIMENSIONS, np.int64)])
            total[0] += n
            total[1] += np.array(df)
    for lang, (n, df) in found.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([n]), pa.array([df.tolist()], pa.list_(pa.int64()))], ["lang", "n", "df"])


def _vectors(idf: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, counts, letter in _matrices(batch.column(1)):
                vector = _normal(np.sqrt(counts) * idf)
                keep = np.flatnonzero(letter)
                langs = batch.column(0).slice(a, b - a).take(pa.array(keep))
                sizes = np.log2(1 + counts[keep].sum(1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([langs, pa.array([vector[k].tobytes() for k in keep], pa.binary()), pa.array(sizes)], ["lang", "vector", "bin"])

    return run


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, spread: bool = False) -> np.ndarray:
    """Unit centroids of unit rows; rounds stop when nothing moves.

    Seeds are far from each other, or, with `spread`, at even places in the order of closeness to the mean, so that no
    outlier is a seed.
    """
    centre = _normal(x.mean(0, keepdims=True))[0]
    k = min(k, len(x))
    if spread:
        c = x[np.argsort(x @ centre, kind="stable")[[int((j + 0.5) / k * len(x)) for j in range(k)]]]
    else:
        seeds = [x[int(np.argmax(x @ centre))]]
        nearest = x @ seeds[0]
        while len(seeds) < k:
            seeds.append(x[int(np.argmin(nearest))])
            nearest = np.maximum(nearest, x @ seeds[-1])
        c = np.array(seeds)
    before = None
    for _ in range(rounds):
        own = np.argmax(x @ c.T, 1)
        if before is not None and (own == before).all():
            break
        before = own
        for j in range(len(c)):
            if (own == j).any():
                c[j] = x[own == j].mean(0)
        c = _normal(c)
    return c


def _learn(k: int):
    def run(table: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(sorted(table["vector"].to_pylist())), np.float32).reshape(table.num_rows, DIMENSIONS)  # one order, whatever the shuffle's
        n = len(x)
        for trim in range(TRIMS + 1):
            c = spherical_kmeans(x, k, spread=True)
            own = np.argmax(x @ c.T, 1)
            count = np.bincount(own, minlength=len(c))
            kept = (count >= LEAST_SHARE * n) | (count == count.max())
            if kept[count > 0].all() or trim == TRIMS:
                break
            x = x[kept[own]]
        c = c[kept & (count > 0)]
        return pa.table({"lang": pa.array([table["lang"][0].as_py()] * len(c), pa.string()), "centroid": pa.array([v.astype(np.float32).tobytes() for v in c], pa.binary())})

    return run


def _own_cosines(langs: list[str], centroids: np.ndarray):
    """lang, bin and best cosine of the vectors whose nearest centroid is their own language's; others are labelled wrongly or mixed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cosine = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(batch.num_rows, DIMENSIONS) @ centroids.T
            best = np.argmax(cosine, 1)
            keep = np.flatnonzero(np.array(langs, object)[best] == np.array(batch.column(0).to_pylist(), object))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(2).take(pa.array(keep)), pa.array(cosine[keep, best[keep]].astype(np.float64))], ["lang", "bin", "value"])

    return run


class LanguageModel:
    """Inverse document frequencies, unit centroids (sorted by language) and, for each centroid by log2 length, the cosine below which a text is rejected."""

    def __init__(self, idf: np.ndarray, langs: list[str], centroids: np.ndarray, floors: np.ndarray):
        self.idf, self.langs, self.centroids, self.floors = idf, langs, centroids, floors

    def predict(self, column) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, best cosine (0 to 1) and whether it is rejected, of each text of an Arrow column."""
        lang, score, reject = [UNKNOWN] * len(column), np.zeros(len(column)), np.ones(len(column), bool)
        for a, b, counts, letter in _matrices(column):
            if not len(self.langs):
                continue
            cosine = _normal(np.sqrt(counts) * self.idf) @ self.centroids.T
            best = np.argmax(cosine, 1)
            value = np.clip(cosine[np.arange(b - a), best], 0, 1).astype(np.float64)
            floor = self.floors[best, np.minimum(np.log2(1 + counts.sum(1)).astype(np.int64), self.floors.shape[1] - 1)]
            for row in np.flatnonzero(letter):
                lang[a + row] = self.langs[best[row]]
            score[a:b] = np.where(letter, value, 0)
            reject[a:b] = ~letter | (value < floor)
        return lang, score, reject


def train(labelled: DataFrame, k: int = CENTROIDS, sample: int = SAMPLE, slack: float = SLACK) -> LanguageModel:
    """Fit on `labelled` (doc_id, text, lang).  Rows of null lang, and texts without a letter, teach nothing; no rows give a model that rejects all.

    A repeated row counts as often as it is there; null doc_ids are ordinary values; other columns are ignored.  More than
    MOST_LANGUAGES values of lang fail.
    """
    spark = labelled.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    labelled = labelled.where("lang is not null")
    partial = labelled.select("lang", F.col("text").cast("string")).mapInArrow(_document_frequencies, "lang string, n long, df array<long>").repartition(min(parts, 64)).mapInArrow(kernel.releasing(_added), "lang string, n long, df array<long>")
    rates = partial.select("lang", "n", F.posexplode("df").alias("at", "df")).groupBy("lang", "at").agg((F.sum("df") / F.sum("n")).alias("rate"), F.sum("n").alias("n"))
    mean = rates.groupBy("at").agg(F.avg("rate").alias("rate"), F.sum("n").alias("n")).collect()  # DIMENSIONS rows
    idf = np.zeros(DIMENSIONS, np.float32)
    for row in mean:  # every language counts alike, however many texts it has
        idf[row["at"]] = -np.log((row["rate"] * row["n"] + 1) / (row["n"] + 1)) + 0.1
    share = [(lang, min(1.0, sample / n)) for lang, n in labelled.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()]
    if len(share) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not share:
        return LanguageModel(idf, [], np.zeros((0, DIMENSIONS), np.float32), np.zeros((0, 48)))
    shares = spark.createDataFrame(pa.table({"lang": pa.array([x for x, _ in share], pa.string()), "share": pa.array([x for _, x in share], pa.float64())}))  # rows would take Python workers of their own
    drawn = labelled.withColumn("draw", F.pmod(F.xxhash64("text", "doc_id"), F.lit(1 << 20)) / float(1 << 20)).join(F.broadcast(shares), "lang").where("draw < share")
    drawn = drawn.select("lang", "text")
    vectors = drawn.mapInArrow(kernel.releasing(_vectors(idf)), "lang string, vector binary, bin long")
    found = sorted(vectors.groupBy("lang").applyInArrow(_learn(k), "lang string, centroid binary").collect(), key=lambda r: (r["lang"], r["centroid"]))
    langs = [r["lang"] for r in found]
    centroids = np.array([np.frombuffer(r["centroid"], np.float32) for r in found]).reshape(len(found), DIMENSIONS)
    floors = np.zeros((len(found), 48))
    if found:
        made, near = _vectors(idf), _own_cosines(langs, centroids)
        own = drawn.mapInArrow(kernel.releasing(lambda batches: near(made(batches))), "lang string, bin long, value double")  # one worker a task, not two
        low = F.percentile("value", F.lit(QUANTILE)).alias("low")
        whole = {r["lang"]: r["low"] for r in own.groupBy("lang").agg(low).collect()}
        known: dict[str, dict[int, float]] = {}
        for r in own.groupBy("lang", "bin").agg(low, F.count("*").alias("n")).where(F.col("n") >= LEAST_TEXTS).collect():
            known.setdefault(r["lang"], {})[r["bin"]] = r["low"]
        for row, lang in enumerate(langs):
            by = known.get(lang, {})
            least = min(by.values(), default=whole.get(lang, 0.0))
            shortest = min(by, default=0)  # a cosine falls about as the root of a text's n-grams
            floors[row] = [slack * by.get(b, least * min(1.0, 2.0 ** ((b - shortest) / 2))) for b in range(48)]
    return LanguageModel(idf, langs, centroids, floors)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score and rejected for each row of `docs` (doc_id, text).

    A null text or one without a letter is `und`, with score 0, and rejected; a text of any length is looked at whole;
    repeated rows and null ids are rows of their own; an empty table gives no rows; other columns are never looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, reject = model.predict(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(reject)], ["doc_id", "lang_pred", "score", "rejected"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of `docs` whose text the model does not reject, with all their columns, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~model.predict(batch.column(batch.schema.get_field_index("text")))[2]))
        kernel.release()

    return docs.mapInArrow(run, docs.schema)
