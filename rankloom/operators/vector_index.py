"""A persisted inverted-file index of vectors: cells around centroids, searched by centroid or, exactly, by bound."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions import stats
from rankloom.operators import nearest
from rankloom.operators.nearest import BLOCK, Best, matrix
from rankloom.operators.ranking import DIGITS, top_k
from rankloom.session import saved

#: Vectors that centroids are learned from, and cells, at most: what goes to every executor is so many centroids.
SAMPLE, MOST_CELLS = 50_000, 4096
#: Cells of the nearest centroids that are searched before the bounds are used.
OPENING = 4
#: Scores are rounded, so a bound may be passed by this much.
SLACK = 2 * 10.0**-DIGITS


def _unit(column: str):
    return F.transform(column, lambda x: x.cast("double") / stats.norm(F.col(column)))


def build(vectors: DataFrame, path: str, cells: int | None = None) -> None:
    """Write the index of vectors (doc_id, vector) to `path`: entries by cell, and cells with their centroids and radii.

    Centroids are learned from a sample of SAMPLE rows, drawn by a hash of doc_id; every vector is in the index, in the cell
    of its nearest centroid, but for null and zero ones, which have no direction.  `cells` is the root of their number unless it is given.
    """
    rows = vectors.select("doc_id", F.col("vector").cast("array<double>").alias("vector")).where(stats.norm(F.col("vector").cast("array<double>")) > 0)
    rows = rows.select("doc_id", _unit("vector").alias("vector"))
    n = rows.count()
    cells = min(MOST_CELLS, cells or max(1, round(n**0.5)))
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-n // SAMPLE)))) == 0).select(array_to_vector("vector").alias("features"))
    centroids = KMeans(k=cells, distanceMeasure="cosine", seed=1, maxIter=10).fit(sample).clusterCenters() if cells > 1 and sample.limit(2).count() > 1 else []
    found = np.array([c / np.linalg.norm(c) for c in centroids if np.linalg.norm(c) > 0])
    shared = rows.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            own = np.stack([np.asarray(v) for v in batch.column(1).to_numpy(zero_copy_only=False)])
            cosines = own @ shared.value.T if len(shared.value) else np.ones((len(own), 1))
            cell = cosines.argmax(1)
            angle = np.arccos(np.clip(cosines[np.arange(len(own)), cell], -1, 1)) if len(shared.value) else np.full(len(own), np.pi)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(angle)], ["doc_id", "vector", "cell", "angle"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    placed = rows.mapInArrow(run, f"doc_id {kind}, vector array<double>, cell int, angle double")
    placed.repartition("cell").write.partitionBy("cell").parquet(f"{path}/entries")
    spark = rows.sparkSession
    known = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(found)], "cell int, centroid array<double>")
    sizes = spark.read.schema(f"doc_id {kind}, vector array<double>, angle double, cell int").parquet(f"{path}/entries").groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius"))
    sizes.join(known, "cell", "left").write.parquet(f"{path}/cells")


class Cells:
    """Cells with their centroids, radii and sizes; a cell without a centroid is the only one, and as near as can be."""

    def __init__(self, rows: list):
        self.place = {r["cell"]: k for k, r in enumerate(rows)}
        self.radius, self.size = np.array([r["radius"] for r in rows]), np.array([r["n"] for r in rows])
        known = [r["centroid"] for r in rows if r["centroid"] is not None]
        self.centroids = np.array(known) if known else None

    def cosines(self, queries: np.ndarray, cells: slice = slice(None)) -> np.ndarray:
        if self.centroids is None:
            return np.ones((len(queries), len(self.size[cells])))
        return np.clip(queries @ self.centroids[cells].T, -1, 1)


def _asked(rows: DataFrame, cells: Broadcast, probes: int) -> DataFrame:
    """case_id and q, with its nearest cells (near) and the cosine of the last of `probes` (reach)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = len(cells.value.size)
        few, last = min(OPENING, many), min(probes, many)
        for batch in batches:
            step = max(1, BLOCK // many)
            for at in range(0, len(batch), step):
                part = batch.slice(at, step)
                cosines = -cells.value.cosines(matrix(part.column(1)))
                near = np.argpartition(cosines, few - 1, axis=1)[:, :few]
                reach = -np.partition(cosines, last - 1, axis=1)[:, last - 1]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(near.tolist(), pa.list_(pa.int32())), pa.array(reach)], ["case_id", "q", "near", "reach"])

    return rows.mapInArrow(run, "case_id long, q array<double>, near array<int>, reach double")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 20, probes: int | None = None) -> DataFrame:
    """case_id, doc_id, score and rank of the k nearest entries of queries (case_id, query_vector), other than their own id.

    With `probes`, so many cells of the nearest centroids are searched: an approximation.  Without, the result is exact: a cell
    can't hold a better cosine than that of the angle to its centroid less its radius, so after the first cells only those
    that can still pass the k-th score are searched.  Queries without a direction have no result.

    Which queries meet a cell is told where its entries are, from the cells and a group of queries that are broadcast.
    """
    asked = queries.select(F.col("case_id").cast("long"), F.col("query_vector").cast("array<double>").alias("q")).where(stats.norm(F.col("q")) > 0)
    asked = saved(asked.select("case_id", _unit("q").alias("q")))
    entries = spark.read.parquet(f"{path}/entries").select(F.col("doc_id").cast("long"), "vector", "cell")
    rows = spark.read.parquet(f"{path}/cells").collect()  # at most MOST_CELLS
    if not rows:
        return top_k(spark.createDataFrame([], nearest.FOUND), k)
    cells = spark.sparkContext.broadcast(Cells(rows))

    def find(part: DataFrame) -> DataFrame:
        own = _asked(part, cells, probes or 1).toArrow()
        if not len(own):
            return spark.createDataFrame([], nearest.FOUND)
        shared = spark.sparkContext.broadcast((own.column(0).to_numpy(), matrix(own.column(1)), matrix(own.column(2)), own.column(3).to_numpy()))

        def met(wanted: Callable, least: Broadcast | None = None) -> DataFrame:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                ids, units, near, reach = shared.value
                best = Best(ids, units, k, None if least is None else least.value)
                for batch in batches:
                    held, docs, vectors = batch.column(2).to_numpy(), batch.column(0).to_numpy(), None
                    for cell in np.unique(held):
                        place = cells.value.place[cell]
                        rows = np.nonzero(wanted(best, place, near, reach))[0]
                        if len(rows):
                            vectors = matrix(batch.column(1)) if vectors is None else vectors
                            best.offer(docs[held == cell], vectors[held == cell], rows)
                yield from best.batches()

            return entries.mapInArrow(run, nearest.FOUND).withColumn("score", F.round("score", DIGITS))

        cosine = lambda best, place: cells.value.cosines(best.queries, slice(place, place + 1))[:, 0]
        if probes is not None:
            return met(lambda best, place, near, reach: cosine(best, place) >= reach - nearest.NOISE)
        first = saved(top_k(met(lambda best, place, near, reach: (near == place).any(1)), k).drop("rank"))
        full = first.groupBy("case_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).select("case_id", "least").toArrow()
        known = dict(zip(full.column(0).to_pylist(), full.column(1).to_pylist()))
        least = spark.sparkContext.broadcast(np.array([known.get(i, -np.inf) for i in own.column(0).to_pylist()]))

        def within_bound(best: Best, place: int, near: np.ndarray, reach: np.ndarray) -> np.ndarray:
            bound = np.cos(np.maximum(0.0, np.arccos(cosine(best, place)) - cells.value.radius[place]))
            return (bound + SLACK >= best.floor) & ~(near == place).any(1)

        return first.unionByName(met(within_bound, least))

    return top_k(nearest.in_groups(asked, find), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """case_id, wanted and recall: the share of each exact ranking that was found."""
    hits = exact.select("case_id", "doc_id").join(found.select("case_id", "doc_id").withColumn("hit", F.lit(1)), ["case_id", "doc_id"], "left")
    return hits.groupBy("case_id").agg(F.count("*").alias("wanted"), F.round(F.avg(F.coalesce("hit", F.lit(0))), DIGITS).alias("recall"))
