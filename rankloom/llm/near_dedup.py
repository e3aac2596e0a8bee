"""Embedding near-dedup: spherical k-means assigns vectors to cells, blocked cosine products compare within cells.

Only vectors of one label (and one length) are compared; the cells of a label are those of one set of centroids for all
labels, learned from a bounded sample.  Equal vectors are one point with a multiplicity.  A vector is a member of its
nearest centroid's cell and a guest of each later cell whose bisecting plane it is near: of two unit vectors at an angle
theta, one of which lies beyond a plane, the other is at most sin(theta) away from it.  So the members and guests of a
cell hold every linked pair, each once, in the later of its two cells.

A label's cells, in order, fill blocks of a bounded number of members.  A vector travels once to its own block and once
to each later block with a cell that it visits, however many those are; a task holds one block's members, compares them,
and lets the guests stream by.  It hands on, for each vector, how many it links with and edges of a forest, never pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from rankloom.llm.graph import components
from rankloom.llm.langid import spherical_kmeans
from rankloom.session import saved, shared_dir

THRESHOLD = 0.93
#: Members of a block, in bytes of their vectors as they travel.
BLOCK_BYTES = 16 << 20
#: Vectors that k-means looks at, about, and the most centroids that it makes.
SAMPLE, MOST_CENTROIDS = 16384, 1024
#: Lengths of vectors that have centroids: the most frequent ones of the sample; the others have one cell a label.
MOST_LENGTHS = 4
TILE = 1024


def centroid_count(n: int) -> int:
    """Centroids for n vectors: as the root of n, up to a bound."""
    return max(1, min(MOST_CENTROIDS, math.ceil(math.sqrt(n) / 8)))


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows over their lengths, in double precision; rows of zeros, or with what is no finite number, become nan."""
    x = x.astype(np.float64)
    top = np.abs(x).max(1, keepdims=True) if x.shape[1] else np.zeros((len(x), 1))
    x = x / np.where(np.isfinite(top) & (top > 0), top, np.nan)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrices(column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, values) of an Arrow list column, by length; null lists and lengths of 0 are left out, null components are nan."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    begin = np.concatenate(([0], np.cumsum(sizes)))
    for size in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        yield rows, flat[begin[rows][:, None] + np.arange(size)]


def _learn(n: int):
    def run(table: pa.Table) -> pa.Table:
        x = np.concatenate([unit_rows(m) for chunk in table["embedding"].chunks for _, m in _matrices(chunk)])
        x = np.unique(x[np.isfinite(x).all(1)], axis=0)
        c = spherical_kmeans(x, min(centroid_count(n), len(x))) if len(x) else x
        return pa.table({"dim": pa.array([x.shape[1]], pa.int32()), "drawn": pa.array([table.num_rows], pa.int64()), "centroids": pa.array([c.astype(np.float64).tobytes()], pa.binary())})

    return run


class Cells:
    """Unit centroids by length of vector, and how near a vector of one cell is to those of another that it may link with."""

    def __init__(self, centroids: dict[int, np.ndarray], threshold: float):
        self.centroids = centroids
        reach = math.sqrt(1 - threshold * threshold) if 0 < threshold <= 1 else 2.0
        self.margin = {d: reach * np.sqrt(np.maximum(2 - 2 * (c @ c.T), 0)) + 1e-9 for d, c in centroids.items()}

    def number(self, dim: int) -> int:
        return len(self.centroids[dim]) if dim in self.centroids else 1

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The home of each row, and its products with the centroids."""
        c = self.centroids.get(x.shape[1])
        if c is None:
            return np.zeros(len(x), np.int64), np.zeros((len(x), 1))
        dot = x @ c.T
        return np.argmax(dot, 1), dot

    def visits(self, dim: int, home: np.ndarray, dot: np.ndarray) -> np.ndarray:
        """Whether a row may link with a member of each cell."""
        if dim not in self.centroids:
            return np.ones((len(home), 1), bool)
        return dot[np.arange(len(home)), home][:, None] - dot <= self.margin[dim][home]


_PREPARED = "vec_id long, label long, dim int, digest binary, vector binary, home int"


def _prepare(cells: Cells, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            dims, homes = np.zeros(n, np.int32), np.zeros(n, np.int32)
            vectors, digests = [None] * n, [None] * n
            for rows, x in _matrices(batch.column(2)):
                x = x.astype(kind) + 0.0
                unit = unit_rows(x)
                good = np.isfinite(unit).all(1)
                dims[rows[good]] = x.shape[1]
                homes[rows[good]] = cells.place(unit[good])[0]
                for row, v in zip(rows[good].tolist(), x[good]):
                    vectors[row] = v.tobytes()
                    digests[row] = hashlib.blake2b(vectors[row], digest_size=16).digest()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dims), pa.array(digests, pa.binary()), pa.array(vectors, pa.binary()), pa.array(homes)], ["vec_id", "label", "dim", "digest", "vector", "home"])

    return run


_SENT = "label long, dim int, block int, guest boolean, home int, part int, first_id long, n long, vector binary"


def _vectors(column, kind: str, dim: int) -> np.ndarray:
    """The rows of a binary column of equally long vectors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind).reshape(len(column), dim)


def _send(cells: Cells, kind: str):
    """Each point for its own block, and as a guest for each later block that holds a cell it visits.

    Columns: label, dim, home, first_id, n, digest, vector, first and parts, the first block and the number of blocks of each
    cell of the label; where these are null, the label has one block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, dim, home, ids, n, vector, first, parts, draw = batch.columns
            block, part = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int32)
            at, to = [], []
            laid = np.asarray(pc.is_valid(first))
            keys = {}
            for row in np.flatnonzero(laid).tolist():
                keys.setdefault((label[row].as_py(), dim[row].as_py()), []).append(row)
            for (_, d), rows in keys.items():
                begin, pieces = np.array(first[rows[0]].as_py()), np.array(parts[rows[0]].as_py())
                rows = np.array(rows)
                own = np.asarray(home)[rows]
                part[rows] = np.asarray(draw)[rows] % pieces[own]
                block[rows] = begin[own] + part[rows]
                cell = np.repeat(np.arange(len(begin)), pieces)  # of each block, once for each cell in it
                held = begin[cell] + np.concatenate([np.arange(k) for k in pieces])
                for a in range(0, len(rows), 2048):
                    some = rows[a : a + 2048]
                    x = unit_rows(_vectors(vector.take(pa.array(some)), kind, d))
                    visits = cells.visits(d, own[a : a + 2048], cells.place(x)[1] if d in cells.centroids else np.zeros((len(some), 1)))
                    row, where = np.nonzero(visits[:, cell] & (held > block[some][:, None]))
                    pairs = np.unique(np.stack([some[row], held[where]]), axis=1)
                    at.append(pairs[0])
                    to.append(pairs[1])
            at, to = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (at, to))
            take = pa.array(np.concatenate([np.arange(batch.num_rows), at]))
            guest = pa.array(np.append(np.zeros(batch.num_rows, bool), np.ones(len(at), bool)))
            yield pa.RecordBatch.from_arrays([label.take(take), dim.take(take), pa.array(np.append(block, to).astype(np.int32)), guest, home.take(take), pa.array(part).take(take), ids.take(take), n.take(take), vector.take(take)], [c.split()[0] for c in _SENT.split(", ")])

    return run


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of the nodes of the edges u, v that are not their component's least."""
    node, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = at[: len(u)], at[len(u) :]
    root = np.arange(len(node))
    while True:
        least = np.minimum(root[u], root[v])
        after = root.copy()
        np.minimum.at(after, u, least)
        np.minimum.at(after, v, least)
        after = after[after]
        if (after == root).all():
            joined = np.flatnonzero(root != np.arange(len(node)))
            return node[joined], node[root[joined]]
        root = after


class Block:
    """The members of a block, sorted by cell and part, and what is found about them."""

    def __init__(self, cells: Cells, dim: int, threshold: float, x: np.ndarray, ids: np.ndarray, weight: np.ndarray, home: np.ndarray, part: np.ndarray):
        order = np.lexsort((ids, part, home))
        self.cells, self.dim, self.threshold = cells, dim, threshold
        self.x, self.ids, self.weight, self.home, self.part = x[order], ids[order], weight[order], home[order], part[order]
        cut = np.flatnonzero((np.diff(self.home) != 0) | (np.diff(self.part) != 0)) + 1
        self.begin, self.end = np.append(0, cut), np.append(cut, len(ids))
        self.links, self.edges = np.zeros(len(ids), np.int64), []
        self.visits = cells.visits(dim, self.home, cells.place(self.x)[1])
        for a, b in zip(self.begin.tolist(), self.end.tolist()):
            self._meet(np.arange(a, b), a, b)
            earlier = np.flatnonzero(self.visits[:a, self.home[a]])
            self._meet(earlier, a, b)

    def _meet(self, rows: np.ndarray, a: int, b: int) -> None:
        """Members `rows`, none of them after the members a to b, against those; within these, each pair once."""
        for k in range(0, len(rows), TILE):
            own = rows[k : k + TILE]
            for low in range(int(max(a, own[0])), b, 4 * TILE):
                u, v = np.nonzero(self.x[own] @ self.x[low : min(b, low + 4 * TILE)].T >= self.threshold)
                u, v = own[u], low + v
                if own[-1] >= a:
                    u, v = u[u < v], v[u < v]
                if len(u):
                    self.links += np.bincount(u, self.weight[v], len(self.ids)).astype(np.int64) + np.bincount(v, self.weight[u], len(self.ids)).astype(np.int64)
                    self.edges.append(forest(u, v))

    def receive(self, x: np.ndarray, ids: np.ndarray, weight: np.ndarray, home: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Guests: (vec_id, links, one vector of its component) of those that link with a member."""
        visits = self.cells.visits(self.dim, home, self.cells.place(x)[1])
        links, edges = np.zeros(len(ids), np.int64), []
        for a, b in zip(self.begin.tolist(), self.end.tolist()):
            rows = np.flatnonzero(visits[:, self.home[a]])
            for k in range(0, len(rows), TILE):
                own = rows[k : k + TILE]
                for low in range(a, b, 4 * TILE):
                    u, v = np.nonzero(x[own] @ self.x[low : min(b, low + 4 * TILE)].T >= self.threshold)
                    u, v = own[u], low + v
                    if len(u):
                        links += np.bincount(u, self.weight[v], len(ids)).astype(np.int64)
                        self.links += np.bincount(v, weight[u], len(self.ids)).astype(np.int64)
                        edges.append(forest(u + len(self.ids), v))
        if edges:
            node, root = forest(*map(np.concatenate, zip(*edges)))
            both = np.concatenate([self.ids, ids])
            yield ids[links > 0], links[links > 0], ids[links > 0]
            yield both[node], np.zeros(len(node), np.int64), both[root]

    def result(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        some = np.flatnonzero(self.links)
        yield self.ids[some], self.links[some], self.ids[some]
        if self.edges:
            node, root = forest(*map(np.concatenate, zip(*self.edges)))
            yield self.ids[node], np.zeros(len(node), np.int64), self.ids[root]


def _compare(cells: Cells, threshold: float, kind: str):
    """Partitions sorted by label, length, block and guest to (vec_id, links, root)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, block = None, [], None

        def packed(found):
            for vec_id, links, root in found:
                for a in range(0, len(vec_id), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(c[a : a + (1 << 16)].astype(np.int64)) for c in (vec_id, links, root)], ["vec_id", "links", "root"])

        def closed():
            """The block whose members are all here."""
            columns = list(map(np.concatenate, zip(*held)))
            held.clear()
            return Block(cells, key[1], threshold, *columns)

        for batch in batches:
            label, dim, number = (np.asarray(batch.column(k)) for k in range(3))
            guest = np.asarray(batch.column(3).cast(pa.int8()))
            cut = np.flatnonzero((np.diff(label) != 0) | (np.diff(dim) != 0) | (np.diff(number) != 0) | (np.diff(guest) != 0)) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(label)]):
                if a == b:
                    continue
                own = (int(label[a]), int(dim[a]), int(number[a]))
                if own != key:
                    if held:
                        block = closed()
                    if block is not None:
                        yield from packed(block.result())
                    key, block = own, None
                home, part, ids, n = (np.asarray(batch.column(k))[a:b] for k in range(4, 8))
                x = unit_rows(_vectors(batch.column(8).slice(a, b - a), kind, own[1]))
                if not guest[a]:
                    held.append((x, ids, n, home, part))
                    continue
                if block is None:
                    if not held:  # a block that lost all its cells has no members to meet
                        continue
                    block = closed()
                yield from packed(block.receive(x, ids, n, home))
        if held:
            block = closed()
        if block is not None:
            yield from packed(block.result())

    return run


def layout(points: DataFrame, cells: Cells, block_bytes: int, width: int) -> DataFrame:
    """label, dim, first and parts of the labels of more than one block: the first block of each cell and how many it fills."""
    most = F.greatest(F.lit(1), F.floor(F.lit(block_bytes) / (F.col("dim") * width)))
    sizes = points.groupBy("label", "dim", "home").agg(F.count("*").alias("n")).withColumn("most", most)
    large = sizes.groupBy("label", "dim").agg((F.sum("n") > F.max("most")).alias("large")).where("large").select("label", "dim")
    sizes = sizes.join(large, ["label", "dim"]).withColumn("parts", F.ceil(F.col("n") / F.col("most")).cast("int"))
    room = F.when(F.col("parts") > 1, F.col("parts") * F.col("most")).otherwise(F.col("n"))
    before = F.sum(room).over(Window.partitionBy("label", "dim").orderBy("home")) - room  # a row a cell
    rows = sizes.withColumn("first", F.floor(before / F.col("most")).cast("int")).groupBy("label", "dim").agg(F.map_from_entries(F.collect_list(F.struct("home", F.struct("first", "parts")))).alias("by"))
    number = F.coalesce(F.create_map(*(F.lit(x) for d in cells.centroids for x in (d, cells.number(d))))[F.col("dim")] if cells.centroids else F.lit(None), F.lit(1))
    own = lambda name: F.transform(F.sequence(F.lit(0), number - 1), lambda k: F.coalesce(F.col("by")[k][name], F.lit(0)))
    return rows.select("label", "dim", own("first").alias("first"), own("parts").alias("parts"))


def learn_cells(vectors: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> Cells:
    """Centroids from about `sample` of the rows of `vectors` (embedding), for its MOST_LENGTHS most frequent lengths."""
    n = vectors.count()
    if not n:
        return Cells({}, threshold)
    drawn = vectors.where(F.pmod(F.xxhash64("embedding"), F.lit(1 << 40)) < F.lit(min(1 << 40, int(sample / n * (1 << 40)) + 1))).select("embedding", F.size("embedding").alias("dim")).where("dim > 0")
    lengths = [r["dim"] for r in drawn.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(MOST_LENGTHS).collect()]
    found = drawn.where(F.col("dim").isin(lengths)).groupBy("dim").applyInArrow(_learn(n), "dim int, drawn long, centroids binary").collect() if lengths else []  # at most MOST_CENTROIDS centroids for each length
    return Cells({r["dim"]: c for r in found if len(c := np.frombuffer(r["centroids"], np.float64).reshape(-1, r["dim"]))}, threshold)


def near_dedup(vectors: DataFrame, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES, sample: int = SAMPLE) -> DataFrame:
    """One row per row of `vectors` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Rows link when their labels are equal and not null and their cosine, in double precision, is at least `threshold`.
    A null, empty or zero vector, one with a null or non-finite component, and a row with a null label or vec_id link with
    nothing; a null vec_id has a null component and is kept.  Repeated rows link with each other.  An empty table gives no
    rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    shared_dir(spark)
    single = isinstance(vectors.schema["embedding"].dataType, ArrayType) and isinstance(vectors.schema["embedding"].dataType.elementType, FloatType)
    kind, width = ("<f4", 4) if single else ("<f8", 8)
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"))
    cells = learn_cells(own.select("embedding"), threshold, sample)
    own = own.mapInArrow(_prepare(cells, kind), _PREPARED).checkpoint()
    key = ["label", "dim", "digest"]
    points = own.where("vec_id is not null and label is not null and digest is not null").groupBy(*key).agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n"), F.first("vector").alias("vector"), F.first("home").alias("home")).checkpoint()
    laid = saved(layout(points, cells, block_bytes, width))  # a row a label of more than one block, its true size known to the planner
    sent = points.join(laid, ["label", "dim"], "left").select("label", "dim", "home", "first_id", "n", "vector", "first", "parts", F.pmod(F.xxhash64("digest"), F.lit(1 << 30)).alias("draw")).mapInArrow(_send(cells, kind), _SENT)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ("label", "dim", "block")
    found = sent.repartition(parts, *order).sortWithinPartitions(*order, "guest").mapInArrow(_compare(cells, threshold, kind), "vec_id long, links long, root long").checkpoint()
    links = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    label = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    named = points.select(*key, F.col("first_id").alias("vec_id"), "n").join(links, "vec_id", "left").join(label.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    named = named.select(*key, (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "vec_id").alias("component"))
    out = own.select("vec_id", *key).withColumn("label", F.when(F.col("vec_id").isNotNull(), F.col("label"))).join(named, key, "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
