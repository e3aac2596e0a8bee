"""N-gram Jaccard join through an R-tree of count vectors.

Tokens (here word shingles) are hashed into groups; a document is the point of its group counts.  Two sets overlap by
at most the sum of the smaller coordinates, so a pair can be dropped without its sets where that sum is too small.

No single tree can lie in one place, so a partitioning brings the points together that may be near, and each part has an
R-tree of its own:

1. Size bands.  A band of set sizes has its own number of blocks of tokens (by their hash), one more than the largest
   number of tokens in which two linked sets can differ, so at least one block of a linked pair is equal throughout.  This
   is a pigeonhole argument and no R-tree; it takes the place of the tree's top levels.  Spare blocks let a set leave out
   those without a rare token, where texts meet that have no more in common than a passage that many share; a set with
   more such blocks leaves out none.  Which tokens are common is a fixed bitmap; it decides how fast the join is, never
   what it finds.
2. Leaders.  Of the sets with an equal block the smallest id leads; (leader, member) pairs replace the pairs.
3. Points.  Under a leader, the points of its members lie in an R-tree: packed leaves of LEAF points, boxes of LEAF leaves
   or boxes, each with its largest coordinates.  A search descends where the sum of minima against a box can reach the
   overlap that is needed.  What passes keeps a forest of edges, whose components are groups.
4. Sets.  Within a group the sets themselves decide, first against one of the group, then, for those apart from it,
   through the tree again.  Pairs already joined through others are not verified.

Every linked pair meets in some block and passes every bound, so no link between different texts is lost.  Equal sets are
joined by value.  Groups of any size are divided into blocks that meet two at a time, and keys with a large share of the
rows are joined by a broadcast of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm import kernel
from rankloom.llm.graph import components, join_hot
from rankloom.session import saved, shared_dir

LEAF = 32
#: Fewest groups of a point, and tokens of the smallest set of a band for each group.
GROUPS = 64
TOKENS_PER_GROUP = 6
#: Spare blocks of a band, as a share of the differences.
SPARE = Fraction(1, 5)
#: A token is common from so many different sets on, counting windows in which it has COMMON_IN_BATCH; at most
#: COMMON_TOKENS, the most common, are marked among COMMON_BITS bits.
COMMON, COMMON_IN_BATCH, COMMON_TOKENS, COMMON_BITS = 6, 3, 1 << 20, 1 << 24
#: Points under a leader that one task takes at once.
BLOCK_POINTS = 8192
#: Distinct shingles under a leader that one task takes at once.
BLOCK_SHINGLES = 2_000_000
#: Bytes of text to each cell of nodes: what one task holds at a time.
CELL_BYTES = 16 << 20
#: Rows that a task of leaders remembers.
MOST_SENT = 1 << 20
#: Bytes of text in which common tokens are told by their repetition.
WINDOW_BYTES = 24 << 20
_U = np.uint64


def group_count(tokens: int) -> int:
    """Groups of a point for sets of at least so many tokens: a power of 2."""
    return 1 << max(GROUPS - 1, tokens // TOKENS_PER_GROUP).bit_length()


class Bands:
    """Size bands and their numbers of blocks for a threshold num/den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        ratio = max(Fraction(5, 4), Fraction(den, num))
        self.low = [1]
        while self.low[-1] < 1 << 40:
            self.low.append(max(self.low[-1] + 1, -(-self.low[-1] * ratio.numerator // ratio.denominator)))
        self.low_array = np.array(self.low)
        self.blocks, self.spare = [], []
        for a, b in zip(self.low, self.low[1:]):
            both = (b - 1) + (b - 1) * den // num
            differ = both * (den - num) // (den + num)
            self.spare.append(-int(-differ * SPARE // 1))
            self.blocks.append(0 if differ == 0 else differ + 1 + self.spare[-1])

    def of(self, n: int) -> list[int]:
        """Bands in which a set of n tokens has blocks: its own, and the one below if a partner may lie there."""
        if n < 1:
            return []
        own = int(np.searchsorted(self.low_array, n, "right")) - 1
        below = own - 1
        return [k for k in ([own, below] if below >= 0 and -(-n * self.num // self.den) < self.low[own] else [own]) if self.blocks[k]]

    def nodes(self, tokens: np.ndarray, common: np.ndarray | None = None) -> list[tuple[int, np.ndarray]]:
        """(band, keys) of the tree's nodes that hold this set; `common` is a bitmap of tokens."""
        out = []
        rare = np.ones(len(tokens), bool) if common is None else ~marked(common, tokens)
        for band in self.of(len(tokens)):
            m = self.blocks[band]
            block = ((tokens >> _U(32)) * _U(m) >> _U(32)).astype(np.int64)
            value = np.zeros(m, _U)
            np.add.at(value, block, kernel.mix64(tokens))
            key = kernel.mix64(value ^ kernel.mix64(np.arange(m, dtype=_U) + _U((band + 1) << 40)))
            rich = np.zeros(m, bool)
            rich[block[rare]] = True
            out.append((band, key[rich] if m - rich.sum() <= self.spare[band] else key))
        return out

    def point(self, tokens: np.ndarray, band: int) -> np.ndarray:
        """Counts of the set's tokens in the band's groups."""
        groups = group_count(self.low[band])
        count = np.bincount((tokens & _U(groups - 1)).astype(np.int64), minlength=groups)
        return count.astype(np.uint8 if count.max() < 256 else np.uint32)

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        both = len(np.intersect1d(a, b, assume_unique=True))
        return both > 0 and both * self.den >= self.num * (len(a) + len(b) - both)

    def needed(self, a, b):
        """The least overlap with which sets of a and b tokens link."""
        return -(-(a + b) * self.num // (self.num + self.den))


def marked(bitmap: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    at = (tokens >> _U(20)).astype(np.int64) & (COMMON_BITS - 1)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _digest(tokens: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest(), np.int64).tolist())


_PACKED = "part int, cell int, band int, keys binary, at binary, ids binary, digests binary"


def _repeated(k: int):
    """Tokens of at least COMMON_IN_BATCH different sets of about WINDOW_BYTES of text, and how many have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, seen, size = [], set(), 0

        def closed():
            tokens, at = np.unique(np.concatenate([t for t, _ in found]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n for _, n in found]), len(tokens)).astype(np.int64)
            found.clear()
            kept = n >= COMMON_IN_BATCH
            return pa.RecordBatch.from_arrays([pa.array(tokens[kept].view(np.int64)), pa.array(n[kept])], ["token", "n"])

        for batch in batches:
            different = []
            for tokens in kernel.distinct_shingles(batch.column(0), k):
                digest = _digest(tokens)
                if digest not in seen:
                    seen.add(digest)
                    different.append(tokens)
            if different:
                found.append(np.unique(np.concatenate(different), return_counts=True))
            size += batch.nbytes
            if size >= WINDOW_BYTES and found:
                yield closed()
                seen, size = set(), 0
        if found:
            yield closed()
        kernel.release()

    return run


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens = np.asarray(batch.column(0)).view(_U)
        yield pa.RecordBatch.from_arrays([pa.array([((tokens >> _U(20)).astype(np.int64) & (COMMON_BITS - 1)).astype(np.uint32).tobytes()], pa.binary())], ["places"])


def common_tokens(docs: DataFrame, k: int) -> np.ndarray:
    """The bitmap of common tokens: of a fixed size, whatever the corpus."""
    counts = docs.select("text").mapInArrow(_repeated(k), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON)
    counts = saved(counts)
    least, left = COMMON, COMMON_TOKENS
    steps = counts.groupBy(F.floor(F.log2("n") * 8).alias("step")).agg(F.min("n").alias("least"), F.count("*").alias("tokens")).orderBy(F.desc("step")).collect()  # a few rows for each doubling
    for step in steps:
        left -= step["tokens"]
        if left < 0:
            break
        least = step["least"]
    else:
        least = COMMON
    bitmap = np.zeros(COMMON_BITS // 8, np.uint8)
    if steps and (left >= 0 or least > COMMON):
        for row in counts.where(F.col("n") >= least).select("token").mapInArrow(kernel.releasing(_places), "places binary").collect():  # four bytes for each of at most COMMON_TOKENS
            places = np.frombuffer(row["places"], np.uint32)
            np.bitwise_or.at(bitmap, places >> 3, (1 << (places & 7)).astype(np.uint8))
    return bitmap


def _pack(k: int, bands: Bands, cells: int, parts: int, common):
    """The nodes of every set, by the cell that a key's hash names; 32 bits of a key are kept, so that a few nodes merge.

    Of equal sets of a batch one is enough, as equal sets are joined by value: a text with any number of copies sends as
    many rows as there are batches with it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            digests, found, seen = np.zeros(len(ids), np.int64), {}, set()
            for row, tokens in enumerate(kernel.distinct_shingles(batch.column(1), k)):
                digest = _digest(tokens)
                if digest in seen:
                    continue
                seen.add(digest)
                digests[row] = digest[0]
                for band, keys in bands.nodes(tokens, common.value):
                    found.setdefault(band, []).append((keys, np.full(len(keys), row, np.int32)))
            rows = []
            for band, pairs in found.items():
                keys, at = map(np.concatenate, zip(*pairs))
                cell = (keys % _U(cells)).astype(np.int64)
                order = np.argsort(cell, kind="stable")
                cut = np.flatnonzero(np.diff(cell[order])) + 1
                for chosen in np.split(order, cut):
                    rows_of, own = np.unique(at[chosen], return_inverse=True)
                    c = int(cell[chosen[0]])
                    rows.append((c % parts, c, band, (keys[chosen] >> _U(32)).astype(np.uint32).tobytes(), own.astype(_width(len(rows_of))).tobytes(), ids[rows_of].tobytes(), digests[rows_of].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (*[pa.int32()] * 3, *[pa.binary()] * 4))], ["part", "cell", "band", "keys", "at", "ids", "digests"])
        kernel.release()

    return run


def _width(n: int):
    return np.uint16 if n <= 65536 else np.uint32


def _led(keys: np.ndarray, ids: np.ndarray, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (leader, member) of the nodes with at least two different sets."""
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    order = order[np.append(same, False) | np.append(False, same)]
    keys, ids, digests = keys[order], ids[order], digests[order]
    order = np.lexsort((ids, digests, keys))
    keys, ids, digests = keys[order], ids[order], digests[order]
    if not len(keys):
        return ids, ids
    first = np.append(True, (keys[1:] != keys[:-1]) | (digests[1:] != digests[:-1]))
    keys, ids = keys[first], ids[first]
    begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    count = np.diff(np.append(begin, len(keys)))
    lead, several = np.repeat(np.minimum.reduceat(ids, begin), count), np.repeat(count, count) > 1
    lead, ids = lead[several], ids[several]
    order = np.lexsort((ids, lead))
    lead, ids = lead[order], ids[order]
    fresh = np.append(True, (lead[1:] != lead[:-1]) | (ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, bool)
    return lead[fresh], ids[fresh]


def _leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partitions sorted by cell and band to (leader, band, member); one cell and band is held at a time.

    What the partition has sent is not sent again, as far as MOST_SENT rows are remembered.
    """
    key, held, sent = None, [], np.zeros((3, 0), np.int64)

    def closed():
        nonlocal sent
        lead, ids = _led(*map(np.concatenate, zip(*held)))
        held.clear()
        both = np.concatenate([sent, np.stack([np.full(len(ids), key[1], np.int64), lead, ids])], 1)
        order = np.lexsort(both)
        again = np.append(False, (both[:, order[1:]] == both[:, order[:-1]]).all(0)) if len(order) else np.zeros(0, bool)
        fresh = order[~again]  # a stable order: of equal rows the one sent before is first
        new = np.sort(fresh[fresh >= sent.shape[1]])
        lead, ids = both[1, new], both[2, new]
        sent = both[:, fresh] if len(fresh) <= MOST_SENT else np.zeros((3, 0), np.int64)
        for a in range(0, len(ids), 1 << 16):
            part = slice(a, a + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(lead[part]), pa.array(np.full(len(lead[part]), key[1], np.int32)), pa.array(ids[part])], ["leader", "band", "member"])

    for batch in batches:
        for _, cell, band, keys, at, own, digest in zip(*(c.to_pylist() for c in batch.columns)):
            if key != (cell, band):
                if held:
                    yield from closed()
                key = (cell, band)
            own = np.frombuffer(own, np.int64)
            at = np.frombuffer(at, _width(len(own)))
            held.append((np.frombuffer(keys, np.uint32), own[at], np.frombuffer(digest, np.int64)[at]))
    if held:
        yield from closed()
    kernel.release()


class Joined:
    """Union-find over the rows of a block."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def top(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x


class Tree:
    """An R-tree of points: packed leaves of LEAF points, by size and their first coordinates, under boxes of LEAF nodes each."""

    def __init__(self, size: np.ndarray, point: np.ndarray, bands: Bands):
        self.size, self.point, self.bands = size, point, bands
        self.order = np.lexsort((*(point[:, g] for g in range(3)), size))
        self.levels = []  # largest coordinates, smallest and largest size of each node, leaves first
        top, smallest, largest = point[self.order], size[self.order], size[self.order]
        while not self.levels or len(top) > LEAF:
            begin = np.arange(0, len(top), LEAF)
            top, smallest, largest = np.maximum.reduceat(top, begin), np.minimum.reduceat(smallest, begin), np.maximum.reduceat(largest, begin)
            self.levels.append((top, smallest, largest))

    def near(self, x: int) -> np.ndarray:
        """The rows whose sets may link with that of x, x included."""
        b, size, own = self.bands, self.size[x], self.point[x]
        nodes = np.arange(len(self.levels[-1][0]))
        for level in range(len(self.levels) - 1, -1, -1):
            top, smallest, largest = (part[nodes] for part in self.levels[level])
            good = (largest * b.den >= size * b.num) & (smallest * b.num <= size * b.den)
            nodes, least = nodes[good], b.needed(size, np.maximum(smallest[good], -(-size * b.num // b.den)))
            nodes = nodes[np.minimum(own, top[good]).sum(1) >= least]
            below = len(self.levels[level - 1][0]) if level else len(self.order)
            nodes = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
            nodes = nodes[nodes < below]
        rows = self.order[nodes]
        return rows[np.minimum(own, self.point[rows]).sum(1) >= b.needed(size, self.size[rows])]


def bound_forest(size: np.ndarray, point: np.ndarray, bands: Bands) -> list[tuple[int, int]]:
    """A forest whose components are those of the pairs that the points don't rule out.

    What passes with row 0 joins it at once; a pair that matters besides has a row that doesn't, and only those search.
    """
    small, large = np.minimum(size, size[0]), np.maximum(size, size[0])
    passes = (np.minimum(point, point[0]).sum(1) >= bands.needed(size, size[0])) & (small * bands.den >= large * bands.num)
    passes[0] = True
    apart = np.flatnonzero(~passes)
    joined, edges = Joined(len(size)), []
    for x in np.flatnonzero(passes)[1:].tolist():
        joined.up[x] = 0
        edges.append((0, x))
    tree = Tree(size, point, bands) if len(apart) else None
    for x in apart.tolist():
        for y in tree.near(x).tolist():
            if joined.top(x) != joined.top(y):
                joined.up[joined.top(x)] = joined.top(y)
                edges.append((x, y))
    return edges


def tree_join(sets: list[np.ndarray], bands: Bands, hub: int, asking: list[int] | None = None) -> tuple[list[tuple[int, int]], list[int]]:
    """Links that span the components among `sets`, and the rows not linked with the row `hub`.

    First every row is compared with the hub, then the rows in `asking` (default: those not linked with it) with all
    others, through the tree.
    """
    n, joined, links, apart = len(sets), Joined(len(sets)), [], []
    for x in range(n):
        if x != hub:
            if bands.linked(sets[hub], sets[x]):
                joined.up[joined.top(x)] = joined.top(hub)
                links.append((hub, x))
            else:
                apart.append(x)
    asking = apart if asking is None else asking
    if not asking or n < 3 and asking is apart:
        return links, apart
    size = np.array([len(s) for s in sets])
    groups = group_count(int(size.min()))
    tree = Tree(size, np.stack([np.bincount((s & _U(groups - 1)).astype(np.int64), minlength=groups) for s in sets]), bands)
    for x in asking:
        for y in tree.near(x).tolist():
            if joined.top(x) != joined.top(y) and bands.linked(sets[x], sets[y]):
                joined.up[joined.top(x)] = joined.top(y)
                links.append((x, y))
    return links, apart


def _bounded(bands: Bands):
    """Partitions sorted by (leader, band, low, high) of points to the edges of their forests."""

    def close(band, rows):
        ids, size, points = zip(*rows)
        size, groups = np.array(size), group_count(bands.low[band])
        point = np.stack([np.frombuffer(p, np.uint8 if len(p) == groups else np.uint32) for p in points])
        point = point.astype(np.int16 if point.dtype == np.uint8 else np.int64)
        return [(ids[x], ids[y]) for x, y in bound_forest(size, point, bands)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []
        for batch in batches:
            for *own, x, n, point in zip(*(c.to_pylist() for c in batch.columns)):
                if own != key:
                    if len(rows) > 1:
                        out += close(key[1], rows)
                    key, rows = own, []
                rows.append((x, n, point))
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])
                out = []
        if len(rows) > 1:
            out += close(key[1], rows)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])

    return run


def _verify(k: int, bands: Bands, within: bool):
    """Partitions sorted by (leader, block, second block) to rows (leader, a, b): links, and (leader, x, null) for x apart from it."""

    def close(key, ids, sets, roles):
        ids_array = np.array(ids)
        hub = int(np.flatnonzero(ids_array == key[0])[0]) if (ids_array == key[0]).any() else 0
        if within:
            links, apart = tree_join(sets, bands, hub)
        else:
            asking = [i for i, r in enumerate(roles) if r == 1]
            links, apart = tree_join(sets, bands, hub, asking)
        for x, y in links:
            yield key[0], ids[x], ids[y]
        if within:
            for x in apart:
                yield key[0], ids[x], None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets, roles, out = None, [], [], [], []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for *own, x, role, tokens in zip(*columns, kernel.distinct_shingles(batch.column(5), k)):
                if own != key:
                    if len(ids) > 1:
                        out += close(key, ids, sets, roles)
                    key, ids, sets, roles = own, [], [], []
                ids.append(x)
                sets.append(tokens)
                roles.append(role)
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["leader", "a", "b"])
                out = []
        if len(ids) > 1:
            out += close(key, ids, sets, roles)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["leader", "a", "b"])

    return run


_OWN = "doc_id long, n_shingles long, h1 long, h2 long, points array<struct<band:int,point:binary>>"


def _sets(k: int, bands: Bands):
    kind = pa.list_(pa.struct([("band", pa.int32()), ("point", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(len(s), *_digest(s), [{"band": b, "point": bands.point(s, b).tobytes()} for b in bands.of(len(s))] if len(s) else []) for s in kernel.distinct_shingles(batch.column(1), k)]
            columns = zip(*found) if found else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (*[pa.int64()] * 3, kind)))], ["doc_id", "n_shingles", "h1", "h2", "points"])

    return run


def candidate_groups(docs: DataFrame, own: DataFrame, k: int, bands: Bands, block_points: int) -> DataFrame:
    """(leader, member, n): groups such that different sets that link are in one group; `own` is what _sets() gives for `docs`."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    common = docs.sparkSession.sparkContext.broadcast(common_tokens(docs, k))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = parts * max(1, -(-size // (parts * CELL_BYTES)))
    packed = docs.mapInArrow(_pack(k, bands, cells, parts, common), _PACKED)
    led = packed.repartitionById(parts, F.col("part")).sortWithinPartitions("cell", "band").mapInArrow(_leaders, "leader long, band int, member long").distinct().checkpoint()
    blocks = led.groupBy("leader", "band").agg(F.ceil(F.count("*") / block_points).cast("int").alias("blocks"))
    points = own.where("doc_id is not null").select(F.col("doc_id").alias("member"), F.col("n_shingles").alias("n"), F.inline("points"))
    rows = join_hot(led, blocks, ["leader", "band"], led.count()).join(points, ["member", "band"]).withColumn("block", F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = ("leader", "band", "low", "high")
    rows = rows.select("leader", "band", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "member", "n", "point")
    edges = rows.repartition(parts, *key).sortWithinPartitions(*key, "member").mapInArrow(kernel.releasing(_bounded(bands)), "a long, b long")
    sizes = own.groupBy("doc_id").agg(F.max("n_shingles").alias("n"))
    return components(edges).select(F.col("component").alias("leader"), F.col("node").alias("doc_id")).join(sizes, "doc_id").select("leader", F.col("doc_id").alias("member"), "n").checkpoint()


def jaccard_links(docs: DataFrame, led: DataFrame, k: int, bands: Bands, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Verified links (a, b) that span the components of `docs` (doc_id long, text string), from candidate groups (leader, member, n).

    Links between equal sets are left to the caller.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = kernel.rows_with_id(docs, spark.sparkContext.broadcast(kernel.id_bitmap(led.select("member").distinct())))  # other texts stay where they are
    weight = led.groupBy("leader").agg(F.ceil(F.sum("n") / block_shingles).cast("int").alias("blocks"))
    member = join_hot(led, weight, ["leader"], led.count()).withColumn(
        "block", F.when(F.col("leader") == F.col("member"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int")))
    )  # the leader goes to every block
    rows = member.select("leader", F.explode("block").alias("block"), F.lit(0).alias("second"), F.col("member").alias("doc_id"), F.lit(0).alias("role"))
    order = ("leader", "block", "second")

    def verified(rows: DataFrame, within: bool) -> DataFrame:
        return docs.join(rows, "doc_id").select(*order, "doc_id", "role", "text").repartition(parts, *order).sortWithinPartitions(*order, "doc_id").mapInArrow(kernel.releasing(_verify(k, bands, within)), "leader long, a long, b long")

    first = verified(rows, True).checkpoint()
    links = first.where("b is not null").select("a", "b")
    large = weight.where("blocks > 1")
    apart = first.where("b is null").select("leader", F.col("a").alias("member")).distinct().join(large, "leader").join(led, ["leader", "member"])
    if apart.take(1):  # rows of a divided group that are apart from its leader still have to meet the other blocks
        again = apart.groupBy("leader").agg(F.ceil(F.sum("n") / block_shingles).cast("int").alias("seconds"))
        asking = apart.join(again, "leader").select("leader", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("member"), F.col("seconds")).cast("int").alias("second"), F.col("member").alias("doc_id"), F.lit(1).alias("role"))
        asked = member.where("leader != member").join(again, "leader").select("leader", F.explode("block").alias("block"), "seconds", F.col("member").alias("doc_id")).select("leader", "block", F.explode(F.sequence(F.lit(0), F.col("seconds") - 1)).alias("second"), "doc_id", F.lit(0).alias("role"))
        links = links.unionAll(verified(asking.unionAll(asked), False).select("a", "b"))
    return links


def ngram_jaccard_join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, block_shingles: int = BLOCK_SHINGLES, block_points: int = BLOCK_POINTS) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id (the smallest doc_id reachable by links).

    Sets are the distinct k-word shingles of the lower-cased (A-Z) text, or the whole sequence if it has fewer words.
    A null or wordless text has the empty set and links with nothing; a null doc_id links with nothing and has a null
    component_id; rows with the same doc_id are one node.  Other columns of `docs` are ignored.  An empty table gives no rows.
    """
    shared_dir(docs.sparkSession)
    bands = Bands(num, den)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = docs.mapInArrow(kernel.releasing(_sets(k, bands)), _OWN).checkpoint()
    linking = own.where("n_shingles > 0 and doc_id is not null").select("doc_id", "h1", "h2", "n_shingles")
    same = linking.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")
    equal = join_hot(linking, same, ["h1", "h2", "n_shingles"], linking.count()).select(F.col("doc_id").alias("a"), F.col("first_id").alias("b")).where("a != b")
    named = docs.where("doc_id is not null")
    groups = candidate_groups(named, own, k, bands, block_points)
    label = components(jaccard_links(named, groups, k, bands, block_shingles).unionAll(equal))
    return own.select("doc_id", "n_shingles").join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
