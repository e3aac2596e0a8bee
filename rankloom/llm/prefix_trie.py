"""The trie of conversations by their first turns, by radix partitioning from the first turn on.

Turns get numbers from a dictionary, and a conversation is its rows (conv_id, depth, number).  Conversations of a bucket
share their first turns; a bucket's shared turns are found from counts by depth, without its rows meeting, and the turn
after them deals its rows to new buckets.  A bucket with few rows is local: one task sorts its sequences by multikey
quicksort, whose partitions are nodes.  A larger one is dealt again, however many of its conversations are equal; how far
rows are dealt changes no result.  Large buckets are at most the rows over `most_local`, so what is known of them fits the
driver; sums come back to them from the local nodes below.

A digest of a node's conversations is made of their sorted numbers in blocks: blocks are made in parallel and digested in
turn, none held.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import word_count
from rankloom.llm import kernel
from rankloom.session import saved, shared_dir

#: Rows that a local bucket has at most, and how few make one however small the table is.
MOST_LOCAL, LEAST_LOCAL = 1 << 18, 1 << 10
#: Local buckets for each task, if all were of the largest size.
SHARES = 8
#: Rows that a task sorts at a time, ids in a block of a digest, and dictionary numbers that may collide.
CHUNK, BLOCK, MOST_COLLISIONS = 1 << 16, 1 << 13, 1 << 16
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _encoded(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, id and words of the turns, saved: equal role and text have an equal id, others another."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), word_count(text).cast("long").alias("words"),
        F.xxhash64(role, text).bitwiseAND(F.lit((1 << 63) - 1)).alias("id"), F.xxhash64(F.lit(7), text, role).alias("own"))
    rows = saved(rows)
    wrong = saved(rows.groupBy("id").agg(F.min("own").alias("a"), F.max("own").alias("b")).where("a <> b").select("id"))
    if not wrong.count():
        return rows.drop("own")
    pairs = rows.join(F.broadcast(wrong), "id", "left_semi").select("id", "own").distinct().orderBy("id", "own").limit(MOST_COLLISIONS).collect()
    if len(pairs) == MOST_COLLISIONS:
        raise ValueError("too many turns share a number")
    numbered = rows.sparkSession.createDataFrame([(a, b, -1 - k) for k, (a, b) in enumerate(pairs)], "id long, own long, new long")
    return rows.join(F.broadcast(numbered), ["id", "own"], "left").select("conv_id", "turn", "words", F.coalesce("new", "id").alias("id"))


_PLACED = "conv_id long, pos long, id long, words long, cum long"


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted partition: its first and last conversation, and how many rows and words each has."""
    part, first, last = None, None, None
    for batch in batches:
        if len(batch):
            conv, words = (np.asarray(batch.column(k)) for k in (1, 3))
            part = batch.column(0)[0].as_py()
            for a, b in zip(*_spans(conv)):
                own = [int(conv[a]), b - a, int(words[a:b].sum())]
                if last is not None and last[0] == own[0]:
                    last[1], last[2] = last[1] + own[1], last[2] + own[2]
                else:
                    last = own
                    first = first or last
    if part is not None:
        yield pa.RecordBatch.from_pylist([{"part": part, "first": first[0], "last": last[0], "n": last[1], "words": last[2]}])


def _spans(key: np.ndarray) -> tuple[list[int], list[int]]:
    """Begin and end of each run of equal keys."""
    cut = (np.flatnonzero(key[1:] != key[:-1]) + 1).tolist()
    return [0, *cut], [*cut, len(key)]


def _places(before):
    """Place and words so far of each row within its conversation, of which `before` knows what earlier partitions hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, total = None, 0, 0
        for batch in batches:
            if not len(batch):
                continue
            conv, ids, words = (np.asarray(batch.column(k)) for k in (1, 2, 3))
            if at is None:
                at, n, total = before.value.get(batch.column(0)[0].as_py(), (int(conv[0]), 0, 0))
            begins, ends = _spans(conv)
            size = np.subtract(ends, begins)
            sums = np.cumsum(words)
            base = np.where(np.array(begins) > 0, sums[np.array(begins) - 1], 0)
            pos, cum = np.arange(len(conv)) - np.repeat(begins, size) + 1, sums - np.repeat(base, size)
            if int(conv[0]) == at:
                pos[: ends[0]] += n
                cum[: ends[0]] += total
            at, n, total = int(conv[-1]), int(pos[-1]), int(cum[-1])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (conv, pos, ids, words, cum)], ["conv_id", "pos", "id", "words", "cum"])

    return run


def ordered(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), id, words and cum (words up to and with it) of each turn, saved.

    A conversation is in order of turn, null first, and of number where turns are equal; repeated rows are turns.  Rows of a
    null conv_id are left out; a null role or text is empty.  A conversation may lie in many partitions.
    """
    spark = conversations.sparkSession
    shared_dir(spark)
    keys = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("id")]
    rows = _encoded(conversations).repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = rows.select(F.spark_partition_id().alias("part"), "conv_id", "id", "words").checkpoint()
    before, open_conv, n, words = {}, None, 0, 0
    for x in sorted(rows.mapInArrow(_edges, "part long, first long, last long, n long, words long").collect()):  # a row a partition
        if x.first == open_conv:
            before[x.part] = (open_conv, n, words)
        spans = x.first == open_conv and x.first == x.last
        open_conv, n, words = x.last, x.n + (n if spans else 0), x.words + (words if spans else 0)
    return saved(rows.mapInArrow(_places(spark.sparkContext.broadcast(before)), _PLACED))


def spliced(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt to share turns, from those of `ordered`: rows (conv_id, depth, id, words, cum, length), and all conv_ids.

    The first h turns of c are those of conversation c - c % every (all if fewer, none if absent), and c's own follow after
    its first h; h = crc32(c as text) % most.  A conversation may be left without turns; its rows are then none.
    """
    heads = [F.max(F.when(F.col("pos") == k, F.col(c))).alias(f"{c}{k}") for k in range(1, most) for c in ("id", "words", "cum")]
    structs = [F.struct(*(F.col(f"{c}{k}").alias(c) for c in ("id", "words", "cum"))).alias(f"t{k}") for k in range(1, most)]
    own = saved(turns.groupBy("conv_id").agg(F.max("pos").alias("n"), *heads).select("conv_id", "n", *structs))
    base = own.select(F.col("conv_id").alias("base"), F.least("n", F.lit(most - 1)).alias("base_n"), F.array(*(f"t{k}" for k in range(1, most))).alias("lent"))
    known = own.select("conv_id", "n", F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(most)).alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base"),
                       F.array(*(f"t{k}" for k in range(1, most))).alias("dropped"))
    known = known.join(base, "base", "left").withColumn("m", F.least("h", F.coalesce("base_n", F.lit(0))))
    words_of = lambda turns, n: F.coalesce(F.try_element_at(turns, n.cast("int"))["cum"], F.lit(0))
    known = saved(known.select("conv_id", "h", "m", F.slice("lent", 1, F.col("m").cast("int")).alias("lent"), F.greatest(F.col("n") - F.col("h"), F.lit(0)).alias("kept"),
                               F.when(F.col("m") > 0, words_of(F.col("lent"), F.greatest("m", F.lit(1)))).otherwise(0).alias("lent_words"),
                               F.when(F.col("h") > 0, words_of(F.col("dropped"), F.greatest("h", F.lit(1)))).otherwise(0).alias("dropped_words")))
    length = (F.col("m") + F.col("kept")).alias("length")
    first = known.select("conv_id", F.posexplode("lent").alias("k", "t"), length).select("conv_id", (F.col("k") + 1).cast("long").alias("depth"), "t.id", "t.words", "t.cum", "length")
    rest = turns.join(known.drop("lent"), "conv_id").where("pos > h")
    rest = rest.select("conv_id", (F.col("m") + F.col("pos") - F.col("h")).alias("depth"), "id", "words", (F.col("cum") - F.col("dropped_words") + F.col("lent_words")).alias("cum"), length)
    return saved(first.unionByName(rest)), known.select("conv_id", length)


@dataclass
class Bucket:
    """A bucket dealt out by turns: the node that opens it, what it has and what comes back from below."""

    number: int
    parent: int | None
    least_above: int | None  # the conversation that names the node above
    depth: int
    n: int
    least: int
    words: int
    cum: int
    reach: int = 0  # the depth that all its conversations share
    reach_cum: int = 0
    children: int = 0
    leaves: int = 0
    tokens: int = 0  # what its children's subtrees save
    ends: str = NO_ENDS

    def saved_from(self, cum: int, words: int) -> int:
        return self.tokens + (self.n - 1) * (self.reach_cum - cum + words)


def prefix_trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of rows (conv_id, depth, id, words, cum, length) and convs (conv_id, length), saved tables.

    conv_id: a node's smallest member; parent_conv_id: that of the node above, null for the root; the other columns are
    counts of members, children and leaves below, the words saved by holding a turn once, and the digest of the members that
    end at the node.  No conversation, no node.
    """
    spark = rows.sparkSession
    shared_dir(spark)
    total, n = rows.count(), convs.agg(F.count("*"), F.min("conv_id")).first()
    if not n[0]:
        return spark.createDataFrame([], NODES)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    most_local = max(LEAST_LOCAL, min(MOST_LOCAL, total // (SHARES * tasks)))
    buckets = {0: Bucket(0, None, None, 0, n[0], n[1], 0, 0)}
    active, level, chains, local = rows.withColumn("bucket", F.lit(0)), [buckets[0]], [], []
    ends = [convs.where("length = 0").select(F.lit(0).alias("bucket"), "conv_id")]
    while level:
        frame = lambda made, schema: F.broadcast(spark.createDataFrame(made, schema))  # noqa: E731  a row for each large bucket
        known = frame([(b.number, b.depth, b.n) for b in level], "bucket int, top long, n long")
        stats = active.join(known, "bucket").where("depth > top").groupBy("bucket", "depth", "n").agg(F.count("*").alias("rows"), F.min("id").alias("a"), F.max("id").alias("b"), F.max("words").alias("words"), F.max("cum").alias("cum"))
        stats = saved(stats)
        apart = F.min(F.when((F.col("rows") < F.col("n")) | (F.col("a") != F.col("b")), F.col("depth")))
        for x in stats.groupBy("bucket").agg(apart.alias("apart"), F.max("depth").alias("deepest")).collect():
            buckets[x.bucket].reach = x.deepest if x.apart is None else x.apart - 1
        for b in level:
            b.reach, b.reach_cum = max(b.reach, b.depth), b.cum
        known = frame([(b.number, b.reach) for b in level], "bucket int, reach long")
        stats = stats.join(known, "bucket").where("depth <= reach")
        for x in stats.where("depth = reach").select("bucket", "cum").collect():
            buckets[x.bucket].reach_cum = x.cum
        chains.append(stats.select("bucket", "depth", "words", "cum", "reach"))
        here = active.join(known, "bucket")
        ends.append(here.where("depth = reach and length = reach").select("bucket", "conv_id"))
        turn = here.where("depth = reach + 1").select("conv_id", F.col("id").alias("turn"))
        below = saved(here.where("depth > reach").join(turn, "conv_id"))
        opens = F.col("depth") == F.col("reach") + 1
        dealt = below.groupBy("bucket", "turn").agg(F.count("*").alias("rows"), F.count_if(opens).alias("n"), F.min("conv_id").alias("least"), F.max(F.when(opens, F.col("words"))).alias("words"), F.max(F.when(opens, F.col("cum"))).alias("cum"))
        large = dealt.where(F.col("rows") > most_local).collect()  # at most `total` rows over `most_local`
        opened = []
        for x in large:
            above = buckets[x.bucket]
            opened.append(Bucket(len(buckets), above.number, above.least, above.reach + 1, x.n, x.least, x.words, x.cum))
            buckets[opened[-1].number] = opened[-1]
        named = frame([(x.bucket, x.turn, b.number) for x, b in zip(large, opened)], "bucket int, turn long, new int")
        local.append(below.join(named, ["bucket", "turn"], "left_anti").select("bucket", "turn", "conv_id", "depth", "id", "words"))
        active = below.join(named, ["bucket", "turn"]).select("conv_id", "depth", "id", "words", "cum", "length", F.col("new").alias("bucket"))
        level = opened

    least = spark.sparkContext.broadcast({b.number: b.least for b in buckets.values()})
    below = local[0]
    for more in local[1:]:
        below = below.unionByName(more)
    below = below.repartition("bucket", "turn").sortWithinPartitions("bucket", "turn", "conv_id", "depth")
    below = saved(below.mapInArrow(kernel.releasing(_finished(least)), NODES + ", bucket int"))
    for x in below.where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("tokens")).collect():
        b = buckets[x.bucket]
        b.children, b.leaves, b.tokens = x.n, x.leaves, x.tokens
    for number, digest in _end_digests(ends):
        buckets[number].ends = digest
    for b in reversed(buckets.values()):  # a bucket comes after that above it
        b.leaves = b.leaves or 1
        if b.parent is not None:
            above = buckets[b.parent]
            above.children, above.leaves, above.tokens = above.children + 1, above.leaves + b.leaves, above.tokens + b.saved_from(b.cum, b.words)
    return below.drop("bucket").unionByName(_large_nodes(buckets, chains))


def _large_nodes(buckets: dict[int, Bucket], chains: list[DataFrame]) -> DataFrame:
    """The nodes that open large buckets, and those of the turns that all conversations of one share."""
    spark = chains[0].sparkSession
    one = lambda b, last: (b.children if last else 1, b.ends if last else NO_ENDS)
    tops = [(b.least, b.depth, b.least_above, b.n, one(b, b.reach == b.depth)[0], b.leaves, b.saved_from(b.cum, b.words), one(b, b.reach == b.depth)[1]) for b in buckets.values()]
    found = spark.createDataFrame(tops, NODES)
    known = F.broadcast(spark.createDataFrame([(b.number, b.least, b.n, b.children, b.leaves, b.tokens, b.reach_cum, b.ends) for b in buckets.values()], "bucket int, least long, n long, children long, leaves long, tokens long, reach_cum long, ends string"))
    last = F.col("depth") == F.col("reach")
    for chain in chains:
        nodes = chain.join(known, "bucket").select(
            F.col("least").alias("conv_id"), "depth", F.col("least").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.when(last, F.col("children")).otherwise(1).alias("n_children"), F.col("leaves").alias("n_leaves"),
            (F.col("tokens") + (F.col("n") - 1) * (F.col("reach_cum") - F.col("cum") + F.col("words"))).alias("saved_tokens"), F.when(last, F.col("ends")).otherwise(NO_ENDS).alias("ends_sha256"))
        found = found.unionByName(nodes)
    return found


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joined numbers of the conversations that end in a bucket, some thousand at a time, with the first of them."""
    for batch in batches:
        bucket, conv = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        rows = []
        for a, b in zip(*_spans(bucket)) if len(bucket) else ():
            rows += [(int(bucket[k]), int(conv[k]), ",".join(map(str, conv[k : min(b, k + BLOCK)].tolist()))) for k in range(a, b, BLOCK)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.string()))], ["bucket", "first", "ids"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's digest, of its blocks in order."""
    at, digest, rows = None, None, []
    for batch in batches:
        for bucket, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if bucket != at:
                at, digest = bucket, hashlib.sha256()
                rows.append((at, digest))
            else:
                digest.update(b",")
            digest.update(ids.encode())
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1].hexdigest() for r in rows])], ["bucket", "ends"])


def _end_digests(ends: list[DataFrame]) -> list:
    """(bucket, digest) of the large buckets in whose last shared turn conversations end."""
    rows = ends[0]
    for more in ends[1:]:
        rows = rows.unionByName(more)
    blocks = rows.repartitionByRange("bucket", "conv_id").sortWithinPartitions("bucket", "conv_id").mapInArrow(_blocks, "bucket int, first long, ids string")
    return blocks.repartition("bucket").sortWithinPartitions("bucket", "first").mapInArrow(_digested, "bucket int, ends string").collect()


class _Sorted:
    """Nodes of local buckets, from their rows in order of bucket, turn, conversation and depth."""

    def __init__(self, least: dict[int, int]):
        self.least = least
        self.columns: dict[str, list] = defaultdict(list)

    def add(self, bucket, turn, conv, depth, ids, words) -> None:
        new = np.append(True, (bucket[1:] != bucket[:-1]) | (turn[1:] != turn[:-1]) | (conv[1:] != conv[:-1]))
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(conv)))
        group = np.append(True, (bucket[start][1:] != bucket[start][:-1]) | (turn[start][1:] != turn[start][:-1]))
        first = np.append(np.flatnonzero(group), len(start))
        self.ids, self.words, self.start, self.size, self.conv = ids, words, start, size, conv[start]
        self.nodes: list[list] = []  # conv_id, depth, parent, n_convs, children, leaves, saved, ends, bucket
        alone = first[:-1][np.diff(first) == 1]
        tails = [(alone, np.zeros(len(alone), np.int64), np.array([self.least[b] for b in bucket[start[alone]].tolist()], np.int64), bucket[start[alone]])]
        shared = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a > 1:
                own = int(bucket[start[a]])
                self._sort(np.arange(a, b), int(depth[start[a]]), own, shared)
        if shared:
            tails.append(tuple(map(np.array, zip(*shared))) + (None,))
        for tail in tails:
            self._tails(depth, *tail)

    def _sort(self, seqs: np.ndarray, top: int, bucket: int, tails: list) -> None:
        """Multikey quicksort of sequences that share their first turn, from it on; single ones are left to `tails`."""
        base = len(self.nodes)
        todo = [(seqs, 0, None)]
        while todo:
            seqs, k, above = todo.pop()  # sequences in order of conv_id that share the k turns up to node `above`
            if above is not None:
                over = self.size[seqs] == k
                if over.any():
                    above[7] = [*above[7], *self.conv[seqs[over]].tolist()]
                    seqs = seqs[~over]
            if not len(seqs):
                continue
            turn = self.ids[self.start[seqs] + k]
            pivot = turn[len(turn) >> 1]
            equal = seqs[turn == pivot]
            if len(equal) < len(seqs):
                todo += [(part, k, above) for part in (seqs[turn < pivot], seqs[turn > pivot]) if len(part)]
            if above is not None:
                above[4] += 1
            if len(equal) == 1:
                above[5] += 1
                tails.append((equal[0], k, above[0]))
                continue
            words = int(self.words[self.start[equal[0]] + k])
            node = [int(self.conv[equal[0]]), top + k, above, len(equal), 0, 0, (len(equal) - 1) * words, [], bucket if above is None else None]
            self.nodes.append(node)
            todo.append((equal, k + 1, node))
        for node in reversed(self.nodes[base:]):
            node[5] = node[5] or 1
            above = node[2]
            if above is not None:
                above[5] += node[5]
                above[6] += node[6]
                node[2] = above[0]
            else:
                node[2] = self.least[bucket]
            node[7] = hashlib.sha256(",".join(map(str, sorted(node[7]))).encode()).hexdigest() if node[7] else NO_ENDS

    def _tails(self, depth: np.ndarray, seqs: np.ndarray, skip: np.ndarray, above: np.ndarray, bucket: np.ndarray | None) -> None:
        """The nodes of turns that one conversation has to itself, behind its first `skip`."""
        if not len(seqs):
            return
        size = self.size[seqs] - skip
        begin = np.cumsum(size) - size
        at = np.repeat(self.start[seqs] + skip - begin, size) + np.arange(size.sum())
        conv = np.repeat(self.conv[seqs], size)
        parent = conv.copy()
        parent[begin] = above
        last = begin + size - 1
        children = np.ones(len(at), np.int64)
        children[last] = 0
        ends = np.full(len(at), NO_ENDS, object)
        ends[last] = [hashlib.sha256(str(c).encode()).hexdigest() for c in self.conv[seqs].tolist()]
        top = np.full(len(at), -1, np.int64)
        if bucket is not None:
            top[begin] = bucket
        one = np.ones(len(at), np.int64)
        for name, column in zip(_NAMES, (conv, depth[at], parent, one, children, one, one - 1, ends, top)):
            self.columns[name].append(column)

    def taken(self) -> pa.RecordBatch:
        made = {name: np.concatenate(self.columns[name]) if self.columns[name] else np.zeros(0, np.int64) for name in _NAMES}
        shared = list(zip(*self.nodes)) or [()] * len(_NAMES)
        own = [shared[k] if name != "bucket" else [-1 if b is None else b for b in shared[k]] for k, name in enumerate(_NAMES)]
        arrays = []
        for name, more in zip(_NAMES, own):
            kind = pa.string() if name == "ends_sha256" else pa.int64()
            arrays.append(pa.concat_arrays([pa.array(made[name] if len(made[name]) else [], kind), pa.array(list(more), kind)]))
        arrays[-1] = pc.if_else(pc.less(arrays[-1], 0), pa.scalar(None, pa.int64()), arrays[-1]).cast(pa.int32())
        self.columns.clear()
        return pa.RecordBatch.from_arrays(arrays, _NAMES)


_NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "bucket"]


def _finished(least):
    """Local buckets, whole ones of about CHUNK rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append([np.asarray(c) for c in batch.columns])
            n += len(batch)
            if n >= CHUNK:
                columns = [np.concatenate(c) for c in zip(*held)]
                bucket, turn = columns[:2]
                cut = np.flatnonzero((bucket[1:] != bucket[:-1]) | (turn[1:] != turn[:-1]))
                if len(cut):
                    end = int(cut[-1]) + 1
                    yield from sorted_nodes([c[:end] for c in columns])
                    columns = [c[end:] for c in columns]
                held, n = [columns], len(columns[0])
        if n:
            yield from sorted_nodes([np.concatenate(c) for c in zip(*held)])

    def sorted_nodes(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        own = _Sorted(least.value)
        own.add(*columns)
        yield own.taken()

    return run


def shared_prefixes(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of `conversations` (conv_id, turn, role, text); other columns are left out.

    Nulls: rows of a null conv_id are left out, a null turn comes first, a null role or text is empty.  Equal turns of a
    conversation are taken in a fixed order, repeated rows are repeated turns, and texts and conversations may be of any
    length.  An empty table has no node.
    """
    rows, convs = spliced(ordered(conversations))
    return prefix_trie(rows, convs)
