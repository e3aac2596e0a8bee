"""Phrases whose words occur together, mined from count tries.

A shard of texts becomes a trie of the counts of its phrases, of a limited depth.  Serialised, a trie is its nodes in order,
level by level, cut at the same boundaries everywhere; what lies between two boundaries meets in one task, which merges the
sorted nodes of all shards.  A boundary may lie anywhere in the trie, so a word before very many others is split too; the
nodes on the path to a boundary go with what is behind it, so a range knows the counts above its nodes.

What is left of a cut through a phrase is a node above it: the walk down the trie gives it.  What is right of it starts with
another word and lies in another range: it is the node that the phrase's suffix link points to, found by a join of frequent
phrases, which brings the right parts of that suffix with it.

A phrase is frequent only if its parts are, so there is a pass for each level: the trie of a pass has nodes for frequent
phrases, and on its last level for phrases whose first and last parts are.  Which are frequent is told by a bitmap of a bounded
size, that holds others by chance: it decides how much is sent, never a count.

A node's word is a 64-bit hash of its language and itself; another 64 bits are compared wherever equal hashes meet, and a hash
that stands for two words makes the job begin again with other hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm import kernel
from rankloom.session import saved, shared_dir

#: Bytes of text in a shard, in a range of the merged trie, and in the sample that boundaries are drawn from.
SHARD_BYTES, RANGE_BYTES, SAMPLE_BYTES = 8 << 20, 8 << 20, 32 << 20
#: Nodes of a shard of the sample that may be a boundary.
PROPOSED = 4096
#: Hashes that are tried before the job gives up.
TRIES = 4
_U = np.uint64
_C = _U(0x9E3779B97F4A7C15)
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[list(b".,;:!?")] = 10


class Level(NamedTuple):
    """Nodes in order: the place of each one's parent in the level above, its word's place among the words, and its count."""

    parent: np.ndarray
    word: np.ndarray
    count: np.ndarray


class Trie(NamedTuple):
    """Words are hashes in order, with second hashes and where they first occur: row, begin and end byte."""

    words: np.ndarray
    checks: np.ndarray
    rows: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    levels: list[Level]


class Collision(Exception):
    """A hash stands for two words."""


def _grouped(key: np.ndarray, count: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the sum of their counts, the first row of each, and each row's key; sorted runs are merged."""
    order = np.argsort(key, kind="stable")
    new = np.ones(len(key), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    begin = np.flatnonzero(new)
    total = np.diff(np.append(begin, len(key))) if count is None else np.add.reduceat(count[order], begin) if len(begin) else count[:0]
    at = np.empty(len(key), np.int64)
    at[order] = np.cumsum(new) - 1
    return key[order[begin]], total, order[begin], at


def _held(bitmap: np.ndarray, key: np.ndarray) -> np.ndarray:
    at = kernel.id_bits(key, len(bitmap) * 8)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _deeper(path: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase and a word behind it."""
    return kernel.mix64(path * _C + word)


def shard_trie(texts: pa.Array, langs: pa.Array, depth: int, seed: int, frequent: list[np.ndarray]) -> Trie | None:
    """The trie of texts to `depth` words; only the last level has phrases that `frequent` (a bitmap a level) does not hold."""
    data, offsets = kernel.utf8(texts)
    names = langs.dictionary_encode()
    codes = np.array([int.from_bytes(n.encode(), "little") % ((1 << 64) - 59) for n in names.dictionary.to_pylist()], _U)
    lang = kernel.mix64(codes + _U(1))[np.asarray(names.indices)] if len(codes) else np.zeros(len(langs), _U)
    salt = kernel.mix64(np.array([seed + 1], _U))[0]
    parts = []
    for a, b, own, ends in kernel.slices(_PLAIN[data], offsets):
        word, first = kernel.word_hashes(own, ends)
        if not len(word):
            continue
        begins, stops, _ = kernel.words(own, ends)
        breaks = np.cumsum((own >= 10) & (own <= 13))
        row = np.repeat(np.arange(a, b), np.diff(first))
        joined = np.append(False, (breaks[begins[1:]] == breaks[begins[:-1]]) & (row[1:] == row[:-1]))
        check = kernel.mix64(word * _C + (stops - begins).astype(_U)) ^ lang[row]
        parts.append((kernel.mix64(word + lang[row] * _C ^ salt), check, joined, row, begins + offsets[a], stops + offsets[a]))
    if not parts:
        return None
    key, check, joined, row, begins, stops = map(np.concatenate, zip(*parts))
    if depth > 1:
        kept = np.flatnonzero(_held(frequent[0], key))
        joined = (np.cumsum(~joined)[kept] == np.append(-1, np.cumsum(~joined)[kept][:-1])) & (np.diff(kept, prepend=-2) == 1)
        key, check, row, begins, stops = (x[kept] for x in (key, check, row, begins, stops))
    words, count, first, word = _grouped(key)
    if (check != check[first][word]).any():
        raise Collision
    levels = [Level(np.zeros(len(words), np.int64), np.arange(len(words)), count)]
    path, node = words, word
    run = np.arange(len(key))
    run = run - np.maximum.accumulate(np.where(joined, 0, run))  # words before it in its piece
    for j in range(1, depth):
        ends = np.flatnonzero(run >= j)
        ends = ends[(node[ends - 1] >= 0) & (node[ends] >= 0)]
        pair, count, _, at = _grouped(node[ends - 1] * len(words) + word[ends])
        level = Level(pair // max(1, len(words)), pair % max(1, len(words)), count)
        path = _deeper(path[level.parent], words[level.word])
        if j < depth - 1:
            kept = _held(frequent[j], path)
            place = np.where(kept, np.cumsum(kept) - 1, -1)
            level, path, at = Level(*(x[kept] for x in level)), path[kept], place[at]
        node = np.full(len(key), -1, np.int64)
        node[ends] = at
        levels.append(level)
    return Trie(words, check[first], row[first], begins[first], stops[first], levels)


def _places(trie: Trie, cut: np.ndarray) -> list[tuple[int, int]]:
    """For each level, the first node behind the cut (a path, 0 behind its last word), and 1 if the node before it is above the cut."""
    out, above = [], 0  # `above`: the first node of the level above whose children are not before the cut
    exact = True  # whether that node is the cut's own prefix
    for j, level in enumerate(trie.levels):
        a, b = (int(np.searchsorted(level.parent, above + k)) for k in (0, 1))
        if not exact:
            out.append((a, 0))
            above = a
            continue
        own = trie.words[level.word[a:b]]
        at = a + int(np.searchsorted(own, cut[j])) if cut[j] else a
        exact = bool(cut[j]) and at < b and own[at - a] == cut[j]
        passed = exact and bool(cut[j + 1 :].any())
        out.append((at + passed, int(passed)))
        above = at
        exact = passed
    return out


def _slices(trie: Trie, cuts: np.ndarray) -> Iterator[tuple[int, list[tuple]]]:
    """(range, levels) of a trie cut into ranges; a level is (marked, children of each node above, words, counts)."""
    end = [(len(level.word), 0) for level in trie.levels]
    places = [[(0, 0)] * len(trie.levels), *(_places(trie, cut) for cut in cuts), end]
    for r, (low, high) in enumerate(zip(places[:-1], places[1:])):
        levels, before = [], (0, 1)
        for level, (a, mark), (b, _) in zip(trie.levels, low, high):
            own = slice(a - mark, b)
            kids = np.bincount(level.parent[own] - before[0], minlength=before[1] - before[0])
            levels.append((mark, kids, level.word[own], level.count[own]))
            before = (a - mark, b)
        if any(len(x[2]) for x in levels):
            yield r, levels


_LEVEL = pa.struct([("marked", pa.int32()), ("kids", pa.binary()), ("words", pa.binary()), ("counts", pa.binary())])
_SENT = pa.schema([("range", pa.int32()), ("levels", pa.list_(_LEVEL)), ("checks", pa.binary()), ("texts", pa.list_(pa.string())), ("langs", pa.list_(pa.string()))])
_SENT_DDL = "range int, levels array<struct<marked int, kids binary, words binary, counts binary>>, checks binary, texts array<string>, langs array<string>"


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Texts and languages of about SHARD_BYTES at a time."""
    held, size = [], 0
    for batch in batches:
        data, offsets = kernel.utf8(batch.column(0))
        for a, b, own, _ in kernel.slices(data, offsets, SHARD_BYTES):
            held.append(batch.slice(a, b - a))
            size += len(own)
            if size >= SHARD_BYTES:
                yield tuple(pa.concat_arrays([h.column(k) for h in held]) for k in (0, 1))
                held, size = [], 0
    if held:
        yield tuple(pa.concat_arrays([h.column(k) for h in held]) for k in (0, 1))


def _serialised(depth: int, seed: int, frequent: list[Broadcast], cuts: Broadcast, named: bool):
    """The slices of each shard's trie; words come with their texts and languages if `named`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, langs in _shards(batches):
            trie = shard_trie(texts, langs, depth, seed, [f.value for f in frequent])
            if trie is None:
                continue
            data, _ = kernel.utf8(texts)
            low = kernel.LOWER[data].tobytes() if named else b""
            for r, levels in _slices(trie, cuts.value):
                own = levels[0][2]
                packed = [{"marked": m, "kids": k.astype("<u4").tobytes(), "words": trie.words[w].tobytes(), "counts": c.astype("<u4").tobytes()} for m, k, w, c in levels]
                row = {"range": r, "levels": packed, "checks": trie.checks[own].tobytes(), "texts": None, "langs": None}
                if named:
                    row["texts"] = [low[a:b].decode() for a, b in zip(trie.begins[own].tolist(), trie.ends[own].tolist())]
                    row["langs"] = [langs[k].as_py() for k in trie.rows[own].tolist()]
                yield pa.RecordBatch.from_pylist([row], _SENT)

    return run


class Merged(NamedTuple):
    """The trie of a range: for each level, its nodes' parents, words, counts, and which are marked."""

    words: np.ndarray
    names: list[tuple[str, str]] | None
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def _merged(rows: list[dict]) -> Merged:
    """One trie of the slices of all shards."""
    read = [[(x["marked"], np.frombuffer(x["kids"], "<u4").astype(np.int64), np.frombuffer(x["words"], _U), np.frombuffer(x["counts"], "<u4").astype(np.int64)) for x in row["levels"]] for row in rows]
    words = np.unique(np.concatenate([level[2] for own in read for level in own]))
    levels, places, names = [], [np.zeros(1, np.int64) for _ in read], None
    for j in range(len(read[0])):
        parent = np.concatenate([at[np.repeat(np.arange(len(own[j][1])), own[j][1])] for own, at in zip(read, places)])
        word = np.searchsorted(words, np.concatenate([own[j][2] for own in read]))
        mark = np.concatenate([np.arange(len(own[j][2])) < own[j][0] for own in read])
        key, count, first, at = _grouped(parent * len(words) + word, np.concatenate([own[j][3] for own in read]))
        levels.append((key // len(words), key % len(words), count, mark[first]))
        cut = np.cumsum([len(own[j][2]) for own in read])
        places = np.split(at, cut[:-1])
        if j == 0:
            check = np.concatenate([np.frombuffer(row["checks"], _U) for row in rows])
            if (check != check[first][at]).any():
                raise Collision
            if rows[0]["texts"] is not None:
                texts, langs = ([v for row in rows for v in row[name]] for name in ("texts", "langs"))
                names = [(langs[k], texts[k]) for k in first.tolist()]
    return Merged(words, names, levels)


def _frequent_paths(least: int, depth: int, _: Merged, path: list[np.ndarray]) -> pa.RecordBatch:
    """The hashes of the frequent phrases of the last level."""
    _, _, count, mark = _.levels[depth - 1]
    return pa.RecordBatch.from_arrays([pa.array(path[depth - 1][(count >= least) & ~mark].view(np.int64))], ["id"])


_NODE_DDL = "level int, path array<long>, f long, lefts array<long>, lang string, first string"


def _frequent_nodes(least: int, depth: int, own: Merged, _: list[np.ndarray]) -> pa.RecordBatch:
    """The frequent phrases of all levels, with the counts of their left parts and their first word's name."""
    rows = []
    paths = [own.words[own.levels[0][1]][:, None]]
    lefts, first = [np.zeros((len(paths[0]), 0), np.int64)], [np.arange(len(paths[0]))]
    for parent, word, _, _ in own.levels[1:]:
        above = own.levels[len(paths) - 1][2]
        lefts.append(np.hstack([lefts[-1][parent], above[parent][:, None]]))
        first.append(first[-1][parent])
        paths.append(np.hstack([paths[-1][parent], own.words[word][:, None]]))
    for j, (_, _, count, mark) in enumerate(own.levels):
        kept = np.flatnonzero((count >= least) & ~mark)
        names = [own.names[k] for k in first[j][kept].tolist()]
        rows += [(j + 1, p, f, x, *n) for p, f, x, n in zip(paths[j][kept].view(np.int64).tolist(), count[kept].tolist(), lefts[j][kept].tolist(), names)]
    columns = list(zip(*rows)) or [()] * 6
    kinds = (pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64()), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["level", "path", "f", "lefts", "lang", "first"])


def _ranges(taken):
    """Merges the slices of each range, which come one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for k in range(len(batch)):
                r = batch.column(0)[k].as_py()
                if held and r != at:
                    yield finished(held)
                    held = []
                at = r
                held += batch.slice(k, 1).to_pylist()
        if held:
            yield finished(held)

    def finished(rows: list[dict]) -> pa.RecordBatch:
        own = _merged(rows)
        path = [own.words[own.levels[0][1]]]
        for parent, word, _, _ in own.levels[1:]:
            path.append(_deeper(path[-1][parent], own.words[word]))
        return taken(own, path)

    return run


def _proposed(depth: int, seed: int, frequent: list[Broadcast]):
    """Paths of some nodes of the last levels of a sample's tries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, langs in _shards(batches):
            trie = shard_trie(texts, langs, depth, seed, [f.value for f in frequent])
            if trie is None:
                continue
            paths = [trie.words[:, None]]
            for level in trie.levels[1:]:
                paths.append(np.hstack([paths[-1][level.parent], trie.words[level.word][:, None]]))
            own = np.concatenate([np.hstack([p, np.zeros((len(p), depth - p.shape[1]), _U)]) for p in paths])
            own = own[np.unique(np.linspace(0, len(own) - 1, PROPOSED).astype(np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array([own.tobytes()], pa.binary())], ["paths"])

    return run


def _cuts(docs: DataFrame, size: int, depth: int, seed: int, frequent: list[Broadcast]) -> np.ndarray:
    """Paths that cut tries of `depth` into ranges of like size, by a sample of SAMPLE_BYTES."""
    n = max(1, -(-size // RANGE_BYTES))
    if depth == 1:  # hashes are even
        return (np.arange(1, n, dtype=object) * ((1 << 64) // n)).astype(_U)[:, None]
    share = min(1.0, SAMPLE_BYTES / max(1, size))
    sample = docs.sample(share, seed=1) if share < 1 else docs
    found = [np.frombuffer(r.paths, _U).reshape(-1, depth) for r in sample.mapInArrow(_proposed(depth, seed, frequent), "paths binary").collect()]  # PROPOSED paths a shard of the sample
    if not found:
        return np.zeros((0, depth), _U)
    paths = np.unique(np.concatenate(found), axis=0)
    return paths[np.unique(np.linspace(0, len(paths), n + 1)[1:-1].astype(np.int64))]


def _merge_pass(docs: DataFrame, size: int, depth: int, seed: int, frequent: list[Broadcast], taken, schema: str, named: bool) -> DataFrame:
    context = docs.sparkSession.sparkContext
    cuts = context.broadcast(_cuts(docs, size, depth, seed, frequent))
    sent = docs.mapInArrow(kernel.releasing(_serialised(depth, seed, frequent, cuts, named)), _SENT_DDL)
    n = len(cuts.value) + 1
    sent = sent.repartition(n, "range") if n > 1 else sent.repartition(1, "range")
    return saved(sent.sortWithinPartitions("range").mapInArrow(kernel.releasing(_ranges(taken)), schema))


def frequent_phrases(docs: DataFrame, least: int = 10, depth: int = 3) -> DataFrame:
    """level, path (its words' hashes), f, lefts (counts of its first 1, 2 .. words), lang and first (word) of frequent phrases."""
    shared_dir(docs.sparkSession)
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")
    docs = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), lang)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    for seed in range(TRIES):
        try:
            frequent: list[Broadcast] = []
            for j in range(1, depth):
                ids = _merge_pass(docs, size, j, seed, frequent, lambda own, path, j=j: _frequent_paths(least, j, own, path), "id long", False)
                frequent.append(docs.sparkSession.sparkContext.broadcast(kernel.id_bitmap(ids)))
            return _merge_pass(docs, size, depth, seed, frequent, lambda own, path: _frequent_nodes(least, depth, own, path), _NODE_DDL, True)
        except Exception as e:
            if "Collision" not in str(e) or seed == TRIES - 1:
                raise
    raise AssertionError


def _totals(docs: DataFrame) -> DataFrame:
    """lang and n: all its words, counted where the texts are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = kernel.utf8(batch.column(0))
            counts = np.zeros(len(batch), np.int64)
            for a, b, own, ends in kernel.slices(_PLAIN[data], offsets):
                counts[a:b] = np.diff(kernel.words(own, ends)[2])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(counts)], ["lang", "n"])

    own = docs.select(F.col("text").cast("string"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    return own.mapInArrow(run, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n"))


def _score(f: Column, left: Column, right: Column) -> Column:
    """floor(1000000 f f / (left right)), in whole numbers of up to 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", (wide(f) * wide(f)).cast("decimal(31,0)") * F.lit(1000000).cast("decimal(7,0)"), wide(left) * wide(right))


def collocations(docs: DataFrame, least: int = 10, depth: int = 3, most: int = 2000, share: int = 50) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the `most` best phrases of 2 to `depth` words of each language.

    Phrases lie within pieces of texts, cut at `[.,;:!?]` and line ends, and occur at least `least` times (a).  The score is
    that of the phrase's worst cut into l and r; a phrase in a longer one with at least `share` % of its occurrences is left out.
    Ranks are by score, a, then phrase.  Null texts are empty, a null lang is "und", equal rows count each, texts are whole;
    other columns are ignored; an empty table has no phrases.
    """
    nodes = frequent_phrases(docs, least, depth)
    words = [f"w{k}" for k in range(1, depth + 1)]

    def level(j: int) -> DataFrame:
        own = nodes.where(F.col("level") == j)
        return own.select(*(F.col("path")[k].alias(words[k]) for k in range(j)), "f", "lefts", "lang", "first")

    parts = {1: level(1).select("w1", "f", F.array().cast("array<long>").alias("rights"), F.col("first").alias("phrase"))}
    found = None
    for j in range(2, depth + 1):
        suffix = parts[j - 1].select(*(F.col(words[k]).alias(words[k + 1]) for k in range(j - 1)), F.concat(F.array("f"), "rights").alias("rights"), F.col("phrase").alias("rest"))
        parts[j] = saved(level(j).join(suffix, words[1:j]).select(*words[:j], "f", "lefts", "rights", "lang", F.concat_ws(" ", "first", "rest").alias("phrase")))
    for j in range(2, depth + 1):
        longer = None
        for m in range(j + 1, depth + 1):
            for at in range(m - j + 1):
                inner = parts[m].select(*(F.col(words[at + k]).alias(words[k]) for k in range(j)), "f")
                longer = inner if longer is None else longer.unionByName(inner)
        own = parts[j]
        if longer is not None:
            longer = longer.groupBy(*words[:j]).agg(F.max("f").alias("around"))
            own = own.join(longer, words[:j], "left").where(F.col("around").isNull() | (100 * F.col("around") < share * F.col("f")))
        cuts = F.transform(F.sequence(F.lit(1), F.lit(j - 1)), lambda k: F.struct(_score(F.col("f"), F.col("lefts")[k - 1], F.col("rights")[k - 1]).alias("score"), k.alias("k"), F.col("lefts")[k - 1].alias("l"), F.col("rights")[k - 1].alias("r")))
        own = own.select("lang", "phrase", F.col("f").alias("a"), F.array_min(cuts).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
        found = own if found is None else found.unionByName(own)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most)
    return best.join(_totals(docs), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
