import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from rankloom.llm import graph, kernel, ngram_join
from rankloom.llm.graph import components
from rankloom.llm.ngram_join import COMMON_BITS, Bands, ngram_jaccard_join, tree_join

SCHEMA = "doc_id long, text string, leader long, block int"


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def shingle_set(text, k):
    w = words_of(text)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k, num, den):
    sets = [shingle_set(t, k) for _, t in rows]
    up = {i: i for i, _ in rows if i is not None}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, _) in enumerate(rows):
        for b in range(a):
            j, both = rows[b][0], len(sets[a] & sets[b])
            if both and i is not None and j is not None and den * both >= num * len(sets[a] | sets[b]):
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else top(i)) for (i, _), s in zip(rows, sets)), key=str)


def made_rows(seed):
    r = random.Random(seed)
    vocabulary = [f"w{n}" for n in range(300)]
    passage = [r.choice(vocabulary) for _ in range(60)]
    rows, bases = [], []
    for _ in range(40):
        bases.append([r.choice(vocabulary) for _ in range(r.choice([1, 2, 3, 4, 5, 6, 7, 9, 14, 30, 80, 200, 700]))])
    for n in range(260):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        if r.random() < 0.3:
            at = r.randrange(len(w) + 1)
            w[at:at] = passage
        rows.append((n * 3 + 1, r.choice(["", " ", "\n"]) + r.choice([" ", "\t", "  "]).join(w).replace("w1", r.choice(["W1", "w1"]))))
    rows += [(None, rows[0][1]), (None, None), (9000, None), (9001, ""), (9002, " \n\t"), (9003, "é É x"), (rows[5][0], rows[5][1]), (9004, "a b c d e " * 3000), (9005, "a b c d e " * 3000)]
    r.shuffle(rows)
    return rows


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], SCHEMA)
    return sorted(map(tuple, ngram_jaccard_join(df, **options).collect()), key=str)


def test_join_matches_all_pairs(spark):
    rows = made_rows(1)
    assert run(spark, rows, k=4, num=85, den=100) == brute(rows, 4, 85, 100)
    assert run(spark, rows, k=5, num=80, den=100) == brute(rows, 5, 80, 100)


def test_divided_groups_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(graph, "LEAST_HOT", 3)
    monkeypatch.setattr(graph, "SHARES", 40)
    monkeypatch.setattr(ngram_join, "CELL_BYTES", 1000)
    rows = made_rows(2)
    assert run(spark, rows, k=4, num=85, den=100, block_shingles=300, block_points=3) == brute(rows, 4, 85, 100)


def test_empty_table(spark):
    assert run(spark, [], k=4) == []


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(0, 2**32), st.sampled_from([(85, 100), (80, 100), (1, 2)]))
def test_linked_sets_share_a_node(n, seed, threshold):
    r = np.random.default_rng(seed)
    a = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
    bands = Bands(*threshold)
    most = len(a) - -(-len(a) * bands.num // bands.den)
    b = np.unique(np.concatenate([a[int(r.integers(0, most + 1)) :], r.integers(0, 2**64, int(r.integers(0, most + 1)), dtype=np.uint64)]))
    if bands.linked(a, b) and not np.array_equal(a, b):
        common = np.where(r.random(COMMON_BITS // 8) < r.choice([0.0, 0.5, 1.0]), 255, 0).astype(np.uint8)
        nodes, others = dict(bands.nodes(a, common)), dict(bands.nodes(b, common))
        assert any(len(np.intersect1d(nodes[k], others[k])) for k in nodes.keys() & others.keys())
        for k in nodes.keys() & others.keys():
            assert np.minimum(bands.point(a, k), bands.point(b, k)).sum() >= bands.needed(len(a), len(b))


def test_the_tree_has_levels_and_loses_no_near_point():
    r = np.random.default_rng(9)
    bands = Bands(85, 100)
    bases = r.integers(0, 4, (20, 64))
    point = (bases[r.integers(0, 20, 3000)] + (r.random((3000, 64)) < 0.02)).astype(np.int16)
    size = point.sum(1)
    tree = ngram_join.Tree(size, point, bands)
    assert len(tree.levels) == 2 and [len(t) for t, _, _ in tree.levels] == [94, 3]
    for x in range(0, 3000, 97):
        near = (np.minimum(point, point[x]).sum(1) >= bands.needed(size, size[x])) & (np.minimum(size, size[x]) * 100 >= np.maximum(size, size[x]) * 85)
        assert set(np.flatnonzero(near)) <= set(tree.near(x).tolist()) and x in tree.near(x)


def test_tree_finds_every_component():
    r = np.random.default_rng(3)
    sets = []
    for _ in range(150):
        base = sets[int(r.integers(len(sets)))] if sets and r.random() < 0.7 else np.unique(r.integers(0, 2**64, 100, dtype=np.uint64))
        sets.append(np.unique(np.concatenate([base[int(r.integers(0, 9)) :], r.integers(0, 2**64, int(r.integers(0, 9)), dtype=np.uint64)])))
    bands = Bands(85, 100)
    links, _ = tree_join(sets, bands, 0)

    def roots(pairs):
        up = list(range(len(sets)))
        for _ in range(len(sets)):
            for x, y in pairs:
                up[x] = up[y] = min(up[x], up[y])
        return up

    assert roots(links) == roots([(x, y) for x in range(len(sets)) for y in range(x) if bands.linked(sets[x], sets[y])])
    assert all(bands.linked(sets[x], sets[y]) for x, y in links)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from(list("abAB é\t\n\x0b\x0c\r ߿𝄞\x1f\x85")), max_size=30)), max_size=8), st.integers(1, 5))
def test_kernel_words_and_shingles(texts, k):
    column = pa.array(texts, pa.string())
    assert kernel.word_counts(column).tolist() == [len(words_of(t)) for t in texts]
    assert [len(s) for s in kernel.distinct_shingles(column, k)] == [len(shingle_set(t, k)) for t in texts]


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(n, n + 1) for n in range(1000, 1060)] + [(2000, n) for n in range(2001, 2100)] + [(7, 7), (None, 3)]
    up = {}
    for a, b in edges:
        if None not in (a, b) and a != b:
            up.setdefault(a, a), up.setdefault(b, b)
    for _ in range(len(up)):
        changed = False
        for a, b in edges:
            if a in up and b in up and up[a] != up[b]:
                up[a] = up[b] = min(up[a], up[b])
                changed = True
        if not changed:
            break
    found = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == up
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
