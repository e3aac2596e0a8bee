import math
import random

import numpy as np

from rankloom.llm import near_dedup as near_dedup_module
from rankloom.llm.near_dedup import learn_cells, near_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, kept string, cell int"


def brute(rows, threshold=0.93):
    def unit(i, v, label):
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        n = math.sqrt(sum(x * x for x in v))
        return [x / n for x in v]

    units, links = [unit(*r[:3]) for r in rows], {k: set() for k in range(len(rows))}
    for a in range(len(rows)):
        for b in range(a):
            if units[a] and units[b] and rows[a][2] == rows[b][2] and len(units[a]) == len(units[b]) and sum(x * y for x, y in zip(units[a], units[b])) >= threshold:
                links[a].add(b), links[b].add(a)
    out = []
    for k, (i, *_) in enumerate(rows):
        seen, stack = {k}, [k]
        while stack:
            for n in links[stack.pop()]:
                if n not in seen:
                    seen.add(n), stack.append(n)
        component = None if i is None else min(rows[x][0] for x in seen)
        out.append((i, len(links[k]), component, i is None or i == component))
    return sorted(out, key=str)


def made(seed, n=500, dim=6):
    r = random.Random(seed)
    as_float = lambda x: float(__import__("numpy").float32(x))
    rows, bases = [], [[r.gauss(0, 1) for _ in range(dim)] for _ in range(60)]
    for k in range(n):
        base = r.choice(bases)
        spread = r.choice([0.0, 0.05, 0.2, 0.4, 2.0])
        rows.append((k + 10, [as_float(r.choice([0.01, 1, 50]) * (x + r.gauss(0, spread))) if spread else as_float(x) for x in base], r.choice([0, 0, 0, 1, None]), "a", 1))
    nan, inf = float("nan"), float("inf")
    rows += [(1, None, 0, "a", 1), (2, [], 0, "a", 1), (3, [0.0] * dim, 0, "a", 1), (4, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0, "a", 1), (5, [nan] + [1.0] * 5, 0, "a", 1), (6, [inf] + [1.0] * 5, 0, "a", 1), (None, rows[0][1], 0, "a", 1), (7, [1.0, 2.0], 0, "a", 1), (8, [2.0, 4.0], 0, "a", 1), rows[3]]
    return rows


def run(spark, rows, **options):
    return sorted(map(tuple, near_dedup(spark.createDataFrame(rows, SCHEMA), **options).collect()), key=str)


def test_links_and_components_are_those_of_all_pairs(spark, monkeypatch):
    rows = made(1)
    want = brute(rows)
    assert run(spark, rows) == want
    assert run(spark, rows, block_bytes=300) == want  # 12 members a block
    monkeypatch.setattr(near_dedup_module, "centroid_count", lambda n: 9)
    assert run(spark, rows, block_bytes=300, sample=100) == want
    assert run(spark, rows) == want
    double = near_dedup(spark.createDataFrame(rows, SCHEMA.replace("float", "double")), block_bytes=600)
    assert sorted(map(tuple, double.collect()), key=str) == want


def test_no_link_is_lost_and_every_pair_counted_once_for_other_thresholds(spark, monkeypatch):
    rows = made(2, 300, 4)
    monkeypatch.setattr(near_dedup_module, "centroid_count", lambda n: 6)
    for threshold in (0.5, 0.999):
        assert run(spark, rows, threshold=threshold, block_bytes=160) == brute(rows, threshold)


def test_centroids_decide_at_every_size(spark):
    rows = made(3, 200)
    cells = learn_cells(spark.createDataFrame(rows, SCHEMA).select("embedding"))
    assert {d: len(c) for d, c in cells.centroids.items()} == {6: 2, 2: 1}  # the two vectors of length 2 have one direction
    assert all(abs(np.linalg.norm(c, axis=1) - 1).max() < 1e-9 for c in cells.centroids.values())


def test_blocks_and_guests_in_tiles(monkeypatch):
    monkeypatch.setattr(near_dedup_module, "TILE", 7)
    r = np.random.default_rng(5)
    x = near_dedup_module.unit_rows(r.normal(size=(40, 5))[r.integers(0, 40, 200)] + r.normal(size=(200, 5)) * 0.3)
    cells = near_dedup_module.Cells({5: near_dedup_module.unit_rows(r.normal(size=(6, 5)))}, 0.93)
    home = cells.place(x)[0]
    ids, weight, part = np.arange(200) + 1000, r.integers(1, 4, 200), np.zeros(200, np.int64)
    member = home >= 3  # lower cells are guests of the block
    block = near_dedup_module.Block(cells, 5, 0.93, x[member], ids[member], weight[member], home[member], part[member])
    found = [*block.receive(x[~member], ids[~member], weight[~member], home[~member]), *block.result()]
    links = dict.fromkeys(ids.tolist(), 0)
    for vec_id, n, _ in found:
        for i, k in zip(vec_id.tolist(), n.tolist()):
            links[i] += k
    close = (x @ x.T >= 0.93) & ~np.eye(200, dtype=bool) & (member[:, None] | member[None, :])
    assert list(links.values()) == (close * weight[None, :]).sum(1).tolist()
    joined = {frozenset((i, k)) for vec_id, _, root in found for i, k in zip(vec_id.tolist(), root.tolist())}
    up = list(range(200))
    top = lambda i: i if up[i] == i else top(up[i])
    for i, k in (tuple(j) for j in joined if len(j) == 2):
        a, b = top(i - 1000), top(k - 1000)
        up[max(a, b)] = min(a, b)
    reach = np.eye(200, dtype=bool) | close
    for _ in range(8):
        reach = reach @ reach
    assert [top(k) for k in range(200)] == [int(np.flatnonzero(row)[0]) for row in reach]


def test_empty_table(spark):
    assert run(spark, []) == []
