import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from rankloom.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string"


def brute_rebuilt(rows):
    turns = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(own, key=lambda t: t[:2])] for c, own in turns.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        rebuilt[c] = turns.get(base, [])[:h] + own[h:]
    return rebuilt


def brute(rows):
    members = defaultdict(list)
    rebuilt = brute_rebuilt(rows)
    for c, own in rebuilt.items():
        for d in range(len(own) + 1):
            members[tuple(own[:d])].append(c)
    out = set()
    for node, own in members.items():
        under = [m for m in members if m[: len(node)] == node]
        children = [m for m in under if len(m) == len(node) + 1]
        leaves = [m for m in under if not any(len(x) == len(m) + 1 and x[: len(m)] == m for x in under)]
        words = lambda m: len(re.findall(r"[^\x20\x09-\x0D]+", m[-1][1])) if m else 0
        ends = sorted(c for c in own if len(rebuilt[c]) == len(node))
        out.add((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(children), len(leaves),
                 sum((len(members[m]) - 1) * words(m) for m in under), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out


def nodes(spark, rows):
    found = prefix_trie.shared_prefixes(spark.createDataFrame([(*r[:4], "clash") for r in rows], SCHEMA)).collect()
    assert len(set(map(tuple, found))) == len(found)
    return set(map(tuple, found))


def drawn(seed, convs=60, deepest=7, words=3):
    draw = random.Random(seed)
    rows = []
    for c in draw.sample(range(-40, 200), convs):
        rows += [(c, t, draw.choice(["user", "assistant", None]), draw.choice([None, "", "a", "a b", "b  c\n d"][:words])) for t in range(draw.randint(1, deepest))]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("least, seed", [(1 << 10, 1), (4, 2), (1, 3), (20, 4)])
def test_nodes_against_brute_force(spark, monkeypatch, least, seed):
    """From one level of dealing to dealing down to single rows."""
    monkeypatch.setattr(prefix_trie, "LEAST_LOCAL", least)
    monkeypatch.setattr(prefix_trie, "CHUNK", 16)
    rows = drawn(seed, words=2 if seed > 2 else 3)
    assert nodes(spark, rows) == brute(rows)


def test_copies_long_conversations_and_turnless_ones(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "LEAST_LOCAL", 30)
    monkeypatch.setattr(prefix_trie, "BLOCK", 7)
    same = [("user", "hello there"), ("assistant", "yes " * 50), ("user", "bye")]
    rows = [(c, t, *same[t]) for c in range(0, 1000, 20) for t in range(3)]
    rows += [(c, t, *same[t]) for c in range(2000, 2030) for t in range(3)]
    rows += [(7777, t, "user", f"turn {t % 5}") for t in range(120)]
    rows += [(7780, t, "user", f"turn {t % 5}") for t in range(90)]
    rows += [(c, 0, "user", "only") for c in range(3000, 3010)]  # some lose their one turn
    assert nodes(spark, rows) == brute(rows)


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(None, 1, "user", "lost"), (5, None, "user", "first"), (5, 1, None, None), (5, 2, "", ""), (6, 1, "user", "twice"), (6, 1, "user", "twice"), (6, 1, "user", "twice"), (6, 1, "user", "twice"), (26, 0, "user", "far")]
    assert nodes(spark, rows) == brute(rows)
    assert nodes(spark, [(None, 1, "user", "lost")]) == set() and nodes(spark, []) == set()
    assert nodes(spark, [(1, 0, "user", "x y")]) == brute([(1, 0, "user", "x y")])


def test_a_conversation_over_many_partitions(spark):
    rows = [(1, t, "user", f"{t % 7} words here") for t in range(3000)] + [(2, t, "user", "other") for t in range(5)]
    turns = prefix_trie.ordered(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)).orderBy("conv_id", "pos").collect()
    assert [(r.conv_id, r.pos, r.cum) for r in turns] == [(1, t + 1, 3 * (t + 1)) for t in range(3000)] + [(2, t + 1, t + 1) for t in range(5)]


def test_numbers_that_collide_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    real = F.xxhash64
    monkeypatch.setattr(prefix_trie.F, "xxhash64", lambda *c: real(*c) if len(c) == 3 else real(*c) % 3)
    rows = drawn(9, convs=20)
    assert nodes(spark, rows) == brute(rows)


def test_query(spark):
    from rankloom.llm import queries

    source = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{source}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert set(map(tuple, queries.QUERIES["op12_prefix_trie"](spark, source).collect())) == brute(rows)
