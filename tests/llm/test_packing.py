import os
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rankloom.llm import packing

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_ids_are_those_of_the_tokenizer(text):
    text = text.encode("utf-8", "ignore").decode()
    assert packing.token_ids(text, RANKS, public_tokenizers.PATTERN).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_ids_of_odd_texts():
    for text in ("", " ", "\n\n \t ", "<|endoftext|>a <|endoftext|>", "don't I'LL", "ünïcödé  x", "a" * 5000, "١٢٣ 4½", None):
        assert packing.token_ids(text, RANKS, public_tokenizers.PATTERN).tolist() == plain.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30)))
def test_plans_place_everything_once(counts):
    bins, ranks = {}, {}
    for length, rank, n, first, offset in packing.plan(counts, 64):
        assert ranks.get(length, 0) == rank
        ranks[length] = rank + n
        for k in range(n):
            bins.setdefault(first + k, []).append((offset, length))
    assert ranks == counts
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
        assert sum(length > 64 // 3 for _, length in own) <= 2
    # An item above a third shares a bin with at most one other such item, so a maximum matching of them gives the
    # fewest bins that they need.  Small items open a bin only if no bin has a gap for them, so of the bins opened for
    # them all but the last are more than two thirds full.
    items = [a for a, n in counts.items() for _ in range(n)]
    opened = [own for own in bins.values() if all(length <= 64 // 3 for _, length in own)]
    assert len(bins) - len(opened) == fewest_bins_of_large([a for a in items if a > 64 // 3], 64)
    assert sum(sum(length for _, length in own) <= 64 - 64 // 3 for own in opened) <= 1


def fewest_bins_of_large(items: list[int], capacity: int) -> int:
    """Bins for items above a third of the capacity, two at most a bin: two pointers, the smallest with the largest that fits."""
    items = sorted(items)
    low, high, n = 0, len(items) - 1, 0
    while low <= high:
        if low < high and items[low] + items[high] <= capacity:
            low += 1
        high -= 1
        n += 1
    return n


def fewest_bins(items: list[int], capacity: int) -> int:
    """The least number of bins, by exhaustive search; for a few items."""
    best = len(items)

    def place(rest: list[int], loads: list[int]) -> None:
        nonlocal best
        if len(loads) >= best:
            return
        if not rest:
            best = len(loads)
            return
        for load in sorted({x for x in loads if x + rest[0] <= capacity}):
            k = loads.index(load)
            place(rest[1:], [*loads[:k], load + rest[0], *loads[k + 1 :]])
        place(rest[1:], [*loads, rest[0]])

    place(sorted(items, reverse=True), [])
    return best


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 24), min_size=1, max_size=8))
def test_plans_of_a_few_items_are_near_the_least_number_of_bins(items):
    counts = {a: items.count(a) for a in items}
    used = max(first + n for _, _, n, first, _ in packing.plan(counts, 24))
    least = fewest_bins(items, 24)
    assert least <= used <= max(least, 4 * least // 3 + 1)
    if all(a > 8 for a in items):
        assert used == least


def test_pack_documents(spark):
    texts = [(1, "a b c " * 900), (2, ""), (3, None), (4, "word " * 300), (5, "word " * 300), (None, "x"), (1, "a b c " * 900), (6, "q" * 20_000)] + [(100 + k, "some words here " * (k % 40)) for k in range(150)]
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in texts], "doc_id long, text string, length int, offset int")
    whole = packing.pieces(df, with_ids=True)
    packed = packing.pack(whole)
    rows = packed.collect()
    joined = {}
    for i, t in texts:
        joined.setdefault(i, []).append(plain.encode(t or "", add_special_tokens=False).ids + [2])
    for i, want in joined.items():
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        for p in {r["piece"] for r in own}:
            for r in (r for r in own if r["piece"] == p):
                assert r["ids"] == want[0][r["start"] : r["start"] + r["length"]]
                assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
                assert p == 0 or r["length"] == 1024
        assert sum(r["length"] for r in own) == sum(map(len, want))
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["ids"]))
    for own in by.values():
        at = 0
        for offset, length, _ in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    odd = packing.pack(whole.withColumn("bucket", F.lit("b")).withColumn("earlier", F.lit(1)).withColumn("rank", F.lit(2)).withColumn("n", F.lit(3)).withColumn("row", F.lit(4)).withColumn("a.b", F.lit(5)))
    assert {"bucket", "earlier", "rank", "n", "row", "a.b", "sequence_id", "offset"} <= set(odd.columns) and odd.count() == len(rows)
    built = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    assert built == {k: [x for _, _, ids in sorted(own) for x in ids] for k, own in by.items()}
    assert len(by) <= -(-sum(r["length"] for r in rows) // 1024) + 2
    assert packing.pack_documents(df.limit(0)).collect() == []
