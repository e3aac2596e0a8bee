import random
import re

import pytest

from rankloom.operators import context, fusion, ranking


def plain_segments(text, budget):
    """By the longest prefix of so many words, tried from the end, and the latest of three boundaries."""
    out = []
    for section in [s for s in re.split("(?m)(?=^### )", text) if s]:
        start = 0
        while start < len(section):
            end = max(e for e in range(start + 1, len(section) + 1) if len(re.findall("[^ \t\n\v\f\r]+", section[start:e])) <= budget and (e == len(section) or not re.match("[^ \t\n\v\f\r]", section[e]) or re.match("[ \t\n\v\f\r]", section[e - 1])))
            while end < len(section) and section[end] in " \t\n\v\f\r":
                end += 1
            if end < len(section):
                floor = start + max(1, (end - start) // 2)
                at = max(section.rfind("\n\n", floor, end), section.rfind("\n", floor, end), section.rfind(" ", floor, end))
                if at > start:
                    end = at + (2 if section.startswith("\n\n", at) else 1)
            out.append((f"E{len(out) + 1:03d}", section.splitlines()[0] if section.startswith("### ") else "", section[start:end]))
            start = end
    return out


def test_segments_against_plain_ones():
    draw = random.Random(3)
    for _ in range(300):
        text = "".join(draw.choice(["a", "bc", " ", " ", "\n", "\n\n", "\t", "\n### h x\n", "### "]) for _ in range(draw.randint(0, 60)))
        for budget in (1, 2, 5):
            found = list(context.segments(text, budget))
            assert "".join(x[2] for x in found) == text and [x[:3] for x in found] == plain_segments(text, budget), (text, budget)
            assert [x[3] for x in found] == [len(re.findall("[^ \t\n\v\f\r]+", x[2])) for x in found]
    with pytest.raises(ValueError):
        list(context.segments("a", 0))


def test_segments_are_linear():
    assert sum(1 for _ in context.segments("word " * 1_000_000, 10)) == 100_000  # quadratic work would not end


def test_segment_table_function(spark):
    context.register_segmenter(spark)
    rows = spark.createDataFrame([(1, "### a/b\none two three"), (2, None), (3, "")], "doc_id long, text string")
    found = spark.sql("SELECT d.doc_id, s.* FROM {d} d, LATERAL segment_text(d.text, 3) s ORDER BY ALL", d=rows).collect()
    assert [tuple(r) for r in found] == [(1, "E001", "### a/b", "### a/b\none ", 3), (1, "E002", "### a/b", "two three", 2)]
    assert context.segment(rows, 3).count() == 2


def plain_batches(rows, most, bound):
    out, state = {}, {}
    for g, i, s in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2] or 0)):
        batch, n, size = state.get(g, (0, 0, 0))
        if n and (n >= most or size + (s or 0) > bound):
            batch, n, size = batch + 1, 0, 0
        state[g] = (batch, n + 1, size + (s or 0))
        out[g, i] = batch
    return out


@pytest.mark.parametrize("partitions, most, bound, seed", [(1, 8, 100, 1), (40, 8, 100, 2), (60, 3, 40, 3), (25, 1, 10, 4), (30, 8, 10_000, 5)])
def test_batches_over_many_partitions(spark, partitions, most, bound, seed):
    draw = random.Random(seed)
    rows = [(draw.choice(["hot"] * 6 + ["a", "b", "c", None]), i, draw.choice([None, 0, 1, 7, 30, 60, 200])) for i in range(900)]
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = context.batched(spark.createDataFrame(rows, "g string, id long, size long"), most, bound, "g").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r.g, r.id): r.batch for r in found} == plain_batches(rows, most, bound) and len(found) == len(rows)


def test_whole_lists_are_fused(spark):
    """Document 100 is first in one list and 30th in the other, so it beats those that are in one list only."""
    first = spark.createDataFrame([(1, 100, 1)] + [(1, d, d + 1) for d in range(1, 30)], "case_id long, doc_id long, rank int")
    second = spark.createDataFrame([(1, 200 + d, d) for d in range(1, 30)] + [(1, 100, 30)], "case_id long, doc_id long, rank int")
    best = fusion.two_way(first, second, 0.5).orderBy("rank").first()
    assert best.doc_id == 100 and best.score == round(0.5 / 61 + 0.5 / 90, 10)
    docs = spark.createDataFrame([(d, f"word {'x ' * d}") for d in range(60)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "word")], "case_id long, query string")
    assert ranking.bm25(docs, asked, None).count() == 60 and ranking.bm25(docs, asked).count() == 20


def test_ladder_permutes_the_first_of_reranked_modes(spark):
    lists = spark.createDataFrame([(c, d, d) for c in (1, 2) for d in range(1, 61)], "case_id long, doc_id long, rank int")
    logits = lists.select("case_id", "doc_id").selectExpr("*", "0d AS logit")
    places = lists.where("case_id = 2").selectExpr("case_id", "doc_id", "100 - doc_id AS place")
    found = fusion.ladder(lists, lists, lists, logits, places)
    order = {(m, c): [r.doc_id for r in found.where(f"mode = '{m}' and case_id = {c}").orderBy("rank").collect()] for m in ("hybrid", "hybrid_rerank") for c in (1, 2)}
    assert order["hybrid", 1] == order["hybrid", 2] == order["hybrid_rerank", 1] == list(range(1, 21)) and order["hybrid_rerank", 2] == list(range(20, 0, -1))
