import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from rankloom.llm import collocations

SCHEMA = "doc_id long, text string, lang string, phrase string, n string"


def brute(rows, least=10, depth=3, most=2000, share=50):
    count, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for j in range(1, depth + 1):
                count[lang].update(tuple(words[k : k + j]) for k in range(len(words) - j + 1))
    out = set()
    for lang, f in count.items():
        good = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for p, a in good.items():
            for j in range(2, len(p)):
                for k in range(len(p) - j + 1):
                    inside[p[k : k + j]] = max(inside[p[k : k + j]], a)
        kept = []
        for p, a in good.items():
            if 100 * inside[p] >= share * a and inside[p]:
                continue
            score, _, left, right = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        for n, (score, a, p, left, right) in enumerate(sorted(kept)[:most]):
            out.add((lang, n + 1, p.decode(), -a, left, right, total[lang], -score))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(n, t, la, "clash", "clash") for n, (t, la) in enumerate(rows)], SCHEMA)


def drawn(seed, texts=300, vocabulary=12):
    draw = random.Random(seed)
    words = [draw.choice(["a", "B", "of", "The", "é", "x1", "naïve", "z-z", "日本", "Q"]) + str(k % 7) * (k % 3) for k in range(vocabulary)]
    return [("".join(draw.choice(words) + draw.choice([" "] * 8 + ["\t", "  ", ". ", ",", "\n", "\r\n", "!?", "\x0b"]) for _ in range(draw.randint(0, 40))), draw.choice(["en", "de", None, "und"])) for _ in range(texts)]


@pytest.mark.parametrize("shard, span, seed", [(8 << 20, 8 << 20, 1), (500, 400, 2), (60, 100, 3)])
def test_against_brute_force(spark, monkeypatch, shard, span, seed):
    """Shards of a few texts and ranges that cut words' subtrees."""
    monkeypatch.setattr(collocations, "SHARD_BYTES", shard)
    monkeypatch.setattr(collocations, "RANGE_BYTES", span)
    rows = drawn(seed)
    assert set(map(tuple, collocations.collocations(frame(spark, rows)).collect())) == brute(rows)


def test_longer_phrases_small_limits(spark):
    rows = drawn(4, 200, 6)
    found = collocations.collocations(frame(spark, rows), least=3, depth=5, most=40, share=60)
    assert set(map(tuple, found.collect())) == brute(rows, 3, 5, 40, 60)


def test_a_hot_word_is_in_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(collocations, "RANGE_BYTES", 2000)
    monkeypatch.setattr(collocations, "SHARD_BYTES", 1500)
    rows = [(f"hot w{k % 90} tail{k % 13} hot hot w{k % 17}", "en") for k in range(1500)]
    assert set(map(tuple, collocations.collocations(frame(spark, rows)).collect())) == brute(rows)


def test_nulls_empty_texts_and_tables(spark):
    rows = [(None, "en"), ("", None), (" . ,", "de"), ("a b " * 50, None), ("a b " * 50, "und"), ("A B " * 50, ""), ("c" * 100000 + " d", "en")] + [("x y", "en")] * 12
    assert set(map(tuple, collocations.collocations(frame(spark, rows)).collect())) == brute(rows)
    assert collocations.collocations(frame(spark, [])).count() == 0
    assert collocations.collocations(frame(spark, [(None, None)])).count() == 0


def test_other_hashes_are_taken_after_a_collision(spark, monkeypatch):
    rows = drawn(5, 60)
    real = collocations.shard_trie

    def once(texts, langs, depth, seed, frequent):
        if seed == 0:
            raise collocations.Collision("Collision")
        return real(texts, langs, depth, seed, frequent)

    monkeypatch.setattr(collocations, "shard_trie", once)
    assert set(map(tuple, collocations.collocations(frame(spark, rows)).collect())) == brute(rows)


def test_a_word_with_two_hashes_is_a_collision(monkeypatch):
    real = collocations.kernel.word_hashes
    monkeypatch.setattr(collocations.kernel, "word_hashes", lambda *a, **k: (real(*a, **k)[0] % np.uint64(2), real(*a, **k)[1]))
    with pytest.raises(collocations.Collision):
        collocations.shard_trie(pa.array(["one two three fourteen"]), pa.array(["en"]), 1, 0, [])


def test_scores_of_large_counts_are_exact(spark):
    from pyspark.sql import functions as F

    a, left, right = 9 * 10**14 + 7, 10**15 + 3, 9 * 10**14 + 11
    row = spark.range(1).select(collocations._score(F.lit(a), F.lit(left), F.lit(right)).alias("s")).first()
    assert row.s == 1000000 * a * a // (left * right)


def test_query(spark):
    from rankloom.llm import queries

    source = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{source}/documents.parquet").select("text", "lang").collect()]
    assert set(map(tuple, queries.QUERIES["op13_collocations"](spark, source).collect())) == brute(rows)
