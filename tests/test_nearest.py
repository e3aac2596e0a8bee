import time

import numpy as np

from rankloom.operators import nearest, ranking
from rankloom.operators.ranking import DIGITS


def made(spark, n, seed=3):
    draw = np.random.default_rng(seed)
    rows = [(k, draw.normal(size=8).astype("float32").tolist()) for k in range(n)]
    rows += [(n + k, rows[5][1]) for k in range(60)] + [(2 * n + k, [x * 2 for x in rows[7][1]]) for k in range(60)]  # ties
    return spark.createDataFrame(rows, "doc_id long, vector array<float>")


def asked_of(vectors):
    return vectors.where("doc_id % 5 = 0").selectExpr("doc_id AS case_id", "vector AS query_vector")


def test_blocks_find_what_all_pairs_do(spark, monkeypatch):
    vectors = made(spark, 300)
    odd = spark.createDataFrame([(9000, None), (9001, [1.0, 2.0])], "doc_id long, vector array<float>")
    for rows in (vectors, vectors.unionByName(odd)):
        asked = asked_of(rows)
        want = sorted(map(tuple, ranking.dense_scan(rows, asked, None).where("rank <= 20").collect()))
        for most in (nearest.MOST_BROADCAST, 2000):
            monkeypatch.setattr(nearest, "MOST_BROADCAST", most)
            assert sorted(map(tuple, ranking.dense_scan(rows, asked, 20).collect())) == want


def test_few_vectors_and_none(spark):
    vectors = made(spark, 300).where("doc_id < 4")
    assert ranking.dense_scan(vectors, asked_of(vectors), 20).count() == 3
    assert ranking.dense_scan(vectors, asked_of(vectors).where("false"), 20).count() == 0
    assert ranking.dense_scan(vectors.where("false"), asked_of(vectors), 20).count() == 0


def test_rounding_is_sparks(spark):
    values = np.array([0.1234565, -0.1234565, 0.5000005, 0.99999949999, 1e-7, -0.0000005, 0.0])
    want = [round(r[0] * 10**DIGITS) for r in spark.createDataFrame([(float(v),) for v in values], "x double").selectExpr(f"round(x, {DIGITS})").collect()]
    assert nearest.rounded(values).tolist() == want


def test_many_pairs_take_no_step_each():
    draw = np.random.default_rng(1)
    vectors = draw.normal(size=(20_000, 64))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    best, began = nearest.Best(np.arange(1000), vectors[:1000], 20), time.process_time()
    for at in range(0, 20_000, 5000):
        best.offer(np.arange(at, at + 5000), vectors[at : at + 5000])
    assert time.process_time() - began < 60  # 20 million pairs; one by one in Spark they took about ten minutes of CPU
    assert (best.key != nearest.EMPTY).all()
