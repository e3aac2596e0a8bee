import uuid

import numpy as np

from rankloom.operators import ranking, vector_index
from rankloom.session import shared_dir


def made(spark, n=400, seed=1, groups=12):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(groups, 16))
    rows = [(k, (centres[k % groups] + 0.3 * draw.normal(size=16)).tolist()) for k in range(n)]
    rows += [(n + k, rows[k][1]) for k in range(5)]  # copies
    rows += [(n + 10, None), (n + 11, [0.0] * 16)]
    return spark.createDataFrame(rows, "doc_id long, vector array<float>")


def indexed(spark, vectors, cells=None):
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    vector_index.build(vectors, path, cells)
    return path


def test_bounds_lose_nothing(spark):
    vectors = made(spark)
    asked = vectors.where("doc_id % 20 = 0").selectExpr("doc_id AS case_id", "vector AS query_vector")
    want = {tuple(r) for r in ranking.dense_scan(vectors.where("vector IS NOT NULL and doc_id < 410"), asked).select("case_id", "doc_id", "rank").collect()}
    for cells in (1, 7, None):
        path = indexed(spark, vectors, cells)
        found = vector_index.search(spark, path, asked)
        assert {(r.case_id, r.doc_id, r["rank"]) for r in found.collect()} == want
        assert spark.read.parquet(f"{path}/entries").count() == 405


def test_recall_grows_with_probes(spark):
    vectors = made(spark, 600, 2)
    asked = vectors.where("doc_id % 20 = 0").selectExpr("doc_id AS case_id", "vector AS query_vector")
    path = indexed(spark, vectors)
    exact = vector_index.search(spark, path, asked)
    recalls = [vector_index.recall(vector_index.search(spark, path, asked, probes=p), exact).agg({"recall": "avg"}).first()[0] for p in (1, 6, 10_000)]
    assert recalls[0] <= recalls[1] <= recalls[2] == 1 and recalls[1] > 0.9


def test_empty_tables_and_queries_without_direction(spark):
    vectors = made(spark, 30)
    asked = vectors.where("doc_id >= 40").selectExpr("doc_id AS case_id", "vector AS query_vector")
    assert vector_index.search(spark, indexed(spark, vectors), asked).count() == 0
    one = vectors.where("doc_id = 3")
    assert vector_index.search(spark, indexed(spark, one), one.selectExpr("7L AS case_id", "vector AS query_vector")).first().score == 1.0
