import numpy as np

from rankloom.operators import nearest, ranking, vector_index
from test_vector_index import indexed


def test_no_row_for_each_pair(spark, monkeypatch):
    """No step of a search has a row for each query and vector, or cell: all is told in the tasks."""
    draw = np.random.default_rng(4)
    vectors = spark.createDataFrame([(k, draw.normal(size=8).tolist()) for k in range(500)], "doc_id long, vector array<float>")
    asked = vectors.where("doc_id % 20 = 0").selectExpr("doc_id AS case_id", "vector AS query_vector")
    want = sorted(map(tuple, ranking.dense_scan(vectors, asked, None).where("rank <= 20").collect()))
    path = indexed(spark, vectors)
    for most in (nearest.MOST_BROADCAST, 1000):  # one group of queries, and three
        monkeypatch.setattr(nearest, "MOST_BROADCAST", most)
        found = vector_index.search(spark, path, asked)
        assert sorted(map(tuple, found.collect())) == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "lambda" not in plan


def test_a_cell_has_few_files(spark):
    vectors = spark.createDataFrame([(k, [float(k % 7), 1.0, float(k % 3)]) for k in range(200)], "doc_id long, vector array<float>").repartition(8)
    files = len(spark.read.parquet(f"{indexed(spark, vectors, 5)}/entries").inputFiles())
    assert files <= 5
