import random

import pytest
from pyspark.sql import functions as F

from rankloom.functions import text
from rankloom.operators import fusion, nearest, ranking, scoring
from rankloom.plans import frames, retrieval
from test_nearest import asked_of, made
from test_scoring import corpus, rows_of


def test_ranks_are_those_of_whole_rankings(spark, monkeypatch):
    """Ranks of chosen vectors, also of odd ones and ties, are those among all vectors, whatever groups queries are sent in."""
    vectors = made(spark, 150)
    odd = spark.createDataFrame([(9000, None), (9001, [1.0, 2.0]), (9005, [1.0, None] + [0.5] * 6), (9010, [float("nan")] + [0.5] * 7), (9015, [float("inf")] + [0.5] * 7)], "doc_id long, vector array<float>")
    for rows in (vectors, vectors.unionByName(odd)):
        asked = asked_of(rows)
        whole = ranking.dense_scan(rows, asked, None).select("case_id", "doc_id", "rank")
        chosen = whole.where("(case_id + doc_id) % 7 = 0 or rank <= 3").select("case_id", "doc_id")
        want = rows_of(whole.join(chosen, ["case_id", "doc_id"], "left_semi"), "case_id", "doc_id", "rank")
        for most in (64 << 20, 2500):  # one group of queries, and two
            monkeypatch.setattr(nearest, "MOST_BROADCAST", most)
            assert rows_of(ranking.dense_ranks(rows, asked, chosen), "case_id", "doc_id", "rank") == want


def test_a_querys_own_id_is_left_out(spark):
    vectors = made(spark, 60)
    asked = vectors.where("doc_id % 9 = 0").selectExpr("doc_id * 2 AS case_id", "doc_id AS own_id", "vector AS query_vector")
    want = ranking.dense_scan(vectors, asked.selectExpr("own_id AS case_id", "query_vector"), None).selectExpr("case_id * 2 AS case_id", "doc_id", "rank")
    assert rows_of(ranking.dense_scan(vectors, asked, 9), "case_id", "doc_id", "rank") == rows_of(want.where("rank <= 9"), "case_id", "doc_id", "rank")
    assert rows_of(ranking.dense_ranks(vectors, asked, want), "case_id", "doc_id", "rank") == rows_of(want, "case_id", "doc_id", "rank")


def test_no_pairs_and_no_vectors(spark):
    vectors = made(spark, 20)
    pairs = spark.createDataFrame([(5, 1), (5, 5), (6, 1), (10, 777)], "case_id long, doc_id long")
    assert [(r[0], r[1]) for r in ranking.dense_ranks(vectors, asked_of(vectors), pairs).collect()] == [(5, 1)]
    assert ranking.dense_ranks(vectors, asked_of(vectors), pairs.where("false")).count() == 0
    assert ranking.dense_ranks(vectors.where("false"), asked_of(vectors), pairs).count() == 0


def test_given_pairs_have_the_scores_and_ranks_of_all(spark):
    docs, asked = corpus(spark)
    own = scoring.Queries(asked)
    index = scoring.index(docs, own)
    own.weigh(index)
    every = scoring.all_rows(index, own)
    pairs = asked.select("case_id").crossJoin(docs.select("doc_id")).where("(case_id * 31 + doc_id) % 11 = 0")
    got = scoring.rows_of(index, own, pairs)
    assert rows_of(got, *every.columns) == rows_of(every.join(pairs, ["case_id", "doc_id"], "left_semi"), *every.columns) and got.count()
    want = ranking.bm25(docs, asked, None).join(pairs, ["case_id", "doc_id"], "left_semi")
    assert rows_of(scoring.with_ranks(index, own, got, ("bm25",)), "case_id", "doc_id", "rank") == rows_of(want, "case_id", "doc_id", "rank")
    assert scoring.with_ranks(index, own, scoring.rows_of(index, own, pairs.where("false")), ("bm25",)).count() == 0


def test_documents_without_an_id_are_ranked_nowhere(spark):
    docs, asked = corpus(spark, 40)
    odd = docs.unionByName(spark.createDataFrame([(None, "w1 w2 w3")], "doc_id long, text string"))
    assert ranking.bm25(odd, asked, 5).where("doc_id is null").count() == 0


@pytest.fixture
def tables(spark, tmp_path):
    draw, words = random.Random(7), [f"word{k}" for k in range(40)]
    say = lambda n: " ".join(draw.choice(words) for _ in range(n))
    spark.createDataFrame([(k, say(draw.randint(0, 9))) for k in range(3000)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, [draw.gauss(0, 1) for _ in range(4)]) for k in range(3000)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    items = [(1, " ".join("plain prose of more than six words".split())), (2, say(4)), (3, "a few words that nobody wrote about word1 and word2"), (900, "word3 word4")]  # the last has no vector
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_ladder_writes_no_whole_ranking(spark, tables, monkeypatch):
    """What is written is bounded by cases and depth, not by documents; the modes are those of whole rankings."""
    sizes, save = [], retrieval.saved

    def counted(df, *rest):
        found = save(df, *rest)
        sizes.append(found.count())
        return found

    monkeypatch.setattr(retrieval, "saved", counted)
    columns = ("mode", "case_id", "doc_id", "rank")
    got = rows_of(retrieval.ladder_modes(spark, tables), *columns)
    assert sizes and max(sizes) <= 2 * 3 * 4 * fusion.depth(2.0, limit=50) < 2 * 3000

    docs, asked = frames.documents(spark, tables).select("doc_id", "text"), frames.queries(spark, tables)
    vectors = spark.read.parquet(f"{tables}/embeddings.parquet").selectExpr("vec_id AS doc_id", "embedding AS vector")
    by_id = {r["doc_id"]: r["vector"] for r in vectors.collect()}
    prose = {r[0]: r[1] for r in asked.select("case_id", text.is_prose(F.col("query"))).collect()}
    assert prose[1] and not prose[2]
    plain = {c: list(by_id[c * 20]) for c in prose if c * 20 in by_id}
    wider = {c: [x + y for x, y in zip(v, by_id[c * 20 + 1])] if prose[c] else v for c, v in plain.items()}
    whole = lambda own: ranking.dense_scan(vectors, spark.createDataFrame([(c * 20, v) for c, v in own.items()], "case_id long, query_vector array<double>"), None).selectExpr("case_id div 20 AS case_id", "doc_id", "rank")
    logits = asked.select("case_id").crossJoin(docs.select("doc_id")).selectExpr("case_id", "doc_id", "double(doc_id % 7 - 3) AS logit")
    want = fusion.ladder(whole(plain), whole(wider), ranking.bm25(docs, asked, None), logits, logits.where("case_id % 2 = 0").selectExpr("case_id", "doc_id", "doc_id AS place"))
    assert got == rows_of(want, *columns)
    assert {r[0] for r in got if r[1] == 900} == {"hybrid", "hybrid_expand", "hybrid_rerank", "hybrid_rerank_expand"}
