import numpy as np

from rankloom.operators import fusion, ranking, scoring


def corpus(spark, n=400, seed=5):
    draw = np.random.default_rng(seed)
    docs = [(k, " ".join(f"w{int(x)}" for x in draw.zipf(1.3, 30) if x < 60)) for k in range(n)] + [(n, None), (n + 1, "")]
    asked = [(k, " ".join(f"w{int(x)}" for x in draw.integers(1, 60, 6))) for k in range(9)] + [(20, "nowhere"), (21, "")]
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(asked, "case_id long, query string")


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_first_and_ranks_are_those_of_whole_rankings(spark):
    docs, asked = corpus(spark)
    whole = {name: f(docs, asked, None) for name, f in (("bm25", ranking.bm25), ("lexical", ranking.term_overlap))}
    columns = ("case_id", "doc_id", "score", "rank")
    assert rows_of(ranking.bm25(docs, asked, 7), *columns) == rows_of(whole["bm25"].where("rank <= 7"), *columns)
    assert rows_of(ranking.term_overlap(docs, asked, 7), *columns) == rows_of(whole["lexical"].where("rank <= 7"), *columns)
    own = scoring.Queries(asked)
    index = scoring.index(docs, own)
    own.weigh(index)
    chosen = scoring.first_rows(index, own, 11)
    got = scoring.with_ranks(index, own, chosen)
    want = fusion.union_branches(whole).join(chosen.select("case_id", "doc_id"), ["case_id", "doc_id"], "left_semi")
    assert rows_of(got, "branch", "case_id", "doc_id", "rank") == rows_of(want, "branch", "case_id", "doc_id", "rank") and got.count()


def test_no_pair_is_shuffled(spark):
    """Rows that leave a task of the first documents are cases times k, not cases times documents."""
    docs, asked = corpus(spark)
    own = scoring.Queries(asked)
    index = scoring.index(docs, own)
    found = scoring.first_rows(index, own.weigh(index), 2)
    assert found.count() <= 9 * 2 * 2 * index.rdd.getNumPartitions() < ranking.bm25(docs, asked, None).count()


def test_nothing_to_ask(spark):
    docs, asked = corpus(spark, 20)
    assert ranking.bm25(docs, asked.where("case_id >= 20"), 5).count() == 0
    assert ranking.bm25(docs.where("false"), asked, 5).count() == 0
