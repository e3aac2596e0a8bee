import random

from rankloom.operators import ranking

WORDS = ["alpha", "alphabet", "Beta", "betas", "gamma", "Delta", "delta9", "é", "x"]


def corpus(spark, n=400):
    draw = random.Random(3)
    texts = [(k, " ".join(draw.choice(WORDS) for _ in range(draw.randint(0, 6)))) for k in range(n)]
    asked = [(k, " ".join(draw.choice(WORDS) for _ in range(draw.randint(1, 9)))) for k in range(12)]
    return spark.createDataFrame(texts, "doc_id long, text string").repartition(3), spark.createDataFrame(asked, "case_id long, query string")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_passages_are_looked_for_where_texts_are(spark):
    """Neither texts nor their phrases leave the task that reads them."""
    docs, asked = corpus(spark)
    docs = docs.union(spark.createDataFrame([(900, "a.b*c (d) [e] \\w $ ü| x"), (901, None)], "doc_id long, text string"))
    asked = asked.union(spark.createDataFrame([(20, "b*c (d) [e] \\w $ ü|"), (21, "a.b*c"), (22, None), (23, "axb")] + [(100 + k, f"missing passage number {k} of many") for k in range(600)], "case_id long, query string"))
    found = ranking.holding(docs, asked)
    assert "Join" not in plan(found) and "Generate" not in plan(found)
    texts = {r[0]: r[1] for r in docs.collect() if r[1] is not None}
    assert sorted(map(tuple, found.collect())) == sorted((c, i) for c, q in asked.collect() if q is not None for i, x in texts.items() if q in x)
    assert ranking.holding(docs, asked.where("false")).count() == 0
