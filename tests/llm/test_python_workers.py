"""A task has one Python worker at a time, and small tables are sent as Arrow, which takes none: workers count as an executor's memory."""

import random

import pytest
from pyspark import RDD
from pyspark.sql import DataFrame
from test_models import SYLLABLES, text_of

from rankloom.llm import graph, langid


@pytest.fixture
def sent(spark, monkeypatch):
    """Rows that go to executors as pickled objects, and functions chained in one stage."""
    found, real, arrow = [], RDD._to_java_object_rdd, DataFrame.mapInArrow
    monkeypatch.setattr(RDD, "_to_java_object_rdd", lambda self: found.append("rows") or real(self))

    def chained(self, *args, **kwargs):
        plan = self._jdf.queryExecution().executedPlan().toString()
        at = plan.find("MapInArrow")
        if at >= 0 and "Exchange" not in plan[:at]:
            found.append("chain")
        return arrow(self, *args, **kwargs)

    monkeypatch.setattr(DataFrame, "mapInArrow", chained)
    return found


def test_language_model(spark, sent):
    r = random.Random(4)
    rows = [(k, text_of(r, lang), lang) for k in range(200) for lang in [r.choice(list(SYLLABLES))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sent.clear()
    model = langid.train(docs)
    assert not sent and set(model.langs) == set(SYLLABLES)
    assert all(model.floors.max(1) > 0)


def test_no_labels_teach_nothing(spark):
    docs = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert [tuple(r) for r in langid.identify(docs, model).collect()] == [(1, "und", 0.0, True)]


def test_hot_keys(spark, sent):
    rows = spark.range(4000).selectExpr("case when id % 2 = 0 then 7 else id end as k", "cast(id % 3 as int) as b").cache()
    table = rows.select("k").distinct().selectExpr("k", "k * 10 as v").cache()
    sent.clear()
    got = graph.join_hot(rows, table, ["k"], 4000)
    assert not sent and graph.hot_keys(rows, ["k"], 4000).num_rows == 1
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(table, "k").collect()))
