"""Frames that several queries start from, made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.text import word_count
from rankloom.operators import fusion, metrics, pairing, ranking, scoring
from rankloom.session import saved, table

#: Fused arms: the share of the lexical ranking.
ARMS = {"bm25": 0.0, "rrf30": 0.3, "rrf70": 0.7, "lexical": 1.0}
PAIR_METRICS = ("MRR", "Recall@5", "Recall@20", "any_gold@20")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("case_id"), F.col("text").alias("query"))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id and doc_id of the documents that hold an item's text, saved."""
    return saved(ranking.holding(documents(spark, sf_dir).select("doc_id", "text"), queries(spark, sf_dir)))


def cases(spark: SparkSession, sf_dir: str, gold_rows: DataFrame) -> DataFrame:
    """case_id, query, repo (source), workflow (lang) and first_gold of the items with gold."""
    first = gold_rows.groupBy("case_id").agg(F.min("doc_id").alias("first_gold"))
    home = documents(spark, sf_dir).select(F.col("doc_id").alias("first_gold"), F.col("source").alias("repo"), F.col("lang").alias("workflow"))
    return queries(spark, sf_dir).join(first, "case_id").join(home, "first_gold").select("case_id", "query", "repo", "workflow", "first_gold")


def scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, scoring.Queries]:
    """The index of the documents' terms, and the queries weighted by it."""
    asked = scoring.Queries(queries(spark, sf_dir))
    rows = scoring.index(documents(spark, sf_dir).select("doc_id", "text"), asked)
    return rows, asked.weigh(rows)


def base_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """branch, case_id, doc_id and rank, in the whole rankings of the two base rankers, of the documents that can be in a fused top 20.

    Those are early in one of the two, by the least share of ARMS; their rank in the other is counted over all documents.
    """
    rows, asked = scored(spark, sf_dir)
    depth = fusion.depth(1 / min(share for arm in ARMS.values() for share in (arm, 1 - arm) if share > 0))
    first = scoring.first_rows(rows, asked, depth)
    early = [ranking.top_k(first, depth, order=(F.desc(name), F.asc("doc_id"))).drop("rank") for name in scoring.BRANCHES]
    return scoring.with_ranks(rows, asked, early[0].union(early[1]).distinct())


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """arm, case_id, doc_id, score and rank of every arm."""
    weights = spark.createDataFrame([row for arm, share in ARMS.items() for row in ((arm, "bm25", 1 - share), (arm, "lexical", share))], "config string, branch string, weight double")
    return fusion.rrf(base_branches(spark, sf_dir), weights).withColumnRenamed("config", "arm")


def case_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """arm, case_id, metric, value, repo and workflow, saved."""
    rows = gold(spark, sf_dir)
    found = metrics.rank_metrics(saved(ranked(spark, sf_dir)), rows)
    return saved(found.join(cases(spark, sf_dir, rows).select("case_id", "repo", "workflow"), "case_id"))


def arm(found: DataFrame, name: str) -> DataFrame:
    return found.where(F.col("arm") == name).drop("arm")


def pairs(spark: SparkSession, sf_dir: str, baseline: str = "bm25", candidate: str = "lexical") -> DataFrame:
    """case_id, metric, repo, workflow, baseline, candidate and delta of two arms, checked to have the same cases."""
    found = case_metrics(spark, sf_dir).where(F.col("metric").isin(*PAIR_METRICS))
    pairing.check_paired(found.where((F.col("metric") == PAIR_METRICS[0]) & F.col("arm").isin(baseline, candidate)), ("repo", "workflow"))
    return pairing.paired(arm(found, baseline), arm(found, candidate))


def costs(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """`rows` with the words and a digest of their documents' texts, joined after the ranking is cut."""
    own = documents(spark, sf_dir).select("doc_id", word_count(F.col("text")).alias("cost"), F.md5("text").alias("digest"))
    return rows.join(own, "doc_id")


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run registry: event_id, run, case_id, ts, status and latency."""
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("run"), (F.col("event_id") % 97).alias("case_id"), "ts", F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"), F.col("value").alias("latency"))


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All vectors (doc_id, vector, label) and the queries among them (case_id, query_vector, query_label)."""
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "label")
    return own, own.where("doc_id % 20 = 0").select(F.col("doc_id").alias("case_id"), F.col("vector").alias("query_vector"), F.col("label").alias("query_label"))
