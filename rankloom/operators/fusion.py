"""Reciprocal-rank fusion of rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators.ranking import DIGITS, permuted, rerank_blend, top_k
from rankloom.session import saved


def union_branches(branches: dict[str, DataFrame]) -> DataFrame:
    """branch, case_id, doc_id and rank of all rankings."""
    return reduce(DataFrame.unionByName, (df.select(F.lit(name).alias("branch"), "case_id", "doc_id", "rank") for name, df in branches.items()))


def depth(share: float, k: int = 60, limit: int = 20) -> int:
    """The rank behind which a document that is early in no branch can't be among the first `limit`: see rrf()."""
    return int(share * (k + limit)) - k + 2


def rrf(branches: DataFrame, weights: DataFrame, k: int = 60, limit: int = 20) -> DataFrame:
    """Fused rankings, one for each config in `weights` (config, branch, weight) over `branches` (branch, case_id, doc_id, rank).

    A document's score is the sum of weight / (k + rank); a branch of weight 0 adds no candidates; ties go to the smaller doc_id.

    Whole rankings are fused, but a document can be among the first `limit` only if it is early in one: with `limit` documents in any
    branch, the last of them has at least the least weight / (k + limit), and one behind rank m everywhere has less than the sum of
    weights / (k + m).  Rows of other documents are left out before the sums; the result is the same.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    bounds = weights.where("weight > 0").groupBy("config").agg((F.sum("weight") / F.min("weight")).alias("share"))
    widest = bounds.agg(F.max("share")).first()[0] or 1.0
    early = branches.where(F.col("rank") <= depth(widest, k, limit)).select("case_id", "doc_id").distinct()
    branches = branches.join(early, ["case_id", "doc_id"], "left_semi")
    score = F.round(F.sum(F.col("weight") / (k + F.col("rank"))), DIGITS + 4)
    fused = branches.join(weights.where("weight > 0"), "branch").groupBy("config", "case_id", "doc_id").agg(score.alias("score"))
    return top_k(fused, limit, keys=("config", "case_id"))


def two_way(first: DataFrame, second: DataFrame, share: float = 0.7, k: int = 60, limit: int = 20) -> DataFrame:
    """Two rankings, the second with weight `share`, the first with the rest."""
    if not 0 <= share <= 1:
        raise ValueError("share must be between 0 and 1")
    spark = first.sparkSession
    weights = spark.createDataFrame([("two", "first", float(1 - share)), ("two", "second", float(share))], "config string, branch string, weight double")
    return rrf(union_branches({"first": first, "second": second}), weights, k, limit).drop("config")


def ablations(weights: dict[str, float]) -> list[tuple[str, str, float]]:
    """(config, branch, weight) rows of all branches together and of all but one, for each branch."""
    rows = [("baseline", branch, w) for branch, w in weights.items()]
    return rows + [(f"without_{off}", branch, 0.0 if branch == off else w) for off in weights for branch, w in weights.items()]


#: Weights of the two leading branches in configs that leave all others out.
OVERRIDES = {"vector_bm25_equal": {"vector": 0.5, "bm25": 0.5}, "vector_bm25_tuned": {"vector": 0.5, "bm25": 0.25}, "vector_only": {"vector": 0.5}}


def overrides(weights: dict[str, float]) -> list[tuple[str, str, float]]:
    """(config, branch, weight) rows of the configs of OVERRIDES."""
    return [(config, branch, own.get(branch, 0.0)) for config, own in OVERRIDES.items() for branch in weights]


def multi_query(items: DataFrame, k: int = 60, limit: int = 20) -> DataFrame:
    """One ranking of the items (case_id, query_no, item, rank) of several queries of a case; ties keep the order of first appearance."""
    first = F.min(F.struct("query_no", "rank"))
    fused = items.groupBy("case_id", "item").agg(F.round(F.sum(1 / (k + F.col("rank"))), DIGITS + 4).alias("score"), first.alias("first_seen"))
    return top_k(fused, limit, order=(F.desc("score"), F.asc("first_seen"))).drop("first_seen")


def check_limits(scored: int, fetched: int | None = None) -> tuple[int, int]:
    """(scored, fetched) depths of a ranking: as many are fetched as scored unless more are asked for."""
    fetched = scored if fetched is None else fetched
    if scored < 1 or fetched < scored:
        raise ValueError("the depth fetched must be at least the depth scored, and that at least 1")
    return scored, fetched


def traces(branches: DataFrame) -> DataFrame:
    """case_id, doc_id, its best rank and the sorted names of the branches that found it."""
    return branches.groupBy("case_id", "doc_id").agg(F.min("rank").alias("best_rank"), F.array_join(F.array_sort(F.collect_set("branch")), ",").alias("found_by"))


def wide_traces(ranks: DataFrame, names: list[str]) -> DataFrame:
    """traces() of one row a case and document, with its rank in each branch as a column of the branch's name, null where it isn't found."""
    found = F.filter(F.array(*(F.when(F.col(n).isNotNull(), F.lit(n)) for n in sorted(names))), lambda x: x.isNotNull())
    return ranks.select("case_id", "doc_id", F.least(*names).alias("best_rank"), F.array_join(found, ",").alias("found_by"))


def ladder(dense: DataFrame, expanded: DataFrame, bm25: DataFrame, logits: DataFrame, places: DataFrame | None = None, limit: int = 20, head: int = 50, listed: int = 20) -> DataFrame:
    """mode, case_id, doc_id and rank of the modes dense, hybrid, hybrid_expand, hybrid_rerank and hybrid_rerank_expand.

    `dense` and `expanded` are whole rankings of the queries as they are and with their expansions, `bm25` that of the words, or
    the rows in them of the documents that are among the first depth(2, limit=head) of one; hybrids are fused with equal weights
    and then cut at `head`.  `logits` (case_id, doc_id, logit) come from any scorer;
    without one a document has logit 0.  Reranking is the blend, and then the order of the first `listed` that `places`
    (case_id, doc_id, place) gives for all of them; where it doesn't, they stay.
    """
    weights = dense.sparkSession.createDataFrame([(c, b, 1.0) for c, own in (("hybrid", "dense"), ("hybrid_expand", "expanded")) for b in (own, "bm25")], "config string, branch string, weight double")
    fused = saved(rrf(union_branches({"dense": dense, "expanded": expanded, "bm25": bm25}), weights, limit=head))

    def reranked(config: str, mode: str) -> DataFrame:
        rows = fused.where(F.col("config") == config).join(logits, ["case_id", "doc_id"], "left").withColumn("logit", F.coalesce("logit", F.lit(0.0)))
        rows = rerank_blend(rows, head).select("case_id", "doc_id", "rank")
        if places is not None:
            first = rows.where(F.col("rank") <= listed).select("case_id", "doc_id")
            rows = permuted(rows, places.join(first, ["case_id", "doc_id"], "left_semi"), listed)
        return rows.select(F.lit(mode).alias("mode"), "case_id", "doc_id", "rank")

    modes = [dense.select(F.lit("dense").alias("mode"), "case_id", "doc_id", "rank"), fused.select(F.col("config").alias("mode"), "case_id", "doc_id", "rank")]
    modes += [reranked("hybrid", "hybrid_rerank"), reranked("hybrid_expand", "hybrid_rerank_expand")]
    return reduce(DataFrame.unionByName, modes).where(F.col("rank") <= limit)
