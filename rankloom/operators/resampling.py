"""Cluster bootstrap.

A replicate draws as many clusters as there are, with replacement, and pools the values of those drawn; its mean is a ratio
of sums, so clusters are reduced to (sum, count) first and a replicate never touches a row again.  Draws come from a hash of
(seed, replicate, slot), so every engine makes the same ones, and all metrics and contrasts with the same number of
clusters share them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.stats import hash_int
from rankloom.session import saved

RESAMPLES = 1000
SEED = 1042
DIGITS = 6


def draws(groups: DataFrame, resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """g, rep, pick and times for each distinct number of clusters `g`: how often a replicate drew which cluster."""
    reps = groups.select("g").distinct().select("g", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("rep")).repartition("rep")  # counted where they are drawn
    slots = reps.select("g", "rep", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)).alias("slot"))
    return slots.withColumn("pick", F.pmod(hash_int(str(seed), F.col("rep"), F.col("slot")), "g")).groupBy("g", "rep", "pick").agg(F.count("*").alias("times"))


def _clusters(values: DataFrame, keys: Sequence[str], cluster: str, column: str) -> DataFrame:
    """keys, cluster, s, n, its place `pick` among the sorted clusters of the key, and their number `g`."""
    own = Window.partitionBy(*keys)
    sums = values.groupBy(*keys, cluster).agg(F.sum(column).alias("s"), F.count(column).alias("n"))
    return sums.withColumn("pick", (F.row_number().over(own.orderBy(cluster)) - 1).cast("long")).withColumn("g", F.count("*").over(own))


def replicates(values: DataFrame, keys: Sequence[str] = ("metric",), cluster: str = "repo", column: str = "delta", resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """keys, rep and value: the pooled mean of each replicate."""
    groups = saved(_clusters(values, keys, cluster, column))  # its size known to the planner: draws need not move to meet it
    return groups.join(draws(groups, resamples, seed), ["g", "pick"]).groupBy(*keys, "rep").agg((F.sum(F.col("times") * F.col("s")) / F.sum(F.col("times") * F.col("n"))).alias("value"))


def interval(reps: DataFrame, keys: Sequence[str] = ("metric",), alpha: float = 0.05, names: tuple[str, str] = ("ci_low", "ci_high")) -> DataFrame:
    """Interpolated quantiles at alpha / 2 and 1 - alpha / 2."""
    quantile = lambda p: F.round(F.percentile("value", F.lit(p)), DIGITS)
    return reps.groupBy(*keys).agg(quantile(alpha / 2).alias(names[0]), quantile(1 - alpha / 2).alias(names[1]))


#: Places (from 0) of the two endpoints among B sorted replicates, for each rule that takes order statistics.
ENDPOINTS = {
    "truncated": ("floor(0.025 * (b - 1))", "floor(0.975 * (b - 1))"),
    "capped": ("floor(0.025 * b)", "least(floor(0.975 * b), b - 1)"),
    "shifted": ("floor(0.025 * b)", "floor(0.975 * b) - 1"),
}


def endpoint_rules(reps: DataFrame, keys: Sequence[str] = ("metric",)) -> DataFrame:
    """keys, rule, ci_low and ci_high under each rule: interpolated, and those of ENDPOINTS."""
    own = Window.partitionBy(*keys)
    placed = reps.withColumn("place", F.row_number().over(own.orderBy("value")) - 1).withColumn("b", F.count("*").over(own))
    picks = [F.max(F.when(F.col("place") == F.expr(e), F.col("value"))).alias(f"{rule}_{side}") for rule, ends in ENDPOINTS.items() for side, e in zip(("low", "high"), ends)]
    quantile = [F.percentile("value", F.lit(p)).alias(f"interpolated_{side}") for side, p in (("low", 0.025), ("high", 0.975))]
    wide = placed.groupBy(*keys).agg(*quantile, *picks)
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.round(f"{r}_low", DIGITS).alias("ci_low"), F.round(f"{r}_high", DIGITS).alias("ci_high")) for r in ("interpolated", *ENDPOINTS)))
    return wide.select(*keys, F.explode(rules).alias("r")).select(*keys, "r.*")


def multi_arm(metrics: DataFrame, reference: str, resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """Levels of every arm and effects against the reference arm, with intervals, for each metric and estimand.

    `metrics`: arm, metric, case_id, repo, workflow, value, with the same cases in all arms, which share the draws.  A
    repository drawn twice counts twice in sample_weighted and in workflow means, but its mean once in repository_macro; a
    workflow absent from a draw drops out of it.
    """
    keys = ["arm", "metric"]
    cells = metrics.groupBy(*keys, "repo", "workflow").agg(F.sum("value").alias("s"), F.count("*").alias("n"))
    repos = metrics.select("repo").distinct()
    repos = repos.withColumn("pick", (F.row_number().over(Window.orderBy("repo")) - 1).cast("long")).withColumn("g", F.count("*").over(Window.partitionBy()))  # a row a cluster
    point = draws(repos.limit(1).select("g"), 1, seed).select(F.lit(-1).alias("rep")).limit(1).crossJoin(repos.select("g", "pick")).select("g", "rep", "pick", F.lit(1).cast("long").alias("times"))
    cells = saved(cells.join(repos, "repo"))  # a row an arm, metric, repository and workflow
    times = draws(repos, resamples, seed).unionByName(point)
    by_repo = saved(cells.groupBy(*keys, "g", "pick").agg(F.sum("s").alias("rs"), F.sum("n").alias("rn"))).join(times, ["g", "pick"])
    sample = by_repo.groupBy(*keys, "rep").agg((F.sum(F.col("times") * F.col("rs")) / F.sum(F.col("times") * F.col("rn"))).alias("sample_weighted"), F.avg(F.col("rs") / F.col("rn")).alias("repository_macro"))
    flows = cells.join(times, ["g", "pick"]).groupBy(*keys, "rep", "workflow").agg((F.sum(F.col("times") * F.col("s")) / F.sum(F.col("times") * F.col("n"))).alias("mean")).groupBy(*keys, "rep").agg(F.avg("mean").alias("workflow_macro"))
    names = ("sample_weighted", "repository_macro", "workflow_macro")
    levels = sample.join(flows, [*keys, "rep"]).select(*keys, "rep", F.explode(F.array(*(F.struct(F.lit(n).alias("estimand"), F.col(n).alias("level")) for n in names))).alias("e")).select(*keys, "rep", "e.*")
    base = levels.where(F.col("arm") == reference).select("metric", "rep", "estimand", F.col("level").alias("base"))
    both = levels.join(base, ["metric", "rep", "estimand"]).withColumn("effect", F.col("level") - F.col("base"))
    kept = F.col("rep") >= 0
    quantile = lambda c, p: F.round(F.percentile(F.when(kept, F.col(c)), F.lit(p)), DIGITS)
    return both.groupBy(*keys, "estimand").agg(
        F.round(F.max(F.when(~kept, F.col("level"))), DIGITS).alias("level"), quantile("level", 0.025).alias("level_low"), quantile("level", 0.975).alias("level_high"),
        F.round(F.max(F.when(~kept, F.col("effect"))), DIGITS).alias("effect"), quantile("effect", 0.025).alias("effect_low"), quantile("effect", 0.975).alias("effect_high"),
    )
