"""Metrics of a case and their estimands; inside, metrics are rows (.., metric, value), never columns of a row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CUTS = (5, 10, 20)
DIGITS = 6


def long(df: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """keys, metric and value for each of the columns `names`."""
    return df.select(*keys, F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(f"`{n}`").cast("double").alias("value")) for n in names))).alias("m")).select(*keys, "m.metric", "m.value")


def rank_metrics(ranked: DataFrame, gold: DataFrame, keys: Sequence[str] = ("arm",), most: int = 20) -> DataFrame:
    """Long metrics of each case with gold, for each of `keys`: a case without any hit has zeros.

    MRR, and Recall, Precision, F0.5 and irrelevant documents at each cut, coverage_auc@20 (the mean of Recall@1 to @20) and
    any_gold@20.
    """
    cases = gold.groupBy("case_id").agg(F.count("*").alias("n_gold"))
    every = cases.crossJoin(ranked.select(*keys).distinct())
    marked = ranked.where(F.col("rank") <= most).join(gold.withColumn("hit", F.lit(1)), ["case_id", "doc_id"], "left")
    hit = F.col("hit").isNotNull()
    sums = [F.min(F.when(hit, F.col("rank"))).alias("first"), F.coalesce(F.sum(F.when(hit, most + 1 - F.col("rank"))), F.lit(0)).alias("area")]
    for k in CUTS:
        sums += [F.sum(F.when(hit & (F.col("rank") <= k), 1).otherwise(0)).alias(f"h{k}"), F.sum(F.when(F.col("rank") <= k, 1).otherwise(0)).alias(f"r{k}")]
    found = every.join(marked.groupBy("case_id", *keys).agg(*sums), ["case_id", *keys], "left").na.fill(0, [c for k in CUTS for c in (f"h{k}", f"r{k}")] + ["area"])
    columns = {"MRR": F.coalesce(1 / F.col("first"), F.lit(0.0)), "coverage_auc@20": F.col("area") / (most * F.col("n_gold")), "any_gold@20": (F.col("h20") > 0).cast("double")}
    for k in CUTS:
        p, r = F.col(f"h{k}") / k, F.col(f"h{k}") / F.col("n_gold")
        columns |= {f"Recall@{k}": r, f"Precision@{k}": p, f"F0.5@{k}": F.when(p + r > 0, 1.25 * p * r / (0.25 * p + r)).otherwise(0.0), f"irrelevant_files@{k}": F.col(f"r{k}") - F.col(f"h{k}")}
    return long(found.select("case_id", *keys, *(F.round(c.cast("double"), DIGITS).alias(n) for n, c in columns.items())), ["case_id", *keys], list(columns))


def hard_negative_hits(ranked: DataFrame, negatives: DataFrame, keys: Sequence[str] = ("arm",), cases: DataFrame | None = None) -> DataFrame:
    """case_id, keys, metric and value: how many of a case's hard negatives (case_id, doc_id) are in the first k, for each cut.

    Every case with hard negatives has a row for each of `keys`, 0 where it has no hit: those of `negatives`, or of `cases`
    where `negatives` has only the documents that a ranking holds.
    """
    every = (negatives if cases is None else cases).select("case_id").distinct().crossJoin(ranked.select(*keys).distinct())
    hits = ranked.join(negatives, ["case_id", "doc_id"], "left_semi").groupBy("case_id", *keys).agg(*(F.count_if(F.col("rank") <= k).alias(f"hard_negative_hits@{k}") for k in CUTS))
    names = [f"hard_negative_hits@{k}" for k in CUTS]
    return long(every.join(hits, ["case_id", *keys], "left").na.fill(0, names), ["case_id", *keys], names)


def zero_failures(metrics: DataFrame, status: DataFrame) -> DataFrame:
    """Metrics of failed cases become 0, and their rows stay in every mean."""
    return metrics.join(status, "case_id").withColumn("value", F.when(F.col("status") == "ok", F.col("value")).otherwise(0.0))


def sample_mean(metrics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Means of the metrics that every case of a key has."""
    counted = metrics.groupBy(*keys, "metric").agg(F.avg("value").alias("value"), F.count("value").alias("n"))
    cases = metrics.groupBy(*keys).agg(F.countDistinct("case_id").alias("cases"))
    joined = counted.join(cases, list(keys)) if keys else counted.crossJoin(cases)
    return joined.where("n = cases").drop("cases")


def estimands(metrics: DataFrame, keys: Sequence[str] = ("arm",)) -> DataFrame:
    """keys, metric, estimand and value: sample_weighted, repository_macro and workflow_macro, in one pass over the rows.

    `metrics` has repo and workflow besides; a macro mean is the mean of its groups' means.
    """
    by = ", ".join([*keys, "metric"])
    sets = f"GROUPING SETS (({by}), ({by}, repo), ({by}, workflow))"
    view = metrics.selectExpr(*keys, "metric", "repo", "workflow", "value")
    grouped = view.sparkSession.sql(f"SELECT {by}, grouping(repo) AS no_repo, grouping(workflow) AS no_workflow, avg(value) AS value FROM {{view}} GROUP BY {sets}", view=view)
    name = F.when((F.col("no_repo") == 1) & (F.col("no_workflow") == 1), "sample_weighted").when(F.col("no_repo") == 0, "repository_macro").otherwise("workflow_macro")
    return grouped.withColumn("estimand", name).groupBy(*keys, "metric", "estimand").agg(F.round(F.avg("value"), DIGITS).alias("value"))


def by_group(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    return metrics.groupBy(*keys, "metric").agg(F.countDistinct("case_id").alias("n"), F.round(F.avg("value"), DIGITS).alias("value"))


def distribution(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """n, mean, median, p95 (interpolated), min and max; one row of nulls if there is nothing."""
    c = F.col(column)
    return df.groupBy(*keys).agg(
        F.count(c).alias("n"), F.round(F.avg(c), DIGITS).alias("mean"), F.round(F.median(c), DIGITS).alias("median"), F.round(F.percentile(c, F.lit(0.95)), DIGITS).alias("p95"), F.min(c).alias("min"), F.max(c).alias("max")
    )


def upper_median(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """sorted[n // 2] of the values, by rank, with the shares up to 40 and above 200."""
    own = Window.partitionBy(*keys)
    placed = df.where(F.col(column).isNotNull()).withColumn("place", F.row_number().over(own.orderBy(column)) - 1).withColumn("n", F.count("*").over(own))
    return placed.groupBy(*keys).agg(
        F.max(F.when(F.col("place") == F.floor(F.col("n") / 2), F.col(column))).alias("upper_median"), F.round(F.avg((F.col(column) <= 40).cast("double")), DIGITS).alias("share_to_40"),
        F.round(F.avg((F.col(column) > 200).cast("double")), DIGITS).alias("share_over_200"), F.count("*").alias("n"),
    )


def rank_buckets(first_ranks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts and shares of first gold ranks 1, 2-5, 6-20 and miss."""
    r = F.col("first_gold_rank")
    bucket = F.when(r == 1, "1").when(r <= 5, "2-5").when(r <= 20, "6-20").otherwise("miss")
    counts = first_ranks.groupBy(*keys, bucket.alias("bucket")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(*keys)), DIGITS))


def best_in_column(df: DataFrame, keys: Sequence[str], column: str = "value", tolerance: float = 1e-9) -> DataFrame:
    """Adds `best`: whether a value reaches the largest of its keys."""
    return df.withColumn("best", F.col(column) >= F.max(column).over(Window.partitionBy(*keys)) - tolerance)


def selective(positives: DataFrame, no_gold: DataFrame, prefix: str) -> DataFrame:
    """Selective success at 20 under the natural and a balanced mixture.

    `positives` (case_id, success) and `no_gold` (case_id, abstained, natural); the balanced mixture takes as many positives as
    there are cases without gold, first by the hash of their ids.  Rates over no cases are null, and so is the success of a
    mixture without cases without gold, of which nothing is known.
    """
    count = no_gold.agg(F.count("*").alias("wanted"))
    order = Window.orderBy(F.sha2(F.concat(F.lit(prefix), F.col("case_id").cast("string")), 256))
    ranked = positives.withColumn("place", F.row_number().over(order)).crossJoin(count)  # a row a case
    mixtures = ranked.withColumn("mixture", F.explode(F.when(F.col("place") <= F.col("wanted"), F.array(F.lit("natural"), F.lit("balanced"))).otherwise(F.array(F.lit("natural")))))
    hits = mixtures.groupBy("mixture").agg(F.count("*").alias("positive_n"), F.sum(F.col("success").cast("int")).alias("hits"))
    none = no_gold.agg(
        F.count("*").alias("no_gold_n"), F.sum(F.col("abstained").cast("int")).alias("abstentions"), F.avg(F.when(F.col("natural"), F.col("abstained").cast("double"))).alias("natural_rate"),
        F.avg(F.when(~F.col("natural"), F.col("abstained").cast("double"))).alias("counterfactual_rate"),
    )
    rate = lambda c: F.round(c, DIGITS)
    return hits.crossJoin(none).select(
        "mixture", (F.col("positive_n") + F.col("no_gold_n")).alias("n"), "positive_n", "no_gold_n", rate((F.col("hits") + F.col("abstentions")) / (F.col("positive_n") + F.col("no_gold_n"))).alias("selective_success"),
        rate(F.col("hits") / F.col("positive_n")).alias("positive_success"), rate(F.try_divide("abstentions", "no_gold_n")).alias("abstention_rate"), rate(F.col("natural_rate")).alias("natural_rate"), rate(F.col("counterfactual_rate")).alias("counterfactual_rate"),
    )


def success(metrics: DataFrame, keys: Sequence[str] = ("arm",)) -> DataFrame:
    """success@k: the share of cases with any recall at each cut; a case without the metric counts as none."""
    wanted = metrics.where(F.col("metric").startswith("Recall@"))
    cases = metrics.groupBy(*keys).agg(F.countDistinct("case_id").alias("cases"))
    hits = wanted.groupBy(*keys, F.replace("metric", F.lit("Recall"), F.lit("success")).alias("metric")).agg(F.count_if(F.col("value") > 0).alias("hits"))
    return hits.join(cases, list(keys)).select(*keys, "metric", F.round(F.col("hits") / F.col("cases"), DIGITS).alias("value"))
