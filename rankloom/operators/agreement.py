"""Agreement between runs that should be equal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions import stats

DIGITS = 6


def as_lists(ranked: DataFrame, keys: Sequence[str], k: int = 20) -> DataFrame:
    """keys and `items`: the first k documents of each ranking, in order."""
    return ranked.where(F.col("rank") <= k).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("items"))


def pairs_of_runs(runs: DataFrame, run: str = "run", case: str = "case_id") -> DataFrame:
    """Every two runs of a case: its columns with _a and _b."""
    a = runs.select(case, *(F.col(c).alias(f"{c}_a") for c in runs.columns if c != case))
    b = runs.select(case, *(F.col(c).alias(f"{c}_b") for c in runs.columns if c != case))
    return a.join(b, case).where(F.col(f"{run}_a") < F.col(f"{run}_b"))


def first_against_rest(runs: DataFrame, first, run: str = "run", case: str = "case_id") -> DataFrame:
    """The first run of a case with each other run of it."""
    a = runs.where(F.col(run) == first).select(case, *(F.col(c).alias(f"{c}_a") for c in runs.columns if c != case))
    b = runs.where(F.col(run) != first).select(case, *(F.col(c).alias(f"{c}_b") for c in runs.columns if c != case))
    return a.join(b, case)


def list_agreement(pairs: DataFrame, k: int = 20) -> DataFrame:
    """Adds exact_order, exact_set and jaccard of items_a and items_b."""
    a, b = F.slice("items_a", 1, k), F.slice("items_b", 1, k)
    return pairs.withColumn("exact_order", (a == b).cast("double")).withColumn("exact_set", (F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))).cast("double")).withColumn("jaccard", stats.jaccard(a, b))


def kendall_tau(pairs: DataFrame) -> DataFrame:
    """Adds tau over the items that both lists hold; null if they share fewer than two."""
    shared = F.array_intersect("items_a", "items_b")  # in the order of the first
    places = F.transform(shared, lambda x: F.array_position(F.col("items_b"), x))
    later = F.transform(places, lambda x, i: F.aggregate(F.slice(places, i + 2, F.size(places)), F.lit(0).cast("long"), lambda acc, y: acc + F.when(y > x, 1).otherwise(-1)))
    total = F.aggregate(later, F.lit(0).cast("long"), lambda acc, x: acc + x)
    n = F.size(shared)
    return pairs.withColumn("tau", F.when(n >= 2, total / (n * (n - 1) / 2.0)))


def case_then_mean(pairs: DataFrame, columns: Sequence[str], missing: dict[str, float] | None = None) -> DataFrame:
    """Means over cases of each case's mean; a case's missing mean takes the value given."""
    cases = pairs.groupBy("case_id").agg(*(F.coalesce(F.avg(c), F.lit((missing or {}).get(c))) .alias(c) if c in (missing or {}) else F.avg(c).alias(c) for c in columns))
    return cases.agg(F.count("*").alias("cases"), *(F.round(F.avg(c), DIGITS).alias(c) for c in columns))


def run_rates(runs: DataFrame, column: str, run: str = "run") -> DataFrame:
    """Mean, smallest and largest of the runs' rates of a boolean column."""
    rates = runs.groupBy(run).agg(F.avg(F.col(column).cast("double")).alias("rate"))
    return rates.agg(F.round(F.avg("rate"), DIGITS).alias("rate_mean"), F.round(F.min("rate"), DIGITS).alias("rate_min"), F.round(F.max("rate"), DIGITS).alias("rate_max"))


def repeat_means(runs: DataFrame, keys: Sequence[str] = ("arm", "case_id"), column: str = "value") -> DataFrame:
    """The mean over repeats of each case."""
    return runs.groupBy(*keys).agg(F.avg(column).alias("value"), F.count("*").alias("repeats"))


def majority(runs: DataFrame, keys: Sequence[str] = ("case_id",), column: str = "passed") -> DataFrame:
    """Whether at least two thirds of the repeats passed."""
    return runs.groupBy(*keys).agg(F.count_if(column).alias("passes"), F.count("*").alias("repeats")).withColumn("majority", F.col("passes") * 3 >= F.col("repeats") * 2)


def pinned(runs: DataFrame, expected: DataFrame, value: str = "query") -> DataFrame:
    """For each case of either side: how many values it was recorded with, and whether that is exactly the expected one, by hash."""
    seen = runs.groupBy("case_id").agg(F.countDistinct(value).alias("n_values"), F.sha2(F.min(value), 256).alias("digest"))
    joined = expected.select("case_id", F.col("digest").alias("expected")).join(seen, "case_id", "full_outer")
    return joined.select("case_id", F.coalesce("n_values", F.lit(0)).alias("n_values"), F.coalesce((F.col("n_values") == 1) & (F.col("digest") == F.col("expected")), F.lit(False)).alias("pinned"))


def next_places(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds `place` from 0 by the given order within keys."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
