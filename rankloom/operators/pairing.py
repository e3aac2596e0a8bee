"""Paired comparison of two or more arms over the same cases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions import stats

DIGITS = 6


class PairingError(ValueError):
    """Arms that must have the same cases don't."""


def check_paired(arms: DataFrame, identity: Sequence[str] = ()) -> None:
    """Fail unless every arm (arm, case_id, ..) has each case once, with the same `identity` columns, and there are two arms at least.

    One aggregate over all arms; only its single row comes to the driver.
    """
    per_case = arms.groupBy("case_id").agg(F.count("*").alias("rows"), F.countDistinct("arm").alias("arms"), F.countDistinct(F.struct(*(F.col(c) for c in identity)) if identity else F.lit(1)).alias("identities"))
    n_arms = arms.agg(F.countDistinct("arm").alias("n_arms"))
    found = per_case.crossJoin(n_arms).agg(F.max("n_arms").alias("n_arms"), F.count_if(F.col("rows") != F.col("arms")).alias("repeated"), F.count_if(F.col("arms") != F.col("n_arms")).alias("missing"), F.count_if(F.col("identities") > 1).alias("differing")).first()
    if (found["n_arms"] or 0) < 2:
        raise PairingError("at least two arms are needed")
    for what in ("repeated", "missing", "differing"):
        if found[what]:
            raise PairingError(f"{found[what]} cases are {what} in an arm")


def paired(baseline: DataFrame, candidate: DataFrame, keys: Sequence[str] = ("case_id", "metric")) -> DataFrame:
    """keys, the baseline's other columns, baseline, candidate and delta of what both have (.., value)."""
    right = candidate.select(*keys, F.col("value").alias("candidate"))
    return baseline.withColumnRenamed("value", "baseline").join(right, list(keys)).withColumn("delta", F.col("candidate") - F.col("baseline"))


def delta_summary(pairs: DataFrame, keys: Sequence[str] = ("metric",), tolerance: float = 0.0) -> DataFrame:
    """Means, mean delta, wins, losses and ties; a tie is a delta of exactly 0, or of less than the tolerance if there is one."""
    tie = F.abs(F.col("delta")) < tolerance if tolerance else F.col("delta") == 0
    r = lambda c: F.round(F.avg(c), DIGITS)
    return pairs.groupBy(*keys).agg(
        F.count("*").alias("n"), r("baseline").alias("baseline_mean"), r("candidate").alias("candidate_mean"), r("delta").alias("mean_delta"),
        F.count_if(~tie & (F.col("delta") > 0)).alias("wins"), F.count_if(~tie & (F.col("delta") < 0)).alias("losses"), F.count_if(tie).alias("ties"),
    )


def acquisition(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The 2x2 table of a binary outcome (baseline, candidate above 0), the ids that changed, and McNemar's exact p."""
    b, c = F.col("baseline") > 0, F.col("candidate") > 0
    ids = lambda test: F.array_sort(F.collect_list(F.when(test, F.col("case_id"))))
    table = pairs.groupBy(*keys).agg(
        F.count_if(b & c).alias("both"), F.count_if(~b & ~c).alias("neither"), F.count_if(~b & c).alias("recovered"), F.count_if(b & ~c).alias("lost"),
        ids(~b & c).alias("recovered_ids"), ids(b & ~c).alias("lost_ids"),
    )
    return table.withColumn("p", F.round(stats.mcnemar_p(F.col("recovered"), F.col("lost")), DIGITS))


def transform_deltas(observations: DataFrame) -> DataFrame:
    """compact less full of each case and repeat that has both transforms."""
    wide = observations.groupBy("case_id", "repeat").pivot("transform", ["full", "compact"]).agg(F.first("value"))
    return wide.where("full IS NOT NULL AND compact IS NOT NULL").withColumn("delta", F.round(F.col("compact") - F.col("full"), DIGITS))


def fail_closed(schedule: DataFrame, observations: DataFrame, keys: Sequence[str] = ("transform",)) -> DataFrame:
    """Means of each key, null unless every scheduled observation is there and ok; always a row a key, with its number of errors."""
    joined = schedule.join(observations, ["case_id", "repeat", *keys], "left")
    ok = F.coalesce(F.col("status") == "ok", F.lit(False))
    found = joined.groupBy(*keys).agg(F.count("*").alias("scheduled"), F.count_if(~ok).alias("errors"), F.avg("value").alias("mean"))
    total = joined.agg(F.bool_and(ok).alias("valid"))
    return found.crossJoin(total).select(*keys, "scheduled", "errors", "valid", F.when(F.col("valid"), F.round("mean", DIGITS)).alias("mean"))
