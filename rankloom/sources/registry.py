"""The run registry: append-only tables of runs and cases, of which the last row of a key counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators.audit import latest_valid

RUNS = "run_id string, created_at double, finished_at double, track string, system string, config string, split string, status string, notes string"
CASES = "run_id string, case_id string, written_at double, workflow string, repo string, ok boolean, latency_ms double, metrics map<string,double>, ranked array<string>, gold array<string>"


class RegistryError(ValueError):
    """A run that is asked for is missing, unfinished, empty or failed."""


class Registry:
    """Runs and cases under one folder; `write_*` append, `runs` and `cases` read the last row of each key."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write_runs(self, rows: DataFrame) -> None:
        rows.select(*(c.split()[0] for c in RUNS.split(", "))).write.mode("append").partitionBy("track").parquet(f"{self.path}/runs")

    def write_cases(self, rows: DataFrame) -> None:
        names = [c.split()[0] for c in CASES.split(", ")]
        rows.select(*names).write.mode("append").parquet(f"{self.path}/cases")

    def runs(self) -> DataFrame:
        """The last row of each run, with its number of cases counted, not stored."""
        rows = self.spark.read.schema(RUNS).parquet(f"{self.path}/runs")
        last = latest_valid(rows, ["run_id"], ["created_at", "finished_at"], F.lit(True))
        counts = self.cases().groupBy("run_id").agg(F.count("*").alias("n_cases"))
        return last.join(counts, "run_id", "left").na.fill(0, ["n_cases"])

    def cases(self, run_id: str | None = None) -> DataFrame:
        rows = self.spark.read.schema(CASES).parquet(f"{self.path}/cases")
        rows = rows if run_id is None else rows.where(F.col("run_id") == run_id)
        return latest_valid(rows, ["run_id", "case_id"], ["written_at"], F.lit(True))

    def valid_run(self, run_id: str) -> DataFrame:
        """The cases of a run that is done and has cases, all of them ok; anything else fails.  One row comes to the driver."""
        status = self.runs().where(F.col("run_id") == run_id).select("status", "n_cases").first()
        if status is None:
            raise RegistryError(f"no run {run_id}")
        if status["status"] != "done":
            raise RegistryError(f"run {run_id} is {status['status']}")
        rows = self.cases(run_id)
        bad = rows.where("not coalesce(ok, false)").count()
        if bad or not status["n_cases"]:
            raise RegistryError(f"run {run_id} has {status['n_cases']} cases, {bad} of them failed")
        return rows

    def long_metrics(self, run_id: str) -> DataFrame:
        """case_id, workflow, repo, metric and value of a valid run."""
        return self.valid_run(run_id).select("case_id", "workflow", "repo", F.explode("metrics").alias("metric", "value"))


def lookup(keys: DataFrame, store: DataFrame, key: str = "key") -> DataFrame:
    """The store's rows for the keys, missing ones with nulls: a join, however many keys there are."""
    return keys.select(key).distinct().join(store, key, "left")
