"""A live view of runs: cases arrive, the dashboard reads windowed counts and the latest row of each case.

An extension: the reference design appends cases while a dashboard polls; here both are streaming queries with
checkpoints in a folder that all executors share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def case_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_rates(cases: DataFrame, time: str = "ts", window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """run, window start, cases, failures and mean latency; rows later than the watermark are dropped and windows close behind it."""
    w = F.window(time, window)
    grouped = cases.withWatermark(time, late).groupBy(w.alias("w"), "run")
    return grouped.agg(F.count("*").alias("n"), F.count_if(F.col("status") != "ok").alias("failures"), F.avg("latency").alias("mean_latency")).select("run", F.col("w.start").alias("start"), "n", "failures", "mean_latency")


def sessions(cases: DataFrame, time: str = "ts", gap: str = "5 minutes", late: str = "30 minutes") -> DataFrame:
    """Bursts of a run's cases: a session ends when none arrives for the gap."""
    w = F.session_window(time, gap)
    return cases.withWatermark(time, late).groupBy(w.alias("w"), "run").agg(F.count("*").alias("n")).select("run", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_of_each(cases: DataFrame, time: str = "ts", late: str = "30 minutes") -> DataFrame:
    """Each (run, case_id) once within the watermark."""
    return cases.withWatermark(time, late).dropDuplicatesWithinWatermark(["run", "case_id"])


def append_latest(cases: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...] = ("run", "case_id"), order: str = "ts") -> StreamingQuery:
    """Write the last row of each key of every batch to `path`/batch=n; a repeated batch overwrites its own files only."""

    def write(batch: DataFrame, n: int) -> None:
        rest = [c for c in batch.columns if c not in keys]
        last = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("row")).select(*keys, "row.*")
        last.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return cases.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
