"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document gets an exponential key divided by its quality weight; within a source documents are taken in key order
until the source's token budget is met, after as many complete epochs as the budget holds.

The prefix sum over a source never meets in one task: keys fall into BUCKETS ranges a source, only the ranges' sums
are summed up source-wide, and rows are ordered within a range.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm import kernel
from rankloom.session import saved, shared_dir

BUCKETS = 4096
WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
SEED = "mix-1"


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = [c for c in batch.schema.names if c != "text"]
        columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(kernel.word_counts(batch.column(batch.schema.get_field_index("text"))))], [*names, "size"])


def sized(docs: DataFrame, with_row: bool = False) -> DataFrame:
    """doc_id, source, size (words; null text 0) and quality, from text statistics: 1 for six characters a word, less away from it; `with_row` adds the row as a struct."""
    row = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if with_row else []
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("chars"), *row, F.col("text").cast("string").alias("text"))
    fields = "".join(f", row {own.schema['row'].dataType.simpleString()}" for _ in row)
    out = own.mapInArrow(_measure, f"doc_id long, source string, chars long{fields}, size long")
    quality = F.when(F.col("size") > 0, 1 / (1 + F.abs(F.col("chars").cast("double") / F.col("size") - 6)))
    return out.select("doc_id", "source", "size", F.coalesce(quality, F.lit(1.0)).alias("quality"), *(["row"] if with_row else []))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """Per source: source_size, target and mean_quality.

    Sources by code point, null last, take the weights in turn and share the sum of all sizes by weight; a target stops
    at `most` times its source's size and the excess is shared again by weight among the others.  In order of the level
    at which a source stops, the level of all others is the first that stops nobody else.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.avg("quality").alias("mean_quality"))
    turn = Window.orderBy(F.col("source").isNull(), "source")
    ranked = total.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(turn) - 1) % len(weights) + 1).cast("int")).cast("double")).withColumn("stop", most * F.col("source_size") / F.col("weight"))
    before = Window.orderBy("stop", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    shared = ranked.withColumn("level", level).withColumn("shared", F.min_by("level", F.when(F.col("level") <= F.col("stop"), F.struct("stop", F.col("source").isNull().alias("n"), "source"))).over(everything))
    return shared.select("source", "source_size", "mean_quality", F.least(F.col("weight") * F.col("shared"), (most * F.col("source_size")).cast("double")).alias("target"))


def uniform(seed: str, key: Column) -> Column:
    """A number in (0, 1) from the key, the same in every run."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def mix(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, seed: str = SEED, buckets: int = BUCKETS, rows: DataFrame | None = None) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken (copies times size) for rows of doc_id, source, size, quality.

    Every document is taken once for each complete epoch in its source's target; what is left of it goes to documents in
    key order, each while at least half of it fits.  Null or negative sizes count as 0, null or non-positive qualities
    as the least positive weight; a null source is a source of its own; repeated rows are taken each on its own, ties in
    key are broken by doc_id and size; an empty table gives no rows.  `rows`, if given, has the same rows with a column
    `row`, which the result then has, too.
    """
    shared_dir(sizes.sparkSession)
    clean = lambda df: df.withColumn("size", F.greatest(F.coalesce("size", F.lit(0)), F.lit(0)).cast("long")).withColumn("quality", F.greatest(F.coalesce(F.nanvl("quality", F.lit(0.0)), F.lit(0.0)), F.lit(1e-6)))
    named = lambda df: df.withColumn("named", F.col("source").isNotNull()).withColumn("source", F.coalesce("source", F.lit("")))
    sizes = clean(sizes.select("doc_id", "source", "size", "quality")).checkpoint()
    targets = saved(named(source_targets(sizes, weights, most)))  # a row a source: broadcast if small

    def keyed(df: DataFrame) -> DataFrame:
        df = named(df).join(targets, ["named", "source"]).withColumn("key", -F.ln(uniform(seed, F.col("doc_id"))) / F.col("quality"))
        return df.withColumn("bucket", F.least(F.floor((1 - F.exp(-F.col("key") * F.col("mean_quality"))) * buckets), F.lit(buckets - 1)).cast("int"))

    sums = keyed(sizes).groupBy("named", "source", "bucket").agg(F.sum("size").alias("in_bucket"))
    earlier = Window.partitionBy("named", "source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("named", "source", "bucket", F.coalesce(F.sum("in_bucket").over(earlier), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("named", "source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed(sizes if rows is None else clean(rows)).join(sums, ["named", "source", "bucket"]).withColumn("before", F.col("earlier") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("target") - epochs * F.col("source_size")
    copies = epochs + F.when((rest > 0) & (F.col("before") + F.col("size") / 2.0 <= rest), 1).otherwise(0)
    kept = ["row"] if rows is not None else []
    return placed.select("doc_id", "size", "source_size", "target", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), *kept)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it; rows it does not take are left out."""
    taken = mix(sized(docs), rows=sized(docs, with_row=True), **options).where("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
