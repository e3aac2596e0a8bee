"""Connected components of an edge table, without gathering a component anywhere."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.session import shared_dir

#: A key with more than this many rows, and more than one part in SHARES of all, is hot: at most SHARES keys are.
LEAST_HOT, SHARES = 1000, 256


def hot_keys(rows: DataFrame, keys: list[str], total: int) -> pa.Table:
    """The keys of `rows` (`total` of them, materialised) with so many rows that a task of their own would be too large."""
    found = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > max(LEAST_HOT, total // SHARES))
    return found.select(*keys).toArrow()  # at most SHARES rows


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str], total: int, how: str = "inner") -> DataFrame:
    """rows.join(table, keys, how), where `table` has a row a key: rows of hot keys stay where they are and meet it by a broadcast."""
    hot = hot_keys(rows, keys, total)
    if not hot.num_rows:
        return rows.join(table, keys, how)
    own = F.broadcast(rows.sparkSession.createDataFrame(hot))  # of an Arrow table: rows would take Python workers of their own
    few = table.join(own, keys, "left_semi")  # at most SHARES rows
    return rows.join(own, keys, "left_anti").join(table, keys, how).unionByName(rows.join(own, keys, "left_semi").join(F.broadcast(few), keys, how))


def _stars(pairs: DataFrame) -> bool:
    """Whether every larger end has one edge and no smaller end is a larger one elsewhere: the components are read off."""
    if pairs.groupBy("a").count().where("count > 1").take(1):
        return False
    return not pairs.select("b").distinct().join(pairs.select(F.col("a").alias("b")), "b", "left_semi").take(1)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from each node of `edges` (a long, b long).

    Alternating large-star and small-star rounds until only stars are left.  A round takes minima per node, which combine
    before the shuffle, and joins them back; nodes with a large share of the edges are joined by a broadcast of them.  Each
    round is checkpointed in the shared folder.  Null ends, loops and repeated edges are ignored; no edges give no rows.
    """
    shared_dir(edges.sparkSession)
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct().checkpoint()
    while not _stars(pairs):
        total = pairs.count()
        least = pairs.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"))
        large = join_hot(pairs, least, ["b"], total, "left").select("a", F.coalesce("m", "b").alias("b")).distinct().checkpoint()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = join_hot(large, least, ["a"], total).where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = small.unionAll(least.select("a", F.col("m").alias("b"))).distinct().checkpoint()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
