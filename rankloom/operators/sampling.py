"""Deterministic samples, splits and schedules: orders come from hashes of ids, never from a generator's state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.stats import hash_key


#: Hexadecimal digits of a hash that name a bucket: 4096 of them in each group.
BUCKET_DIGITS = 3


def hash_places(rows: DataFrame, group: str, key: Column) -> DataFrame:
    """Adds key, place (from 1, in the key's order within the group) and group_size; the key is a hexadecimal hash.

    Rows are numbered within buckets of the hash, and the buckets of a group by their counts, so that a group with a third of
    all rows is not sorted by one task.  A null group is a group.
    """
    hashed = rows.withColumn("key", key)
    own = hashed.select(F.struct(F.col(group).alias("g")).alias("_group"), F.substring("key", 1, BUCKET_DIGITS).alias("_bucket"), F.struct(*(F.col(f"`{c}`") for c in hashed.columns)).alias("_row"))
    counts = own.groupBy("_group", "_bucket").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy("_group")
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_group", "_bucket", before.alias("_before"), F.sum("_n").over(whole).alias("group_size"))  # at most 4096 rows a group
    inside = Window.partitionBy("_group", "_bucket").orderBy("_row.key")
    return own.join(counts, ["_group", "_bucket"]).select("_row.*", (F.col("_before") + F.row_number().over(inside)).alias("place"), "group_size")


def hash_split(cases: DataFrame, seed: str, release: str, stratum: str = "stratum", share: float = 0.25) -> DataFrame:
    """Adds `split`: of each stratum, in hash order, the first max(1, floor(share * n)) are development, the rest final."""
    placed = hash_places(cases, stratum, hash_key(seed, release, F.col(stratum), F.col("case_id")))
    development = F.col("place") <= F.greatest(F.lit(1), F.floor(share * F.col("group_size")))
    return placed.withColumn("split", F.when(development, "development").otherwise("final")).drop("place", "group_size", "key")


def quota_sample(cases: DataFrame, n: int, salt: str, group: str = "repo") -> DataFrame:
    """About n cases in proportion to the groups: max(1, round half even) of each, in hash order, then the first n by hash."""
    total = cases.agg(F.count("*").alias("total"))  # one row
    placed = hash_places(cases, group, hash_key(salt, F.col("case_id"))).crossJoin(F.broadcast(total))
    kept = placed.withColumn("quota", F.greatest(F.lit(1), F.bround(n * F.col("group_size") / F.col("total"))).cast("int")).where("place <= quota")
    return kept.orderBy("key").limit(n).drop("place", "group_size", "key", "total")


def group_counts_split(cases: DataFrame, development: int, final: int, seed: str, group: str = "repo") -> DataFrame:
    """Adds `split` with fixed numbers of each group, others left out; fails if a group is too small."""
    short = cases.groupBy(group).count().where(F.col("count") < development + final).select(F.count("*")).first()[0]
    if short:
        raise ValueError(f"{short} groups have fewer than {development + final} cases")
    place = F.row_number().over(Window.partitionBy(group).orderBy(hash_key(seed, F.col(group), F.col("case_id"))))
    placed = cases.withColumn("place", place).where(F.col("place") <= development + final)
    return placed.withColumn("split", F.when(F.col("place") <= development, "development").otherwise("final")).drop("place")


def distinct_keep_least(rows: DataFrame, by: str, key: str, limit: int, seed: str) -> DataFrame:
    """Of rows with the same `by` the one with the smallest key; then the first `limit` in hash order, with their place."""
    least = rows.groupBy(by).agg(F.min(key).alias(key))
    ranked = least.withColumn("digest", hash_key(seed, F.col(key))).orderBy("digest").limit(limit)
    return ranked.withColumn("place", F.row_number().over(Window.orderBy("digest"))).select("place", by, key)  # `limit` rows


def control_sample(cases: DataFrame, corpus: DataFrame, gold: DataFrame, k: int, seed: str) -> DataFrame:
    """k documents of each case's repository (case_id, repo; doc_id, repo) in hash order, none of them its gold.

    Only a case's own repository holds candidates, and row_number cuts each partition's to k before they are dealt out.
    """
    pairs = cases.select("case_id", "repo").join(corpus.select("doc_id", "repo"), "repo").drop("repo")
    pairs = pairs.join(gold, ["case_id", "doc_id"], "left_anti")
    order = Window.partitionBy("case_id").orderBy(hash_key(seed, F.col("case_id"), F.col("doc_id")), "doc_id")
    return pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def first_of_group(cases: DataFrame, n: int, group: str = "workflow", order: Sequence[str] = ("case_id",)) -> DataFrame:
    return cases.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("place") <= n)


def diverse_probe(candidates: Sequence[tuple[str, str, str]], limit: int) -> list[str]:
    """Ids of (id, task, repo) candidates in order: first those of a new task and a new repo, then of a new repo, then any.

    A choice depends on all before it, so this is for the tens of candidates that the driver holds.
    """
    chosen: dict[str, None] = {}
    tasks, repos = set(), set()
    rounds = (lambda task, repo: task not in tasks and repo not in repos, lambda task, repo: repo not in repos, lambda task, repo: True)
    for k, wanted in enumerate(rounds):
        for case, task, repo in candidates:
            if k and len(chosen) >= limit:
                return list(chosen)
            if case not in chosen and wanted(task, repo):
                chosen[case] = None
                tasks.add(task)
                repos.add(repo)
    return list(chosen)


def balanced_schedule(cases: DataFrame, repeats: int, order: Column | str = "case_id") -> DataFrame:
    """Two observations, full and compact, of each case and repeat; AB and BA alternate by case and by repeat.

    Positions follow from the place of the case, so nothing is numbered across the whole table but the cases.
    """
    n = F.count("*").over(Window.partitionBy())
    placed = cases.withColumn("case_position", F.row_number().over(Window.orderBy(order))).withColumn("n", n)  # a row a case
    rows = placed.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats)))).withColumn("position", F.explode(F.array(F.lit(1), F.lit(2))))
    ab = (F.col("repeat") + F.col("case_position")) % 2 == 0
    pair = ((F.col("repeat") - 1) * F.col("n") + F.col("case_position")).cast("long")
    return rows.select(
        ((pair - 1) * 2 + F.col("position")).alias("observation_index"), pair.alias("pair_index"), "repeat", "case_position", "case_id",
        F.when(ab == (F.col("position") == 1), "full").otherwise("compact").alias("transform"), F.when(ab, "AB").otherwise("BA").alias("order"), "position",
    )


def eligible(cases: DataFrame, gold: DataFrame, corpus: DataFrame, leaking: DataFrame) -> DataFrame:
    """Every case with the reason it is dropped for: no_gold, missing_gold or leakage, else kept."""
    counts = gold.groupBy("case_id").agg(F.count("*").alias("n_gold"))
    missing = gold.join(corpus.select("doc_id"), "doc_id", "left_anti").groupBy("case_id").agg(F.count("*").alias("n_missing"))
    joined = cases.join(counts, "case_id", "left").join(missing, "case_id", "left").join(leaking.select("case_id", F.lit(True).alias("leaks")).distinct(), "case_id", "left")
    reason = F.when(F.col("n_gold").isNull(), "no_gold").when(F.col("n_missing").isNotNull(), "missing_gold").when(F.col("leaks"), "leakage").otherwise("kept")
    return joined.select("case_id", reason.alias("reason"))


def shard_completeness(shards: DataFrame, keys: Sequence[str] = ("repo",)) -> DataFrame:
    """Whether the shards (index, total, terminal) of a key agree on their total, are 1 to it, and are all terminal."""
    found = shards.groupBy(*keys).agg(F.countDistinct("total").alias("totals"), F.max("total").alias("total"), F.countDistinct("index").alias("indexes"), F.min("index").alias("lowest"), F.max("index").alias("highest"), F.bool_and("terminal").alias("terminal"))
    return found.select(*keys, "total", ((F.col("totals") == 1) & (F.col("indexes") == F.col("total")) & (F.col("lowest") == 1) & (F.col("highest") == F.col("total")) & F.col("terminal")).alias("complete"))
