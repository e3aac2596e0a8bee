"""Manifests, coverage and index audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 6


def latest_valid(log: DataFrame, keys: Sequence[str], order: Sequence[str], valid: Column) -> DataFrame:
    """The last row of each key, if it is valid: an invalid later row deletes the key."""
    rest = [c for c in log.columns if c not in keys]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row")).select(*keys, "row.*")
    return last.where(valid)


def coverage_gaps(required: DataFrame, available: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What is required and not available, once each."""
    return required.select(*keys).distinct().join(available.select(*keys), list(keys), "left_anti")


def overlap(a: DataFrame, b: DataFrame, key: str) -> int:
    """Keys that both have; splits must have none."""
    return a.select(key).distinct().join(b.select(key), key, "left_semi").count()


def exclude_exposed(cases: DataFrame, exposed_ids: DataFrame, exposed_commits: DataFrame) -> DataFrame:
    """Cases that are exposed neither by id nor by commit."""
    return cases.join(exposed_ids.select("case_id"), "case_id", "left_anti").join(exposed_commits.select("commit"), "commit", "left_anti")


def ordered_subset(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of the wanted (case_id, ordinal), in that order; fails if one is missing."""
    missing = wanted.join(rows, "case_id", "left_anti").count()
    if missing:
        raise ValueError(f"{missing} wanted cases are missing")
    return wanted.join(rows, "case_id").orderBy("ordinal")


def source_counts(sources: DataFrame, files: DataFrame, chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Files, chunks and embeddings of each source: three aggregates joined, not a count a row."""
    out = sources
    for name, df in (("files", files), ("chunks", chunks), ("embeddings", embeddings)):
        out = out.join(df.groupBy("source").agg(F.count("*").alias(name)), "source", "left")
    return out.na.fill(0, ["files", "chunks", "embeddings"])


def index_audit(required: DataFrame, counts: DataFrame) -> DataFrame:
    """One row: totals, and lists of missing, extra, duplicate, empty and inconsistent sources, and whether all is complete.

    `required` (source) and `counts` (source, files, chunks, embeddings); the lists hold what is wrong only.
    """
    names = lambda test: F.array_sort(F.collect_set(F.when(test, F.col("source"))))
    need = required.groupBy("source").agg(F.lit(True).alias("needed"))
    have = counts.groupBy("source").agg(F.sum("files").alias("files"), F.sum("chunks").alias("chunks"), F.sum("embeddings").alias("embeddings"), F.count("*").alias("rows"))
    joined = need.join(have, "source", "full_outer")
    audit = joined.agg(
        F.coalesce(F.sum("files"), F.lit(0)).alias("files"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("embeddings"), F.lit(0)).alias("embeddings"),
        names(F.col("rows").isNull()).alias("missing"), names(F.col("needed").isNull()).alias("extra"), names(F.col("rows") > 1).alias("duplicates"), names(F.col("files") == 0).alias("zero_files"),
        names(F.col("chunks") == 0).alias("zero_chunks"), names(F.col("chunks") != F.col("embeddings")).alias("chunk_embedding_mismatch"),
    )
    empty = [F.size(c) == 0 for c in ("missing", "extra", "duplicates", "zero_files", "zero_chunks", "chunk_embedding_mismatch")]
    complete = empty[0]
    for e in empty[1:]:
        complete = complete & e
    return audit.withColumn("complete", complete)


def fidelity_audit(gold: DataFrame, files: DataFrame) -> DataFrame:
    """Each gold span (case_id, doc_id, last_line) as missing, truncated, shorter than its span, or available."""
    joined = gold.join(files, "doc_id", "left")
    state = F.when(F.col("lines").isNull(), "missing").when(F.col("truncated"), "truncated").when(F.col("lines") < F.col("last_line"), "shorter_than_span").otherwise("available")
    return joined.select("case_id", "doc_id", state.alias("state"))


def searchability_gaps(gold: DataFrame, indexed: DataFrame, reasons: Column) -> DataFrame:
    """Gold documents that no index holds, with the reason."""
    return gold.join(indexed.select("doc_id"), "doc_id", "left_anti").withColumn("reason", reasons)


#: Lines to a bin of ranges.
BIN = 64


def range_overlap(edits: DataFrame, shown: DataFrame, key: str = "path") -> DataFrame:
    """Edits (key, s, e) with whether they touch a shown range (key, lo, hi): s <= hi and e >= lo.

    Ranges are cut into bins of BIN lines, and what is shown of a bin is merged into at most BIN / 2 ranges, before edits meet
    it: a key with any number of ranges is as many groups as it has bins, and no edit meets a range twice.  Ranges with a null, or
    that end before they start, touch nothing.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / BIN), F.floor(F.col(b) / BIN)))
    cut = shown.where(F.col(key).isNotNull() & (F.col("lo") <= F.col("hi"))).select(key, "lo", "hi", bins("lo", "hi").alias("bin"))
    cut = cut.select(key, "bin", F.greatest("lo", F.col("bin") * BIN).alias("lo"), F.least("hi", F.col("bin") * BIN + BIN - 1).alias("hi"))
    cut = cut.groupBy(key, "bin", "lo").agg(F.max("hi").alias("hi"))  # at most BIN rows a bin
    merged = lambda acc, x: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["hi"] >= x["lo"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["lo"].alias("lo"), F.greatest(F.element_at(acc, -1)["hi"], x["hi"]).alias("hi")))),
    ).otherwise(F.concat(acc, F.array(x)))
    ranges = F.array_sort(F.collect_list(F.struct(F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))))
    held = cut.groupBy(key, "bin").agg(ranges.alias("ranges")).select(key, "bin", F.aggregate("ranges", F.array().cast("array<struct<lo:bigint,hi:bigint>>"), merged).alias("ranges"))
    asked = edits.where(F.col(key).isNotNull() & (F.col("s") <= F.col("e"))).distinct().withColumn("bin", bins("s", "e"))
    hits = asked.join(held, [key, "bin"]).where(F.exists("ranges", lambda x: (F.col("s") <= x["hi"]) & (F.col("e") >= x["lo"])))
    hits = hits.select(*edits.columns).distinct().withColumn("covered", F.lit(True))
    return edits.join(hits, list(edits.columns), "left").na.fill(False, ["covered"])


def verdicts(rows: DataFrame, precedence: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """The label of each key that is last in the precedence; labels that aren't in it give not_evaluated."""
    place = F.array_position(F.array(*map(F.lit, precedence)), F.col("label"))
    best = rows.groupBy(*keys).agg(F.max_by("label", place).alias("label"), F.max(place).alias("place"))
    return best.select(*keys, F.when(F.coalesce("place", F.lit(0)) > 0, F.col("label")).otherwise("not_evaluated").alias("verdict"))


def trajectories(messages: DataFrame) -> DataFrame:
    """Steps (assistant turns), messages and words of each conversation."""
    from rankloom.functions.text import word_count

    return messages.groupBy("conv_id").agg(F.count_if(F.col("role") == "assistant").alias("steps"), F.count("*").alias("n_messages"), F.sum(word_count(F.col("text"))).alias("words"), F.max("turn").alias("last_turn"))


def config_mismatches(expected: DataFrame, actual: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Settings (keys, name, value) that the actual config of the same keys lacks or has otherwise."""
    found = actual.select(*keys, "name", F.col("value").alias("found"))
    return expected.join(found, [*keys, "name"], "left").where(~F.col("value").eqNullSafe(F.col("found")))


def flat_config(df: DataFrame, column: str) -> DataFrame:
    """name (dotted) and value of the leaves of a struct column's first level and of structs below it."""
    def leaves(prefix: str, kind):
        for f in kind.fields:
            at = f"{prefix}.{f.name}"
            yield from leaves(at, f.dataType) if hasattr(f.dataType, "fields") else [at]

    names = list(leaves(column, df.schema[column].dataType))
    return df.select(F.explode(F.array(*(F.struct(F.lit(n[len(column) + 1 :]).alias("name"), F.col(n).cast("string").alias("value")) for n in names))).alias("s")).select("s.*")


def exposure(cases: DataFrame, used: DataFrame) -> DataFrame:
    """exposure_class of each set: C2 if all of its cases were used, C1 if some, C0 if none, with the used ids."""
    marked = cases.join(used.select("case_id", F.lit(1).alias("seen")).distinct(), "case_id", "left")
    found = marked.groupBy("set").agg(F.count("*").alias("n"), F.count("seen").alias("n_used"), F.array_sort(F.collect_list(F.when(F.col("seen").isNotNull(), F.col("case_id")))).alias("case_ids"))
    return found.withColumn("exposure_class", F.when(F.col("n_used") == 0, "C0").when(F.col("n_used") < F.col("n"), "C1").otherwise("C2"))


def still_to_do(required: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    return coverage_gaps(required, done, keys).orderBy(*keys)


def resolve(candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The candidate of each key that is best by exact name, benchmark, trust and snippets, ties to the smaller id."""
    order = F.struct(F.col("exact").cast("int"), "benchmark", "trust", "snippets", (-F.col("id")).alias("i"))
    return candidates.groupBy(*keys).agg(F.max_by("id", order).alias("id"))


def run_validity(cases: DataFrame, keys: Sequence[str] = ("run",)) -> DataFrame:
    """done if a run has cases and all are ok, else incomplete; with rates of failure."""
    return cases.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("status") != "ok").alias("failures"), F.round(F.avg((F.col("status") != "ok").cast("double")), DIGITS).alias("failure_rate"), F.when(F.bool_and(F.col("status") == "ok"), "done").otherwise("incomplete").alias("state"))


def first_seen(rows: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """Distinct keys with their place by first appearance."""
    first = rows.groupBy(*keys).agg(F.min(ordinal).alias("first"))
    return first.withColumn("place", F.row_number().over(Window.orderBy("first", *keys))).drop("first")  # a row a snapshot


def seed_content(seeds: DataFrame, gold: DataFrame, homes: DataFrame) -> DataFrame:
    """For each case: gold documents, how many of them are seeded, and the share of its seeds in the directory of a gold document.

    `seeds` and `gold` are (case_id, doc_id), `homes` (doc_id, directory).
    """
    found = gold.join(seeds.select("case_id", "doc_id", F.lit(1).alias("seeded")), ["case_id", "doc_id"], "left").groupBy("case_id").agg(F.count("*").alias("n_gold"), F.count("seeded").alias("gold_seeded"))
    places = gold.join(homes, "doc_id").select("case_id", "directory", F.lit(1).alias("near")).distinct()
    near = seeds.join(homes, "doc_id").join(places, ["case_id", "directory"], "left").groupBy("case_id").agg(F.count("*").alias("n_seeds"), F.round(F.count("near") / F.count("*"), DIGITS).alias("same_directory"))
    return found.join(near, "case_id", "left").select("case_id", "n_gold", "gold_seeded", F.coalesce("n_seeds", F.lit(0)).alias("n_seeds"), "same_directory")


def accessible(rows: DataFrame, owners: DataFrame, key: str, public: Column, owned: Column) -> DataFrame:
    """The rows that are public or whose owner (joined on the key) may see them."""
    return rows.join(owners, key).where(public | owned)
