"""Packing ranked documents into a token budget."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from rankloom.session import shared_dir

DIGITS = 6


def packed(ranked: DataFrame, budget: int = 8000, keys: Sequence[str] = ("arm", "case_id")) -> DataFrame:
    """The rows (.., rank, cost) that fit, with `used` tokens of each; the last one is cut at the budget."""
    before = F.coalesce(F.sum("cost").over(Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranked.withColumn("before", before).where(F.col("before") < budget).withColumn("used", F.least(F.col("cost"), budget - F.col("before")))


def context_metrics(packs: DataFrame, gold: DataFrame, budget: int = 8000, keys: Sequence[str] = ("arm", "case_id")) -> DataFrame:
    """Budgeted yield of each case: BCY (share of gold documents packed whole), coverage, token ratios, pollution, redundancy.

    Redundant tokens are those of documents whose `digest` an earlier document of the pack has.
    """
    n_gold = gold.groupBy("case_id").agg(F.count("*").alias("n_gold"))
    again = F.row_number().over(Window.partitionBy(*keys, "digest").orderBy("rank")) > 1
    marked = packs.withColumn("again", again).join(gold.withColumn("hit", F.lit(1)), ["case_id", "doc_id"], "left")
    hit = F.col("hit").isNotNull()
    sums = marked.groupBy(*keys).agg(
        F.sum("used").alias("packed_tokens"), F.sum(F.when(hit, F.col("used")).otherwise(0)).alias("gold_tokens"), F.sum(F.when(hit & (F.col("used") == F.col("cost")), 1).otherwise(0)).alias("whole"),
        F.sum(F.when(hit, 1).otherwise(0)).alias("touched"), F.sum(F.when(F.col("again"), F.col("used")).otherwise(0)).alias("repeated"),
    )
    part = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), DIGITS)
    c = F.col
    return sums.join(n_gold, "case_id").select(
        *keys, part(c("whole"), c("n_gold")).alias("bcy"), part(c("touched"), c("n_gold")).alias("gold_coverage"), part(c("gold_tokens"), c("packed_tokens")).alias("gold_token_ratio"), F.round(c("gold_tokens") / F.lit(budget), DIGITS).alias("context_efficiency"),
        (c("packed_tokens") - c("gold_tokens")).alias("context_pollution_tokens"), part(c("repeated"), c("packed_tokens")).alias("redundancy"), "packed_tokens",
    )


def seeded(paths: Column, budget: int, opening: int = 0) -> Column:
    """Sections kept of an ordered array of (id, cost, header_cost): whole if it fits, else its header, else nothing more.

    Whether a section shrinks depends on what came before, so this folds over the array: kept is (id, whole, cost).
    """
    start = F.struct(F.lit(opening).cast("long").alias("used"), F.lit(False).alias("closed"), F.array().cast("array<struct<id:bigint,whole:boolean,cost:bigint>>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        whole, header = acc["used"] + x["cost"] <= budget, acc["used"] + x["header_cost"] <= budget
        cost = F.when(whole, x["cost"]).otherwise(x["header_cost"]).cast("long")
        item = F.array(F.struct(x["id"].cast("long").alias("id"), whole.alias("whole"), cost.alias("cost")))
        more = ~acc["closed"] & (whole | header)
        return F.struct(F.when(more, acc["used"] + cost).otherwise(acc["used"]).alias("used"), (acc["closed"] | ~more).alias("closed"), F.when(more, F.concat(acc["kept"], item)).otherwise(acc["kept"]).alias("kept"))

    return F.aggregate(paths, start, step)


def _closed(sizes: list[int], n: int, size: int, most_items: int, most_size: int) -> tuple[list[int], int, int]:
    """Batches closed before each of the items, from an open batch of n items and `size`; and the open batch behind them."""
    out, closed = [], 0
    for s in sizes:
        if n and (n >= most_items or size + s > most_size):
            closed, n, size = closed + 1, 0, 0
        n, size = n + 1, size + s
        out.append(closed)
    return out, n, size


def batched(items: DataFrame, most_items: int, most_size: int, group: str) -> DataFrame:
    """group, id and batch of `items` (group, id, size) in the order of their ids: a batch closes before the item that would pass a bound.

    A parallel fold: a group lies in as many partitions as it fills.  Where a partition's first batch stands depends on all
    before it, but the batch that is open there has at most `most_items` items, so each partition tells, for each number of
    items that it may have, how many batches close within it and how many items the open one has behind it; those maps, a few
    numbers a partition, are composed in order.  Equal ids are in order of size; a null size counts 0, null groups are one
    group; an item above the bound is a batch of its own.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    spark = items.sparkSession
    shared_dir(spark)
    keys = [F.col(group).asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("size")]
    own = items.select(group, F.col("id").cast("long").alias("id"), F.coalesce(F.col("size").cast("long"), F.lit(0)).alias("size"))
    rows = own.repartitionByRange(*keys).sortWithinPartitions(*keys).select(F.spark_partition_id().alias("part"), group, "id", "size").checkpoint()
    kind = rows.schema[group].dataType.simpleString()

    def edges(found):
        part, first, last, sizes, n = None, None, None, [], 0
        for batch in found:
            for p, g, s in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3))):
                if part is None:
                    part, first = p, g
                if n and g != last:
                    sizes, n = [], 0
                last, n = g, n + 1
                sizes = [*sizes[1 - most_items :], s] if most_items > 1 else [s]
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([first], rows_type), pa.array([last], rows_type), pa.array([sizes], pa.list_(pa.int64()))], ["part", "first", "last", "sizes"])

    rows_type = to_arrow_type(rows.schema[group].dataType)
    ends = sorted(rows.mapInArrow(edges, f"part long, first {kind}, last {kind}, sizes array<bigint>").collect(), key=lambda r: r.part)  # a row a partition
    tails, before = {}, {}  # of a partition that goes on with a group: the sizes of the items before it
    for above, r in zip(ends, ends[1:]):
        tail = above.sizes if above.first != above.last or above.part not in before else [*before[above.part], *above.sizes][-most_items:]
        if r.first == above.last:
            before[r.part] = tail
            if r.first == r.last:
                tails[r.part] = tail
    known = spark.sparkContext.broadcast(tails)

    def maps(found):
        part, open_batches = None, []
        for batch in found:
            if batch.num_rows and part is None:
                part = batch.column(0)[0].as_py()
                tail = known.value.get(part, [])
                open_batches = [[0, n, sum(tail[-n:])] for n in range(1, len(tail) + 1)]
            if part in known.value:
                sizes, ran = batch.column(3).to_pylist(), {}
                for x in open_batches:  # equal states go on as one
                    state = (x[1], x[2])
                    if state not in ran:
                        ran[state] = _closed(sizes, *state, most_items, most_size)
                    closed, x[1], x[2] = ran[state]
                    x[0] += closed[-1] if closed else 0
        if part in known.value:
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([[x[0] for x in open_batches]], pa.list_(pa.int64())), pa.array([[x[1] for x in open_batches]], pa.list_(pa.int64()))], ["part", "closed", "behind"])

    through = {r.part: r for r in rows.mapInArrow(maps, "part long, closed array<bigint>, behind array<bigint>").collect()} if tails else {}
    # the number of the batch that is open before each partition, and its items; a partition with its group's start tells its own
    inside = {}
    if before:
        starts = {r.part for r in ends if r.first != r.last or r.part not in before}

        def opened(found):
            """Of a partition in which its last group starts: how many batches that closes, and the items of the open one."""
            part, last, closed, n, size = None, None, 0, 0, 0
            for batch in found:
                for p, g, s in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3))):
                    if part is None or g != last:
                        part, last, closed, n, size = p, g, 0, 0, 0
                    more, n, size = _closed([s], n, size, most_items, most_size)
                    closed += more[0]
            if part is not None:
                yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([closed]), pa.array([n])], ["part", "closed", "n"])

        inside = {r.part: (r.closed, r.n) for r in rows.mapInArrow(opened, "part long, closed long, n long").collect() if r.part in starts}
    entry, state = {}, None
    for r in ends:
        if r.part in before:
            entry[r.part] = (*state, before[r.part])
        if r.part in inside:
            state = inside[r.part]
        elif r.part in through:
            number, n = state
            state = (number + through[r.part].closed[n - 1], through[r.part].behind[n - 1])
    entered = spark.sparkContext.broadcast({p: (number, n, sum(tail[-n:])) for p, (number, n, tail) in entry.items()})

    def run(found):
        last, number, n, size, begun = None, 0, 0, 0, False
        for batch in found:
            if not batch.num_rows:
                continue
            if not begun:
                begun, last = True, batch.column(1)[0].as_py()
                number, n, size = entered.value.get(batch.column(0)[0].as_py(), (0, 0, 0))
            out = []
            for g, s in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                if g != last:
                    last, number, n, size = g, 0, 0, 0
                closed, n, size = _closed([s], n, size, most_items, most_size)
                number += closed[0]
                out.append(number)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(out, pa.int32())], [group, "id", "batch"])

    return rows.mapInArrow(run, f"`{group}` {kind}, id long, batch int")


_WORD = re.compile("[^ \\t\\n\\v\\f\\r]+")


def segments(text: str, budget: int) -> Iterator[tuple[str, str, str, int]]:
    """(segment_id, heading, text, words) of the segments of at most `budget` words of a text, which together are the text.

    Sections start at lines with `### `, whose first line is their heading.  A segment that is not the last of its section ends
    behind the latest space or line end of its second half.  Ids count from E001 through all sections.  Linear in the text.
    """
    if budget < 1:
        raise ValueError("budget must be at least 1")
    number = 0
    for section in re.split("(?m)(?=^### )", text):
        heading = section.split("\n", 1)[0] if section.startswith("### ") else ""
        starts, start, first = [m.start() for m in _WORD.finditer(section)], 0, 0
        while start < len(section):
            end = starts[first + budget] if first + budget < len(starts) else len(section)
            if end < len(section):
                cut = max(section.rfind(mark, start + max(1, (end - start) // 2), end) for mark in ("\n", " "))
                end = cut + 1 if cut > start else end
            after = bisect_left(starts, end, first)
            number += 1
            yield f"E{number:03d}", heading, section[start:end], after - first
            start, first = end, after


def register_segmenter(spark: SparkSession) -> None:
    """The table function segment_text(text, budget): segment_id, heading, text and words; null texts have none."""

    class Segmenter:
        def eval(self, text: str, budget: int):
            yield from segments(text or "", budget)

    spark.udtf.register("segment_text", udtf(Segmenter, returnType="segment_id string, heading string, text string, words int"))


def segment(docs: DataFrame, budget: int = 200) -> DataFrame:
    """doc_id, segment_id, heading, segment and words of each document's pieces; null texts have none."""
    register_segmenter(docs.sparkSession)
    return docs.sparkSession.sql(f"SELECT d.doc_id, s.segment_id, s.heading, s.text AS segment, s.words FROM {{docs}} d, LATERAL segment_text(d.text, {int(budget)}) s", docs=docs.select("doc_id", "text"))
