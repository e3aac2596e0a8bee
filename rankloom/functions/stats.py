"""Column expressions of statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; two empty ones are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def same_top(a: Column, b: Column, k: int) -> Column:
    return F.slice(a, 1, k) == F.slice(b, 1, k)


def mcnemar_p(recovered: Column, lost: Column) -> Column:
    """The exact two-sided p-value of McNemar's test; 1 without discordant pairs.

    Binomial terms grow out of each other, in logarithms so that many pairs don't overflow.
    """
    n, low = (recovered + lost).cast("long"), F.least(recovered, lost).cast("long")
    start = F.struct((-n * F.ln(F.lit(2.0))).alias("term"), F.exp(-n * F.ln(F.lit(2.0))).alias("total"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.ln((n - i + 1).cast("double")) - F.ln(i.cast("double"))
        return F.struct(term.alias("term"), (acc["total"] + F.exp(term)).alias("total"))

    steps = F.when(low > 0, F.sequence(F.lit(1).cast("long"), low)).otherwise(F.array().cast("array<bigint>"))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.aggregate(steps, start, step)["total"]))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 where a vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def hash_int(*parts: Column | str) -> Column:
    """A number below 2^32 from the parts' md5, the same in every engine."""
    columns = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *columns)), 1, 8), 16, 10).cast("long")


def hash_key(*parts: Column | str) -> Column:
    """The hexadecimal sha-256 of the parts, for orders that depend on nothing else."""
    columns = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.sha2(F.concat_ws("|", *columns), 256)
