import random

import pytest

from rankloom.llm import mixing


def shares(sizes, weights, most):
    """Targets by resharing the excess until none is above its stop."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        left = total - sum(fixed.values())
        open_ = [s for s in order if s not in fixed]
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in over}


def rows_of(seed, n=400):
    r = random.Random(seed)
    return [(k, r.choice(["a", "b", "Z", "é", None, "hot", "hot", "hot"]), r.choice([0, 1, 5, 100, r.randrange(1000)]), r.choice([None, 0.5, 1.0, float("nan"), -1.0])) for k in range(n)]


def test_targets_and_takings(spark):
    for seed in (1, 2):
        rows = rows_of(seed)
        out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long, quality double")).collect()
        sizes = {}
        for _, s, n, _ in rows:
            sizes[s] = sizes.get(s, 0) + n
        want, of = shares(sizes, mixing.WEIGHTS, 3), {k: s for k, s, _, _ in rows}
        assert len(out) == len(rows)
        taken = {}
        for r in out:
            source = of[r["doc_id"]]
            assert r["source_size"] == sizes[source] and r["target"] == pytest.approx(want[source])
            assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
            taken[source] = taken.get(source, 0) + r["taken"]
        largest = max(n for _, _, n, _ in rows)
        assert all(abs(taken[s] - want[s]) <= largest / 2 + 1e-6 for s in want)


def test_taken_documents_are_the_first_by_key(spark):
    rows = [(k, "a", 10, 0.2 + (k % 5) / 5) for k in range(200)] + [(1000 + k, "b", 10, 1.0) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, quality double")
    keys = df.withColumn("key", -mixing.F.ln(mixing.uniform(mixing.SEED, mixing.F.col("doc_id"))) / mixing.F.col("quality"))
    key = {r["doc_id"]: r["key"] for r in keys.collect()}
    for buckets in (1, 7, 4096):
        out = {r["doc_id"]: r["copies"] for r in mixing.mix(df, buckets=buckets).collect()}
        for lo in (0, 1000):
            own = sorted((d for d in out if lo <= d < lo + 1000), key=key.get)
            assert [out[d] for d in own] == sorted((out[d] for d in own), reverse=True)
    again = {r["doc_id"]: r["copies"] for r in mixing.mix(df.repartition(7)).collect()}
    assert again == out


def test_documents_with_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "a b c", "en", "s", 5, 1), (1, "a b c", "en", "s", 5, 1), (None, "x y", None, None, None, 2), (None, "x y z", None, None, None, 3), (4, None, "en", "s", 0, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size long, copies int")
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    assert set(map(tuple, out.collect())) <= set(rows)
    sized = sorted((r["size"] for r in mixing.sized(df).collect()))
    assert sized == [0, 2, 3, 3, 3]
    assert mixing.mixed_documents(df.limit(0)).collect() == []
    assert mixing.mix(mixing.sized(df.where("text is null"))).first()["taken"] == 0
