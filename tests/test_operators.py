"""Hand-computed examples of the comparison operators."""

import pytest
from pyspark.sql import functions as F

from rankloom.functions import stats
from rankloom.operators import agreement, audit, context, fusion, metrics, pairing, ranking, resampling, sampling


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_paired_rows_and_acquisition(spark):
    base = spark.createDataFrame([("one", "owner/one", "MRR", 0.0), ("two", "owner/two", "MRR", 0.5)], "case_id string, repo string, metric string, value double")
    cand = spark.createDataFrame([("one", "owner/one", "MRR", 1.0), ("two", "owner/two", "MRR", 0.0)], base.schema)
    pairs = pairing.paired(base, cand)
    s = pairing.delta_summary(pairs).first()
    assert (s["n"], s["mean_delta"], s["wins"], s["losses"], s["ties"]) == (2, 0.25, 1, 1, 0)
    a = pairing.acquisition(pairs).first()
    assert (a["both"], a["neither"], a["recovered"], a["lost"], a["recovered_ids"], a["lost_ids"], a["p"]) == (0, 0, 1, 1, ["one"], ["two"], 1.0)


def test_pairing_guards(spark):
    good = [("a", 1, "r"), ("a", 2, "r"), ("b", 1, "r"), ("b", 2, "r")]
    make = lambda data: spark.createDataFrame(data, "arm string, case_id int, repo string")
    pairing.check_paired(make(good), ("repo",))
    for bad in (good[:2], good[:3], [*good, good[0]], [*good[:3], ("b", 2, "other")], []):
        with pytest.raises(pairing.PairingError):
            pairing.check_paired(make(bad), ("repo",))


@pytest.mark.parametrize("recovered,lost,p", [(0, 0, 1.0), (2, 14, 0.004180908), (1, 1, 1.0), (0, 5, 0.0625), (700, 900, 6.3e-7)])
def test_mcnemar(spark, recovered, lost, p):
    found = spark.range(1).select(stats.mcnemar_p(F.lit(recovered), F.lit(lost))).first()[0]
    assert found == pytest.approx(p, rel=0.05 if p < 1e-5 else 1e-6)


def test_ranking_agreement(spark):
    runs = spark.createDataFrame([("base", "a", ["one", "two"]), ("base", "b", ["three", "four"]), ("cand", "a", ["one", "two"]), ("cand", "b", ["four", "five"])], "run string, case_id string, items array<string>")
    found = agreement.list_agreement(agreement.pairs_of_runs(runs), 2).agg(F.avg("exact_order"), F.avg("jaccard")).first()
    assert found[0] == 0.5 and found[1] == pytest.approx((1 + 1 / 3) / 2)
    tau = rows(agreement.kendall_tau(agreement.pairs_of_runs(runs)).select("case_id", "tau"), "case_id")
    assert tau == [("a", 1.0), ("b", None)]
    empty = spark.createDataFrame([([], [])], "items_a array<int>, items_b array<int>")
    assert agreement.list_agreement(empty).first()["jaccard"] == 1.0


def test_weighted_fusion(spark):
    make = lambda ids: spark.createDataFrame([("q", i, r + 1) for r, i in enumerate(ids)], "case_id string, doc_id string, rank int")
    first, second = make("abc"), make("cbd")
    order = lambda share: [r["doc_id"] for r in fusion.two_way(first, second, share).orderBy("rank").collect()]
    assert order(0.7) == list("cbda") and order(0) == list("abc") and order(1) == list("cbd")
    for share, k in ((1.5, 60), (-0.1, 60), (0.5, -1)):
        with pytest.raises(ValueError):
            fusion.two_way(first, second, share, k)


def test_latest_row_decides(spark):
    log = [("o/empty", "abc", 0, 1, 0), ("o/valid", "def", 1, 3, 9), ("o/stale", "abc", 2, 3, 9), ("o/stale", "abc", 3, 3, 0)]
    df = spark.createDataFrame(log, "repo string, revision string, ordinal int, files int, chunks int")
    assert rows(audit.latest_valid(df, ["repo", "revision"], ["ordinal"], (F.col("files") > 0) & (F.col("chunks") > 0)).select("repo", "revision")) == [("o/valid", "def")]


def test_index_audit(spark):
    counts = spark.createDataFrame([("one", 3, 5, 5), ("two", 4, 7, 6)], "source string, files int, chunks int, embeddings int")
    found = audit.index_audit(counts.select("source"), counts).first()
    assert (found["complete"], found["files"], found["chunks"], found["embeddings"], found["chunk_embedding_mismatch"]) == (False, 7, 12, 11, ["two"])
    assert not any(found[c] for c in ("missing", "extra", "duplicates", "zero_files", "zero_chunks"))
    none = audit.index_audit(counts.limit(0).select("source"), counts.limit(0)).first()
    assert none["complete"] and none["files"] == 0


def test_schedule(spark):
    cases = spark.createDataFrame([(f"case-{k}",) for k in range(10)], "case_id string")
    plan = sampling.balanced_schedule(cases, 5).orderBy("observation_index").collect()
    assert [r["observation_index"] for r in plan] == list(range(1, 101))
    count = lambda t, p: sum(r["transform"] == t and r["position"] == p for r in plan)
    assert [count("full", 1), count("full", 2), count("compact", 2), count("compact", 1)] == [25, 25, 25, 25]
    for k in range(50):
        a, b = plan[2 * k : 2 * k + 2]
        assert {a["transform"], b["transform"]} == {"full", "compact"} and (a["position"], b["position"]) == (1, 2) and a["case_id"] == b["case_id"]


def test_cluster_bootstrap(spark):
    df = spark.createDataFrame([("m", "a", 1.0), ("m", "a", 1.0), ("m", "b", -1.0), ("m", "b", -1.0)], "metric string, repo string, delta double")
    reps = resampling.replicates(df, resamples=400)
    assert rows(resampling.interval(reps)) == [("m", -1.0, 1.0)]
    assert sorted(rows(reps)) == sorted(rows(resampling.replicates(df.repartition(3), resamples=400)))
    assert {round(v, 6) for _, _, v in rows(reps)} == {-1.0, 0.0, 1.0}
    ends = {r["rule"]: (r["ci_low"], r["ci_high"]) for r in resampling.endpoint_rules(spark.range(100).select(F.lit("m").alias("metric"), F.col("id").alias("rep"), F.col("id").cast("double").alias("value"))).collect()}
    assert ends == {"interpolated": (2.475, 96.525), "truncated": (2.0, 96.0), "capped": (2.0, 97.0), "shifted": (2.0, 96.0)}


def test_multi_arm_counts_repositories_once(spark):
    data = [(arm, "m", c, repo, wf, v + (arm == "x")) for arm in ("base", "x") for c, repo, wf, v in ((1, "a", "w", 0.0), (2, "a", "w", 1.0), (3, "b", "v", 4.0))]
    df = spark.createDataFrame(data, "arm string, metric string, case_id int, repo string, workflow string, value double")
    found = {(r["arm"], r["estimand"]): r for r in resampling.multi_arm(df, "base", resamples=200).collect()}
    assert found["base", "sample_weighted"]["level"] == round(5 / 3, 6) and found["base", "repository_macro"]["level"] == 2.25 and found["base", "workflow_macro"]["level"] == 2.25
    assert all(found["x", e]["effect"] == found["x", e]["effect_low"] == found["x", e]["effect_high"] == 1.0 for e in ("sample_weighted", "repository_macro", "workflow_macro"))


def test_fail_closed(spark):
    schedule = spark.createDataFrame([("a", 1, "full"), ("b", 1, "full")], "case_id string, repeat int, transform string")
    seen = spark.createDataFrame([("a", 1, "full", "ok", 1.0), ("b", 1, "full", "error", 0.0)], "case_id string, repeat int, transform string, status string, value double")
    r = pairing.fail_closed(schedule, seen).first()
    assert (r["errors"], r["valid"], r["mean"]) == (1, False, None)
    assert pairing.fail_closed(schedule.where("case_id = 'a'"), seen).first()["mean"] == 1.0


def test_rank_metrics_and_estimands(spark):
    gold = spark.createDataFrame([(1, 10), (1, 11), (2, 20)], "case_id int, doc_id int")
    ranked = spark.createDataFrame([("x", 1, 5, 1), ("x", 1, 10, 2), ("x", 1, 6, 3), ("x", 2, 7, 1)], "arm string, case_id int, doc_id int, rank int")
    found = {(r["case_id"], r["metric"]): r["value"] for r in metrics.rank_metrics(ranked, gold).collect()}
    assert found[1, "MRR"] == 0.5 and found[1, "Recall@5"] == 0.5 and found[1, "Precision@5"] == 0.2 and found[1, "irrelevant_files@5"] == 2 and found[1, "coverage_auc@20"] == 19 / 40
    assert found[2, "MRR"] == 0.0 and found[2, "any_gold@20"] == 0.0
    case = spark.createDataFrame([("x", "m", 1, "a", "w", 1.0), ("x", "m", 2, "a", "v", 0.0), ("x", "m", 3, "b", "v", 0.5)], "arm string, metric string, case_id int, repo string, workflow string, value double")
    assert {r["estimand"]: r["value"] for r in metrics.estimands(case).collect()} == {"sample_weighted": 0.5, "repository_macro": 0.5, "workflow_macro": 0.625}
    zero = metrics.zero_failures(case, spark.createDataFrame([(1, "error"), (2, "ok"), (3, "ok")], "case_id int, status string"))
    assert sorted(r["value"] for r in zero.collect()) == [0.0, 0.0, 0.5]
    assert metrics.distribution(case.limit(0), "value").first()["mean"] is None


def test_packing_a_context(spark):
    df = spark.createDataFrame([("x", 1, d, r, c, d) for d, r, c in ((1, 1, 5), (2, 2, 6), (3, 3, 1))], "arm string, case_id int, doc_id int, rank int, cost int, digest int")
    assert [(r["doc_id"], r["used"]) for r in context.packed(df, 10).orderBy("rank").collect()] == [(1, 5), (2, 5)]
    items = spark.createDataFrame([([(1, 6, 1), (2, 6, 1), (3, 3, 1), (4, 9, 4), (5, 1, 1)],)], "a array<struct<id:bigint,cost:bigint,header_cost:bigint>>")
    kept = items.select(context.seeded(F.col("a"), 11)["kept"].alias("k")).first()["k"]
    assert [(r["id"], r["whole"], r["cost"]) for r in kept] == [(1, True, 6), (2, False, 1), (3, True, 3)]
    rows = [(g, i, n) for g in ("x", None) for i, n in ((5, 1), (1, 4), (2, 4), (3, 4), (4, 9))]
    found = context.batched(spark.createDataFrame(rows, "batch_of string, id long, size long"), 2, 10, "batch_of").collect()
    assert sorted((str(r["batch_of"]), r["id"], r["batch"]) for r in found) == [(g, i + 1, b) for g in ("None", "x") for i, b in enumerate([0, 0, 1, 2, 2])]
    assert context.batched(spark.createDataFrame([], "g string, id long, size long"), 2, 10, "g").collect() == []
    assert [x[2] for x in context.segments("a b c\n\nd e f g h", 6)] == ["a b c\n\nd e f ", "g h"] and list(context.segments("", 5)) == [] and [x[2] for x in context.segments("x" * 50, 1)] == ["x" * 50]


def test_sampling(spark):
    cases = spark.createDataFrame([(k, f"r{k % 3}") for k in range(30)], "case_id int, repo string")
    split = sampling.hash_split(cases, "s", "v", "repo")
    assert rows(split.groupBy("repo", "split").count(), "repo", "split") == [(f"r{k}", s, n) for k in range(3) for s, n in (("development", 2), ("final", 8))]
    assert sampling.quota_sample(cases, 8, "x").count() == 8
    with pytest.raises(ValueError):
        sampling.group_counts_split(cases, 5, 6, "s")
    assert sampling.diverse_probe([("1", "t1", "a"), ("2", "t1", "b"), ("3", "t2", "b"), ("4", "t3", "a")], 3) == ["1", "3", "2"]
    assert sampling.diverse_probe([], 3) == []


def test_reranking(spark):
    df = spark.createDataFrame([(1, d, 10.0 - d, d + 1, 5.0 if d == 2 else -5.0) for d in range(5)], "case_id int, doc_id int, score double, rank int, logit double")
    assert [r["doc_id"] for r in ranking.rerank_blend(df, head=4, window=3).orderBy("rank").collect()] == [2, 0, 1, 3]
    order = spark.createDataFrame([(1, 0, 3), (1, 1, 1), (1, 2, 2)], "case_id int, doc_id int, place int")
    assert [r["doc_id"] for r in ranking.permuted(df, order, head=3).orderBy("rank").collect()] == [1, 2, 0, 3, 4]
    assert [r["doc_id"] for r in ranking.permuted(df, order.limit(2), head=3).orderBy("rank").collect()] == [0, 1, 2, 3, 4]


def test_pinning_and_verdicts(spark):
    runs = spark.createDataFrame([(1, "q"), (1, "q"), (2, "q"), (2, "r"), (3, "x")], "case_id int, query string")
    expected = spark.createDataFrame([(1, "q"), (2, "q"), (4, "q")], "case_id int, q string").select("case_id", F.sha2("q", 256).alias("digest"))
    assert rows(agreement.pinned(runs, expected), "case_id") == [(1, 1, True), (2, 2, False), (3, 1, False), (4, 0, False)]
    labels = spark.createDataFrame([("i", "error"), ("i", "resolved"), ("j", "?"), ("k", "unresolved")], "id string, label string")
    assert rows(audit.verdicts(labels, ("unresolved", "resolved", "error", "empty_patch"), ["id"]), "id") == [("i", "error"), ("j", "not_evaluated"), ("k", "unresolved")]


def test_results_do_not_depend_on_row_order(spark):
    docs = spark.createDataFrame([(k, " ".join(f"w{(k * j) % 7}" for j in range(1, 12))) for k in range(40)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "w1 w2 w3"), (2, "w5"), (3, "none")], "case_id long, query string")
    for ranker in (ranking.bm25, ranking.term_overlap):
        want = sorted(rows(ranker(docs, asked, 5)))
        assert want and want == sorted(rows(ranker(docs.orderBy(F.desc("doc_id")).repartition(5), asked, 5)))


def test_containment_is_that_of_every_pair(spark):
    from rankloom.operators import ranking

    texts = {1: "See foo.bar_baz and FooBar", 2: "xfoobarx İstanbul_x", 3: "", 4: None, 5: "naïve.Name NAÏVE.NAME", 6: "a.b", 7: "Straße9 ﬀab 数字类_名"}
    terms = ["foobar", "FOO", "bar_b", "naïve.name", "i̇stan", "b", "a.b", "数字", "STRASSE9", "straße9", "none"]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {tuple(r) for r in ranking.containing(docs, spark.createDataFrame([(t,) for t in terms], "term string")).collect()}
    assert found == {(i, t) for i, x in texts.items() for t in terms if x and t.lower() in x.lower()}
    assert ranking.containing(docs, spark.createDataFrame([], "term string")).collect() == []


def test_passages_are_found_wherever_they_are(spark):
    from rankloom.operators import ranking

    texts = {1: "one two three four five six seven", 2: "bone two three four five sixty", 3: "one  two three", 4: None, 5: "two", 6: "", 7: "one two\nthree four five six seven eight nine"}
    items = {1: "one two three four five six", 2: "e two three f", 3: "two", 4: "one two", 5: "one two three", 6: "", 7: "two\nthree four five six seven eight", 8: "five six sev", 9: "absent words that are long enough", 10: "two  three"}
    docs, asked = spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "case_id long, query string")
    found = sorted(map(tuple, ranking.holding(docs, asked).collect()))
    assert found == sorted((c, i) for c, q in items.items() for i, x in texts.items() if x is not None and q in x)


def test_hash_places_number_each_group(spark):
    import hashlib

    from pyspark.sql import functions as F

    from rankloom.functions.stats import hash_key
    from rankloom.operators import sampling

    rows = [(k, "hot" if k % 3 else None, "row") for k in range(300)] + [(1000, "one", "row")]
    found = sampling.hash_places(spark.createDataFrame(rows, "case_id long, repo string, row string"), "repo", hash_key("s", F.col("case_id"))).collect()
    for group in ("hot", None, "one"):
        own = sorted((r for r in found if r["repo"] == group), key=lambda r: r["place"])
        want = sorted((i for i, g, _ in rows if g == group), key=lambda i: hashlib.sha256(f"s|{i}".encode()).hexdigest())
        assert [r["case_id"] for r in own] == want and [r["place"] for r in own] == list(range(1, len(want) + 1))
        assert {r["group_size"] for r in own} == {len(want)}
