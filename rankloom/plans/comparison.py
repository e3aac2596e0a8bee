"""Queries: paired comparison, resampling, agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions import stats
from rankloom.operators import agreement, pairing, resampling
from rankloom.plans import frames
from rankloom.plans.fragments import sql
from rankloom.session import saved, table

QUERIES, SQL = {}, {}


def query(name: str, twin: str | None):
    def keep(f):
        QUERIES[name] = f
        if twin:
            SQL[name] = twin
        return f

    return keep


SUMMARY = "count(*) AS n, round(avg(baseline), 6) AS baseline_mean, round(avg(candidate), 6) AS candidate_mean, round(avg(delta), 6) AS mean_delta, count(*) FILTER (delta > 0) AS wins, count(*) FILTER (delta < 0) AS losses, count(*) FILTER (delta = 0) AS ties"


@query("paired_delta", sql(f"SELECT metric, {SUMMARY} FROM pairs GROUP BY metric", "pairs"))
def paired_delta(spark, d):
    return pairing.delta_summary(frames.pairs(spark, d))


@query("paired_by_workflow", sql(f"SELECT metric, workflow, {SUMMARY} FROM pairs GROUP BY metric, workflow", "pairs"))
def paired_by_workflow(spark, d):
    return pairing.delta_summary(frames.pairs(spark, d), ("metric", "workflow"))


@query("compare_view", sql("SELECT metric, count(*) FILTER (abs(delta) >= 1e-9 AND delta > 0) AS wins, count(*) FILTER (abs(delta) >= 1e-9 AND delta < 0) AS losses, count(*) FILTER (abs(delta) < 1e-9) AS ties FROM pairs GROUP BY metric", "pairs"))
def compare_view(spark, d):
    return pairing.delta_summary(frames.pairs(spark, d), tolerance=1e-9).select("metric", "wins", "losses", "ties")


#: McNemar's exact p of (recovered, lost), by log-gamma terms of the binomial.
P_SQL = "round(CASE WHEN recovered + lost = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(least(recovered, lost) + 1), lambda i: exp(lgamma(recovered + lost + 1) - lgamma(i + 1) - lgamma(recovered + lost - i + 1) - (recovered + lost) * ln(2.0::DOUBLE))))) END, 6) AS p"
OUTCOMES_SQL = "WITH o AS (SELECT d.source, l.doc_id AS case_id, l.quality AS b, l.toxic AS c FROM labels l JOIN documents d USING (doc_id)) "
TABLE_SQL = "count(*) FILTER (b > 0 AND c > 0) AS both, count(*) FILTER (NOT b > 0 AND NOT c > 0) AS neither, count(*) FILTER (NOT b > 0 AND c > 0) AS recovered, count(*) FILTER (b > 0 AND NOT c > 0) AS lost"


def _outcomes(spark, d):
    own = table(spark, d, "documents").select("doc_id", "source")
    return table(spark, d, "labels").join(own, "doc_id").select("source", F.col("doc_id").alias("case_id"), F.col("quality").alias("baseline"), F.col("toxic").alias("candidate"))


@query("mcnemar", OUTCOMES_SQL + f'SELECT source, recovered, lost, {P_SQL} FROM (SELECT source, {TABLE_SQL.replace("AS both", "AS both_n")} FROM o GROUP BY source)')
def mcnemar(spark, d):
    """Quality against toxicity labels of each source, as two binary outcomes."""
    return pairing.acquisition(_outcomes(spark, d), ["source"]).select("source", "recovered", "lost", "p")


@query("acquisition_table", OUTCOMES_SQL + f"""SELECT *, {P_SQL} FROM (SELECT source, {TABLE_SQL}, array_to_string(list(case_id ORDER BY case_id) FILTER (NOT b > 0 AND c > 0), ',') AS recovered_ids, md5(array_to_string(list(case_id ORDER BY case_id) FILTER (b > 0 AND NOT c > 0), ',')) AS lost_ids FROM o GROUP BY source)""".replace(" AS both,", ' AS "both",'))
def acquisition_table(spark, d):
    found = pairing.acquisition(_outcomes(spark, d), ["source"])
    text = lambda c: F.when(F.size(c) > 0, F.array_join(F.transform(c, lambda x: x.cast("string")), ","))
    return found.withColumn("recovered_ids", text("recovered_ids")).withColumn("lost_ids", F.md5(text("lost_ids")))


CI = "round(quantile_cont(value, 0.025), 6) AS ci_low, round(quantile_cont(value, 0.975), 6) AS ci_high"


@query("bootstrap_ci", sql(f"SELECT metric, mean_delta, ci_low, ci_high, ci_low > 0 OR ci_high < 0 AS significant FROM (SELECT metric, {CI} FROM reps GROUP BY metric) JOIN (SELECT metric, round(avg(delta), 6) AS mean_delta FROM pairs GROUP BY metric) USING (metric)", "reps"))
def bootstrap_ci(spark, d):
    pairs = saved(frames.pairs(spark, d))
    found = resampling.interval(resampling.replicates(pairs)).join(pairing.delta_summary(pairs), "metric")
    return found.select("metric", "mean_delta", "ci_low", "ci_high", ((F.col("ci_low") > 0) | (F.col("ci_high") < 0)).alias("significant"))


@query("case_cluster_bootstrap", sql("""SELECT metric, round(quantile_cont(value, 0.025), 6) AS ci_low, round(quantile_cont(value, 0.975), 6) AS ci_high FROM (SELECT metric, rep, sum(times * s) / sum(times * n) AS value FROM k JOIN kd USING (g, pick) GROUP BY metric, rep) GROUP BY metric""", "pairs").replace("\nSELECT metric, round(quantile", """,
k AS MATERIALIZED (SELECT metric, case_id, sum(delta) AS s, count(*) AS n, row_number() OVER (PARTITION BY metric ORDER BY case_id) - 1 AS pick, count(*) OVER (PARTITION BY metric) AS g FROM pairs GROUP BY metric, case_id),
kd AS MATERIALIZED (SELECT g, rep, pick, count(*) AS times FROM (SELECT g, rep, ('0x' || substr(md5('1042|' || rep || '|' || slot), 1, 8))::BIGINT % g AS pick FROM (SELECT g, rep, unnest(range(g)) AS slot FROM (SELECT DISTINCT g FROM k), range(1000) r(rep))) GROUP BY ALL)
SELECT metric, round(quantile""", 1))
def case_cluster_bootstrap(spark, d):
    return resampling.interval(resampling.replicates(frames.pairs(spark, d), cluster="case_id"))


ENDS_SQL = sql("""SELECT metric, rule, round(lo, 6) AS ci_low, round(hi, 6) AS ci_high FROM (
SELECT metric, 'interpolated' AS rule, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi FROM reps GROUP BY metric
UNION ALL SELECT metric, 'truncated', v[24 + 1], v[974 + 1] FROM w UNION ALL SELECT metric, 'capped', v[25 + 1], v[975 + 1] FROM w UNION ALL SELECT metric, 'shifted', v[25 + 1], v[974 + 1] FROM w)""", "reps").replace("\nSELECT metric, rule", ",\nw AS (SELECT metric, list(value ORDER BY value) AS v FROM reps GROUP BY metric)\nSELECT metric, rule", 1)


@query("bootstrap_endpoints", ENDS_SQL)
def bootstrap_endpoints(spark, d):
    return resampling.endpoint_rules(resampling.replicates(frames.pairs(spark, d)))


MULTI_SQL = sql("""SELECT arm, metric, estimand, round(max(level) FILTER (rep < 0), 6) AS level, round(quantile_cont(level, 0.025) FILTER (rep >= 0), 6) AS level_low, round(quantile_cont(level, 0.975) FILTER (rep >= 0), 6) AS level_high,
  round(max(effect) FILTER (rep < 0), 6) AS effect, round(quantile_cont(effect, 0.025) FILTER (rep >= 0), 6) AS effect_low, round(quantile_cont(effect, 0.975) FILTER (rep >= 0), 6) AS effect_high
FROM (SELECT l.*, l.level - b.level AS effect FROM levels l JOIN levels b ON b.arm = 'bm25' AND b.metric = l.metric AND b.rep = l.rep AND b.estimand = l.estimand) GROUP BY ALL""", "metrics").replace("\nSELECT arm, metric, estimand, round(max", """,
cells AS MATERIALIZED (SELECT arm, metric, repo, workflow, sum(value) AS s, count(*) AS n FROM metrics WHERE metric IN ('MRR', 'Recall@20') GROUP BY ALL),
repos AS MATERIALIZED (SELECT repo, row_number() OVER (ORDER BY repo) - 1 AS pick, count(*) OVER () AS g FROM (SELECT DISTINCT repo FROM cells)),
times AS MATERIALIZED (SELECT rep, pick, count(*) AS times FROM (SELECT rep, ('0x' || substr(md5('1042|' || rep || '|' || slot), 1, 8))::BIGINT % g AS pick FROM (SELECT g, rep, unnest(range(g)) AS slot FROM (SELECT DISTINCT g FROM repos), range(100000) r(rep))) GROUP BY ALL UNION ALL SELECT -1, pick, 1 FROM repos),
drawn AS MATERIALIZED (SELECT c.*, rep, times FROM cells c JOIN repos USING (repo) JOIN times USING (pick)),
levels AS MATERIALIZED (
  SELECT arm, metric, rep, 'sample_weighted' AS estimand, sum(times * s) / sum(times * n) AS level FROM drawn GROUP BY ALL
  UNION ALL SELECT arm, metric, rep, 'repository_macro', avg(m) FROM (SELECT arm, metric, rep, repo, sum(s) / sum(n) AS m FROM drawn GROUP BY ALL) GROUP BY ALL
  UNION ALL SELECT arm, metric, rep, 'workflow_macro', avg(m) FROM (SELECT arm, metric, rep, workflow, sum(times * s) / sum(times * n) AS m FROM drawn GROUP BY ALL) GROUP BY ALL)
SELECT arm, metric, estimand, round(max""", 1)


@query("bootstrap_multi_arm", MULTI_SQL)
def bootstrap_multi_arm(spark, d):
    found = frames.case_metrics(spark, d).where(F.col("metric").isin("MRR", "Recall@20"))
    return resampling.multi_arm(found, "bm25", resamples=100_000)


@query("pooled_pairs", sql(f"""SELECT metric, {SUMMARY} FROM (SELECT b.metric, b.value AS baseline, c.value AS candidate, c.value - b.value AS delta FROM metrics b JOIN metrics c USING (case_id, metric) WHERE (b.arm, c.arm) IN (('bm25', 'rrf70'), ('rrf30', 'lexical')) AND metric IN ('MRR', 'Recall@5', 'Recall@20', 'any_gold@20')) GROUP BY metric""", "metrics"))
def pooled_pairs(spark, d):
    """Two pairs of runs, pooled."""
    found = frames.case_metrics(spark, d).where(F.col("metric").isin(*frames.PAIR_METRICS))
    pair = lambda a, b: pairing.paired(frames.arm(found, a), frames.arm(found, b))
    return pairing.delta_summary(pair("bm25", "rrf70").unionByName(pair("rrf30", "lexical")))


LOOKS_SQL = sql("""SELECT look, metric, count(*) AS n, round(avg(delta), 6) AS mean_delta, avg(delta) > 0 AS positive FROM pairs, range(1, 4) l(look) WHERE case_id % 3 < look GROUP BY look, metric""", "pairs")


@query("sequential_looks", LOOKS_SQL.replace("SELECT look, metric, count(*) AS n, round", "SELECT x.*, ci_low, ci_high, ci_low_adjusted, ci_high_adjusted FROM (SELECT look, metric, count(*) AS n, round", 1).replace("GROUP BY look, metric", """GROUP BY look, metric) x JOIN
(SELECT look, metric, round(quantile_cont(value, 0.025), 6) AS ci_low, round(quantile_cont(value, 0.975), 6) AS ci_high, round(quantile_cont(value, 0.05 / 3 / 2), 6) AS ci_low_adjusted, round(quantile_cont(value, 1 - 0.05 / 3 / 2), 6) AS ci_high_adjusted FROM (
  SELECT look, metric, rep, sum(times * s) / sum(times * n) AS value FROM lk JOIN ld USING (g, pick) GROUP BY ALL) GROUP BY ALL) y USING (look, metric)""").replace("\nSELECT x.*", """,
lk AS MATERIALIZED (SELECT look, metric, repo, sum(delta) AS s, count(*) AS n, row_number() OVER (PARTITION BY look, metric ORDER BY repo) - 1 AS pick, count(*) OVER (PARTITION BY look, metric) AS g FROM pairs, range(1, 4) l(look) WHERE case_id % 3 < look GROUP BY look, metric, repo),
ld AS MATERIALIZED (SELECT g, rep, pick, count(*) AS times FROM (SELECT g, rep, ('0x' || substr(md5('1042|' || rep || '|' || slot), 1, 8))::BIGINT % g AS pick FROM (SELECT g, rep, unnest(range(g)) AS slot FROM (SELECT DISTINCT g FROM lk), range(20000) r(rep))) GROUP BY ALL)
SELECT x.*""", 1))
def sequential_looks(spark, d):
    """Three draws of cases, pooled one after the other; intervals at 0.05 and at 0.05 over the number of looks."""
    looks = 3
    rows = frames.pairs(spark, d).withColumn("look", F.explode(F.sequence(F.col("case_id") % looks + 1, F.lit(looks).cast("long"))))
    keys = ("look", "metric")
    rows = saved(rows)
    reps = saved(resampling.replicates(rows, keys, resamples=20_000))
    found = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg("delta"), 6).alias("mean_delta"), (F.avg("delta") > 0).alias("positive"))
    return found.join(resampling.interval(reps, keys), list(keys)).join(resampling.interval(reps, keys, 0.05 / looks, ("ci_low_adjusted", "ci_high_adjusted")), list(keys))


#: Contrasts of the 2x2 design (which base ranker leads, whether the other is fused in), and its two diagonals.
CONTRASTS = {"fusion_on_bm25": ("bm25", "rrf30"), "fusion_on_lexical": ("lexical", "rrf70"), "base_without_fusion": ("bm25", "lexical"), "base_with_fusion": ("rrf30", "rrf70"), "both": ("bm25", "rrf70"), "crossed": ("lexical", "rrf30")}


@query("factorial_contrasts", sql(f"SELECT contrast, metric, {SUMMARY} FROM (SELECT contrast, b.metric, b.value AS baseline, c.value AS candidate, c.value - b.value AS delta FROM (VALUES " + ", ".join(f"('{n}', '{a}', '{b}')" for n, (a, b) in CONTRASTS.items()) + ") t(contrast, x, y) JOIN metrics b ON b.arm = x JOIN metrics c ON c.arm = y AND c.case_id = b.case_id AND c.metric = b.metric WHERE b.metric IN ('MRR', 'Recall@20')) GROUP BY contrast, metric", "metrics"))
def factorial_contrasts(spark, d):
    """All contrasts in one plan: the contrast table is joined, not looped over."""
    found = frames.case_metrics(spark, d).where(F.col("metric").isin("MRR", "Recall@20"))
    contrasts = spark.createDataFrame([(n, a, b) for n, (a, b) in CONTRASTS.items()], "contrast string, x string, y string")
    base = found.join(contrasts, F.col("arm") == F.col("x")).select("contrast", "y", "case_id", "metric", F.col("value").alias("baseline"))
    other = found.select(F.col("arm").alias("y"), "case_id", "metric", F.col("value").alias("candidate"))
    return pairing.delta_summary(base.join(other, ["y", "case_id", "metric"]).withColumn("delta", F.col("candidate") - F.col("baseline")), ("contrast", "metric"))


@query("branch_ablation", sql(f"SELECT config, metric, {SUMMARY} FROM (SELECT c.arm AS config, b.metric, b.value AS baseline, c.value AS candidate, c.value - b.value AS delta FROM metrics b JOIN metrics c USING (case_id, metric) WHERE b.arm = 'rrf70' AND c.arm <> 'rrf70' AND metric IN ('MRR', 'Recall@20')) GROUP BY config, metric", "metrics"))
def branch_ablation(spark, d):
    """Every other arm against the fused one."""
    found = frames.case_metrics(spark, d).where(F.col("metric").isin("MRR", "Recall@20"))
    base = frames.arm(found, "rrf70").select("case_id", "metric", F.col("value").alias("baseline"))
    other = found.where("arm != 'rrf70'").select(F.col("arm").alias("config"), "case_id", "metric", F.col("value").alias("candidate"))
    return pairing.delta_summary(base.join(other, ["case_id", "metric"]).withColumn("delta", F.col("candidate") - F.col("baseline")), ("config", "metric"))


@query("repeat_deltas", sql("SELECT case_id, round(avg(c) - avg(b), 6) AS delta, count(*) FILTER (c > b) AS wins, count(*) FILTER (c < b) AS losses FROM (SELECT case_id, x.v AS b, y.v AS c FROM (SELECT case_id, arm AS r, value AS v FROM metrics WHERE arm IN ('bm25', 'rrf30') AND metric = 'MRR') x JOIN (SELECT case_id, CASE arm WHEN 'lexical' THEN 'bm25' ELSE 'rrf30' END AS r, value AS v FROM metrics WHERE arm IN ('lexical', 'rrf70') AND metric = 'MRR') y USING (case_id, r)) GROUP BY case_id", "metrics"))
def repeat_deltas(spark, d):
    """Two repeats of each arm: the delta of a case's repeat means, and paired wins over repeats."""
    found = frames.case_metrics(spark, d).where("metric = 'MRR'")
    repeat = F.when(F.col("arm").isin("bm25", "lexical"), 1).otherwise(2)
    base = found.where("arm in ('bm25', 'rrf30')").select("case_id", repeat.alias("repeat"), F.col("value").alias("b"))
    other = found.where("arm in ('lexical', 'rrf70')").select("case_id", repeat.alias("repeat"), F.col("value").alias("c"))
    return base.join(other, ["case_id", "repeat"]).groupBy("case_id").agg(F.round(F.avg("c") - F.avg("b"), 6).alias("delta"), F.count_if(F.col("c") > F.col("b")).alias("wins"), F.count_if(F.col("c") < F.col("b")).alias("losses"))


REPEATS_SQL = "SELECT case_id, avg(c - b) AS delta FROM (SELECT case_id, x.v AS b, y.v AS c FROM (SELECT case_id, arm AS r, value AS v FROM metrics WHERE arm IN ('bm25', 'rrf30') AND metric = 'MRR') x JOIN (SELECT case_id, CASE arm WHEN 'lexical' THEN 'bm25' ELSE 'rrf30' END AS r, value AS v FROM metrics WHERE arm IN ('lexical', 'rrf70') AND metric = 'MRR') y USING (case_id, r)) GROUP BY case_id"


@query("repeat_delta_interval", sql("""SELECT n, round(mean, 6) AS mean_delta, round(v[24 + 1], 6) AS ci_low, round(v[974 + 1], 6) AS ci_high FROM (SELECT count(*) AS n, avg(delta) AS mean FROM cd), (SELECT list(value ORDER BY value) AS v FROM cr)""", "metrics").replace("\nSELECT n, round", f""",
cd AS MATERIALIZED ({REPEATS_SQL}),
ck AS MATERIALIZED (SELECT case_id, delta AS s, row_number() OVER (ORDER BY case_id) - 1 AS pick, count(*) OVER () AS g FROM cd),
cr AS MATERIALIZED (SELECT rep, sum(s) / any_value(g) AS value FROM (SELECT rep, slot, g, ('0x' || substr(md5('1042|' || rep || '|' || slot), 1, 8))::BIGINT % g AS pick FROM (SELECT g, rep, unnest(range(g)) AS slot FROM (SELECT DISTINCT g FROM ck), range(1000) r(rep))) d JOIN ck USING (g, pick) GROUP BY rep)
SELECT n, round""", 1))
def repeat_delta_interval(spark, d):
    """Two repeats of each arm, paired: the mean over cases of the deltas of their repeat means, with a bootstrap of cases."""
    found = frames.case_metrics(spark, d).where("metric = 'MRR'")
    pairing.check_paired(found.select("arm", "case_id"))  # repeats that lack a case are refused
    repeat = F.when(F.col("arm").isin("bm25", "lexical"), 1).otherwise(2)
    side = F.when(F.col("arm").isin("bm25", "rrf30"), -1).otherwise(1)
    deltas = found.groupBy("metric", "case_id", repeat.alias("repeat")).agg(F.sum(side * F.col("value")).alias("delta")).groupBy("metric", "case_id").agg(F.avg("delta").alias("delta"))
    deltas = saved(deltas)
    ends = resampling.endpoint_rules(resampling.replicates(deltas, cluster="case_id")).where("rule = 'truncated'")
    return deltas.groupBy("metric").agg(F.count("*").alias("n"), F.round(F.avg("delta"), 6).alias("mean_delta")).join(ends, "metric").select("n", "mean_delta", "ci_low", "ci_high")


OBSERVATIONS = "SELECT doc_id // 6 AS case_id, (doc_id % 3)::INT AS repeat, CASE WHEN doc_id % 6 < 3 THEN 'full' ELSE 'compact' END AS transform, n_chars::DOUBLE AS value FROM documents"


def _observations(spark, d):
    """Six documents a case, over the whole table: three repeats of each transform."""
    slot = F.pmod(F.col("doc_id"), F.lit(6))
    return table(spark, d, "documents").select(F.floor(F.col("doc_id") / 6).alias("case_id"), (slot % 3).cast("int").alias("repeat"), F.when(slot < 3, "full").otherwise("compact").alias("transform"), F.col("n_chars").cast("double").alias("value"))


@query("transform_deltas", f"SELECT case_id, repeat, x.value AS full, y.value AS compact, round(y.value - x.value, 6) AS delta FROM ({OBSERVATIONS}) x JOIN ({OBSERVATIONS}) y USING (case_id, repeat) WHERE x.transform = 'full' AND y.transform = 'compact'".replace("AS full", 'AS "full"'))
def transform_deltas(spark, d):
    return pairing.transform_deltas(_observations(spark, d))


@query("fail_closed", f"SELECT transform, count(*) AS scheduled, count(*) FILTER (value IS NULL) AS errors, false AS valid, NULL::DOUBLE AS mean FROM (SELECT c AS case_id, r::INT AS repeat, t AS transform FROM (SELECT DISTINCT doc_id // 6 AS c FROM documents UNION ALL SELECT max(doc_id) // 6 + 1 FROM documents), range(3) b(r), (VALUES ('full'), ('compact')) v(t)) LEFT JOIN ({OBSERVATIONS}) USING (case_id, repeat, transform) GROUP BY transform")
def fail_closed(spark, d):
    """A schedule of every case of the table and of one more, which is missing: every mean is null."""
    rows = _observations(spark, d)
    cases = rows.select("case_id").distinct().unionByName(rows.agg((F.max("case_id") + 1).alias("case_id")))
    schedule = cases.withColumn("repeat", F.explode(F.array(*map(F.lit, range(3))))).withColumn("transform", F.explode(F.array(F.lit("full"), F.lit("compact"))))
    return pairing.fail_closed(schedule, rows.withColumn("status", F.lit("ok")))


@query("fail_closed_whole", f"SELECT transform, count(*) AS scheduled, 0::BIGINT AS errors, true AS valid, round(avg(value), 6) AS mean FROM ({OBSERVATIONS}) GROUP BY transform")
def fail_closed_whole(spark, d):
    """A schedule of what was observed, so that nothing is missing: the means are there."""
    rows = _observations(spark, d)
    return pairing.fail_closed(rows.select("case_id", "repeat", "transform"), rows.withColumn("status", F.lit("ok")))


def _runs(spark, d) -> DataFrame:
    """Arms as runs of the same cases: run and items."""
    return saved(agreement.as_lists(frames.ranked(spark, d), ["arm", "case_id"]).withColumnRenamed("arm", "run"))


PAIR_RUNS = """SELECT a.arm AS run_a, b.arm AS run_b, a.case_id, a.items AS items_a, b.items AS items_b, (a.items = b.items)::INT::DOUBLE AS exact_order, (list_sort(a.items) = list_sort(b.items))::INT::DOUBLE AS exact_set,
CASE WHEN len(list_distinct(list_concat(a.items, b.items))) = 0 THEN 1.0 ELSE len(list_intersect(a.items, b.items)) / len(list_distinct(list_concat(a.items, b.items)))::DOUBLE END AS jaccard FROM lists a JOIN lists b ON a.case_id = b.case_id AND a.arm < b.arm"""


@query("topk_agreement", sql("SELECT count(*) AS cases, round(avg((a.items[1:20] = b.items[1:20])::INT::DOUBLE), 6) AS exact_order, round(avg(CASE WHEN len(a.items) + len(b.items) = 0 THEN 1.0 ELSE len(list_intersect(a.items, b.items)) / len(list_distinct(list_concat(a.items, b.items)))::DOUBLE END), 6) AS jaccard FROM lists a JOIN lists b USING (case_id) WHERE a.arm = 'rrf30' AND b.arm = 'rrf70'", "lists"))
def topk_agreement(spark, d):
    runs = _runs(spark, d).where("run in ('rrf30', 'rrf70')")
    found = agreement.list_agreement(agreement.pairs_of_runs(runs))
    return found.agg(F.count("*").alias("cases"), F.round(F.avg("exact_order"), 6).alias("exact_order"), F.round(F.avg("jaccard"), 6).alias("jaccard"))


TAU = "CASE WHEN len(p) >= 2 THEN list_sum(list_transform(range(1, len(p)), lambda i: list_sum(list_transform(p[i + 1:], lambda y: CASE WHEN y > p[i] THEN 1 ELSE -1 END)))) / (len(p) * (len(p) - 1) / 2.0::DOUBLE) END"


@query("kendall_tau", sql(f"SELECT case_id, run_a, run_b, round({TAU}, 6) AS tau FROM (SELECT case_id, run_a, run_b, list_transform(list_filter(items_a, lambda x: list_contains(items_b, x)), lambda x: list_position(items_b, x)) AS p FROM ({PAIR_RUNS}))", "lists"))
def kendall_tau(spark, d):
    return agreement.kendall_tau(agreement.pairs_of_runs(_runs(spark, d))).select("case_id", "run_a", "run_b", F.round("tau", 6).alias("tau"))


@query("pairwise_determinism", sql(f"SELECT run_a, run_b, count(*) AS cases, round(avg(exact_order), 6) AS exact_order, round(avg(exact_set), 6) AS exact_set, round(avg(jaccard), 6) AS jaccard FROM ({PAIR_RUNS}) GROUP BY run_a, run_b", "lists"))
def pairwise_determinism(spark, d):
    found = agreement.list_agreement(agreement.pairs_of_runs(_runs(spark, d)))
    return found.groupBy("run_a", "run_b").agg(F.count("*").alias("cases"), *(F.round(F.avg(c), 6).alias(c) for c in ("exact_order", "exact_set", "jaccard")))


@query("like_for_like", sql(f"SELECT count(*) AS comparisons, round(avg(exact_set), 6) AS set_exact, round(avg(exact_order), 6) AS order_exact, round(avg(jaccard), 6) AS jaccard, round(avg((md5(array_to_string(items_a, ',')) = md5(array_to_string(items_b, ',')))::INT::DOUBLE), 6) AS byte_exact, round(avg((len(items_a) + len(items_b)) / 2.0::DOUBLE), 6) AS mean_sources FROM ({PAIR_RUNS})", "lists"))
def like_for_like(spark, d):
    found = agreement.list_agreement(agreement.pairs_of_runs(_runs(spark, d)))
    digest = lambda c: F.md5(F.array_join(F.transform(c, lambda x: x.cast("string")), ","))
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return found.agg(F.count("*").alias("comparisons"), mean("exact_set", "set_exact"), mean("exact_order", "order_exact"), mean("jaccard", "jaccard"), mean((digest("items_a") == digest("items_b")).cast("double"), "byte_exact"), mean((F.size("items_a") + F.size("items_b")) / 2, "mean_sources"))


@query("first_vs_rest", sql(f"SELECT count(*) AS cases, round(avg(e), 6) AS exact_order, round(avg(j), 6) AS jaccard, round(avg(coalesce(t, 1.0)), 6) AS tau FROM (SELECT case_id, avg(exact_order) AS e, avg(jaccard) AS j, avg(tau) AS t FROM (SELECT *, {TAU} AS tau FROM (SELECT *, list_transform(list_filter(items_a, lambda x: list_contains(items_b, x)), lambda x: list_position(items_b, x)) AS p FROM ({PAIR_RUNS}) WHERE run_a = 'bm25')) GROUP BY case_id)", "lists"))
def first_vs_rest(spark, d):
    found = agreement.kendall_tau(agreement.list_agreement(agreement.first_against_rest(_runs(spark, d), "bm25")))
    return agreement.case_then_mean(found, ["exact_order", "jaccard", "tau"], {"tau": 1.0})



@query("embedding_jitter", sql("""SELECT a.label, count(*) AS pairs, round(avg((a.embedding = b.embedding)::INT::DOUBLE), 6) AS equal_rate, round(max(1 - list_inner_product(x.v, y.v)), 6) AS max_distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 AND a.vec_id % 2 = 0 JOIN unit x ON x.vec_id = a.vec_id JOIN unit y ON y.vec_id = b.vec_id GROUP BY a.label""", "unit"))
def embedding_jitter(spark, d):
    """Neighbouring vectors as two runs of one input: how many are equal, and the largest cosine distance."""
    own = table(spark, d, "embeddings")
    a = own.where("vec_id % 2 = 0").select((F.col("vec_id") + 1).alias("id"), "label", F.col("embedding").alias("a"))
    found = a.join(own.select(F.col("vec_id").alias("id"), F.col("embedding").alias("b")), "id")
    return found.groupBy("label").agg(F.count("*").alias("pairs"), F.round(F.avg((F.col("a") == F.col("b")).cast("double")), 6).alias("equal_rate"), F.round(F.max(1 - stats.cosine(F.col("a"), F.col("b"))), 6).alias("max_distance"))


PASSES = "SELECT conv_id AS case_id, turn AS repeat, length(text) % 3 > 0 AS passed FROM conversations"


def _passes(spark, d):
    return table(spark, d, "conversations").select(F.col("conv_id").alias("case_id"), F.col("turn").alias("repeat"), (F.length("text") % 3 > 0).alias("passed"))


@query("majority_vote", f"SELECT case_id, count(*) FILTER (passed) AS passes, count(*) AS repeats, count(*) FILTER (passed) * 3 >= count(*) * 2 AS majority FROM ({PASSES}) GROUP BY case_id")
def majority_vote(spark, d):
    return agreement.majority(_passes(spark, d))


@query("run_rates", f"SELECT round(avg(r), 6) AS rate_mean, round(min(r), 6) AS rate_min, round(max(r), 6) AS rate_max FROM (SELECT repeat, avg(passed::INT::DOUBLE) AS r FROM ({PASSES}) GROUP BY repeat)")
def run_rates(spark, d):
    return agreement.run_rates(_passes(spark, d), "passed", "repeat")


@query("pass_at_1", "SELECT lang AS library, count(*) AS n, round(avg(quality::DOUBLE), 6) AS pass_at_1, round(avg(avg(quality::DOUBLE)) OVER (), 6) AS library_macro FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def pass_at_1(spark, d):
    """Pass rates of libraries, and their mean."""
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", F.col("lang").alias("library")), "doc_id")
    by = rows.groupBy("library").agg(F.count("*").alias("n"), F.avg(F.col("quality").cast("double")).alias("rate"))
    return by.crossJoin(by.agg(F.round(F.avg("rate"), 6).alias("library_macro"))).select("library", "n", F.round("rate", 6).alias("pass_at_1"), "library_macro")


@query("repeat_means", f"SELECT case_id, round(avg(passed::INT::DOUBLE), 6) AS value, count(*) AS repeats FROM ({PASSES}) GROUP BY case_id")
def repeat_means(spark, d):
    return agreement.repeat_means(_passes(spark, d).withColumn("value", F.col("passed").cast("double")), ("case_id",)).select("case_id", F.round("value", 6).alias("value"), "repeats")


@query("generation_agreement", f"SELECT case_id, count(*) AS pairs, round(avg((a.passed = b.passed)::INT::DOUBLE), 6) AS pass_agreement FROM ({PASSES}) a JOIN ({PASSES}) b USING (case_id) WHERE a.repeat < b.repeat GROUP BY case_id")
def generation_agreement(spark, d):
    found = agreement.pairs_of_runs(_passes(spark, d), run="repeat")
    return found.groupBy("case_id").agg(F.count("*").alias("pairs"), F.round(F.avg((F.col("passed_a") == F.col("passed_b")).cast("double")), 6).alias("pass_agreement"))


@query("query_pinning", "SELECT coalesce(d.conv_id, e.conv_id) AS case_id, coalesce(d.n, 0) AS n_values, coalesce(d.n = 1 AND d.m = e.m, false) AS pinned FROM (SELECT conv_id, count(DISTINCT role) AS n, sha256(min(role)) AS m FROM conversations WHERE conv_id % 5 <> 0 GROUP BY conv_id) d FULL JOIN (SELECT DISTINCT conv_id, sha256('user') AS m FROM conversations WHERE conv_id % 7 <> 0) e USING (conv_id)")
def query_pinning(spark, d):
    rows = table(spark, d, "conversations")
    runs = rows.where("conv_id % 5 != 0").select(F.col("conv_id").alias("case_id"), F.col("role").alias("query"))
    expected = rows.where("conv_id % 7 != 0").select(F.col("conv_id").alias("case_id")).distinct().withColumn("digest", F.sha2(F.lit("user"), 256))
    return agreement.pinned(runs, expected)


# Reports: what tables and figures are made of.


@query("report_ladder", sql("SELECT arm, \"MRR\" AS mrr, \"Recall@5\" AS recall_5, \"Recall@20\" AS recall_20, n FROM (PIVOT (SELECT arm, metric, round(avg(value), 6) AS v, count(*) AS n FROM metrics WHERE metric IN ('MRR', 'Recall@5', 'Recall@20') GROUP BY ALL) ON metric IN ('MRR', 'Recall@5', 'Recall@20') USING any_value(v) GROUP BY arm, n)", "metrics"))
def report_ladder(spark, d):
    wide = frames.case_metrics(spark, d).groupBy("arm").pivot("metric", ["MRR", "Recall@5", "Recall@20"]).agg(F.round(F.avg("value"), 6).alias("v"), F.count("value").alias("n"))
    return wide.select("arm", F.col("`MRR_v`").alias("mrr"), F.col("`Recall@5_v`").alias("recall_5"), F.col("`Recall@20_v`").alias("recall_20"), F.col("`MRR_n`").alias("n"))


@query("report_per_repo", sql("SELECT repo, count(DISTINCT case_id) AS n, round(avg(value) FILTER (arm = 'bm25'), 6) AS bm25, round(avg(value) FILTER (arm = 'lexical'), 6) AS lexical, row_number() OVER (ORDER BY count(DISTINCT case_id) DESC, repo) AS place FROM metrics WHERE metric = 'MRR' GROUP BY repo", "metrics"))
def report_per_repo(spark, d):
    from pyspark.sql import Window

    found = frames.case_metrics(spark, d).where("metric = 'MRR'")
    mean = lambda a: F.round(F.avg(F.when(F.col("arm") == a, F.col("value"))), 6).alias(a)
    by = found.groupBy("repo").agg(F.countDistinct("case_id").alias("n"), mean("bm25"), mean("lexical"))
    return by.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "repo")))  # a row a repository


@query("report_latency", sql("SELECT run, n, mean, quality, round(mean / max(mean) OVER (), 6) AS relative FROM (SELECT run, count(*) AS n, round(avg(latency), 6) AS mean, round(avg((status = 'ok')::INT::DOUBLE), 6) AS quality FROM registry GROUP BY run)", "registry"))
def report_latency(spark, d):
    from pyspark.sql import Window

    by = frames.registry(spark, d).groupBy("run").agg(F.count("*").alias("n"), F.round(F.avg("latency"), 6).alias("mean"), F.round(F.avg((F.col("status") == "ok").cast("double")), 6).alias("quality"))
    return by.withColumn("relative", F.round(F.col("mean") / F.max("mean").over(Window.partitionBy()), 6))  # a row a run


@query("report_paired", sql(f"SELECT contrast, metric, {SUMMARY} FROM (SELECT c.arm || ' - bm25' AS contrast, b.metric, b.value AS baseline, c.value AS candidate, c.value - b.value AS delta FROM metrics b JOIN metrics c USING (case_id, metric) WHERE b.arm = 'bm25' AND c.arm <> 'bm25') GROUP BY ALL", "metrics"))
def report_paired(spark, d):
    found = frames.case_metrics(spark, d)
    base = frames.arm(found, "bm25").select("case_id", "metric", F.col("value").alias("baseline"))
    other = found.where("arm != 'bm25'").select(F.concat("arm", F.lit(" - bm25")).alias("contrast"), "case_id", "metric", F.col("value").alias("candidate"))
    return pairing.delta_summary(base.join(other, ["case_id", "metric"]).withColumn("delta", F.col("candidate") - F.col("baseline")), ("contrast", "metric"))
