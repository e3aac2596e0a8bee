"""Queries: rankings, fusion, metrics, estimands, context."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rankloom.functions import text
from rankloom.operators import branches, context, fusion, metrics, ranking, scoring
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


def _base(spark, d):
    return frames.documents(spark, d).select("doc_id", "text"), frames.queries(spark, d)


@query("bm25_topk", sql("SELECT case_id, doc_id, score, rank FROM bm25", "bm25"))
def bm25_topk(spark, d):
    return ranking.bm25(*_base(spark, d)).select("case_id", "doc_id", "score", "rank")


@query("lexical_topk", sql("SELECT case_id, doc_id, score, rank FROM lexical", "lexical"))
def lexical_topk(spark, d):
    return ranking.term_overlap(*_base(spark, d)).select("case_id", "doc_id", "score", "rank")


IDF_SQL = r"""WITH n AS (SELECT DISTINCT item_id AS case_id, unnest(regexp_extract_all(text, '[\p{L}_][\p{L}\p{N}_.]*[\p{L}\p{N}_]')) AS term FROM benchmark),
t AS (SELECT case_id, term, CASE WHEN contains(term, '.') THEN 1.2::DOUBLE WHEN contains(term, '_') OR regexp_matches(term, '^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$') OR regexp_matches(term, '^.+\p{Lu}') THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS weight,
  row_number() OVER (PARTITION BY case_id ORDER BY length(term) DESC, term) AS r FROM n WHERE length(term) >= 4 QUALIFY r <= 24),
h AS (SELECT doc_id, term FROM (SELECT DISTINCT term FROM t) JOIN documents ON contains(lower(text), lower(term))),
df AS (SELECT term, count(*) AS df FROM h GROUP BY term),
v AS (SELECT case_id, doc_id, term, round(weight * (1 + ln(((SELECT count(DISTINCT doc_id) FROM documents) + 1.0::DOUBLE) / (df + 1.0::DOUBLE))), 6) AS value FROM h JOIN df USING (term) JOIN t USING (term)),
s AS (SELECT case_id, doc_id, round(sum(value), 6) AS score, count(*) AS matched_terms, list(term ORDER BY value DESC, term) AS terms FROM v GROUP BY case_id, doc_id)
SELECT case_id, doc_id, score, matched_terms, array_to_string(terms, ' ') AS terms, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, matched_terms DESC, doc_id) AS rank FROM s QUALIFY rank <= 20"""


@query("idf_lexical_search", IDF_SQL)
def idf_lexical_search(spark, d):
    docs, asked = _base(spark, d)
    return ranking.idf_containment(docs, ranking.identifier_terms(asked)).withColumn("terms", F.array_join("terms", " "))


@query("dense_topk", sql("SELECT case_id, doc_id, score, rank FROM dense", "dense"))
def dense_topk(spark, d):
    own, asked = frames.vectors(spark, d)
    return ranking.dense_scan(own, asked)


@query("dense_maxpool", sql("SELECT case_id, label, max(score) AS score, arg_max(doc_id, (score, -doc_id)) AS best_doc FROM dense JOIN embeddings e ON e.vec_id = dense.doc_id GROUP BY case_id, label", "dense"))
def dense_maxpool(spark, d):
    own, asked = frames.vectors(spark, d)
    return ranking.max_pool(ranking.dense_scan(own, asked).join(own.select("doc_id", "label"), "doc_id"), "label")


@query("dense_keep_first", sql("SELECT case_id, label, row_number() OVER (PARTITION BY case_id ORDER BY min(rank)) AS rank FROM dense JOIN embeddings e ON e.vec_id = dense.doc_id GROUP BY case_id, label", "dense"))
def dense_keep_first(spark, d):
    own, asked = frames.vectors(spark, d)
    return ranking.keep_first(ranking.dense_scan(own, asked).join(own.select("doc_id", "label"), "doc_id"), "label")


@query("best_chunk", sql("SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id % 2 DESC, embedding[1] DESC, vec_id) AS r FROM embeddings) WHERE r = 1"))
def best_chunk(spark, d):
    """Of each group the chunk of the preferred kind with the best score."""
    rows = table(spark, d, "embeddings")
    order = (F.desc(F.col("vec_id") % 2), F.desc(F.get("embedding", F.lit(0))), F.asc("vec_id"))
    return ranking.top_k(rows, 1, keys=("label",), order=order).select("label", "vec_id")


@query("rrf_weighted", sql("SELECT case_id, doc_id, score, rank FROM ranked WHERE arm = 'rrf70'", "ranked"))
def rrf_weighted(spark, d):
    found = frames.base_branches(spark, d)
    side = lambda name: found.where(F.col("branch") == name)
    return fusion.two_way(side("bm25"), side("lexical")).select("case_id", "doc_id", "score", "rank")


#: The weights of the six candidate branches of the fusion profile.
PROFILE = {"vector": 0.50, "bm25": 0.25, "symbol": 0.20, "path": 0.15, "path_affinity": 0.15, "trigram": 0.05}
BRANCHES_SQL = r"""asked AS MATERIALIZED (SELECT item_id AS case_id, text AS query FROM benchmark),
names AS MATERIALIZED (SELECT doc_id, array_to_string(ws[1:3], '/') AS path, list_distinct(ws[1:3]) AS parts FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ws FROM documents) WHERE len(ws) > 0),
qv AS MATERIALIZED (SELECT case_id, vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y)))) AS v FROM asked JOIN embeddings ON vec_id = case_id * 20),
dv AS MATERIALIZED (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y)))) AS v FROM embeddings),
asked_symbols AS MATERIALIZED (SELECT DISTINCT case_id, unnest(regexp_extract_all(query, '(?:^|[^\p{L}\p{N}_])(\p{Lu}\p{Ll}{3,})(?:[^\p{L}\p{N}_]|$)', 1)) AS symbol FROM (SELECT case_id, regexp_replace(query, '([^\p{L}\p{N}_])', '\1\1', 'g') AS query FROM asked)),
held_symbols AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '(?:^|[^\p{L}\p{N}_])(\p{Lu}\p{Ll}{3,})(?:[^\p{L}\p{N}_]|$)', 1)) AS symbol FROM (SELECT doc_id, regexp_replace(text, '([^\p{L}\p{N}_])', '\1\1', 'g') AS text FROM documents)),
worth AS (SELECT symbol, round(ln(1 + (SELECT count(*) FROM documents)::DOUBLE / count(*)), 6) AS worth FROM held_symbols GROUP BY symbol),
shared_parts AS MATERIALIZED (SELECT case_id, doc_id, n, count(*) AS shared FROM (SELECT doc_id, len(parts) AS n, unnest(parts) AS term FROM names) JOIN terms USING (term) GROUP BY ALL),
grams AS MATERIALIZED (SELECT 'q' AS side, case_id AS id, list_distinct(flatten(list_transform(regexp_extract_all(lower(query), '[\p{L}\p{N}_]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i::INT, 3))))) AS g FROM asked
  UNION ALL SELECT 'd', doc_id, list_distinct(flatten(list_transform(string_split(path, '/'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i::INT, 3))))) FROM names),
posted AS MATERIALIZED (SELECT side, id, len(g) AS n, unnest(g) AS gram FROM grams),
all_scores AS (SELECT 'vector' AS branch, case_id, d.vec_id AS doc_id, round(list_inner_product(qv.v, d.v), 6) AS score FROM qv JOIN dv d ON d.vec_id <> qv.vec_id
  UNION ALL SELECT 'bm25', case_id, doc_id, score FROM bm25_all
  UNION ALL SELECT 'symbol', case_id, doc_id, round(sum(worth), 6) FROM asked_symbols JOIN held_symbols USING (symbol) JOIN worth USING (symbol) GROUP BY ALL
  UNION ALL SELECT 'path', case_id, doc_id, 1.0 FROM shared_parts WHERE shared = n
  UNION ALL SELECT 'path_affinity', case_id, doc_id, round(shared / n::DOUBLE, 6) FROM shared_parts
  UNION ALL SELECT 'trigram', case_id, doc_id, round(c / (nq + n - c)::DOUBLE, 6) FROM (SELECT q.id AS case_id, d.id AS doc_id, q.n AS nq, d.n AS n, count(*) AS c FROM posted q JOIN posted d ON q.side = 'q' AND d.side = 'd' AND q.gram = d.gram GROUP BY ALL)),
six AS MATERIALIZED (SELECT branch, case_id, doc_id, row_number() OVER (PARTITION BY branch, case_id ORDER BY score DESC, doc_id) AS rank FROM all_scores QUALIFY rank <= 50),"""
ABLATION_SQL = sql(f"""SELECT config, case_id, doc_id, score, row_number() OVER (PARTITION BY config, case_id ORDER BY score DESC, doc_id) AS rank FROM x QUALIFY rank <= 50""", "bm25_all").replace("\nSELECT config", f""",
{BRANCHES_SQL}
w AS (SELECT * FROM (VALUES {", ".join(f"('{b}', {w}::DOUBLE)" for b, w in PROFILE.items())}) t(branch, weight)),
c AS (SELECT 'baseline' AS config, branch, weight FROM w UNION ALL SELECT 'without_' || o.branch, w.branch, w.weight FROM w o, w WHERE w.branch <> o.branch UNION ALL SELECT * FROM (VALUES {", ".join(f"('{c}', '{b}', {w}::DOUBLE)" for c, own in fusion.OVERRIDES.items() for b, w in own.items())}) v(config, branch, weight)),
x AS (SELECT config, case_id, doc_id, round(sum(weight / (60 + rank)), 10) AS score FROM six JOIN c USING (branch) GROUP BY ALL)
SELECT config""", 1)


def six_branches(spark, d):
    """branch, case_id, doc_id and rank of the first 50 of the six branches for the benchmark items, saved."""
    docs, asked = _base(spark, d)
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    own = asked.select((F.col("case_id") * 20).alias("doc_id")).join(vectors, "doc_id").select(F.col("doc_id").alias("case_id"), F.col("vector").alias("query_vector"))
    vector = ranking.dense_scan(vectors, own, 50).withColumn("case_id", F.floor(F.col("case_id") / 20))
    paths = saved(branches.names(docs))
    found = {"vector": vector, "bm25": ranking.bm25(docs, asked, 50), "symbol": branches.by_symbol(docs, asked), "path": branches.by_path(paths, asked, True),
             "path_affinity": branches.by_path(paths, asked, False), "trigram": branches.by_trigram(branches.trigram_index(paths), asked)}
    return saved(fusion.union_branches(found))


@query("rrf_ablation", ABLATION_SQL)
def rrf_ablation(spark, d):
    """Six-branch fusion, without each branch in turn, and with the two leading branches only: 50 fused candidates of 50 each.

    An item's vector is every twentieth one; a document's path is its first three words; symbols are capitalised words.
    """
    weights = spark.createDataFrame(fusion.ablations(PROFILE) + fusion.overrides(PROFILE), "config string, branch string, weight double")
    return fusion.rrf(six_branches(spark, d), weights, limit=50).select("config", "case_id", "doc_id", "score", "rank")


RERANK_SQL = sql("""SELECT case_id, doc_id, rank AS before, blend, row_number() OVER (PARTITION BY case_id ORDER BY rank <= 30 DESC, CASE WHEN rank <= 30 THEN -blend ELSE rank END, doc_id) AS rank FROM (
SELECT *, round(CASE WHEN rank <= 30 THEN 0.4::DOUBLE / (1 + exp(-((doc_id % 7) - 3)::DOUBLE)) + 0.6::DOUBLE * (score / top) ELSE score / top END, 6) AS blend
FROM (SELECT *, max(score) FILTER (rank = 1) OVER (PARTITION BY case_id) AS top FROM bm25_50))""", "bm25_50")


@query("rerank_blend", RERANK_SQL)
def rerank_blend(spark, d):
    """BM25 with a stand-in logit, a column like any scorer's."""
    found = ranking.bm25(*_base(spark, d), k=50).withColumn("logit", ((F.col("doc_id") % 7) - 3).cast("double"))
    return ranking.rerank_blend(found)


@query("listwise_permutation", sql("SELECT case_id, doc_id, row_number() OVER (PARTITION BY case_id ORDER BY rank > 20, CASE WHEN case_id % 2 = 0 AND rank <= 20 THEN 21 - rank ELSE rank END, rank) AS rank FROM bm25_50", "bm25_50"))
def listwise_permutation(spark, d):
    """A complete order for even cases, an incomplete one for odd ones, which keep theirs."""
    found = saved(ranking.bm25(*_base(spark, d), k=50).select("case_id", "doc_id", "rank"))
    order = found.where("rank <= 20 and (case_id % 2 = 0 or rank = 20)").select("case_id", "doc_id", (21 - F.col("rank")).alias("place"))
    return ranking.permuted(found, order)


GOLD_RANKS_SQL = sql("SELECT c.case_id, a.arm, min(r.rank) AS first_gold_rank FROM (SELECT DISTINCT case_id FROM gold) c CROSS JOIN (SELECT DISTINCT arm FROM ranked) a LEFT JOIN hits r ON r.case_id = c.case_id AND r.arm = a.arm AND r.hit GROUP BY ALL", "hits")


@query("gold_ranks", GOLD_RANKS_SQL)
def gold_ranks(spark, d):
    return ranking.first_gold(saved(frames.ranked(spark, d)), frames.gold(spark, d), ("arm",))


@query("rank_histogram", f"WITH g AS ({GOLD_RANKS_SQL}) SELECT arm, bucket, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY arm)::DOUBLE, 6) AS share FROM (SELECT arm, CASE WHEN first_gold_rank = 1 THEN '1' WHEN first_gold_rank <= 5 THEN '2-5' WHEN first_gold_rank <= 20 THEN '6-20' ELSE 'miss' END AS bucket FROM g) GROUP BY arm, bucket")
def rank_histogram(spark, d):
    return metrics.rank_buckets(gold_ranks(spark, d), ["arm"])


@query("case_metrics", sql("SELECT arm, case_id, metric, value, repo, workflow FROM metrics", "metrics"))
def case_metrics(spark, d):
    return frames.case_metrics(spark, d).select("arm", "case_id", "metric", "value", "repo", "workflow")


ESTIMANDS_SQL = sql("""SELECT arm, metric, 'sample_weighted' AS estimand, round(avg(value), 6) AS value FROM metrics GROUP BY ALL
UNION ALL SELECT arm, metric, 'repository_macro', round(avg(v), 6) FROM (SELECT arm, metric, repo, avg(value) AS v FROM metrics GROUP BY ALL) GROUP BY arm, metric
UNION ALL SELECT arm, metric, 'workflow_macro', round(avg(v), 6) FROM (SELECT arm, metric, workflow, avg(value) AS v FROM metrics GROUP BY ALL) GROUP BY arm, metric""", "metrics")


@query("estimands", ESTIMANDS_SQL)
def estimands(spark, d):
    return metrics.estimands(frames.case_metrics(spark, d))


@query("by_workflow", sql("SELECT arm, workflow, metric, count(DISTINCT case_id) AS n, round(avg(value), 6) AS value FROM metrics GROUP BY ALL", "metrics"))
def by_workflow(spark, d):
    return metrics.by_group(frames.case_metrics(spark, d), ["arm", "workflow"])


@query("common_metrics", sql("SELECT metric, round(avg(value), 6) AS value, count(*) AS n FROM metrics WHERE arm = 'bm25' AND NOT (metric = 'MRR' AND case_id % 2 = 1) GROUP BY metric HAVING count(*) = (SELECT count(DISTINCT case_id) FROM metrics)", "metrics"))
def common_metrics(spark, d):
    """Means of the metrics that every case has; MRR is taken from some to show it."""
    found = frames.arm(frames.case_metrics(spark, d), "bm25").where("not (metric = 'MRR' and case_id % 2 = 1)")
    return metrics.sample_mean(found).select("metric", F.round("value", 6).alias("value"), "n")


@query("best_arm", sql("SELECT metric, arm, value, value >= max(value) OVER (PARTITION BY metric) - 1e-9 AS best FROM (SELECT arm, metric, round(avg(value), 6) AS value FROM metrics GROUP BY ALL)", "metrics"))
def best_arm(spark, d):
    found = frames.case_metrics(spark, d).groupBy("arm", "metric").agg(F.round(F.avg("value"), 6).alias("value"))
    return metrics.best_in_column(found, ["metric"]).select("metric", "arm", "value", "best")


@query("failure_zeroing", sql("SELECT arm, metric, round(avg(CASE WHEN case_id % 5 <> 0 THEN value ELSE 0 END), 6) AS value, count(*) AS n FROM metrics GROUP BY ALL", "metrics"))
def failure_zeroing(spark, d):
    found = frames.case_metrics(spark, d)
    status = found.select("case_id").distinct().withColumn("status", F.when(F.col("case_id") % 5 == 0, "error").otherwise("ok"))
    return metrics.zero_failures(found, status).groupBy("arm", "metric").agg(F.round(F.avg("value"), 6).alias("value"), F.count("*").alias("n"))


@query("latency_distribution", sql("SELECT run, count(*) AS n, round(avg(latency), 6) AS mean, round(median(latency), 6) AS median, round(quantile_cont(latency, 0.95), 6) AS p95, min(latency) AS min, max(latency) AS max FROM registry WHERE status = 'ok' GROUP BY run", "registry"))
def latency_distribution(spark, d):
    return metrics.distribution(frames.registry(spark, d).where("status = 'ok'"), "latency", ["run"])


@query("latency_upper_median", sql("SELECT status, max(latency) FILTER (p = n // 2) AS upper_median, round(avg((latency <= 40)::INT::DOUBLE), 6) AS share_to_40, round(avg((latency > 200)::INT::DOUBLE), 6) AS share_over_200, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY status ORDER BY latency) - 1 AS p, count(*) OVER (PARTITION BY status) AS n FROM registry) GROUP BY status", "registry"))
def latency_upper_median(spark, d):
    return metrics.upper_median(frames.registry(spark, d), "latency", ["status"])


SELECTIVE_SQL = sql("""SELECT mixture, positive_n + no_gold_n AS n, positive_n, no_gold_n, round((hits + abstentions) / (positive_n + no_gold_n)::DOUBLE, 6) AS selective_success, round(hits / positive_n::DOUBLE, 6) AS positive_success,
  round(abstentions / no_gold_n::DOUBLE, 6) AS abstention_rate, round(natural_rate, 6) AS natural_rate, round(counterfactual_rate, 6) AS counterfactual_rate
FROM (SELECT mixture, count(*) AS positive_n, sum(success)::BIGINT AS hits FROM p, (SELECT unnest(['natural', 'balanced']) AS mixture) WHERE mixture = 'natural' OR place <= (SELECT count(*) FROM z) GROUP BY mixture),
(SELECT count(*) AS no_gold_n, sum(abstained)::BIGINT AS abstentions, avg(abstained) FILTER (organic) AS natural_rate, avg(abstained) FILTER (NOT organic) AS counterfactual_rate FROM z)""", "metrics", "terms", "lexical").replace("\nSELECT mixture, positive_n", """,
p AS (SELECT case_id, (value > 0)::INT AS success, row_number() OVER (ORDER BY sha256('balanced|' || case_id)) AS place FROM metrics WHERE arm = 'lexical' AND metric = 'Recall@20'),
z AS (SELECT b.item_id AS case_id, (coalesce(t.score, 0) < 0.9)::INT AS abstained, b.item_id % 2 = 0 AS organic FROM benchmark b LEFT JOIN lexical t ON t.case_id = b.item_id AND t.rank = 1 WHERE b.item_id NOT IN (SELECT case_id FROM gold))
SELECT mixture, positive_n""", 1)


@query("selective_success", SELECTIVE_SQL)
def selective_success(spark, d):
    """The lexical arm abstains where its best document holds under nine tenths of the terms."""
    found = frames.arm(frames.case_metrics(spark, d), "lexical").where("metric = 'Recall@20'").select("case_id", (F.col("value") > 0).alias("success"))
    docs, asked = _base(spark, d)
    top = ranking.term_overlap(docs, asked).where("rank = 1").select("case_id", "score")
    none = asked.join(frames.gold(spark, d), "case_id", "left_anti").join(top, "case_id", "left")
    return metrics.selective(found, none.select("case_id", (F.coalesce("score", F.lit(0.0)) < 0.9).alias("abstained"), (F.col("case_id") % 2 == 0).alias("natural")), "balanced|")


@query("identifier_hit", sql("SELECT doc_id, list_bool_or(list_transform(['La ', 'THE', 'ung'], lambda x: contains(lower(text), lower(x)))) AS hit FROM documents"))
def identifier_hit(spark, d):
    return frames.documents(spark, d).select("doc_id", text.identifier_hit(F.col("text"), F.array(*map(F.lit, ("La ", "THE", "ung")))).alias("hit"))


@query("context_pack", sql("SELECT arm, case_id, doc_id, rank, cost, used FROM packs", "packs"))
def context_pack(spark, d):
    return context.packed(frames.costs(spark, d, frames.ranked(spark, d))).select("arm", "case_id", "doc_id", "rank", "cost", "used")


BCY_SQL = sql("""SELECT arm, case_id, round(whole / n_gold::DOUBLE, 6) AS bcy, round(touched / n_gold::DOUBLE, 6) AS gold_coverage, round(CASE WHEN packed_tokens > 0 THEN gold_tokens / packed_tokens::DOUBLE ELSE 0 END, 6) AS gold_token_ratio, round(gold_tokens / 8000::DOUBLE, 6) AS context_efficiency,
  (packed_tokens - gold_tokens)::BIGINT AS context_pollution_tokens, round(CASE WHEN packed_tokens > 0 THEN repeated / packed_tokens::DOUBLE ELSE 0 END, 6) AS redundancy, packed_tokens::BIGINT AS packed_tokens
FROM (SELECT arm, case_id, sum(used) AS packed_tokens, coalesce(sum(used) FILTER (hit), 0) AS gold_tokens, count(*) FILTER (hit AND used = cost) AS whole, count(*) FILTER (hit) AS touched, coalesce(sum(used) FILTER (again), 0) AS repeated
  FROM (SELECT p.*, g.doc_id IS NOT NULL AS hit, row_number() OVER (PARTITION BY p.arm, p.case_id, p.digest ORDER BY p.rank) > 1 AS again FROM packs p LEFT JOIN gold g USING (case_id, doc_id)) GROUP BY arm, case_id)
JOIN (SELECT case_id, count(*) AS n_gold FROM gold GROUP BY case_id) USING (case_id)""", "packs", "gold")


@query("bcy", BCY_SQL)
def bcy(spark, d):
    return context.context_metrics(context.packed(frames.costs(spark, d, frames.ranked(spark, d))), frames.gold(spark, d))


@query("file_f1", sql("SELECT arm, case_id, round(CASE WHEN h > 0 THEN 2 * (h / n::DOUBLE) * (h / g::DOUBLE) / (h / n::DOUBLE + h / g::DOUBLE) ELSE 0 END, 6) AS f1 FROM (SELECT arm, case_id, count(*) AS n, count(*) FILTER (hit) AS h FROM hits WHERE rank <= 5 GROUP BY ALL) JOIN (SELECT case_id, count(*) AS g FROM gold GROUP BY case_id) USING (case_id)", "hits"))
def file_f1(spark, d):
    """F1 of the first five documents; the precision's denominator is the list's length."""
    rows = frames.gold(spark, d)
    size = rows.groupBy("case_id").agg(F.count("*").alias("g"))
    found = frames.ranked(spark, d).where("rank <= 5").join(rows.withColumn("hit", F.lit(1)), ["case_id", "doc_id"], "left").groupBy("arm", "case_id").agg(F.count("*").alias("n"), F.count("hit").alias("h")).join(size, "case_id")
    p, r = F.col("h") / F.col("n"), F.col("h") / F.col("g")
    return found.select("arm", "case_id", F.round(F.when(F.col("h") > 0, 2 * p * r / (p + r)).otherwise(0.0), 6).alias("f1"))


@query("seed_pack", None)
def seed_pack(spark, d):
    """Sections of the BM25 ranking in 500 words, reduced to their headings where they don't fit."""
    rows = frames.costs(spark, d, frames.ranked(spark, d).where("arm = 'bm25'"))
    lists = rows.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("doc_id").alias("id"), F.col("cost").cast("long").alias("cost"), F.lit(5).cast("long").alias("header_cost")))).alias("sections"))
    return lists.select("case_id", F.explode(context.seeded(F.col("sections"), 500, 10)["kept"]).alias("k")).select("case_id", "k.*")


@query("segments", None)
def segments(spark, d):
    return context.segment(frames.documents(spark, d)).drop("segment")


@query("selected_segments", sql("SELECT doc_id, array_to_string(list_slice(list_filter(list_distinct_in_order, lambda x: x IN ('E001', 'E002', 'E003', 'E004')), 1, 2), ',') AS ids FROM (SELECT doc_id, ['E00' || (doc_id % 7), 'E002', 'E00' || (doc_id % 5)] AS a, CASE WHEN a[1] = a[2] AND a[3] = a[2] THEN [a[1]] WHEN a[1] = a[2] OR a[1] = a[3] THEN CASE WHEN a[1] = a[2] THEN [a[1], a[3]] ELSE [a[1], a[2]] END WHEN a[2] = a[3] THEN [a[1], a[2]] ELSE a END AS list_distinct_in_order FROM documents)"))
def selected_segments(spark, d):
    """The first two distinct valid ids of a made-up reply."""
    reply = F.concat_ws(" then ", F.concat(F.lit("E00"), F.col("doc_id") % 7), F.lit("E002"), F.concat(F.lit("E00"), F.col("doc_id") % 5))
    valid = F.array(*map(F.lit, ("E001", "E002", "E003", "E004")))
    return frames.documents(spark, d).select("doc_id", F.array_join(text.selected_ids(reply, valid, 2), ",").alias("ids"))


@query("multi_query_rrf", sql("SELECT case_id, item, score, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, first_seen) AS rank FROM (SELECT case_id, doc_id AS item, round(sum(1.0::DOUBLE / (60 + rank)), 10) AS score, min(CASE branch WHEN 'bm25' THEN 0 ELSE 1000000000000 END + rank) AS first_seen FROM branches GROUP BY case_id, doc_id) QUALIFY rank <= 20", "branches"))
def multi_query_rrf(spark, d):
    """The two base rankings as the answers to two queries."""
    found = frames.base_branches(spark, d).select("case_id", F.when(F.col("branch") == "bm25", 0).otherwise(1).alias("query_no"), F.col("doc_id").alias("item"), "rank")
    return fusion.multi_query(found).select("case_id", "item", "score", "rank")


@query("trace_capture", sql("SELECT case_id, doc_id, min(rank) AS best_rank, string_agg(DISTINCT branch, ',' ORDER BY branch) AS found_by FROM branches GROUP BY case_id, doc_id", "branches"))
def trace_capture(spark, d):
    ranks = scoring.all_rows(*frames.scored(spark, d))
    for name in scoring.BRANCHES:
        ranks = ranks.withColumn(name, F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc(name), "doc_id")))
    return fusion.wide_traces(ranks, list(scoring.BRANCHES))


@query("expansion_gate", r"SELECT item_id AS case_id, CASE WHEN len(regexp_extract_all(q, '\p{L}{2,}')) >= 6 AND (length(q) - length(translate(q, '{}[]()=<>;_', ''))) * 8 <= length(q) THEN q || ' expansion' ELSE q END AS dense_query FROM (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN text ELSE replace(text, ' ', '()') END AS q FROM benchmark)")
def expansion_gate(spark, d):
    """Expansions go to prose only; every other query is made to look like code."""
    asked = frames.queries(spark, d)
    q = F.when(F.col("case_id") % 2 == 0, F.col("query")).otherwise(F.replace("query", F.lit(" "), F.lit("()")))
    return asked.select("case_id", text.expanded(q, F.lit("expansion")).alias("dense_query"))


@query("success_at_k", sql("SELECT arm, replace(metric, 'Recall', 'success') AS metric, round(avg((value > 0)::INT::DOUBLE), 6) AS value FROM metrics WHERE metric LIKE 'Recall@%' GROUP BY ALL", "metrics"))
def success_at_k(spark, d):
    return metrics.success(frames.case_metrics(spark, d))


SEEDS_SQL = sql("""SELECT g.case_id, n_gold, gold_seeded, coalesce(n_seeds, 0) AS n_seeds, same_directory FROM (SELECT g.case_id, count(*) AS n_gold, count(b.doc_id) AS gold_seeded FROM gold g LEFT JOIN bm25 b ON b.case_id = g.case_id AND b.doc_id = g.doc_id AND b.rank <= 5 GROUP BY g.case_id) g
LEFT JOIN (SELECT b.case_id, count(*) AS n_seeds, round(count(p.source) / count(*)::DOUBLE, 6) AS same_directory FROM bm25 b JOIN documents d USING (doc_id) LEFT JOIN (SELECT DISTINCT case_id, source FROM gold JOIN documents USING (doc_id)) p ON p.case_id = b.case_id AND p.source = d.source WHERE b.rank <= 5 GROUP BY b.case_id) n USING (case_id)""", "bm25", "gold")


@query("seed_audit", SEEDS_SQL)
def seed_audit(spark, d):
    """The first five BM25 documents as seeds, sources as directories."""
    from rankloom.operators.audit import seed_content

    seeds = ranking.bm25(*_base(spark, d), k=5).select("case_id", "doc_id")
    gold = frames.gold(spark, d)
    return seed_content(saved(seeds.join(gold.select("case_id").distinct(), "case_id", "left_semi")), gold, frames.documents(spark, d).select("doc_id", F.col("source").alias("directory")))


@query("dense_agreement", sql("SELECT case_id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE, 6) AS jaccard, a = b AS identical FROM (SELECT case_id, list(doc_id ORDER BY rank) FILTER (rank <= 10) AS a, list(doc_id ORDER BY rank) FILTER (rank BETWEEN 2 AND 11) AS b FROM dense GROUP BY case_id)", "dense"))
def dense_agreement(spark, d):
    """The first ten neighbours of each query against the ten from the second on, as two runs."""
    from rankloom.functions import stats
    from rankloom.operators.agreement import as_lists

    own, asked = frames.vectors(spark, d)
    found = as_lists(ranking.dense_scan(own, asked, 11), ["case_id"], 11)
    a, b = F.slice("items", 1, 10), F.slice("items", 2, 10)
    return found.select("case_id", F.round(stats.jaccard(a, b), 6).alias("jaccard"), (a == b).alias("identical"))


HARD_SQL = sql("""SELECT arm, case_id, 'hard_negative_hits@' || k AS metric, count(*) FILTER (rank <= k)::DOUBLE AS value
FROM (SELECT case_id, arm, rank FROM (SELECT DISTINCT case_id FROM hard) CROSS JOIN (SELECT DISTINCT arm FROM ranked) LEFT JOIN (SELECT ranked.* FROM ranked JOIN hard USING (case_id, doc_id)) USING (arm, case_id)), (VALUES (5), (10), (20)) t(k) GROUP BY ALL""", "cases", "gold", "ranked").replace("\nSELECT arm, case_id, 'hard", ",\nhard AS MATERIALIZED (SELECT c.case_id, d.doc_id FROM cases c JOIN documents d ON d.source = c.repo AND d.doc_id % 3 = 0 ANTI JOIN gold g ON g.case_id = c.case_id AND g.doc_id = d.doc_id)\nSELECT arm, case_id, 'hard", 1)


@query("hard_negative_hits", HARD_SQL)
def hard_negative_hits(spark, d):
    """Every third document of a case's repository that is none of its gold counts as a hard negative.

    Only ranked documents are told apart; which cases have any is known from counts by repository.
    """
    gold = frames.gold(spark, d)
    ranked = saved(frames.ranked(spark, d))
    near = frames.documents(spark, d).where("doc_id % 3 = 0").select("doc_id", F.col("source").alias("repo"))
    cases = saved(frames.cases(spark, d, gold).select("case_id", "repo"))
    own = lambda pairs: pairs.join(near, "doc_id").join(cases, ["case_id", "repo"]).select("case_id", "doc_id")
    negatives = saved(own(ranked.select("case_id", "doc_id").distinct()).join(gold, ["case_id", "doc_id"], "left_anti"))
    taken = own(gold).groupBy("case_id").agg(F.count("*").alias("taken"))
    left = cases.join(near.groupBy("repo").agg(F.count("*").alias("held")), "repo").join(taken, "case_id", "left").where(F.col("held") > F.coalesce("taken", F.lit(0)))
    return metrics.hard_negative_hits(ranked, negatives, cases=left).select("arm", "case_id", "metric", "value")


LADDER_SQL = sql(r"""SELECT mode, case_id, doc_id, rank FROM (SELECT 'dense' AS mode, case_id, doc_id, rank FROM near WHERE branch = 'dense' UNION ALL SELECT config, case_id, doc_id, rank FROM fused UNION ALL SELECT replace(config, 'hybrid', 'hybrid_rerank'), case_id, doc_id, row_number() OVER (PARTITION BY config, case_id ORDER BY rank > 20, CASE WHEN case_id % 2 = 0 AND rank <= 20 THEN doc_id ELSE rank END, rank) FROM listed) WHERE rank <= 20""", "bm25_whole").replace("\nSELECT mode", r""",
asked AS MATERIALIZED (SELECT item_id AS case_id, item_id * 20 AS vec_id, len(regexp_extract_all(text, '\p{L}{2,}')) >= 6 AND (length(text) - length(translate(text, '{}[]()=<>;_', ''))) * 8 <= length(text) AS prose FROM benchmark),
q AS MATERIALIZED (SELECT case_id, vec_id, 'dense' AS branch, embedding::DOUBLE[] AS e FROM asked JOIN embeddings USING (vec_id)
  UNION ALL SELECT case_id, a.vec_id, 'expanded', CASE WHEN prose AND n.vec_id IS NOT NULL THEN list_transform(range(1, len(e.embedding) + 1), lambda i: e.embedding[i]::DOUBLE + n.embedding[i]::DOUBLE) ELSE e.embedding::DOUBLE[] END FROM asked a JOIN embeddings e ON e.vec_id = a.vec_id LEFT JOIN embeddings n ON n.vec_id = a.vec_id + 1),
qn AS MATERIALIZED (SELECT case_id, vec_id, branch, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS v FROM q),
dn AS MATERIALIZED (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y)))) AS v FROM embeddings),
near AS MATERIALIZED (SELECT branch, case_id, d.vec_id AS doc_id, row_number() OVER (PARTITION BY branch, case_id ORDER BY round(list_inner_product(qn.v, d.v), 6) DESC, d.vec_id) AS rank FROM qn JOIN dn d ON d.vec_id <> qn.vec_id),
fused AS MATERIALIZED (SELECT config, case_id, doc_id, score, row_number() OVER (PARTITION BY config, case_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT config, case_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 10) AS score FROM (SELECT CASE branch WHEN 'dense' THEN 'hybrid' ELSE 'hybrid_expand' END AS config, case_id, doc_id, rank FROM near UNION ALL SELECT c, case_id, doc_id, rank FROM bm25_whole, (VALUES ('hybrid'), ('hybrid_expand')) t(c)) GROUP BY ALL) QUALIFY rank <= 50),
blended AS MATERIALIZED (SELECT *, round(CASE WHEN rank <= 30 THEN 0.4::DOUBLE / (1 + exp(-((doc_id % 7) - 3)::DOUBLE)) + 0.6::DOUBLE * (score / top) ELSE score / top END, 6) AS blend FROM (SELECT *, max(score) FILTER (rank = 1) OVER (PARTITION BY config, case_id) AS top FROM fused)),
listed AS MATERIALIZED (SELECT config, case_id, doc_id, row_number() OVER (PARTITION BY config, case_id ORDER BY rank <= 30 DESC, CASE WHEN rank <= 30 THEN -blend ELSE rank END, doc_id) AS rank FROM blended)
SELECT mode""", 1)


#: Rows of a hybrid that are reranked.
HEAD = 50


@query("ladder_modes", LADDER_SQL)
def ladder_modes(spark, d):
    """The five modes for the benchmark items, with every twentieth vector as an item's own and the next one as its expansion.

    Logits are a stand-in, a column like any scorer's, and so are the places of even cases' documents, in the order of their
    ids; an expansion moves the vectors of prose queries only.  Rankings hold the documents that can be in a hybrid's first
    HEAD, as those are early in one of them; their ranks are counted over all documents and vectors.
    """
    asked = frames.queries(spark, d)
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    after = vectors.select((F.col("doc_id") - 1).alias("vec_id"), F.col("vector").alias("next"))
    own = asked.select((F.col("case_id") * 20).alias("vec_id"), text.is_prose(F.col("query")).alias("prose")).join(vectors.select(F.col("doc_id").alias("vec_id"), F.col("vector").alias("own")), "vec_id").join(after, "vec_id", "left")
    plain = F.col("own").cast("array<double>")
    wider = F.when(F.col("prose") & F.col("next").isNotNull(), F.zip_with("own", "next", lambda x, y: x.cast("double") + y.cast("double"))).otherwise(plain)
    # a query's plain form has an even number, its wider one the next
    forms = saved(own.select("vec_id", F.explode(F.array(F.struct((F.col("vec_id") * 2).alias("case_id"), plain.alias("v")), F.struct((F.col("vec_id") * 2 + 1).alias("case_id"), wider.alias("v")))).alias("f")).select("f.case_id", F.col("vec_id").alias("own_id"), F.col("f.v").alias("query_vector")))

    depth = fusion.depth(2.0, limit=HEAD)  # two rankings of equal weight
    rows, weighed = frames.scored(spark, d)
    lexical = ranking.top_k(scoring.first_rows(rows, weighed, depth, ("bm25",)), depth, order=(F.desc("bm25"), F.asc("doc_id")))
    near = ranking.dense_scan(vectors, forms, depth)
    early = saved(lexical.select("case_id", "doc_id").union(near.select(F.floor(F.col("case_id") / 40), "doc_id")).distinct())
    bm25 = saved(scoring.with_ranks(rows, weighed, scoring.rows_of(rows, weighed, early), ("bm25",)).drop("branch"))
    ranks = saved(ranking.dense_ranks(vectors, forms, early.select(F.explode(F.array(F.col("case_id") * 40, F.col("case_id") * 40 + 1)).alias("case_id"), "doc_id")))
    dense, expanded = (ranks.where(F.pmod("case_id", F.lit(2)) == form).withColumn("case_id", F.floor(F.col("case_id") / 40)) for form in (0, 1))
    places = early.where("case_id % 2 = 0").withColumn("place", F.col("doc_id"))
    return fusion.ladder(dense, expanded, bm25, early.withColumn("logit", ((F.col("doc_id") % 7) - 3).cast("double")), places, head=HEAD)
