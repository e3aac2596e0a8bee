"""Shared pieces of the SQL twins: named subqueries and what each needs."""

from __future__ import annotations

WORD = r"[\p{L}\p{N}_]+"
PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "gold": ((), "SELECT b.item_id AS case_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)"),
    "first_gold": (("gold",), "SELECT case_id, min(doc_id) AS doc_id FROM gold GROUP BY case_id"),
    "cases": (("first_gold",), "SELECT b.item_id AS case_id, b.text AS query, d.source AS repo, d.lang AS workflow, d.doc_id AS first_gold FROM benchmark b JOIN first_gold f ON f.case_id = b.item_id JOIN documents d ON d.doc_id = f.doc_id"),
    "terms": ((), f"SELECT DISTINCT item_id AS case_id, unnest(regexp_extract_all(lower(text), '{WORD}')) AS term FROM benchmark"),
    "lengths": ((), f"SELECT doc_id, len(regexp_extract_all(lower(text), '{WORD}')) AS dl FROM documents"),
    "postings": (("terms",), f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{WORD}')) AS term FROM documents) WHERE term IN (SELECT term FROM terms) GROUP BY doc_id, term"),
    "weights": (("postings", "lengths"), "SELECT term, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf, mean_dl FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), (SELECT count(*) AS n, avg(dl) AS mean_dl FROM lengths)"),
    "bm25_all": (("weights",), "SELECT case_id, doc_id, round(sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / mean_dl))), 6) AS score FROM postings JOIN weights USING (term) JOIN terms USING (term) JOIN lengths USING (doc_id) GROUP BY case_id, doc_id"),
    "bm25_whole": (("bm25_all",), "SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, doc_id) AS rank FROM bm25_all"),
    "bm25": (("bm25_all",), "SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, doc_id) AS rank FROM bm25_all QUALIFY rank <= 20"),
    "bm25_50": (("bm25_all",), "SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, doc_id) AS rank FROM bm25_all QUALIFY rank <= 50"),
    "lexical_whole": (("postings",), "SELECT case_id, doc_id, score, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT case_id, doc_id, round(count(*) / any_value(n_terms)::DOUBLE, 6) AS score FROM postings JOIN terms USING (term) JOIN (SELECT case_id, count(*) AS n_terms FROM terms GROUP BY case_id) USING (case_id) GROUP BY case_id, doc_id)"),
    "lexical": (("lexical_whole",), "SELECT * FROM lexical_whole WHERE rank <= 20"),
    "branches": (("bm25_whole", "lexical_whole"), "SELECT 'bm25' AS branch, case_id, doc_id, rank FROM bm25_whole UNION ALL SELECT 'lexical', case_id, doc_id, rank FROM lexical_whole"),
    "fusion_weights": ((), "SELECT * FROM (VALUES ('bm25', 'bm25', 1.0::DOUBLE), ('bm25', 'lexical', 0.0::DOUBLE), ('rrf30', 'bm25', 1 - 0.3::DOUBLE), ('rrf30', 'lexical', 0.3::DOUBLE), ('rrf70', 'bm25', 1 - 0.7::DOUBLE), ('rrf70', 'lexical', 0.7::DOUBLE), ('lexical', 'bm25', 0.0::DOUBLE), ('lexical', 'lexical', 1.0::DOUBLE)) t(arm, branch, weight)"),
    "ranked": (("branches", "fusion_weights"), "SELECT *, row_number() OVER (PARTITION BY arm, case_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT arm, case_id, doc_id, round(sum(weight / (60 + rank)), 10) AS score FROM branches JOIN fusion_weights USING (branch) WHERE weight > 0 GROUP BY arm, case_id, doc_id) QUALIFY rank <= 20"),
    "hits": (("ranked", "gold"), "SELECT r.*, g.doc_id IS NOT NULL AS hit FROM ranked r LEFT JOIN gold g USING (case_id, doc_id)"),
    "summed": (("hits",), "SELECT arm, case_id, n_gold, min(rank) FILTER (hit) AS first, coalesce(sum(21 - rank) FILTER (hit), 0) AS area, "
               + ", ".join(f"count(*) FILTER (hit AND rank <= {k}) AS h{k}, count(*) FILTER (rank <= {k}) AS r{k}" for k in (5, 10, 20))
               + " FROM (SELECT case_id, count(*) AS n_gold FROM gold GROUP BY case_id) CROSS JOIN (SELECT DISTINCT arm FROM ranked) LEFT JOIN hits USING (arm, case_id) GROUP BY arm, case_id, n_gold"),
    "wide": (("summed",), "SELECT arm, case_id, round(coalesce(1.0::DOUBLE / first, 0), 6) AS \"MRR\", round(area / (20 * n_gold)::DOUBLE, 6) AS \"coverage_auc@20\", (h20 > 0)::INT::DOUBLE AS \"any_gold@20\", "
             + ", ".join(f"round(h{k} / n_gold::DOUBLE, 6) AS \"Recall@{k}\", round(h{k} / {k}::DOUBLE, 6) AS \"Precision@{k}\", round(CASE WHEN h{k} > 0 THEN 1.25::DOUBLE * (h{k} / {k}::DOUBLE) * (h{k} / n_gold::DOUBLE) / (0.25::DOUBLE * (h{k} / {k}::DOUBLE) + h{k} / n_gold::DOUBLE) ELSE 0 END, 6) AS \"F0.5@{k}\", (r{k} - h{k})::DOUBLE AS \"irrelevant_files@{k}\"" for k in (5, 10, 20))
             + " FROM summed"),
    "metrics": (("wide", "cases"), "SELECT arm, case_id, metric, value, repo, workflow FROM (UNPIVOT wide ON COLUMNS(* EXCLUDE (arm, case_id)) INTO NAME metric VALUE value) JOIN cases USING (case_id)"),
    "pairs": (("metrics",), "SELECT b.case_id, b.metric, b.repo, b.workflow, b.value AS baseline, c.value AS candidate, c.value - b.value AS delta FROM metrics b JOIN metrics c ON b.case_id = c.case_id AND b.metric = c.metric WHERE b.arm = 'bm25' AND c.arm = 'lexical' AND b.metric IN ('MRR', 'Recall@5', 'Recall@20', 'any_gold@20')"),
    "clusters": (("pairs",), "SELECT metric, repo, sum(delta) AS s, count(*) AS n, row_number() OVER (PARTITION BY metric ORDER BY repo) - 1 AS pick, count(*) OVER (PARTITION BY metric) AS g FROM pairs GROUP BY metric, repo"),
    "draws": (("clusters",), "SELECT g, rep, pick, count(*) AS times FROM (SELECT g, rep, ('0x' || substr(md5('1042|' || rep || '|' || slot), 1, 8))::BIGINT % g AS pick FROM (SELECT g, rep, unnest(range(g)) AS slot FROM (SELECT DISTINCT g FROM clusters), range(1000) r(rep))) GROUP BY ALL"),
    "reps": (("draws",), "SELECT metric, rep, sum(times * s) / sum(times * n) AS value FROM clusters JOIN draws USING (g, pick) GROUP BY metric, rep"),
    "word_counts": ((), r"SELECT doc_id, len(regexp_extract_all(text, '[^ \t\n\v\f\r]+')) AS cost, md5(text) AS digest FROM documents"),
    "packs": (("ranked", "word_counts"), "SELECT *, least(cost, 8000 - before) AS used FROM (SELECT arm, case_id, doc_id, rank, cost, digest, coalesce(sum(cost) OVER (PARTITION BY arm, case_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ranked JOIN word_counts USING (doc_id)) WHERE before < 8000"),
    "lists": (("ranked",), "SELECT arm, case_id, list(doc_id ORDER BY rank) AS items FROM ranked GROUP BY arm, case_id"),
    "unit": ((), "SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y)))) AS v FROM embeddings"),
    "dense": (("unit",), "SELECT q.vec_id AS case_id, d.vec_id AS doc_id, round(list_inner_product(q.v, d.v), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(q.v, d.v), 6) DESC, d.vec_id) AS rank FROM unit q JOIN unit d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id QUALIFY rank <= 20"),
    "registry": ((), "SELECT event_id, user_id AS run, event_id % 97 AS case_id, ts, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status, value AS latency FROM events"),
}


def sql(body: str, *needs: str) -> str:
    """`body` behind the subqueries it needs, each after those it needs itself."""
    order: dict[str, None] = {}

    def add(name: str) -> None:
        for other in PARTS[name][0]:
            add(other)
        order[name] = None

    for name in needs:
        add(name)
    return ("WITH " + ",\n".join(f"{n} AS MATERIALIZED ({PARTS[n][1]})" for n in order) + "\n" if order else "") + body
