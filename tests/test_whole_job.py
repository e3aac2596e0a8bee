"""Registered queries against the whole tables, with results worked out without their SQL twins."""

import os

import numpy as np
import pytest

from rankloom.plans import catalog, frames
from rankloom.session import table

DATA = os.environ.get("RANKLOOM_DATA", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def test_every_twentieth_vector_is_a_query(spark):
    rows = table(spark, DATA, "embeddings").collect()
    ids = np.array([r["vec_id"] for r in rows])
    own = np.array([r["embedding"] for r in rows], np.float64)
    own /= np.sqrt((own * own).sum(1, keepdims=True))
    wanted = {int(i) for i in ids if i % 20 == 0}
    assert {r["case_id"] for r in frames.vectors(spark, DATA)[1].collect()} == wanted
    found = {}
    for r in catalog.QUERIES["dense_topk"](spark, DATA).collect():
        found.setdefault(r["case_id"], {})[r["rank"]] = (r["doc_id"], r["score"])
    assert set(found) == wanted
    for case, ranks in found.items():
        cosine = own @ own[ids == case][0]
        best = np.sort(cosine[ids != case])[::-1][:20]
        assert sorted(ranks) == list(range(1, 21))
        assert np.allclose([ranks[k][1] for k in range(1, 21)], best, atol=2e-6)
        assert all(abs(cosine[ids == doc][0] - score) < 2e-6 and doc != case for doc, score in ranks.values())
    for name in ("dense_maxpool", "dense_keep_first", "dense_agreement"):
        assert {r["case_id"] for r in catalog.QUERIES[name](spark, DATA).collect()} == wanted


def test_observations_are_of_every_document(spark):
    rows = {r["doc_id"]: float(r["n_chars"]) for r in table(spark, DATA, "documents").select("doc_id", "n_chars").collect()}
    pairs = {(i // 6, i % 6): (v, rows[i + 3], round(rows[i + 3] - v, 6)) for i, v in rows.items() if i % 6 < 3 and i + 3 in rows}
    found = catalog.QUERIES["transform_deltas"](spark, DATA).collect()
    assert {(r["case_id"], r["repeat"]): (r["full"], r["compact"], r["delta"]) for r in found} == pairs and len(found) == len(pairs)
    scheduled = 3 * (len({i // 6 for i in rows}) + 1)
    for r in catalog.QUERIES["fail_closed"](spark, DATA).collect():
        there = sum((i % 6 < 3) == (r["transform"] == "full") for i in rows)
        assert (r["scheduled"], r["errors"], r["valid"], r["mean"]) == (scheduled, scheduled - there, False, None)


def test_ordered_subset_is_of_every_labelled_document(spark):
    wanted = sorted({r["doc_id"] for r in table(spark, DATA, "labels").collect()}, reverse=True)
    langs = {r["doc_id"]: r["lang"] for r in table(spark, DATA, "documents").collect()}
    found = catalog.QUERIES["ordered_subset"](spark, DATA).collect()
    assert [(r["case_id"], r["ordinal"], r["lang"]) for r in found] == [(i, wanted[0] - i + 1, langs[i]) for i in wanted]


def test_diverse_probe_searches_all_documents(spark, tmp_path):
    from rankloom.operators.sampling import diverse_probe

    rows = [(i, "en" if i % 7 else "de", "hot") for i in range(60)] + [(60 + i, f"l{i % 3}", f"s{i % 9}") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = [r["case_id"] for r in catalog.QUERIES["diverse_probe"](spark, str(tmp_path)).orderBy("place").collect()]
    assert found == diverse_probe([(str(i), lang, source) for i, lang, source in rows], 12)[:12]
    assert {dict((str(i), source) for i, _, source in rows)[c] for c in found} == {"hot", *(f"s{k}" for k in range(9))}


def documents(spark, path, texts):
    """A documents table of these texts, with ids 1, 13, 25, ..: all are modifications of source files."""
    rows = [(1 + 12 * k, t, "en", "src1", len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_messages_are_whole_texts(spark, tmp_path):
    head = "the same words " * 400
    d = documents(spark, tmp_path, [head + "a", head + "b", head.upper() + "A", head + "b\nSigned-off-by: x"])
    found = {r["doc_id"]: r["message"] for r in catalog.QUERIES["distinct_keep_min"](spark, d).collect()}
    assert found == {1: head + "a", 13: head + "b"}


def test_commits_are_judged_by_the_whole_message(spark, tmp_path):
    good = "A subject that is certainly long enough"
    texts = [good, good + "\n" + "words " * 900 + "see lib/src1_x.py", good + " and " * 9 + "en_y.go", "Short\n" + good, "Chore: " + good, good + "\nMerge"]
    found = {r["doc_id"] for r in catalog.QUERIES["commit_eligibility"](spark, documents(spark, tmp_path, texts)).collect()}
    assert found == {1, 61}


def test_rankers_run_with_their_whole_depth(spark):
    from pyspark.sql import functions as F

    from rankloom.operators import ranking

    docs, asked = frames.documents(spark, DATA).select("doc_id", "text"), frames.queries(spark, DATA)
    rows = lambda df: sorted(map(tuple, df.select("case_id", "doc_id", "rank").collect()))
    deep = ranking.bm25(docs, asked, k=50).select("case_id", "doc_id", "score", "rank").cache()
    assert max(r["rank"] for r in deep.collect()) == 50
    blended = ranking.rerank_blend(deep.withColumn("logit", ((F.col("doc_id") % 7) - 3).cast("double")), head=50, window=30)
    assert rows(catalog.QUERIES["rerank_blend"](spark, DATA)) == rows(blended)
    want = sorted((r["case_id"], r["doc_id"], 21 - r["rank"] if r["case_id"] % 2 == 0 and r["rank"] <= 20 else r["rank"]) for r in deep.collect())
    sizes = {c: sum(x[0] == c for x in want) for c, _, _ in want}
    got = rows(catalog.QUERIES["listwise_permutation"](spark, DATA))
    assert [x for x in got if sizes[x[0]] >= 20] == [x for x in want if sizes[x[0]] >= 20]
    terms = ranking.identifier_terms(asked, most=24)
    assert rows(catalog.QUERIES["idf_lexical_search"](spark, DATA)) == rows(ranking.idf_containment(docs, terms))


@pytest.mark.parametrize("name, module, least", [("bootstrap_multi_arm", "multi_arm", 100_000), ("sequential_looks", "replicates", 20_000)])
def test_bootstraps_have_all_replicates(spark, monkeypatch, name, module, least):
    from rankloom.operators import resampling

    asked, real = [], resampling.draws
    monkeypatch.setattr(resampling, "draws", lambda groups, resamples=resampling.RESAMPLES, seed=resampling.SEED: asked.append(resamples) or real(groups, resamples, seed))
    catalog.QUERIES[name](spark, DATA)
    assert max(asked) == least


def test_ablation_has_the_two_branch_configs(spark):
    found = {}
    for r in catalog.QUERIES["rrf_ablation"](spark, DATA).collect():
        found.setdefault(r["config"], []).append((r["doc_id"], r["rank"], r["score"]))
    assert len(found) == 10 and {"vector_bm25_equal", "vector_bm25_tuned", "vector_only"} <= set(found)
    assert all(score == round(0.5 / (60 + rank), 10) and rank <= 50 for _, rank, score in found["vector_only"])
    alone = {doc for doc, _, _ in found["vector_only"]}
    assert any(doc not in alone for doc, _, _ in found["vector_bm25_equal"]) and found["baseline"] != found["without_trigram"]
