"""Language identification and the quality classifier, on held-out rows and on odd ones."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from rankloom.llm import langid, quality

SYLLABLES = {"aa": "ka no mi ru ta shi".split(), "bb": "ber sch ung keit der und".split(), "cc": "que los ción ña el por".split()}


def text_of(r, lang, most=60):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(4, most)))


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(8)
    rows = [(k, text_of(r, lang), lang) for k in range(900) for lang in [r.choice(list(SYLLABLES))]]
    rows += [(5000, None, "aa"), (5001, "", "aa"), (5002, "123 !?", None), (5003, "ünï", None), (None, "ka no", "aa"), (5004, "漢字 かな " * 50, None), (5005, "que los " * 20_000, None), (5005, "que los " * 20_000, None)]
    return spark.createDataFrame([(i, t, lang, 0.5) for i, t, lang in rows], "doc_id long, text string, lang string, score double")


def test_languages_of_held_out_texts(docs):
    model = langid.train(docs.where("doc_id % 4 != 0"))
    rows = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    held = [r for r in docs.where("doc_id % 4 = 0 and doc_id < 5000").collect()]
    assert np.mean([rows[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) > 0.98
    assert not any(rows[r["doc_id"]]["rejected"] for r in held)
    for i in (5000, 5001, 5002):
        assert (rows[i]["lang_pred"], rows[i]["score"], rows[i]["rejected"]) == ("und", 0.0, True)
    assert rows[5003]["lang_pred"] in SYLLABLES and rows[5005]["lang_pred"] == "cc"
    assert rows[5004]["rejected"] and rows[5004]["lang_pred"] in SYLLABLES
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(5005) == 2 and not {5000, 5001, 5002, 5004} & set(ids)


def test_gram_vectors_by_a_plain_count():
    texts = ["AbÉ é", "", "x", "a b", "ab" * 50]
    (_, _, counts, letter), = langid._matrices(pa.array(texts))
    for row, t in enumerate(texts):
        raw = re.sub("[^a-z\x80-\xff]", " ", t.lower().encode().decode("latin-1")).encode("latin-1")
        want = sum(raw[k : k + n].strip(b" ") != b"" for n in langid.GRAMS for k in range(len(raw) - n + 1))
        assert counts[row].sum() == want
        assert letter[row] == any(map(str.isalpha, t))


def test_nothing_to_learn_from(docs, spark):
    model = langid.train(docs.where("lang = 'zz'"))
    assert {r["lang_pred"] for r in langid.identify(docs, model).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).collect() == []


def test_quality_of_held_out_texts(spark):
    r = random.Random(3)
    rows, labels = [], []
    for k in range(800):
        good = r.random() < 0.7
        t = text_of(r, "bb", 120)
        if not good:
            t = r.choice([t.upper(), re.sub(" ", "$$ ", t), "The " * 60, re.sub(" ", " | ", t)])
        rows.append((k, t))
        if k % 5 != 1:
            labels.append((k, int(good)))
    labels += [(3, None), (None, 1), (4, 7), (10_000, 0)]
    rows += [(900, None), (901, ""), (None, "x"), (902, "long text here " * 40_000), (903, "\n\t"), (2, rows[2][1])]
    docs = quality.features(spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, predicted int"))
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.train(docs.where("doc_id % 5 != 0"), known)
    out = {x["doc_id"]: x for x in quality.score(docs, model).collect()}
    truth = dict(labels)
    held = [k for k in range(800) if k % 5 == 0]
    assert np.mean([out[k]["predicted"] == truth[k] for k in held]) > 0.97
    assert all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.3) for x in out.values())
    nothing = quality.train(docs, known.where("quality = 9"))
    assert {x["score"] for x in quality.score(docs, nothing).collect()} == {0.5}
    only = quality.train(docs, known.where("quality = 1"))
    assert {x["score"] for x in quality.score(docs, only).collect()} == {1.0}
    assert quality.score(docs.limit(0), model).collect() == []


def test_discriminant_is_that_of_the_densities():
    rng = np.random.default_rng(1)
    d = len(quality.FEATURES)
    xs = [rng.normal(k, 1 + k, (200 * (k + 1), d)) @ rng.normal(size=(d, d)) for k in (0, 1)]
    model = quality.Discriminant.fit(np.array([np.concatenate(([len(x)], x.sum(0), (x.T @ x).ravel())) for x in xs]))
    pooled = sum((x - x.mean(0)).T @ (x - x.mean(0)) for x in xs) / 600
    pooled = 0.95 * pooled + 0.05 * (np.trace(pooled) / d + 1e-6) * np.eye(d)
    point, logs = rng.normal(size=d), []
    for x in xs:
        c = 0.9 * np.cov(x.T, bias=True) + 0.1 * pooled
        delta = point - x.mean(0)
        logs.append(np.log(len(x) / 600) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * delta @ np.linalg.solve(c, delta))
    assert model.score(point[None])[0] == pytest.approx(1 / (1 + np.exp(logs[0] - logs[1])))
