import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from rankloom.llm.lm_score import MASS, cross_entropy_difference


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, target):
    def counts(texts):
        pairs, contexts = Counter(), Counter()
        for t in texts:
            before = None
            for w in words_of(t):
                pairs[before, w] += 1
                contexts[before] += 1
                before = w
        return pairs, contexts

    models = counts(target), counts([t for _, t in docs])
    size = len({w for t in [*target, *(t for _, t in docs)] for w in words_of(t)})
    out = {}
    for i, t in docs:
        n, losses = out.get(i, (0, [0.0, 0.0]))
        before = None
        for w in words_of(t):
            for k, (pairs, contexts) in enumerate(models):
                losses[k] -= math.log((pairs[before, w] + MASS / size) / (contexts[before] + MASS))
            before, n = w, n + 1
        out[i] = n, losses
    return {i: (n, *((losses[0] / n, losses[1] / n, (losses[0] - losses[1]) / n) if n else (None,) * 3)) for i, (n, losses) in out.items()}


@pytest.mark.parametrize("options", [{}, {"cell_bytes": 500, "most_hot": 0}, {"cell_bytes": 500, "most_hot": 40}])
def test_scores_are_those_of_the_models(spark, options):
    r = random.Random(2)
    vocabulary = [f"w{k}" for k in range(50)] + ["The", "é", "x.", "the"]
    text = lambda most: " ".join(r.choice(vocabulary) for _ in range(r.randrange(most)))
    docs = [(k, text(60)) for k in range(120)] + [(500, None), (501, " \n"), ((1 << 62) + 5, "w1 w2 far"), (-5, "w1 w2 w3"), (None, "a b"), (None, "c"), (7, "the The the"), (502, "w1 w2 " * 4000)]
    target = [text(40) for _ in range(30)] + [None, ""]
    df = spark.createDataFrame([(i, t, 0.0) for i, t in docs], "doc_id long, text string, score double")
    aim = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    found = {row["doc_id"]: tuple(row)[1:] for row in cross_entropy_difference(df, aim, **options).collect()}
    want = brute(docs, target)
    assert found.keys() == want.keys()
    for i in want:
        assert found[i][0] == want[i][0]
        assert found[i][1:] == (pytest.approx(want[i][1:]) if want[i][0] else (None,) * 3)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert cross_entropy_difference(docs, docs.select("text")).collect() == []
    some = spark.createDataFrame([(1, "a b a")], "doc_id long, text string")
    assert cross_entropy_difference(some, docs.select("text")).first()["n_tokens"] == 3


def test_no_cell_meets_a_word_that_is_everywhere(spark):
    from rankloom.llm import lm_score

    docs = [(k, f"start here then w{k} w{k + 1} end of it all") for k in range(4000)]
    own = spark.createDataFrame(docs, "doc_id long, text string")
    none = own.limit(0)
    vocabulary, keys, kinds = lm_score.hot_keys(own, none, 4, 13)
    assert vocabulary == 4008 and sorted(kinds) == [0] * 6 + [1] * 7  # the pairs and contexts of every text
    hot = lm_score.hot_terms(own, none, 4, vocabulary, 100.0, keys, kinds)
    assert np.allclose(hot[2], np.where(kinds == 0, -np.log(4000 + 100 / vocabulary), np.log(4100)))
    sent = list(lm_score._send(type("B", (), {"value": hot}), False, 8, 4)(iter(own.toArrow().to_batches())))
    sizes = {}
    for batch in sent:
        for r in batch.to_pylist():
            if r["kind"] != lm_score.KNOWN:
                sizes[r["cell"]] = sizes.get(r["cell"], 0) + len(r["keys"]) // 6
    assert len(sizes) == 8 and max(sizes.values()) < 1.2 * min(sizes.values())
