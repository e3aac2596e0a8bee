"""Rejection of what no language was learned for, though some labelled texts are wrong."""

import random

from test_models import SYLLABLES, text_of

from rankloom.llm import langid


def test_unlearned_language_and_gibberish_are_rejected(spark):
    r = random.Random(4)
    rows = [(k, text_of(r, lang), lang) for k in range(900) for lang in [r.choice(list(SYLLABLES))]]
    gibberish = lambda n: "".join(r.choice("qxzjwvfgkp ") for _ in range(n))
    other = lambda n: " ".join("".join(r.choice("vyh uol tek jä mmö zz".split()) for _ in range(2)) for _ in range(n))
    rows += [(2000 + k, gibberish(r.randrange(50, 600)), lang) for k, lang in enumerate([*SYLLABLES] * 4)]  # labelled wrongly
    odd = [(3000 + k, gibberish(r.randrange(50, 600)), None) for k in range(20)] + [(4000 + k, other(r.randrange(10, 90)), None) for k in range(20)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    model = langid.train(docs.where("doc_id % 4 != 0 or doc_id >= 2000"))
    rejected = {x["doc_id"]: x["rejected"] for x in langid.identify(docs, model).collect()}
    assert all(rejected[i] for i, *_ in odd)
    assert sum(rejected[k] for k in range(0, 900, 4)) <= 2
