"""The whole prediction, worked out plainly: n-grams, inverse document frequencies, centroids, cosines and floors."""

import math
import random

import pytest
from test_models import SYLLABLES, text_of

from rankloom.llm import langid

ODD = 0x9E3779B97F4A7C15
DIM = 8192


def letters(text):
    """Lower-case bytes, with a space for whatever is no letter."""
    out, raw = [], (text or "").encode()
    for at, b in enumerate(raw):
        if 65 <= b <= 90:
            b += 32
        elif b >= 128:
            if at and raw[at - 1] == 0xC3 and 0x80 <= b <= 0x9E and b != 0x97:
                b += 32
        elif not 97 <= b <= 122:
            b = 32
        out.append(b)
    return out


def grams(text):
    own, counts = letters(text), {}
    for n in (2, 3, 4):
        for at in range(len(own) - n + 1):
            piece = own[at : at + n]
            if any(b != 32 for b in piece):
                code = 0
                for b in piece:
                    code = (code * 257 + b) % 2**64
                slot = (code * ODD % 2**64) >> 51
                counts[slot] = counts.get(slot, 0) + 1
    return counts


def unit(v):
    size = math.sqrt(sum(x * x for x in v.values()))
    return {k: x / size for k, x in v.items()} if size else {}


def cosine(a, b):
    return sum(x * b.get(k, 0.0) for k, x in a.items())


def mean(vectors):
    total = {}
    for v in vectors:
        for k, x in v.items():
            total[k] = total.get(k, 0.0) + x
    return {k: x / len(vectors) for k, x in total.items()}


def kmeans(x, k):
    centre = unit(mean(x))
    order = sorted(range(len(x)), key=lambda i: cosine(x[i], centre))
    k = min(k, len(x))
    c = [x[order[int((j + 0.5) / k * len(x))]] for j in range(k)]
    before = None
    for _ in range(12):
        own = [max(range(len(c)), key=lambda j: (cosine(v, c[j]), -j)) for v in x]
        if own == before:
            break
        before = own
        c = [unit(mean([v for v, o in zip(x, own) if o == j])) if j in own else c[j] for j in range(k)]
    return c


def quantile(values, q):
    values = sorted(values)
    at = q * (len(values) - 1)
    low = int(at)
    return values[low] + (at - low) * (values[min(low + 1, len(values) - 1)] - values[low])


def brute(rows, asked, clusters):
    rows = [(grams(t), lang) for _, t, lang in rows if lang and any(map(str.isalpha, t or ""))]
    langs = sorted({lang for _, lang in rows})
    df = {lang: {} for lang in langs}
    for counts, lang in rows:
        for slot in counts:
            df[lang][slot] = df[lang].get(slot, 0) + 1
    n = {lang: sum(o == lang for _, o in rows) for lang in langs}
    rate = [sum(df[lang].get(slot, 0) / n[lang] for lang in langs) / len(langs) for slot in range(DIM)]
    idf = [math.log((len(rows) + 1) / (r * len(rows) + 1)) + 0.1 for r in rate]
    vector = lambda counts: unit({k: math.sqrt(x) * idf[k] for k, x in counts.items()})
    bin_of = lambda counts: int(math.log2(1 + sum(counts.values())))
    vectors = [(vector(c), lang, bin_of(c)) for c, lang in rows]
    centroids = []
    for lang in langs:
        own = [v for v, o, _ in vectors if o == lang]
        size = len(own)
        for trim in range(langid.TRIMS + 1):
            c = kmeans(own, clusters)
            home = [max(range(len(c)), key=lambda j: (cosine(v, c[j]), -j)) for v in own]
            count = [home.count(j) for j in range(len(c))]
            kept = [k >= langid.LEAST_SHARE * size or k == max(count) for k in count]
            if all(kept[j] for j in range(len(c)) if count[j]) or trim == langid.TRIMS:
                break
            own = [v for v, h in zip(own, home) if kept[h]]
        centroids += [(lang, v) for v, k, m in zip(c, kept, count) if k and m]
    best = lambda v: max((cosine(v, c), lang) for lang, c in centroids)
    held = {lang: {} for lang in langs}
    for v, lang, size in vectors:
        value, found = best(v)
        if found == lang:
            held[lang].setdefault(size, []).append(value)
    floors = {}
    for lang in langs:
        known = {b: quantile(x, langid.QUANTILE) for b, x in held[lang].items() if len(x) >= langid.LEAST_TEXTS}
        whole = [x for values in held[lang].values() for x in values]
        least = min(known.values(), default=quantile(whole, langid.QUANTILE) if whole else 0.0)
        shortest = min(known, default=0)
        floors[lang] = {b: langid.SLACK * known.get(b, least * min(1.0, math.sqrt(2.0 ** (b - shortest)))) for b in range(48)}
    out = {}
    for i, text, _ in asked:
        if not any(map(str.isalpha, text or "")):
            out[i] = ("und", 0.0, True)
            continue
        counts = grams(text)
        value, lang = best(vector(counts))
        out[i] = (lang, value, value < floors[lang][min(bin_of(counts), 47)])
    return out, [lang for lang, _ in centroids]


def test_predictions_are_those_worked_out_plainly(spark):
    r = random.Random(8)
    rows = [(k, text_of(r, lang)[: r.choice([60, 200, 900])], lang) for k in range(220) for lang in [r.choice(list(SYLLABLES))]]
    rows += [(1000, None, "aa"), (1001, "12 34", "aa"), (1002, "ÀÉÎ õü ÿß × ÷", None), (1003, "", None), (None, "qxz vkj " * 30, None), (1004, "я не знаю", None)]
    want, kept = brute(rows, rows, 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model.langs == kept and max(kept.count(lang) for lang in kept) == 3
    found = {x["doc_id"]: tuple(x)[1:] for x in langid.identify(docs, model).collect()}
    assert found.keys() == want.keys()
    for i, (lang, score, rejected) in want.items():
        assert found[i] == (lang, pytest.approx(score, abs=1e-5), rejected), i
