"""The pipeline's stages by plain versions of them, and its tables by hand."""

import random

import corpus_pipeline
from rankloom.llm import langid, packing, pii

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark):
    r = random.Random(6)
    syllables = {"aa": "ka no mi ru ta shi".split(), "bb": "ber sch ung keit der und".split()}
    rows = []
    for k in range(300):
        lang = r.choice(["aa", "bb"])
        t = " ".join("".join(r.choice(syllables[lang]) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(8, 120)))
        rows.append((k, t, lang, r.choice(["s1", "s2", "s2", None]), len(t)))
    for k in range(300, 360):
        _, t, lang, source, _ = rows[k - 300]
        t = t + r.choice(["", " ka"])
        rows.append((k, t, lang, source, len(t)))
    rows += [(400, None, None, "s1", 0), (401, "12 34", "aa", "s1", 5), (402, "ka no mi write to me@ka.no now ru ta shi", "aa", "s1", 39), (403, "漢字 " * 50, None, "s1", 150)]
    return spark.createDataFrame(rows, COLUMNS), rows


def test_stages(spark, tmp_path):
    df, rows = documents(spark)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "ngram_jaccard_join", "pii", "mixing", "best_fit_packing"]
    named = stages["language_id"](spark, df, "")
    model = langid.train(df)
    rejected = {r["doc_id"] for r in langid.identify(df, model).collect() if r["rejected"]}
    assert rejected == {400, 401, 403}
    assert named.columns == df.columns and {r["doc_id"] for r in named.collect()} == {r[0] for r in rows} - rejected
    single = stages["ngram_jaccard_join"](spark, named, "")
    sets = {r[0]: {tuple(r[1].split()[i : i + 5]) for i in range(max(1, len(r[1].split()) - 4))} for r in rows if r[0] not in rejected}
    near = {i: min(j for j in sets if len(sets[i] & sets[j]) * 100 >= 80 * len(sets[i] | sets[j])) for i in sets}
    for _ in range(5):
        near = {i: near[j] for i, j in near.items()}
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(i for i in near if near[i] == i)
    clean = stages["pii"](spark, single, "")
    text = {r["doc_id"]: r["text"] for r in clean.collect()}
    before = {r["doc_id"]: r["text"] for r in single.collect()}
    assert {i: pii.redact_text(t) for i, t in before.items()} == text and "[EMAIL]" in text[402]
    mixed = stages["mixing"](spark, clean, "").cache()
    assert mixed.columns == df.columns
    assert set(map(tuple, mixed.collect())) <= set(map(tuple, clean.collect()))
    words = sum(len(t.split()) for t in text.values())
    assert abs(sum(len(r["text"].split()) for r in mixed.collect()) - words) <= 3 * 120
    packed = stages["best_fit_packing"](spark, mixed, "").collect()
    want = sum(len(packing.token_ids(r["text"], packing_ranks(), pattern())) + 1 for r in mixed.collect())
    assert sum(r["length"] for r in packed) == want


def packing_ranks():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def pattern():
    import public_tokenizers

    return public_tokenizers.PATTERN


def test_near_copies_of_odd_rows(spark):
    rows = [(1, "a b c d e f", "l", "s", 1), (1, "a b c d e f", "l", "s", 1), (None, "a b c d e f", "l", "s", 1), (None, None, "l", "s", 1), (2, "A B c d e f", "l", None, None), (3, None, "l", "s", 0), (4, "", "l", "s", 0)]
    df = spark.createDataFrame(rows, COLUMNS)
    out = corpus_pipeline.drop_near_copies(spark, df, "").collect()
    assert sorted((str(r["doc_id"]) for r in out)) == ["1", "3", "4", "None", "None"]
    assert corpus_pipeline.drop_near_copies(spark, df.limit(0), "").collect() == []


def test_run(spark, tmp_path):
    df, _ = documents(spark)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns)
    assert out.count() > 0
