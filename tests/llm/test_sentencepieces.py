import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import Row

import pyarrow as pa
from rankloom.llm import sentencepieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "a", " a", "  a  ", "▁a", "a▁ b", "▁", " ▁", "\x00", "<s>", "</s>", "<0x41>", "퟿", "a​b", "Hello  wörld 😀\n", "ﬁ ①  ㍿ x", "ｶﾞ が", "x" * 3000, "\n\n\t ", "　a　", "🤷🏽‍♀️", "ab " * 2000]
LETTERS = "ab cde \n\t▁éß①ﬁ㍿ｶﾞ́​　😀123.,<>中文한"


def proto():
    with open(PATH, "rb") as f:
        return f.read()


def with_map(rule, **flags):
    """The model with the library's own compiled map of a rule."""
    spec = sentencepiece.SentencePieceNormalizer(rule_name=rule, **flags).serialized_normalizer_spec()
    size, left = b"", len(spec)
    while left > 127:
        size, left = size + bytes([left & 127 | 128]), left >> 7
    return proto() + bytes([3 << 3 | 2]) + size + bytes([left]) + spec


@pytest.mark.parametrize("squeeze", [False, True])
@pytest.mark.parametrize("prefix", [False, True])
@pytest.mark.parametrize("rule", [None, "nmt_nfkc", "nfkc_cf"])
def test_pieces_and_spans_are_the_librarys(rule, prefix, squeeze):
    own = with_map(rule, add_dummy_prefix=prefix, remove_extra_whitespaces=squeeze, escape_whitespaces=True) if rule else proto()
    model, library = sentencepieces.Model(own), sentencepiece.SentencePieceProcessor(model_proto=own)
    draw = random.Random(7)
    texts = ODD + ["".join(draw.choice(LETTERS) for _ in range(draw.randint(0, 90))) for _ in range(400)]
    for text, found in zip(texts, model.encode(pa.array(texts, pa.string())), strict=True):
        pieces = library.encode(text, return_type="proto").pieces
        assert [(p.id, p.begin, p.end) for p in pieces] == list(zip(*(x.tolist() for x in found))), text


def test_runs_are_forgotten_and_long_texts_whole(monkeypatch):
    monkeypatch.setattr(sentencepieces, "MOST_RUNS", 5)
    monkeypatch.setattr(sentencepieces, "LONG", 40)
    model, library = sentencepieces.Model(proto()), sentencepiece.SentencePieceProcessor(model_proto=proto())
    texts = ["one two three four five six", "one seven", "a longer text that is merged as a whole, not by its runs", "one\0two"]
    assert [x.ids.tolist() for x in model.encode(pa.array(texts))] == library.encode(texts)


def test_other_models_are_refused():
    with pytest.raises(ValueError, match="byte-pair"):
        sentencepieces.Model(proto() + bytes([2 << 3 | 2, 2, 3 << 3, 1]))  # a unigram model


def rows(spark, made):
    return spark.createDataFrame(made, "doc_id long, text string, ids string, n_tokens int")


def test_operators_over_odd_rows(spark):
    texts = [None, *ODD, ODD[4]]
    docs = rows(spark, [(n, t, "clash", 1) for n, t in enumerate(texts)] + [(None, "null id", "clash", 1), (3, "twice", None, None)])
    encoded = sentencepieces.encode(docs, PATH)
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    got = {(r.doc_id, tuple(r.ids)): r for r in encoded.collect()}
    assert len(got) == len(texts) + 2 and sentencepieces.encode(docs.limit(0), PATH).count() == 0
    for n, text in enumerate(texts):
        row = got[n, tuple(library.encode(text or ""))]
        raw = (text or "").encode()
        covered = b"".join(raw[a:b] for a, b in zip(row.starts, row.ends))
        assert covered == raw, text  # the spans of a map that drops nothing cover the text
    decoded = {(r.doc_id, r.text) for r in sentencepieces.decode(encoded, PATH).collect()}
    assert decoded == {(n, library.decode(library.encode(t or ""))) for n, t in enumerate(texts)} | {(None, "null id"), (3, "twice")}
    assert sentencepieces.decode(spark.createDataFrame([Row(doc_id=1, ids=None)], "doc_id long, ids array<int>"), PATH).first().text == ""


def test_digests_are_those_of_the_librarys_ids(spark):
    texts = [None, *ODD]
    docs = rows(spark, [(n, t, "clash", 1) for n, t in enumerate(texts)])
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for row in sentencepieces.digests(docs, PATH).collect():
        ids = library.encode(texts[row.doc_id] or "", add_bos=True, add_eos=True)
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())


def test_query_is_the_librarys(spark):
    from rankloom.llm import queries

    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    found = queries.QUERIES["op11_sentencepiece"](spark, "/root/testdata/sf0.001").collect()
    assert len(found) == len(texts)
    for row in found:
        ids = library.encode(texts[row.doc_id], add_bos=True, add_eos=True)
        assert row.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest() and row.n_tokens == len(ids)
