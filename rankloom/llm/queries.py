"""The registered queries of the training-data operators: thin calls with production parameters, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import collocations, langid, lm_score, mixing, near_dedup, packing, pii, prefix_trie, quality, sentencepieces, warc, webp
from rankloom.llm.ngram_join import ngram_jaccard_join
from rankloom.session import shared_dir, table


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against the assistant turns of the conversations."""
    target = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return lm_score.cross_entropy_difference(table(spark, sf_dir, "documents"), target)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share 85 % of their four-word shingles: their sets' sizes and components."""
    return ngram_jaccard_join(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\v\f\r]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' '))
                                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
sym AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, a AS r FROM sym UNION SELECT reach.doc_id, sym.b FROM reach JOIN sym ON reach.r = sym.a),
comp AS (SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(comp.c, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN comp ON comp.doc_id = d.doc_id
"""

def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix of all sources takes."""
    return mixing.mix(mixing.sized(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\v\f\r]+')) AS size, coalesce(length(text), 0) AS chars FROM documents),
q AS (SELECT doc_id, source, size, CASE WHEN size > 0 THEN 1 / (1 + abs(chars::DOUBLE / size - 6)) ELSE 1.0::DOUBLE END AS quality FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, avg(quality) AS mean_quality FROM q GROUP BY source),
r AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM s),
p AS (SELECT *, 3 * source_size / weight AS stop FROM r),
l AS (SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER before, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
      FROM p WINDOW before AS (ORDER BY stop, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, mean_quality, least(weight * (SELECT level FROM l WHERE level <= stop ORDER BY stop, source IS NULL, source LIMIT 1), (3 * source_size)::DOUBLE) AS target FROM l),
k AS (SELECT q.*, t.source_size, t.target, -ln((('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / quality AS key
      FROM q JOIN t ON q.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
             CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM k)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       ((epochs + CASE WHEN target - epochs * source_size > 0 AND before + size / 2.0::DOUBLE <= target - epochs * source_size THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM c
"""


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages archived, read back and described."""
    return warc.archived_pages(spark, sf_dir)


OP4_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS n, sha1(b) AS h FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY n, h) AS last FROM d)
SELECT page_id, n AS payload_bytes, h AS payload_digest, CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to
FROM m
"""


def warc_header_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisits of pages under https:// and what they refer to: both filters are pushed down, so no block is inflated."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    found = warc.read_archives(spark, path, payload="false").where("record_type = 'revisit' and startswith(target_uri, 'https://')")
    page = lambda c: F.regexp_extract(c, "<urn:page:(-?[0-9]+)>", 1).try_cast("long")
    return found.select(page("record_id").alias("page_id"), "target_uri", page("refers_to").alias("refers_to"), "full_length")


WARC_HEADERS_SQL = f"SELECT page_id, url AS target_uri, refers_to, payload_bytes AS full_length FROM ({OP4_SQL}) JOIN pages USING (page_id) WHERE record_type = 'revisit' AND starts_with(url, 'https://')"


def _remainder(by: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(by))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages by centroids of the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(_remainder(4) != 2).select("doc_id", "text", "lang"))
    return langid.identify(docs, model).select("doc_id", F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 1024 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality by the discriminant of the labelled documents that are not held out."""
    shared_dir(spark)
    documents = quality.features(table(spark, sf_dir, "documents")).checkpoint()
    model = quality.train(documents.where(_remainder(5) != 0), table(spark, sf_dir, "labels"))
    return quality.score(documents, model).select("doc_id", F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts stored as lossless WebP, read back and described."""
    return webp.examine_media(webp.store_texts(table(spark, sf_dir, "documents")))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digests and spans of personal data."""
    return pii.pii_digest(table(spark, sf_dir, "documents"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of vectors with a cosine of at least 0.93."""
    return near_dedup.near_dedup(table(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
          WHERE a.n > 0 AND b.n > 0 AND list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.93),
reach AS (SELECT a AS vec_id, a AS r FROM links UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON reach.r = links.a),
comp AS (SELECT vec_id, min(r) AS c FROM reach GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS k FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n.k, 0)::BIGINT AS n_links, coalesce(comp.c, v.vec_id) AS component_id, coalesce(comp.c, v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN n ON n.vec_id = v.vec_id LEFT JOIN comp ON comp.vec_id = v.vec_id
"""

def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids, decoded texts and spans of the pieces of every document, as digests."""
    import public_tokenizers

    return sentencepieces.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of the rebuilt conversations by their first turns."""
    return prefix_trie.shared_prefixes(table(spark, sf_dir, "conversations"))


OP12_SQL = r"""
WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
             lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 4 AS h
      FROM (SELECT DISTINCT conv_id FROM o)),
lent AS (SELECT c.conv_id, o.pos AS depth, role, text FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 20 AND o.pos <= h),
m AS (SELECT c.conv_id, h, count(depth) AS m FROM c LEFT JOIN lent USING (conv_id) GROUP BY ALL),
t AS (SELECT conv_id, 0 AS depth, '' AS own, 0 AS words FROM c
      UNION ALL SELECT conv_id, depth, length(role) || ':' || role || length(text) || ':' || text, len(regexp_extract_all(text, '[^ \t\n\v\f\r]+')) FROM
        (SELECT * FROM lent UNION ALL SELECT conv_id, m + pos - h, role, text FROM o JOIN m USING (conv_id) WHERE pos > h)),
p AS (SELECT *, string_agg(own, '') OVER (PARTITION BY conv_id ORDER BY depth) AS key, max(depth) OVER (PARTITION BY conv_id) AS deepest FROM t),
u AS (SELECT *, lag(key) OVER (PARTITION BY conv_id ORDER BY depth) AS above FROM p),
n AS (SELECT depth, key, above, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = deepest), '')) AS ends_sha256 FROM u GROUP BY depth, key, above),
k AS (SELECT depth - 1 AS depth, above AS key, count(*) AS n_children FROM n GROUP BY ALL),
s AS (SELECT p.depth, p.key, sum((n.n_convs - 1) * n.words) AS saved_tokens, count(*) FILTER (k.n_children IS NULL) AS n_leaves
      FROM n LEFT JOIN k USING (depth, key) JOIN p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY ALL)
SELECT n.conv_id, n.depth, a.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM n JOIN s USING (depth, key) LEFT JOIN k USING (depth, key) LEFT JOIN n a ON a.depth = n.depth - 1 AND a.key = n.above
"""


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of two and three words of each language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\v\f\r]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS ws FROM d),
g AS (SELECT lang, array_to_string(p, ' ') AS p, len(p) AS j, count(*) AS f FROM (
        SELECT lang, unnest(list_transform(ws, lambda x: [x])) AS p FROM w
        UNION ALL SELECT lang, unnest(list_transform(range(1, len(ws)), lambda i: ws[i:i+1])) FROM w
        UNION ALL SELECT lang, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i:i+2])) FROM w) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE j = 1 GROUP BY lang),
f AS MATERIALIZED (SELECT lang, p, j, f, string_split(p, ' ') AS ws FROM g WHERE f >= 10),
cut AS MATERIALIZED (SELECT lang, p, f, 1 AS k, ws[1] AS x, array_to_string(ws[2:], ' ') AS y FROM f WHERE j > 1 UNION ALL SELECT lang, p, f, 2, ws[1] || ' ' || ws[2], ws[3] FROM f WHERE j = 3),
cuts AS (SELECT cut.lang, cut.p, cut.f, k, x.f AS l, y.f AS r, (1000000::HUGEINT * cut.f * cut.f) // (x.f::HUGEINT * y.f) AS score
         FROM cut JOIN f x ON x.lang = cut.lang AND x.p = cut.x JOIN f y ON y.lang = cut.lang AND y.p = cut.y),
s AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
o AS (SELECT lang, p, max(f) AS f FROM (SELECT lang, ws[1] || ' ' || ws[2] AS p, f FROM f WHERE j = 3 UNION ALL SELECT lang, ws[2] || ' ' || ws[3], f FROM f WHERE j = 3) GROUP BY ALL),
r AS (SELECT s.lang, s.p AS phrase, s.f AS a, l, r, score FROM s LEFT JOIN o ON o.lang = s.lang AND o.p = s.p WHERE o.f IS NULL OR 100 * o.f < 50 * s.f)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM r JOIN n USING (lang) QUALIFY rank <= 2000
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_mixing": op3_mixing,
    "op4_warc": op4_warc,
    "warc_header_search": warc_header_search,
    "op5_language_id": op5_language_id,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_quality": op7_quality,
    "op8_media_columns": op8_media_columns,
    "op9_pii": op9_pii,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_collocations": op13_collocations,
}

SQL: dict[str, str] = {
    "op2_ngram_jaccard_join": OP2_SQL,
    "op3_mixing": OP3_SQL,
    "op4_warc": OP4_SQL,
    "warc_header_search": WARC_HEADERS_SQL,
    "op10_embedding_near_dedup": OP10_SQL,
    "op12_prefix_trie": OP12_SQL,
    "op13_collocations": OP13_SQL,
}
