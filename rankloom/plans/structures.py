"""Queries: nested values, parallel folds, table functions and persisted indexes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rankloom.functions import variants
from rankloom.operators import context, vector_index
from rankloom.plans import frames
from rankloom.plans.fragments import sql
from rankloom.session import saved, shared_dir, table

QUERIES, SQL = {}, {}
#: Per cent of an index's cells that the approximate search looks into.
PROBED = 70


def query(name: str, twin: str | None):
    def keep(f):
        QUERIES[name] = f
        if twin:
            SQL[name] = twin
        return f

    return keep



#: A conversation as nested JSON, each turn inside the one after it; the properties of events; and texts, which are no JSON.
HINTS_SQL = """WITH RECURSIVE j AS (
SELECT 'conv' || conv_id AS id, list_reduce(list_prepend('{}', list('{"File-Path":' || to_json(role || '/' || turn)::VARCHAR || ',"note":{"Changed-Files":[' || to_json(text)::VARCHAR || ',' || to_json(role || '/' || turn)::VARCHAR || ']},"inner":[' ORDER BY turn)), lambda a, b: b || a || ']}') AS json FROM conversations GROUP BY conv_id
UNION ALL SELECT 'event' || event_id, props FROM events UNION ALL SELECT 'doc' || doc_id, text FROM documents),
t AS (SELECT o.id, e.key, e.value, e.type, [e.key] AS place FROM (SELECT id, json FROM j WHERE try_cast(json AS JSON) IS NOT NULL AND json_type(try_cast(json AS JSON)) = 'OBJECT') o, LATERAL (SELECT * FROM json_each(o.json)) e
UNION ALL SELECT t.id, CASE WHEN t.type = 'OBJECT' THEN e.key ELSE t.key END, e.value, e.type, list_append(place, CASE WHEN t.type = 'OBJECT' THEN e.key ELSE lpad(e.key::VARCHAR, 12, '0') END) FROM t, LATERAL (SELECT * FROM json_each(t.value)) e WHERE t.type IN ('OBJECT', 'ARRAY')),
h AS (SELECT id, value ->> '$' AS path, min(place) AS place FROM t WHERE type = 'VARCHAR' AND value ->> '$' <> '' AND regexp_matches(replace(lower(key), '-', '_'), '(file|files|path|paths|filename|filenames)$') GROUP BY ALL)
SELECT j.id, coalesce(list(path ORDER BY place, path) FILTER (path IS NOT NULL), []) AS paths FROM (SELECT DISTINCT id FROM j) j LEFT JOIN h USING (id) GROUP BY j.id"""


@query("path_hints", HINTS_SQL)
def path_hints(spark, d):
    """Paths named anywhere in JSON made of conversations, as deep as they have turns, in events' properties and in texts."""
    turns = table(spark, d, "conversations")
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("k"))), r'(?s)^\{"k":(.*)\}$', 1)
    name = quoted(F.concat_ws("/", "role", F.col("turn").cast("string")))
    part = F.concat(F.lit('{"File-Path":'), name, F.lit(',"note":{"Changed-Files":['), quoted(F.col("text")), F.lit(","), name, F.lit(']},"inner":['))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("part")))), lambda x: x["part"])
    nested = turns.groupBy("conv_id").agg(F.aggregate(parts, F.lit("{}"), lambda acc, x: F.concat(x, acc, F.lit("]}"))).alias("json"))
    rows = nested.select(F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("id"), "json")
    rows = rows.unionByName(table(spark, d, "events").select(F.concat(F.lit("event"), F.col("event_id").cast("string")).alias("id"), F.col("props").alias("json")))
    rows = rows.unionByName(table(spark, d, "documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("json")))
    return variants.path_hints(rows, "id", "json")


#: Documents and conversations as contexts: a conversation's turns are sections with headings.
SEGMENTS_SQL = r"""WITH RECURSIVE x AS (SELECT 'doc' || doc_id AS id, text FROM documents UNION ALL SELECT 'conv' || conv_id, string_agg('### ' || role || ' ' || turn || chr(10) || text, chr(10) ORDER BY turn) FROM conversations GROUP BY conv_id),
sec AS (SELECT id, generate_subscripts(parts, 1) AS sec, unnest(parts) AS section FROM (SELECT id, list_filter(regexp_split_to_array(regexp_replace(text, '(^|\n)### ', '\1' || chr(1) || '### ', 'g'), chr(1)), lambda p: p <> '') AS parts FROM x)),
c AS (SELECT id, sec, CASE WHEN starts_with(section, '### ') THEN string_split(section, chr(10))[1] ELSE '' END AS heading, section, length(section) AS n, string_split(section, '') AS ch FROM sec),
w AS MATERIALIZED (SELECT id, sec, heading, section, n, list_filter(range(0, n), lambda i: NOT contains(E' \t\n\x0b\f\r', ch[i + 1]) AND (i = 0 OR contains(E' \t\n\x0b\f\r', ch[i]))) AS starts FROM c),
f AS (SELECT id, sec, 0 AS k, 0::BIGINT AS a, 0::BIGINT AS b, 0::BIGINT AS first FROM w
  UNION ALL SELECT h.id, h.sec, h.k + 1, h.b, h.e, h.first + len(list_filter(h.near, lambda i: i < h.e)) FROM (
    SELECT g.*, CASE WHEN stop IS NULL THEN n WHEN regexp_matches(part, '[ \n]') AND length(regexp_extract(part, '(?s)^(.*)[ \n]', 1)) >= greatest(1, (stop - b) // 2) THEN b + length(regexp_extract(part, '(?s)^(.*)[ \n]', 1)) + 1 ELSE stop END AS e FROM (
      SELECT f.id, f.sec, f.k, f.b, f.first, w.n, w.starts[f.first + 1:f.first + 40] AS near, w.starts[f.first + 41] AS stop, substring(w.section, (f.b + 1)::INT, (w.starts[f.first + 41] - f.b)::INT) AS part FROM f JOIN w USING (id, sec) WHERE f.b < w.n) g) h)
SELECT f.id, 'E' || lpad(no::VARCHAR, greatest(3, length(no::VARCHAR))::INT, '0') AS segment_id, heading, len(regexp_extract_all(text, '[^ \t\n\x0b\f\r]+')) AS words, md5(text) AS digest
FROM (SELECT f.id, w.heading, substring(w.section, (a + 1)::INT, (b - a)::INT) AS text, row_number() OVER (PARTITION BY f.id ORDER BY f.sec, f.k) AS no FROM f JOIN w USING (id, sec) WHERE f.k > 0) f"""


@query("segment_table", SEGMENTS_SQL)
def segment_table(spark, d):
    """Documents and conversations in segments of at most 40 words, by the table function, called from SQL."""
    context.register_segmenter(spark)
    docs = table(spark, d, "documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("id"), "text")
    turn = F.concat(F.lit("### "), F.col("role"), F.lit(" "), F.col("turn").cast("string"), F.lit("\n"), F.col("text"))
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", turn.alias("text")))), lambda x: x["text"])
    rows = docs.unionByName(table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(turns, "\n").alias("text")).select(F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("id"), "text"))
    found = spark.sql("SELECT x.id, s.segment_id, s.heading, s.words, md5(s.text) AS digest FROM {rows} x, LATERAL segment_text(x.text, 40) s", rows=rows)
    return found


def _index(spark, d):
    path = f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}"
    vectors, asked = frames.vectors(spark, d)
    vector_index.build(vectors, path)
    return path, asked


@query("index_exact", sql("SELECT case_id, doc_id, score, rank FROM dense", "dense"))
def index_exact(spark, d):
    """The nearest vectors of every twentieth one, by the index's bounds."""
    path, asked = _index(spark, d)
    return vector_index.search(spark, path, asked).select("case_id", "doc_id", "score", "rank")


@query("index_recall", None)
def index_recall(spark, d):
    """How much of each exact ranking a search of a part of the cells finds."""
    path, asked = _index(spark, d)
    cells = spark.read.parquet(f"{path}/cells").count()
    found = vector_index.search(spark, path, asked, probes=max(1, -(-cells * PROBED // 100)))
    return vector_index.recall(found, saved(vector_index.search(spark, path, asked)))
