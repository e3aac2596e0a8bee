"""From raw documents to packed training sequences: five stages, each written and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept.  All but the last return the columns
of documents.  The result cannot be written in SQL: a learned model and a tokenizer decide.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import kernel, langid, mixing, packing, pii
from rankloom.llm.ngram_join import ngram_jaccard_join
from rankloom.session import saved, shared_dir, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, from centroids of the labelled ones."""
    return langid.keep_identified(docs, langid.train(docs.select("doc_id", "text", "lang")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group linked by a Jaccard similarity of 0.8 of five-word shingles; one row a doc_id.

    Rows without a doc_id belong to no group and stay.
    """
    found = saved(ngram_jaccard_join(docs, k=5, num=80, den=100))
    others = found.where("doc_id != component_id").select(F.col("doc_id").alias("other_id")).distinct()
    bitmap = spark.sparkContext.broadcast(kernel.id_bitmap(others))
    doubtful = kernel.rows_with_id(docs, bitmap)  # only these texts move
    kept = kernel.rows_with_id(docs, bitmap, inside=False).unionByName(doubtful.join(others, doubtful["doc_id"] == others["other_id"], "left_anti"))
    if not found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").take(1):
        return kept
    return kept.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.where("doc_id is null"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts replaced."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_copies),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
