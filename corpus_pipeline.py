"""A corpus pipeline of five stages, from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet and reads it
again for the next one. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from protospan.llm import langid, linededup, ngramjoin, packing, quality
from protospan.llm.store import remove_later, shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and blank ones too), or whose language is too unsure, go.

    Equal rows go or stay together. Texts of any length count whole. An empty table stays empty. If no row has a language to learn from, only documents without a letter go.
    """
    return langid.predict(docs.select(COLUMNS), langid.learn(docs)).filter("not rejected").select(COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likely to be labelled 0 go; equal rows together. Without labels of both kinds all scores are
    the share of label 1 (0.5 without any), and below the threshold all go. Null and blank texts are scored like others,
    texts of any length whole. An empty table stays empty."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.predict(docs.select(COLUMNS), quality.learn(docs, labels)).filter("predicted = 1").select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go; so do documents that have nothing else, as they are copies.

    Null and blank texts stay. Equal rows are one document and stay alike; null ids come first. Texts of any length
    count whole. An empty table stays empty.
    """
    rows = linededup.dedup_lines(docs.select(COLUMNS))
    return (
        rows.filter("n_deleted = 0 or trim(text) != ''")
        .withColumn("n_chars", F.when(F.col("n_deleted") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
        .select(COLUMNS)
    )


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that near-duplicate links join (five words, 0.8), the one with the least id stays.

    Null and blank texts and rows without an id link with nothing and stay. Of equal rows one stays; rows that
    repeat an id with another text are documents of their own.
    """
    docs = docs.select(COLUMNS)
    first = ngramjoin.ngram_classes(docs, words=5, least=80, parts=100).filter("first and doc_id is not null")
    keep = first.select(F.col("doc_id").alias("_id"), F.col("t").alias("_t")).distinct()
    known = docs.filter("doc_id is not null").withColumn("_t", F.xxhash64("text"))
    known = known.join(keep.withColumnRenamed("_t", "_u"), (F.col("doc_id") == F.col("_id")) & (F.col("_t") == F.col("_u")), "left_semi")
    rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
    once = known.groupBy("doc_id", "_t").agg(F.first("text").alias("text"), F.min(F.struct(*rest)).alias("_rest"))
    known = once.select("doc_id", "text", *[F.col(f"_rest.{c}").alias(c) for c in rest]).select(COLUMNS)
    return known.union(docs.filter("doc_id is null"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens and their places in sequences of 1024 tokens.

    Null and empty texts are one token, the end. Texts of any length count whole, in pieces. Rows that repeat an id, and
    equal rows, are packed each; null ids stay null. An empty table gives no rows. Other columns are not used.
    """
    return packing.packed_digests(docs, public_tokenizers.path("byte_bpe_50k.json"), added=True)


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("best_fit_packing", best_fit_packing),
]

#: SQL cannot express the classifiers and the tokenizer; tests compare every stage with plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = remove_later(f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
