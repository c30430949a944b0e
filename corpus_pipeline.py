"""Corpus pipeline: from documents to token ids, in stages that each write their result for the next one.

Every stage but the last returns the columns of documents and drops all others, whatever their names. Null and empty texts
and rows without an id pass through all stages. Rows repeated under one id are scored, scanned and encoded one by one;
near copies and benchmark passages keep or drop them together.
Without labels every document scores 0.5 and stays; without benchmark items none is found; without documents the result is
empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commutelens.llm import bpe, decontam, ngram_join, quality, secrets, shared

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. It learns from the labelled documents among them."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels, quality.learnable(F.col("doc_id")))
    return quality.score(docs, model).filter("score >= 0.5").select(*COLUMNS)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies: five-word shingles, similarity of 0.8 or more."""
    return ngram_join.one_of_each(docs).select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark and n_chars after that."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether decoding them gives the text again."""
    import public_tokenizers

    coded = docs.withColumn("coded", bpe.both_ways(F.col("text"), public_tokenizers.path("byte_bpe_50k.json")))
    return coded.select(
        "doc_id",
        "lang",
        "source",
        "n_chars",
        F.col("coded.ids").alias("token_ids"),
        F.size("coded.ids").cast("bigint").alias("n_tokens"),
        (F.col("coded.decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("bpe_encoding", bpe_encoding),
]

#: No stage has a form in SQL; tests hold the pipeline against its operators' brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the result of each is written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
