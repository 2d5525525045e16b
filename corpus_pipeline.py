"""From raw documents to packed training sequences, in stages that are each written and read again."""

from __future__ import annotations

import os
import sys

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sparkclean.functions.names import free_name  # noqa: E402
from sparkclean.llm import packing, quality, secret_scan, shingle_join  # noqa: E402
from sparkclean.sources.scratch import written  # noqa: E402

#: Near copies share four fifths of their five-word shingles.
SHINGLE_WORDS, LEAST_PERCENT = 5, 80


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones, doesn't reject."""
    model, score = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), free_name("score", set(docs.columns))
    return quality.score_quality(docs, model, score_col=score).where(F.col(score) >= 0.5).select(docs.columns)


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id, then the first row; null ids come last.

    Texts without words are copies of nothing. Rows are told apart by numbers that are written once, so repeated and
    null ids do no harm.
    """
    row = free_name("row", set(docs.columns))
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "pipeline-rows")  # a scan may be cut anew each time
    key = F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("id"), F.col(row).alias("row"))
    groups = shingle_join.join_shingles(numbered.select(key.alias("key"), "text"), "key", width=SHINGLE_WORDS, least=LEAST_PERCENT)
    gone = groups.where("key <> component_id").select(F.col("key.row").alias(row))
    return numbered.join(gone, row, "left_anti").select(docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mask in place of each secret, and their new numbers of characters."""
    return secret_scan.redact_secrets(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, placed in sequences of 1024 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", keep_good), ("near_copies", keep_one_of_copies), ("secrets", mask_secrets), ("packing", pack)]

#: Compression, hashing and tokenization have no SQL form; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    name, stage = STAGES[-1]
    return stage(spark, docs, sf_dir)
