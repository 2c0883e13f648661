"""A training corpus from the documents table, in five stages.

Each stage takes what the one before kept, as Parquet in the shared
checkpoint folder: quality rules drop documents and boilerplate lines, one
document of each near-duplicate group stays, documents that leak a benchmark
item go, secrets are masked, and the rest is encoded.  How a stage takes
nulls, empty and long texts, repeated rows, empty tables and other columns is
said by the operator that it calls.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from basketry import session
from basketry.llm import bpe_reuse, decontaminate, near_dup, quality, secrets
from basketry.llm.queries import tokenizer_file

#: SQL cannot express the stages; tests/llm compares them with brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids)`` of every document."""
    return bpe_reuse.encode(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates),
          ("decontamination", decontamination), ("secret_scan", secret_scan), ("bpe", bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = session.write_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
