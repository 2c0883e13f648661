"""Registered queries ``opN_<name>``: each operator over its whole table with
production parameters, and the SQL of those that DuckDB can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

#: Fixed rule set of the url query.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"),
             ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"),
             ("block", "com", "/de/")]
TOKEN_LIMIT = 1024
END_ID = 1


def tokenizer_file(name: str) -> str:
    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark, sf_dir):
    from basketry.llm.url_filter import judge_urls
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    return judge_urls(_table(spark, sf_dir, "pages"), rules)


def op2_token_counts(spark, sf_dir):
    from basketry.llm.token_counts import count_tokens
    return count_tokens(_table(spark, sf_dir, "documents"),
                        tokenizer_file("byte_bpe_50k.json"), TOKEN_LIMIT)


def op3_decontamination(spark, sf_dir):
    from basketry.llm.decontaminate import find_leaks
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_suffix_lm(spark, sf_dir):
    from basketry.llm.suffix_lm import score
    return score(_table(spark, sf_dir, "documents"))


def op5_secret_scan(spark, sf_dir):
    from basketry.llm.secrets import scan
    return scan(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"),
                public_tokenizers.PATTERN)


def op6_near_dup(spark, sf_dir):
    from basketry.llm.near_dup import NearDupParams, near_duplicates
    return near_duplicates(_table(spark, sf_dir, "documents"), NearDupParams(shingle=4)).drop(
        "tkey", "node")


def op7_token_orc(spark, sf_dir):
    from basketry.llm.token_orc import token_file_rows
    return token_file_rows(_table(spark, sf_dir, "documents"),
                           tokenizer_file("word_bpe_49k.json"), END_ID)


def op8_suffix_dedup(spark, sf_dir):
    from basketry.llm.repeats import remove_repeats
    return remove_repeats(_table(spark, sf_dir, "documents"), 200)


def op9_bpe_reuse(spark, sf_dir):
    from basketry.llm.bpe_reuse import digests
    return digests(_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op10_quality_rules(spark, sf_dir):
    from basketry.llm.quality import judge
    return judge(_table(spark, sf_dir, "documents"))


def op11_whitening(spark, sf_dir):
    from basketry.llm.whitening import whiten
    return whiten(_table(spark, sf_dir, "embeddings"))


def op12_license_scan(spark, sf_dir):
    from basketry.llm.licenses import scan
    return scan(_table(spark, sf_dir, "documents"))


def op13_fill_middle(spark, sf_dir):
    from basketry.llm.fill_middle import digests
    return digests(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_url_filter, op2_token_counts, op3_decontamination, op4_suffix_lm, op5_secret_scan,
    op6_near_dup, op7_token_orc, op8_suffix_dedup, op9_bpe_reuse, op10_quality_rules,
    op11_whitening, op12_license_scan, op13_fill_middle)}
