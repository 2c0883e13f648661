"""Basket data derived from the test tables (FIXTURES §3).

Each function reads only the columns it needs, so the parquet scan prunes
the rest.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from basketry.functions.expressions import split_lines, tokens_whitespace
from basketry.sources.baskets import BasketData, from_arrays, from_table


def table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_brand(spark: SparkSession, sf_dir: str) -> BasketData:
    """Orders as baskets of part brands (lineitem join part)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    pa = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    j = li.join(pa, li.l_partkey == pa.p_partkey)
    return from_table(j, "l_orderkey", "p_brand")


def user_day_event(spark: SparkSession, sf_dir: str) -> BasketData:
    """A user's day as a basket of event types; key is struct(user_id, day)."""
    ev = table(spark, sf_dir, "events").select(
        "user_id", F.to_date("ts").alias("day"), "event_type")
    return from_table(ev, ["user_id", "day"], "event_type")


def doc_token_arrays(spark: SparkSession, sf_dir: str):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select(F.col("doc_id").alias("basket"),
                       tokens_whitespace("text").alias("items"))


def doc_tokens(spark: SparkSession, sf_dir: str) -> BasketData:
    """A document as a basket of its whitespace tokens (whole text)."""
    return from_arrays(doc_token_arrays(spark, sf_dir), "basket", "items", tokens=True)


def doc_line_rows(spark: SparkSession, sf_dir: str):
    """Every line of every document (split on LF, all lines kept)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", F.posexplode(split_lines("text", keep_trailing=True))
                       .alias("line_no", "line"))


def doc_lines(spark: SparkSession, sf_dir: str) -> BasketData:
    """A line of a document as a basket; blank lines are empty baskets.

    The basket key is ``monotonically_increasing_id`` of the line rows:
    unique without a shuffle, and fixed once the baskets are written.
    """
    lines = doc_line_rows(spark, sf_dir)
    arr = lines.select(F.monotonically_increasing_id().alias("basket"),
                       tokens_whitespace("line").alias("items"))
    return from_arrays(arr, "basket", "items", tokens=True)
