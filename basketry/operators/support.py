"""Support counting and support filters.

Counts are ``count(*)`` over distinct ``(basket, item...)`` occurrences, so
Spark's partial hash aggregate combines map-side before the shuffle by key:
a hot item or itemset becomes one row per map task, never a hot reduce task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Local (per chunk) thresholds are widened by the larger of an
# absolute and a relative amount, so that rounding in double (0.07 * 100 =
# 7.000000000000001, and the spacing of doubles above 1e10) never drops a
# candidate that is globally frequent (Q6).  Final filters use no slack.
LOCAL_SLACK = 1e-6
LOCAL_SLACK_SHARE = 1e-9


def check_support(min_support: float) -> float:
    s = float(min_support)
    if not (0.0 < s <= 1.0):
        raise ValueError(f"min_support must be in (0, 1], got {min_support!r}")
    return s


def item_support(occ: DataFrame, part_cols=()) -> DataFrame:
    """A-1: baskets containing each item, optionally per chunk."""
    return occ.groupBy(*part_cols, "item").agg(F.count(F.lit(1)).alias("freq"))


def itemset_support(occ_k: DataFrame, part_cols=(), key: str = "items") -> DataFrame:
    """A-2/A-3: baskets containing each itemset (rows of ``occ_k`` are
    distinct ``(basket, itemset)`` pairs)."""
    return occ_k.groupBy(*part_cols, key).agg(F.count(F.lit(1)).alias("freq"))


def local_threshold(min_support: float, n: Column) -> Column:
    """``s * n`` less the slack, in double."""
    t = F.lit(float(min_support)) * n.cast("double")
    return t - F.greatest(F.lit(LOCAL_SLACK), F.lit(LOCAL_SLACK_SHARE) * t)


def support_filter(counts: DataFrame, min_support: float, n=None, sizes=None,
                   part_cols=()) -> DataFrame:
    """F-1..F-4: keep ``freq >= s * n`` computed in double (Q1).

    The global form takes the scalar ``n``.  The local form joins the chunk
    size table ``sizes(*part_cols, n)``, one row per chunk, and allows the
    local slack.
    """
    if sizes is None:
        return counts.where(F.col("freq") >= F.lit(float(min_support))
                            * F.lit(int(n)).cast("double"))
    joined = counts.join(sizes.select(*part_cols, "n"), list(part_cols))
    return joined.where(F.col("freq") >= local_threshold(min_support, F.col("n"))).drop("n")


def support_lookup(candidates: DataFrame, counts: DataFrame, key: str = "items") -> DataFrame:
    """JN-7: the support of each candidate, 0 when it was never seen."""
    return candidates.join(counts.select(key, "freq"), key, "left").select(
        *candidates.columns, F.coalesce("freq", F.lit(0)).cast("bigint").alias("freq"))
