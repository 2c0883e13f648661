"""The levelwise machinery.

Occurrences of level k are rows ``(*part, basket, items ARRAY<BIGINT>, last
BIGINT)``: one per k-itemset of interest contained in a basket.  The next
level joins them with the basket's items on the basket key, keeping items
greater than ``last`` -- JN-2 for k=1, JN-3/JN-5 above.

The miners do not make these rows.  They group a basket's frequent items to
one row once, merge equal baskets, and go up level by level inside the rows
(``basket_rows``, ``next_hits``).

All joins are plain equi-joins of written tables.  A basket or itemset that
holds a large share of the rows is a skewed key, which AQE splits over
tasks; a table of few bytes is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.expressions import itemset_last, itemset_prefix


def first_level(occ1: DataFrame, part_cols=()) -> DataFrame:
    """Level-1 occurrences of ``occ1(*part, basket, code)``."""
    return occ1.select(*part_cols, "basket", F.array("code").alias("items"),
                       F.col("code").alias("last"))


def extend(left: DataFrame, occ1: DataFrame, part_cols=()) -> DataFrame:
    """One level up: every occurrence extended by each larger item of its
    basket."""
    keys = [*part_cols, "basket"]
    right = occ1.select(*keys, F.col("code").alias("_x"))
    return left.join(right, keys).where(F.col("_x") > F.col("last")).select(
        *keys, F.concat("items", F.array("_x")).alias("items"), F.col("_x").alias("last"))


def only(occ: DataFrame, itemsets: DataFrame, part_cols=(), key: str = "items") -> DataFrame:
    """F-6 / JN-4 / JN-6: the occurrences whose key is in ``itemsets``."""
    keys = [*part_cols, key]
    return occ.join(itemsets.select(*keys), keys, "left_semi")


def split_prefix(levels: DataFrame, part_cols=()) -> DataFrame:
    """P-6 on a level table: ``(*part, prefix, last)``."""
    return levels.select(*part_cols, itemset_prefix("items").alias("prefix"),
                         itemset_last("items").alias("last"))


def prefix_groups(level: DataFrame, part_cols=()) -> DataFrame:
    """A-4: last items grouped by prefix (a group has at most F items)."""
    return split_prefix(level, part_cols).groupBy(*part_cols, "prefix").agg(
        F.sort_array(F.collect_set("last")).alias("lasts"))


def candidate_gen(level: DataFrame, part_cols=()) -> DataFrame:
    """JN-1: C_{k+1} from L_k -- two k-itemsets with the same first k-1
    items and ``last_a < last_b`` make one (k+1)-itemset (no all-subsets
    check, see ``prune_candidates``).  The itemsets of a prefix are one group,
    paired inside it: no join."""
    first = prefix_groups(level, part_cols).select(
        *part_cols, "prefix", "lasts", F.posexplode("lasts").alias("_i", "_a"))
    return first.select(*part_cols, F.concat("prefix", F.array("_a")).alias("_p"), F.explode(
        F.slice("lasts", F.col("_i") + 2, F.size("lasts"))).alias("_b")).select(
        *part_cols, F.concat("_p", F.array("_b")).alias("items"))


def prune_candidates(cand: DataFrame, level: DataFrame, k: int, part_cols=()) -> DataFrame:
    """The candidates of size ``k + 1`` all of whose k-subsets are in L_k.
    The two subsets that made a candidate are; the k - 1 others are looked up
    in one join and counted per candidate."""
    if k < 2:
        return cand
    subsets = F.transform(F.sequence(F.lit(1), F.lit(k - 1)), lambda i: F.concat(
        F.slice("items", F.lit(1), i - 1), F.slice("items", i + 1, F.lit(k + 1) - i)))
    known = level.select(*part_cols, F.col("items").alias("_sub"))
    found = cand.select(*part_cols, "items", F.explode(subsets).alias("_sub")).join(
        known, [*part_cols, "_sub"])
    return found.groupBy(*part_cols, "items").agg(F.count(F.lit(1)).alias("_n")).where(
        F.col("_n") == k - 1).drop("_n")


# -- basket rows ------------------------------------------------------------------

def basket_rows(occ1: DataFrame, part_cols=(), basket: str | None = None,
                least: int = 2) -> DataFrame:
    """``(*part, codes, n)``: the distinct lists of ``least`` or more frequent
    items that baskets hold, in code order, with their numbers of baskets
    (equal baskets are one row from here on).  A list has at most F codes.
    With ``basket`` every basket is a row of its own, under its key."""
    keys = [*part_cols, "basket"]
    rows = occ1.groupBy(*keys).agg(F.sort_array(F.collect_list("code")).alias("codes"))
    if basket is not None:
        return rows.select(*part_cols, F.col("basket").alias(basket), "codes")
    return rows.where(F.size("codes") >= least).groupBy(*part_cols, "codes").agg(
        F.count(F.lit(1)).alias("n"))


def start_hits(rows: DataFrame, part_cols=()) -> DataFrame:
    """Basket rows as hits of the empty prefix."""
    return rows.select(*part_cols, F.array().cast("array<bigint>").alias("items"),
                       F.col("codes").alias("hits"), "n")


def next_hits(hits: DataFrame, groups: DataFrame, part_cols=()) -> DataFrame:
    """JN-3 / JN-5 inside a basket row.  ``hits(*part, items, hits, n)`` says
    which last items complete ``items`` to a candidate that the baskets of the
    row hold; the result says the same one size up, for the candidates of
    ``groups(*part, prefix, lasts)``.

    A candidate's own last item and the later ones of the same row are all
    that can extend it, since every subset of a candidate is one: what no
    candidate of this size holds is gone, and rows left without a hit go too.
    No join on baskets: a row carries what its baskets still have.
    """
    one = hits.select(*part_cols, "items", "hits", "n", F.posexplode("hits").alias("_i", "_x"))
    up = one.where(F.col("_i") + 1 < F.size("hits")).select(
        *part_cols, F.concat("items", F.array("_x")).alias("prefix"),
        F.slice("hits", F.col("_i") + 2, F.size("hits")).alias("_rest"), "n")
    return up.join(groups, [*part_cols, "prefix"]).select(
        *part_cols, F.col("prefix").alias("items"),
        F.array_intersect("_rest", "lasts").alias("hits"), "n").where(F.size("hits") > 0)


def hit_support(hits: DataFrame, part_cols=()) -> DataFrame:
    """A-3: ``(*part, items, freq)`` of the candidates that rows hold."""
    return hits.select(*part_cols, "items", F.explode("hits").alias("_x"), "n").groupBy(
        *part_cols, "items", "_x").agg(F.sum("n").alias("freq")).select(
        *part_cols, F.concat("items", F.array("_x")).alias("items"), "freq")
