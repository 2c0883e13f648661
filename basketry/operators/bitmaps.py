"""A-3 in vertical form: the baskets of an item as bitmaps.

Baskets are numbered; an item's baskets are bitmaps of one bucket of numbers
each (Spark's bitmap aggregates), so a hot item is many small rows, spread by
bucket.  The support of an itemset is the number of common bits of its items'
bitmaps, bucket by bucket: baskets are neither joined nor enumerated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.session import write_table


def item_bitmaps(occ1: DataFrame) -> DataFrame:
    """``occ1(basket, code)`` (distinct rows) -> ``(code, bucket, bits)``.
    A basket's number is the place of its row of items in a written table."""
    baskets = write_table(occ1.groupBy("basket").agg(F.collect_list("code").alias("codes"))
                          .select("codes"), "baskets")
    number = F.col("_row") + 1  # buckets hold the numbers from 1 on
    return baskets.select(F.monotonically_increasing_id().alias("_row"), "codes").select(
        "_row", F.explode("codes").alias("code")).groupBy(
        "code", F.bitmap_bucket_number(number).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits"))


def bitmap_support(bitmaps: DataFrame, itemsets: DataFrame) -> DataFrame:
    """``(items, freq)`` of ``itemsets(items)`` (distinct) that some basket
    holds.  A bucket counts where every item of the set has bits in it."""
    parts = itemsets.select("items", F.explode("items").alias("code")).join(bitmaps, "code")
    common = parts.groupBy("items", "bucket").agg(
        F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("_n")).where(
        F.col("_n") == F.size("items"))
    return common.groupBy("items").agg(F.sum(F.bitmap_count("bits")).alias("freq")).where("freq > 0")


def extensions(level: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(items)``: the sets of ``level`` extended by every larger item that
    some basket holds together with their last one (``pairs(items)``: all
    pairs that occur)."""
    last = level.select("items", F.element_at("items", -1).alias("_a"))
    more = pairs.select(F.col("items")[0].alias("_a"), F.col("items")[1].alias("_x"))
    return last.join(more, "_a").select(F.concat("items", F.array("_x")).alias("items"))
