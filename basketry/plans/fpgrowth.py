"""M-4: the same query through Spark ML's distributed FP-growth."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.operators.levels import only
from basketry.operators.support import item_support, support_filter
from basketry.session import write_table
from basketry.sources.baskets import BasketData


def basket_arrays(data: BasketData, min_support: float) -> DataFrame:
    """``(basket, items)`` with every basket, empty ones included (FP-growth
    takes N from the row count).  Items are pruned to the frequent ones
    before they are grouped: no basket array exceeds F items, and the
    FP-trees only hold items that can be in a result."""
    l1 = write_table(support_filter(item_support(data.occ), min_support, n=data.n), "items")
    arr = only(data.occ, l1, key="item").groupBy("basket").agg(
        F.collect_list("item").alias("items"))
    return data.keys.join(arr, "basket", "left").select(
        "basket", F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def fpgrowth_itemsets(data: BasketData, min_support: float, max_len=None) -> DataFrame:
    b = basket_arrays(data, min_support).select(F.array_distinct("items").alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=float(min_support),
                     minConfidence=1.0).fit(b)
    out = model.freqItemsets.select(
        F.concat_ws(" ", F.sort_array("items")).alias("itemset"),
        F.size("items").cast("int").alias("size"),
        F.col("freq").cast("bigint").alias("freq"))
    if max_len is not None:
        out = out.where(F.col("size") <= max_len)
    return out
