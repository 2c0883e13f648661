"""P-11 / P-12: dictionary coding of frequent items.

Codes are dense and follow string order of the items, so a sorted array of
codes decodes to a sorted list of items and itemsets never need a re-sort.
The dictionary holds frequent items only, at most occurrences / (s * N).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.operators.positions import with_positions


def item_dictionary(items: DataFrame) -> DataFrame:
    """``items(item, ...)`` (distinct items) with ``code BIGINT`` = rank - 1
    (dense, see operators/positions.py)."""
    return with_positions(items, ["item"], "code")


def decode_itemsets(coded: DataFrame, dictionary: DataFrame, part_cols=(),
                    keep_items: bool = False) -> DataFrame:
    """``(*part, items ARRAY<BIGINT>, freq)`` -> ``(*part, itemset, size, freq)``.

    Explode, look the codes up, and regroup per itemset; a group holds the k
    items of one itemset.
    """
    exploded = coded.select(*part_cols, "items", "freq",
                            F.posexplode("items").alias("pos", "code"))
    named = exploded.join(dictionary.select("code", "item"), "code")
    grouped = named.groupBy(*part_cols, "items", "freq").agg(
        F.sort_array(F.collect_list(F.struct("pos", "item"))).alias("_p"))
    return grouped.select(
        *part_cols, *(["items"] if keep_items else []),
        F.concat_ws(" ", F.transform("_p", lambda x: x["item"])).alias("itemset"),
        F.size("items").cast("int").alias("size"),
        F.col("freq").cast("bigint").alias("freq"),
    )


def codes_key(items) -> F.Column:
    """The coded itemset as text, e.g. ``"0 5"`` (for inspection)."""
    return F.concat_ws(" ", F.transform(F.col(items) if isinstance(items, str) else items,
                                        lambda c: c.cast("string")))
