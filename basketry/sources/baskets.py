"""Basket data: the one input form every strategy reads.

``occ`` is the long occurrence table ``(basket, item)`` with each item at
most once per basket.  It is the canonical form because it has no unbounded
rows: a basket with a million items is a million small rows, spread by the
shuffle like any other rows.  ``keys`` lists every basket, empty ones
included, since ``N`` (the support denominator) counts them too (Q2).

One contract for all sources: a null basket key is no basket, its rows are
dropped; null and empty items are skipped (P-3 skips empty tokens) but their
basket counts; an item with whitespace is an error unless a replacement is
given, since the itemset text joins items by a space.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions.expressions import WS
from basketry.session import write_table


@dataclass
class BasketData:
    """``rows(basket, items ARRAY<STRING>)`` are written once, on first use,
    and both forms read from that table: a key that depends on how the source
    was split (line ids) is then the same in both."""
    rows: DataFrame
    # Whether a basket is one row already; else rows of a key are merged.
    one_row: bool = True
    _occ: DataFrame | None = field(default=None, repr=False)
    _keys: DataFrame | None = field(default=None, repr=False)
    _n: int | None = field(default=None, repr=False)

    def prepare(self) -> "BasketData":
        if self._occ is None:
            if self.one_row:
                table = write_table(self.rows, "baskets")
                # outer explode: for the inner one the optimizer infers a
                # filter on the array's size, evaluated on its own
                self._occ = table.select("basket", F.explode_outer("items").alias("item")).where(
                    F.col("item").isNotNull())
                self._keys = table.select("basket")
            else:
                # the null item of a basket without items keeps its key
                table = write_table(self.rows.select(
                    "basket", F.explode_outer("items").alias("item")).distinct(), "baskets")
                self._occ = table.where(F.col("item").isNotNull())
                self._keys = table.select("basket").distinct()
        return self

    @property
    def occ(self) -> DataFrame:
        return self.prepare()._occ

    @property
    def keys(self) -> DataFrame:
        return self.prepare()._keys

    @property
    def n(self) -> int:
        """N: number of baskets, empty ones included (one scalar action)."""
        if self._n is None:
            self._n = self.keys.count()
        return self._n


def checked_items(items: Column, replace_ws: str | None = None) -> Column:
    """The items of an array: nulls and empty ones skipped, each once,
    whitespace replaced or refused (the job fails with the item's text)."""
    items = F.array_remove(F.array_compact(items), "")
    if replace_ws is not None:
        items = F.transform(items, lambda x: F.regexp_replace(x, WS, replace_ws))
        return F.array_distinct(F.array_remove(items, ""))
    return F.array_distinct(F.transform(items, lambda x: F.when(
        F.rlike(x, F.lit(WS)), F.raise_error(F.concat(F.lit("item contains whitespace: "), x)))
        .otherwise(x)))


def from_table(df: DataFrame, basket, item, replace_ws: str | None = None) -> BasketData:
    """Table adapter: one basket per key value, one item per row.

    ``basket`` may be a column name, a Column, or a list of columns (then the
    key is a struct, null when one of them is).  See the module for nulls.
    """
    if isinstance(basket, (list, tuple)):
        cols = [F.col(c) if isinstance(c, str) else c for c in basket]
        key, given = F.struct(*cols), F.lit(True)
        for c in cols:
            given = given & c.isNotNull()
    else:
        key = F.col(basket) if isinstance(basket, str) else basket
        given = key.isNotNull()
    it = (F.col(item) if isinstance(item, str) else item).cast("string")
    rows = df.where(given).select(key.alias("basket"), checked_items(
        F.array(it), replace_ws).alias("items"))
    return BasketData(rows, one_row=False)


def from_arrays(df: DataFrame, basket: str, items: str, replace_ws: str | None = None,
                tokens: bool = False) -> BasketData:
    """Adapter for a ``(basket, items ARRAY)`` table with distinct keys (e.g.
    token lists).  ``tokens``: the items come from a whitespace tokenizer, so
    they need no check."""
    every = F.array_distinct(items) if tokens else checked_items(F.col(items), replace_ws)
    return BasketData(df.where(F.col(basket).isNotNull()).select(
        F.col(basket).alias("basket"), every.alias("items")))
