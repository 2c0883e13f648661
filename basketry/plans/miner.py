"""One function for all strategies (M-3, M-4, IT-1)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from basketry import session
from basketry.operators.support import check_support
from basketry.sources.baskets import BasketData


def frequent_itemsets(data: BasketData, min_support: float, max_len: int | None = None,
                      strategy: str = "apriori", chunks: int = 4,
                      chunking: str = "hash", order_cols=None) -> DataFrame:
    """Every itemset contained in at least ``min_support * N`` baskets.

    Returns ``(itemset STRING, size INT, freq BIGINT)``: items sorted and
    joined by one space, exact counts.  Strategies agree on the result:
    ``apriori`` (levelwise), ``son`` (two passes over ``chunks`` chunks,
    ``chunking`` = ``hash`` or ``contiguous`` in ``order_cols`` order) and
    ``fpgrowth`` (Spark ML).  The result is a table in the shared folder;
    what was written on the way is deleted.  ``data`` may be mined again.
    """
    s = check_support(min_support)
    if max_len is not None and max_len < 1:
        raise ValueError("max_len must be >= 1")
    if strategy not in ("apriori", "son", "fpgrowth"):
        raise ValueError(f"unknown strategy {strategy!r}")
    data.prepare()
    with session.work(data.keys.sparkSession) as keep:
        if strategy == "apriori":
            from basketry.plans.apriori import mine_levels
            out = mine_levels(data.occ, s, n=data.n, max_len=max_len).itemsets()
        elif strategy == "son":
            from basketry.plans.son import son_itemsets
            out = son_itemsets(data, s, chunks, max_len=max_len, chunking=chunking,
                               order_cols=order_cols)
        else:
            from basketry.plans.fpgrowth import fpgrowth_itemsets
            out = fpgrowth_itemsets(data, s, max_len=max_len)
        return keep(out, "itemsets")
