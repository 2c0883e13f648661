"""basketry: frequent-itemset mining expressed as Spark DataFrame programs.

Public entry point is :func:`basketry.plans.miner.frequent_itemsets`; the
individual steps live in ``sources`` (scans, adapters, read-backs),
``functions`` (column expressions), ``operators`` (DataFrame -> DataFrame
steps) and ``plans`` (the Apriori, SON and FP-growth strategies).
"""

from basketry.plans.miner import frequent_itemsets  # noqa: F401

__all__ = ["frequent_itemsets"]
