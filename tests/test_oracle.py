"""Registered queries against their DuckDB oracle SQL (sf0.001; the driver
runs all of them at sf0.01)."""

import pytest

import __spark_entry__ as E
from data_dirs import SF0001
from oracle_check import compare, duck

FAST = ["order_brand_itemsets", "apriori_itemsets", "son_frequent_itemsets",
        "fpgrowth_itemsets", "assign_chunks", "report_lines", "basket_candidates",
        "support_lookup", "partial_candidate_counts", "scan_first_file",
        "scan_whole_files", "read_counts", "split_lines", "tokens_single_space",
        "item_dictionary", "itemset_decode", "basket_count", "prefix_groups", "text_chunks",
        "basket_candidate_items", "write_chunks_roundtrip"]


@pytest.fixture(scope="module")
def con():
    return duck(SF0001)


def test_registry_complete():
    from basketry.catalog import QUERIES
    from basketry.oracle import ORACLE
    assert set(QUERIES) == set(ORACLE) and len(QUERIES) >= 51
    assert set(QUERIES) <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    ok, info = compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], SF0001)
    assert ok, info


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["itemset", "size", "freq"]
    rows = df.collect()
    assert sum(1 for r in rows if r["size"] == 1) == 25
    assert sum(1 for r in rows if r["size"] == 2) == 159
