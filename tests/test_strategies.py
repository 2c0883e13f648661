"""Three-way agreement and the levelwise edge cases on the test tables."""

import pytest
from pyspark.sql import functions as F

from basketry import frequent_itemsets
from basketry.sources import fixtures as FX
from data_dirs import SF0001, SF001


def triples(df):
    return sorted((r["itemset"], r["size"], r["freq"]) for r in df.collect())


# SON needs chunks big enough that s * n_c is not tiny:
# doc_tokens has 200 documents at sf0.001, so 10 chunks would be 20 each.
@pytest.mark.parametrize("fixture,s,sizes,chunks", [
    ("order_brand", 0.02, [25, 159], (1, 4, 10)),
    ("user_day_event", 0.005, [5, 10, 10, 5, 1], (1, 4, 10)),
    ("doc_tokens", 0.4, [17, 47, 73, 57, 22, 3], (1, 4)),
])
def test_strategies_agree(spark, fixture, s, sizes, chunks):
    data = getattr(FX, fixture)(spark, SF0001)
    base = triples(frequent_itemsets(data, s))
    by_size = [sum(1 for t in base if t[1] == k) for k in range(1, len(sizes) + 1)]
    assert by_size == sizes
    assert triples(frequent_itemsets(data, s, strategy="fpgrowth")) == base
    for p in chunks:
        assert triples(frequent_itemsets(data, s, strategy="son", chunks=p)) == base


def test_long_set_and_max_len(spark):
    data = FX.user_day_event(spark, SF001)
    res = triples(frequent_itemsets(data, 0.005))
    five = [t for t in res if t[1] == 5]
    assert len(five) == 1 and five[0][2] == 27
    capped = triples(frequent_itemsets(data, 0.005, max_len=4))
    assert capped == [t for t in res if t[1] <= 4]
    assert triples(frequent_itemsets(data, 0.005, max_len=4, strategy="son")) == capped
    assert triples(frequent_itemsets(data, 0.005, max_len=4, strategy="fpgrowth")) == capped


@pytest.mark.parametrize("strategy", ["apriori", "son"])
def test_shuffled_and_skewed_joins_same_result(spark, strategy):
    """Nothing broadcast, and every basket and itemset treated as skewed."""
    data = FX.doc_tokens(spark, SF0001)
    want = triples(frequent_itemsets(data, 0.4))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.01",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        assert triples(frequent_itemsets(data, 0.4, strategy=strategy, chunks=2)) == want
    finally:
        for k in conf:
            spark.conf.unset(k)


def test_son_uses_the_chunks_asked_for(spark, monkeypatch):
    """Small chunks make no candidates of globally rare items."""
    from basketry.plans import son
    data = FX.order_brand(spark, SF0001)
    want = triples(frequent_itemsets(data, 0.02, max_len=2))
    ch, local, cand, totals = son.son_levels(data, 0.02, 100, max_len=2)
    assert ch.keys.select("chunk_id").distinct().count() == 100
    ones = {r["itemset"] for r in local.itemsets().where("size = 1").collect()}
    assert ones == {t[0] for t in want if t[1] == 1}
    assert triples(frequent_itemsets(data, 0.02, max_len=2, strategy="son", chunks=100)) == want


def test_itemsets_are_sorted_and_canonical(spark):
    res = frequent_itemsets(FX.doc_lines(spark, SF0001), 0.05).collect()
    for r in res:
        items = r["itemset"].split(" ")
        assert items == sorted(items) and len(set(items)) == len(items) == r["size"]


@pytest.mark.parametrize("chunks,chunking", [(4, "contiguous"), (10, "hash")])
def test_son_candidates_cover_result(spark, chunks, chunking):
    """SURVEY §5: the SON candidate set contains every frequent itemset, and
    pass 2 counts equal the direct counts."""
    from basketry.operators.dictionary import decode_itemsets
    from basketry.plans import son
    data = FX.user_day_event(spark, SF0001)
    ch, local, cand, totals = son.son_levels(data, 0.05, chunks, chunking=chunking,
                                             order_cols=["basket.user_id", "basket.day"])
    names = decode_itemsets(cand.select("items", F.lit(0).cast("bigint").alias("freq")),
                            local.dictionary)
    cands = {r["itemset"] for r in names.collect()}
    result = triples(frequent_itemsets(data, 0.05))
    assert {t[0] for t in result} <= cands
    counted = {r["itemset"]: r["freq"] for r in
               decode_itemsets(totals, local.dictionary).collect()}
    assert all(counted[t[0]] == t[2] for t in result)
