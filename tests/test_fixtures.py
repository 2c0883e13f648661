"""Hand and edge fixtures (FIXTURES §1, §2)."""

import pytest
from pyspark.sql import functions as F

from basketry import frequent_itemsets
from basketry.operators.positions import assign_chunks
from basketry.sources import text as TX
from basketry.sources.baskets import from_arrays, from_table

HAND = ["a b c", "a b", "a c", "b c", "a b c d", "", "a  b", "d d"]
HAND_REPORT = ["8", "a (5)", "b (5)", "a b (4)", "c (4)", "a c (3)", "b c (3)",
               "a b c (2)", "d (2)"]
STRATEGIES = [("apriori", {}), ("son", {"chunks": 1}), ("son", {"chunks": 3}),
              ("son", {"chunks": 4, "chunking": "contiguous"}), ("fpgrowth", {})]


def triples(df):
    return sorted((r["itemset"], r["size"], r["freq"]) for r in df.collect())


@pytest.mark.parametrize("strategy,kw", STRATEGIES)
def test_hand_fixture(spark, text_file, strategy, kw):
    data = TX.text_baskets(spark, text_file(HAND))
    assert data.n == 8
    res = frequent_itemsets(data, 0.25, strategy=strategy, **kw)
    lines = TX.report_lines(res).orderBy("line_no").collect()
    assert [r["value"] for r in lines] == HAND_REPORT
    assert [r["line_no"] for r in lines] == list(range(9))


def test_report_written_and_read_back(spark, text_file, tmp_path):
    res = frequent_itemsets(TX.text_baskets(spark, text_file(HAND)), 0.25)
    out = str(tmp_path / "report")
    TX.write_report(res, out)
    import glob
    text = "".join(open(f, encoding="utf-8").read()
                   for f in sorted(glob.glob(out + "/part-*")))
    assert text.splitlines() == HAND_REPORT
    back = TX.read_report(spark, out)
    assert triples(res.select("itemset", "freq").withColumn("size", F.lit(0))) == \
        triples(back.withColumn("size", F.lit(0)))


def _arrays(spark, baskets):
    df = spark.createDataFrame([(i, b) for i, b in enumerate(baskets)],
                               "basket bigint, items array<string>")
    return from_arrays(df, "basket", "items")


@pytest.mark.parametrize("strategy,kw", STRATEGIES)
def test_round_local(spark, strategy, kw):
    # 0.07 * 100 = 7.000000000000001 in double: 7 of 100 is not frequent (Q1).
    data = _arrays(spark, [["x"]] * 7 + [["y"]] * 93)
    assert triples(frequent_itemsets(data, 0.07, strategy=strategy, **kw)) == [("y", 1, 93)]


@pytest.mark.parametrize("chunking", ["hash", "contiguous"])
def test_round_son(spark, chunking):
    # 5 chunks x 100 baskets, 7 hits each: locally 7 < 7.000000000000001 but
    # globally 35 >= 35.0 -- the local slack keeps the candidate (Q6).
    baskets = [["x"] if i % 100 < 7 else ["y"] for i in range(500)]
    data = _arrays(spark, baskets)
    want = [("x", 1, 35), ("y", 1, 465)]
    assert triples(frequent_itemsets(data, 0.07, strategy="son", chunks=5,
                                     chunking=chunking)) == want
    assert triples(frequent_itemsets(data, 0.07)) == want


def test_chunk_layout(spark):
    keys = spark.range(10).withColumnRenamed("id", "basket")
    sizes = lambda p: [r["n"] for r in assign_chunks(keys, ["basket"], p).groupBy(
        "chunk_id").count().withColumnRenamed("count", "n").orderBy("chunk_id").collect()]
    assert sizes(4) == [3, 3, 3, 1]
    assert sizes(6) == [2, 2, 2, 2, 2]  # sixth chunk empty


def test_chunk_positions_contiguous(spark):
    keys = spark.range(10).withColumnRenamed("id", "basket")
    rows = assign_chunks(keys, ["basket"], 4).orderBy("basket").collect()
    assert [r["pos"] for r in rows] == list(range(10))
    assert [r["chunk_id"] for r in rows] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3]


@pytest.mark.parametrize("strategy,kw", STRATEGIES)
def test_empty(spark, text_file, strategy, kw):
    data = TX.text_baskets(spark, text_file([]))
    assert data.n == 0
    res = frequent_itemsets(data, 0.5, strategy=strategy, **kw)
    assert res.count() == 0
    assert [r["value"] for r in TX.report_lines(res).collect()] == ["0"]


def test_blank_lines(spark, text_file):
    data = TX.text_baskets(spark, text_file(["a", "", "", "a"]))
    assert data.n == 4
    assert frequent_itemsets(data, 0.6).count() == 0
    assert triples(frequent_itemsets(data, 0.5)) == [("a", 1, 2)]


def test_tabs(spark, text_file):
    data = TX.text_baskets(spark, text_file(["a\tb", "a\tb"]))
    assert triples(frequent_itemsets(data, 1.0)) == [("a", 1, 2), ("a b", 2, 2), ("b", 1, 2)]


@pytest.mark.parametrize("s", [0, -1, 1.5])
def test_bad_support(spark, text_file, s):
    data = TX.text_baskets(spark, text_file(["a"]))
    with pytest.raises(ValueError):
        frequent_itemsets(data, s)


def test_unknown_strategy(spark, text_file):
    with pytest.raises(ValueError):
        frequent_itemsets(TX.text_baskets(spark, text_file(["a"])), 0.5, strategy="nope")


def test_local_slack_is_relative(spark):
    """0.07 of 3 * 327453147300 baskets: enough in all, and in no chunk by
    plain double arithmetic; the relative slack keeps it."""
    from basketry.operators.support import support_filter
    n = 327453147300
    hits = 22921720311  # 0.07 * n rounds above it
    assert 3 * hits >= 0.07 * (3 * n) and hits < 0.07 * n - 1e-6
    counts = spark.createDataFrame([(0, "x", hits)], "chunk_id int, item string, freq bigint")
    sizes = spark.createDataFrame([(0, n)], "chunk_id int, n bigint")
    assert support_filter(counts, 0.07, sizes=sizes, part_cols=["chunk_id"]).count() == 1


ODD = [(None, "a"), (None, "b"), (1, "c"), (1, "a"), (2, None), (2, ""), (3, "a"), (3, "a")]


@pytest.mark.parametrize("strategy,kw", STRATEGIES)
def test_null_keys_and_items(spark, strategy, kw):
    """Null keys are no baskets, null and empty items are skipped, their
    basket counts, in both adapters and all strategies."""
    table = spark.createDataFrame(ODD, "k int, item string")
    arrays = spark.createDataFrame([(None, ["a", "b"]), (1, ["c", "a"]), (2, [None, ""]), (3, ["a", "a"])],
                                   "k int, items array<string>")
    for data in (from_table(table, "k", "item"), from_table(table, ["k"], "item"),
                 from_arrays(arrays, "k", "items")):
        assert data.n == 3
        assert triples(frequent_itemsets(data, 0.3, strategy=strategy, **kw)) == [
            ("a", 1, 2), ("a c", 2, 1), ("c", 1, 1)]


def test_items_with_whitespace(spark):
    table = spark.createDataFrame([(1, "a b"), (1, "c")], "k int, item string")
    arrays = spark.createDataFrame([(1, ["a b", "c"])], "k int, items array<string>")
    for make in (lambda **k: from_table(table, "k", "item", **k),
                 lambda **k: from_arrays(arrays, "k", "items", **k)):
        with pytest.raises(Exception, match="item contains whitespace: a b"):
            frequent_itemsets(make(), 1.0).collect()
        assert triples(frequent_itemsets(make(replace_ws="_"), 1.0)) == [
            ("a_b", 1, 1), ("a_b c", 2, 1), ("c", 1, 1)]


@pytest.mark.parametrize("strategy,kw", STRATEGIES)
def test_line_ids_do_not_follow_splits(spark, tmp_path, strategy, kw):
    """Baskets and occurrences come from one written table, so another split
    size between two reads changes nothing."""
    for i in range(6):
        (tmp_path / f"{i}.txt").write_text("a b\nc\n" * 175)
    data = TX.text_baskets(spark, str(tmp_path))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        assert data.n == 2100
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
        got = triples(frequent_itemsets(data, 0.4, strategy=strategy, **kw))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [("a", 1, 1050), ("a b", 2, 1050), ("b", 1, 1050), ("c", 1, 1050)]
