"""Plan shape: the properties the design relies on at scale."""

from basketry.operators import levels as LV
from basketry.operators.support import itemset_support
from basketry.plans import apriori
from basketry.sources import fixtures as FX
from basketry.sources import text as TX
from data_dirs import SF0001


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_small_tables_broadcast_by_their_bytes(spark):
    """A written level table is broadcast because its bytes are few, and
    shuffled when they are not; no row count and no hint decides."""
    data = FX.user_day_event(spark, SF0001)
    res = apriori.mine_levels(data.occ, 0.005, n=data.n, keep_occurrences=True, max_len=2)
    kept = LV.only(res.occurrences[1], res.levels[1])
    assert "BroadcastHashJoin" in plan(kept)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(LV.only(res.occurrences[1], res.levels[1]))
        assert "SortMergeJoin" in p and "BroadcastHashJoin" not in p
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_counts_combine_before_the_shuffle(spark):
    data = FX.user_day_event(spark, SF0001)
    res = apriori.mine_levels(data.occ, 0.005, n=data.n, max_len=1)
    counts = itemset_support(LV.extend(LV.first_level(res.occ1), res.occ1))
    assert "partial_count" in plan(counts)


def test_scan_pushes_column_pruning(spark):
    p = plan(FX.order_brand(spark, SF0001).rows)
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in p
    assert "ReadSchema: struct<p_partkey:bigint,p_brand:string>" in p


def test_first_file_missing_path(spark, tmp_path):
    assert TX.first_file(spark, str(tmp_path / "nope")) is None


def test_first_and_whole_files(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.txt").write_text("x y\nz\n")
    (d / "b.txt").write_text("q\n")
    assert TX.first_file(spark, str(d)).endswith("a.txt")
    assert [r["value"] for r in TX.scan_first_file(spark, str(d)).collect()] == ["x y", "z"]
    whole = {r["file_name"]: r["value"] for r in TX.scan_whole_files(spark, str(d)).collect()}
    assert whole == {"a.txt": "x y\nz\n", "b.txt": "q\n"}


def test_line_numbers_follow_file_order(spark, tmp_path):
    p = tmp_path / "lines.txt"
    p.write_text("".join(f"l{i}\n" for i in range(50)))
    rows = TX.line_numbers(TX.scan_text(spark, str(p))).collect()
    assert sorted((r["line_no"], r["value"]) for r in rows) == [(i, f"l{i}") for i in range(50)]


def test_read_backs(spark, tmp_path):
    df = spark.createDataFrame([("a b", 2, 3), ("c", 1, 5)], "itemset string, size int, freq bigint")
    TX.write_counts(df, str(tmp_path / "c"))
    got = sorted(tuple(r) for r in TX.read_counts(spark, str(tmp_path / "c")).collect())
    assert got == [("a b", 3), ("c", 5)]
    cands = sorted(r["items"] for r in TX.read_candidates(spark, str(tmp_path / "c")).collect())
    assert cands == [["a", "b"], ["c"]]


def test_text_baskets_first_file_only(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.txt").write_text("x y\nx\n")
    (d / "b.txt").write_text("y\ny\ny\n")
    assert TX.text_baskets(spark, str(d)).n == 5
    only = TX.text_baskets(spark, str(d), first_file_only=True)
    assert only.n == 2
    from basketry import frequent_itemsets
    got = sorted((r["itemset"], r["freq"]) for r in frequent_itemsets(only, 1.0).collect())
    assert got == [("x", 2)]


def test_text_chunks_in_line_order(spark, tmp_path):
    """Text to contiguous chunks: blank lines kept, line order in every chunk
    read back from its part files in name order."""
    import glob
    lines = [f"l{i}" if i % 5 else "" for i in range(103)]
    (tmp_path / "in.txt").write_text("".join(x + "\n" for x in lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        chunks = TX.text_chunks(spark, str(tmp_path / "in.txt"), 4)
        TX.write_chunks(chunks, str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = []
    for c in range(4):
        files = sorted(glob.glob(f"{tmp_path}/out/chunk_id={c}/part-*"))
        text = "".join(open(f).read() for f in files)
        got.append(text.splitlines())
    assert got == [lines[0:26], lines[26:52], lines[52:78], lines[78:103]]
    whole = TX.scan_whole_files(spark, str(tmp_path / "out"))
    assert {"file_name", "value", "chunk_id"} <= set(whole.columns)


def test_prune_candidates(spark):
    """Candidates with an infrequent subset go; the rest stay."""
    level = spark.createDataFrame([([1, 2],), ([1, 3],), ([2, 3],), ([1, 4],), ([3, 4],)],
                                  "items array<bigint>")
    cand = LV.candidate_gen(level)
    assert sorted(r["items"] for r in cand.collect()) == [[1, 2, 3], [1, 2, 4], [1, 3, 4]]
    kept = LV.prune_candidates(cand, level, 2)
    assert sorted(r["items"] for r in kept.collect()) == [[1, 2, 3], [1, 3, 4]]


def test_work_tables_are_deleted(spark, tmp_path):
    """After a mining run only its result and the baskets are left."""
    import glob
    import os
    from basketry import frequent_itemsets, session
    root = session._root(spark).removeprefix("file:")
    before = set(glob.glob(f"{root}/*"))
    data = FX.user_day_event(spark, SF0001)
    for strategy in ("apriori", "son", "fpgrowth"):
        frequent_itemsets(data, 0.05, strategy=strategy)
    left = [os.path.basename(x) for x in set(glob.glob(f"{root}/*")) - before]
    assert sorted(x.split("-")[0] for x in left) == ["baskets", "itemsets", "itemsets", "itemsets"]
