"""The levelwise operators against brute force and by their plans: pair
hashing, hits of basket rows, prefix trees, bitmaps, chunk boundaries and line
numbers."""

import itertools
import random
import re
import threading
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry import frequent_itemsets, session
from basketry.operators import bitmaps, levels, pairs, tree
from basketry.operators.positions import chunk_size
from basketry.plans import apriori, son
from basketry.sources import fixtures as FX
from basketry.sources import text as TX
from basketry.sources.baskets import from_arrays
from data_dirs import SF0001, SF001


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def operators(df, kind):
    """Nodes of ``kind`` in the plan's tree, parts that are reused once."""
    body = plan(df)
    body = body.split("== Initial Plan ==")[-1] if "== Initial Plan ==" in body else body
    return re.findall(rf"^[\s:|+*()\d-]*({kind}\b.*)$", body, re.M)


def random_baskets(seed, n=60, items=9):
    rnd = random.Random(seed)
    weights = [rnd.random() ** 2 for _ in range(items)]
    return [[i for i in range(items) if rnd.random() < weights[i]] for _ in range(n)]


@pytest.fixture(scope="module", params=[1, 2])
def coded(request, spark):
    """Baskets in two parts, one of them given a hundred times."""
    baskets = random_baskets(request.param) + [[0, 1, 2, 5]] * 100
    rows = [(i % 2, i, c) for i, b in enumerate(baskets) for c in b]
    return baskets, spark.createDataFrame(rows, "chunk_id bigint, basket bigint, code bigint")


def brute(baskets, k, part=None):
    counts = Counter()
    for i, b in enumerate(baskets):
        if part is None or i % 2 == part:
            counts.update(itertools.combinations(b, k))
    return counts


def as_counts(df, *part):
    return {(*[r[p] for p in part], tuple(r["items"])): r["freq"] for r in df.collect()}


# -- pair hashing ------------------------------------------------------------------

@pytest.mark.parametrize("n_slots", [1 << 20, 64])
def test_pairs_by_hashing(coded, monkeypatch, n_slots):
    """No pair that reaches the count is lost, even with many pairs a slot;
    counts are exact."""
    baskets, occ1 = coded
    monkeypatch.setattr(pairs, "SLOTS", max(n_slots, pairs.BITMAP_BITS))
    if n_slots == 64:
        full = pairs.slots
        monkeypatch.setattr(pairs, "slots", lambda *a: full(*a) % 64)
    want = brute(baskets, 2)
    for least in (1, 5, 60):
        got = as_counts(pairs.pair_support(levels.basket_rows(occ1), least))
        assert {(k,) for k, n in want.items() if n >= least} <= set(got)
        assert all(want[k[0]] == n for k, n in got.items())
    got = as_counts(pairs.pair_support(levels.basket_rows(occ1, ["chunk_id"]), 3, ["chunk_id"]),
                    "chunk_id")
    for part in (0, 1):
        for k, n in brute(baskets, 2, part).items():
            assert n < 3 or got[part, k] == n


def test_pair_blocks():
    """All pairs of every basket, whatever the block."""
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array([[1, 2, 5, 9], [], [4], [2, 3]], pa.list_(pa.int64())),
                                        pa.array([3, 1, 1, 2])], ["codes", "n"])
    want = [(1, 2, 3), (1, 5, 3), (1, 9, 3), (2, 5, 3), (2, 9, 3), (5, 9, 3), (2, 3, 2)]
    assert [x for _, a, b, n in pairs.pair_blocks(batch)
            for x in zip(a.tolist(), b.tolist(), n.tolist(), strict=True)] == want
    for limit in (1, 2, 100):
        ranges = list(pairs.blocks(np.array([5, 0, 3, 1, 0]), limit))
        assert [i for i, _ in ranges] == [0, *[j for _, j in ranges[:-1]]] and ranges[-1][1] == 5


def test_light_pairs_are_no_rows(spark):
    """Pairs of doc_lines that cannot be frequent never become rows."""
    data = FX.doc_lines(spark, SF001)
    res = apriori.mine_levels(data.occ, 0.05, n=data.n, max_len=1)
    rows = session.write_table(levels.basket_rows(res.occ1), "rows")
    every = levels.extend(levels.first_level(res.occ1), res.occ1).count()
    made = pairs.pair_support(rows, 0.05 * data.n).agg(F.sum("freq")).first()[0]
    distinct = pairs.pair_support(rows, 0.05 * data.n).count()
    # rows into the exact count: the heavy pairs, summed in the task
    assert made < every and distinct < every / 2
    frequent = pairs.pair_support(rows, 0.05 * data.n).where(F.col("freq") >= 0.05 * data.n).count()
    assert distinct < 1.5 * frequent + 10


def test_pairs_of_no_baskets(spark):
    empty = spark.createDataFrame([], "codes array<bigint>, n bigint")
    assert pairs.pair_support(empty).collect() == []
    assert pairs.pair_support(spark.createDataFrame([([7],  3)], empty.schema)).collect() == []


# -- candidates and hits --------------------------------------------------------------

def test_candidates_and_pruning_take_one_join(spark):
    """At every k, also with many subsets to look up."""
    for k in (2, 3, 4):
        base = [list(c) for c in itertools.combinations(range(6), k)][:-3] + [[*range(20, 20 + k)]]
        level = spark.createDataFrame([(b,) for b in base], "items array<bigint>")
        cand = levels.prune_candidates(levels.candidate_gen(level), level, k)
        known = {tuple(b) for b in base}
        want = sorted(c for c in itertools.combinations([*range(6), *range(20, 20 + k)], k + 1)
                      if all(s in known for s in itertools.combinations(c, k)))
        assert sorted(tuple(r["items"]) for r in cand.collect()) == want
        assert len(operators(cand, r"\w*Join")) == 1
        assert not operators(levels.candidate_gen(level), r"\w*Join")


def test_hits_count_all_candidates(coded):
    baskets, occ1 = coded
    rows = session.write_table(levels.basket_rows(occ1, ["chunk_id"]), "rows")
    part = ["chunk_id"]
    hits = levels.start_hits(rows, part)
    for k in (2, 3, 4):
        sets = {(p, c) for p in (0, 1) for c, n in brute(baskets, k, p).items() if n >= 4}
        level = occ1.sparkSession.createDataFrame([(p, list(c)) for p, c in sets],
                                                  "chunk_id bigint, items array<bigint>")
        hits = session.write_table(levels.next_hits(hits, levels.prefix_groups(level, part), part), "h")
        got = as_counts(levels.hit_support(hits, part), "chunk_id")
        assert got == {(p, c): brute(baskets, k, p)[c] for p, c in sets}


def test_trimming_leaves_few_rows(spark):
    """A level's rows hold candidates only, and rows that cannot go on are
    gone: fewer than the occurrences of the level before."""
    data = FX.doc_lines(spark, SF001)
    res = apriori.mine_levels(data.occ, 0.05, n=data.n, keep_occurrences=True, max_len=3)
    rows = session.write_table(levels.basket_rows(res.occ1), "rows")
    hits = levels.next_hits(levels.start_hits(rows), levels.prefix_groups(res.levels[1]))
    cand = levels.prune_candidates(levels.candidate_gen(res.levels[1]), res.levels[1], 2)
    third = levels.next_hits(hits, levels.prefix_groups(cand))
    assert rows.count() < data.n
    assert third.count() < res.occurrences[1].count()
    held = third.select(F.explode("hits").alias("x"), "items").select(
        F.concat("items", F.array("x")).alias("items")).distinct()
    assert held.join(cand, "items", "left_anti").count() == 0


def test_levels_make_no_join_on_baskets(spark):
    data = FX.user_day_event(spark, SF0001)
    res = apriori.mine_levels(data.occ, 0.005, n=data.n)
    assert len(res.levels) == 5
    for level in res.levels[1:]:
        assert "basket#" not in plan(level) and "basket:" not in plan(level)


# -- prefix trees -----------------------------------------------------------------------

@pytest.mark.parametrize("tree_sets", [1 << 18, 7])
def test_tree_counts_every_size_in_one_pass(coded, spark, monkeypatch, tree_sets):
    baskets, occ1 = coded
    monkeypatch.setattr(tree, "TREE_SETS", tree_sets)
    sets = sorted(c for k in (1, 2, 3, 4) for c, n in brute(baskets, k).items() if n >= 6)
    sets = sorted([*sets, (3, 77), (80,)])  # items that no basket holds
    cand = spark.createDataFrame([(list(c), i) for i, c in enumerate(sets)],
                                 "items array<bigint>, id bigint")
    every = Counter(c for k in (1, 2, 3, 4) for c in brute(baskets, k).elements())
    rows = session.write_table(levels.basket_rows(occ1, least=1), "rows")
    got = as_counts(tree.contained_support(rows, cand, len(sets)))
    assert got == {(c,): every[c] for c in sets if every[c]}
    part = session.write_table(levels.basket_rows(occ1, ["chunk_id"], least=1), "rows")
    got = as_counts(tree.contained_support(part, cand, len(sets), ["chunk_id"]), "chunk_id")
    assert got == {(p, c): brute(baskets, len(c), p)[c] for p in (0, 1) for c in sets
                   if brute(baskets, len(c), p)[c]}
    held = tree.contained_sets(levels.basket_rows(occ1, basket="basket"), cand, len(sets))
    want = Counter((i, c) for i, b in enumerate(baskets) for c in sets if set(c) <= set(b))
    assert Counter((r["basket"], tuple(r["items"])) for r in held.collect()) == want


def test_tree_of_no_candidates(coded, spark):
    _, occ1 = coded
    cand = spark.createDataFrame([], "items array<bigint>, id bigint")
    assert tree.contained_support(levels.basket_rows(occ1), cand, 0).collect() == []
    assert tree.contained_sets(levels.basket_rows(occ1, basket="basket"), cand, 0).collect() == []


def test_tree_blocks(monkeypatch):
    monkeypatch.setattr(tree, "blocks", lambda sizes: pairs.blocks(sizes, 3))
    sets = [(0,), (0, 1), (0, 1, 4), (1, 4), (2, 3, 4)]
    off = np.cumsum([0, *map(len, sets)])
    t = tree.PrefixTree(off, np.array([c for s in sets for c in s]), 10)
    basket = np.array([0, 1, 2, 3, 4])
    found = sorted(int(x) for _, n in t.contained(basket, np.array([0, 5])) for x in n)
    assert found == [10, 11, 12, 13, 14]


# -- bitmaps -------------------------------------------------------------------------------

def test_bitmap_support_equals_rows(coded, spark):
    baskets, occ1 = coded
    bits = session.write_table(bitmaps.item_bitmaps(occ1.drop("chunk_id")), "bits")
    for k in (1, 2, 3, 5):
        want = brute(baskets, k)
        sets = [*want, tuple(range(50, 50 + k))]
        df = spark.createDataFrame([(list(c),) for c in sets], "items array<bigint>")
        assert as_counts(bitmaps.bitmap_support(bits, df)) == {(c,): n for c, n in want.items()}


def test_bitmaps_over_many_buckets(spark):
    """More baskets than a bucket has bits, in several partitions."""
    n = 100_000
    occ1 = spark.range(n).select(F.col("id").alias("basket"), F.explode(F.array_compact(F.array(
        *[F.when(F.col("id") % m == 0, F.lit(m).cast("bigint")) for m in (2, 3, 5, 7)]))).alias("code"))
    bits = session.write_table(bitmaps.item_bitmaps(occ1), "bits")
    sets = spark.createDataFrame([([2, 3],), ([2, 3, 5],), ([3, 7],)], "items array<bigint>")
    assert as_counts(bitmaps.bitmap_support(bits, sets)) == {
        ((2, 3),): -(-n // 6), ((2, 3, 5),): -(-n // 30), ((3, 7),): -(-n // 21)}


# -- chunks and lines -------------------------------------------------------------------------

@pytest.mark.parametrize("chunks", [1, 2, 4, 7, 50])
def test_chunks_by_boundaries(spark, chunks):
    """Baskets in order, ties by the basket; occurrences go with theirs."""
    rnd = random.Random(chunks)
    rows = [(rnd.choice([None, 1, 2, 3]), i) for i in range(41)]
    df = spark.createDataFrame([((a, b), [f"x{b % 3}", "y"]) for a, b in rows],
                               "basket struct<day:int, user:int>, items array<string>")
    data = from_arrays(df.repartition(3), "basket", "items")
    ch = son.chunk_baskets(data, chunks, "contiguous", ["basket.day"])
    order = sorted(rows, key=lambda r: (r[0] is not None, r))
    size = chunk_size(len(rows), chunks)
    want = {r: i // size for i, r in enumerate(order)}
    assert {tuple(r["basket"]): r["chunk_id"] for r in ch.keys.collect()} == want
    occ = ch.occ.collect()
    assert len(occ) == 82 and all(want[tuple(r["basket"])] == r["chunk_id"] for r in occ)
    assert {r["chunk_id"]: r["n"] for r in ch.sizes.collect()} == Counter(want.values())


def test_contiguous_chunks_join_nothing(spark, monkeypatch):
    data = FX.user_day_event(spark, SF0001)
    seen = []
    keep = son.write_table
    monkeypatch.setattr(son, "write_table", lambda df, tag="t": seen.append((tag, plan(df))) or keep(df, tag))
    son.chunk_baskets(data, 4, "contiguous", ["basket.user_id", "basket.day"])
    occ = [p for tag, p in seen if tag == "chunked"]
    assert len(occ) == 1 and "Join" not in occ[0] and "Exchange" not in occ[0].split("Subquery")[0]


def test_line_numbers_move_no_text(spark, tmp_path):
    """Many files and splits: the plan has no exchange and no sort of the
    text, and nothing of it is written."""
    for f in range(3):
        (tmp_path / f"{f}.txt").write_text("".join(f"{f}-{i}\n" if i % 7 else "\n" for i in range(40 + f)))
    want = [x for f in range(3) for x in (tmp_path / f"{f}.txt").read_text().split("\n")[:-1]]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "8")
    try:
        chunks = TX.text_chunks(spark, str(tmp_path), 5)
        rows = sorted((r["pos"], r["chunk_id"], r["value"]) for r in chunks.collect())
        size = chunk_size(len(want), 5)
        assert rows == [(i, i // size, v) for i, v in enumerate(want)]
        assert not operators(chunks, "Exchange") and not operators(chunks, "Sort")
        splits = TX._line_counts(TX.scan_text(spark, str(tmp_path)))
        assert splits.count() > 5 and "value" not in splits.columns
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    with pytest.raises(Exception, match="split in another way"):
        TX._numbered(TX.scan_text(spark, str(tmp_path)), splits).collect()


# -- scratch ----------------------------------------------------------------------------------

def test_runs_in_threads_keep_their_scratch(spark):
    """Two runs at once neither share a folder nor delete each other's."""
    data = FX.user_day_event(spark, SF0001).prepare()
    want = sorted(map(tuple, frequent_itemsets(data, 0.05).collect()))
    got, folders = {}, set()

    def mine(i):
        with session.work(spark):
            folders.add(session._work.get())
            got[i] = sorted(map(tuple, frequent_itemsets(data, 0.05).collect()))

    threads = [threading.Thread(target=mine, args=(i,)) for i in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert [got[i] for i in range(3)] == [want] * 3 and len(folders) == 3
