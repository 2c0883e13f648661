"""Properties on random baskets against a brute-force count."""

import itertools
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from basketry import frequent_itemsets
from basketry.sources.baskets import from_arrays

baskets_st = st.lists(st.lists(st.sampled_from([*"abcdef", "", None]), max_size=6),
                      min_size=1, max_size=25)


def brute(baskets, s):
    n = len(baskets)
    counts = Counter()
    for b in baskets:
        items = sorted({x for x in b if x})
        for k in range(1, len(items) + 1):
            for c in itertools.combinations(items, k):
                counts[c] += 1
    return sorted((" ".join(c), len(c), f) for c, f in counts.items() if f >= s * n)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(baskets=baskets_st, s=st.sampled_from([0.1, 0.2, 0.35, 0.5]))
def test_matches_brute_force(spark, baskets, s):
    df = spark.createDataFrame([(i, b) for i, b in enumerate(baskets)],
                               "basket bigint, items array<string>")
    data = from_arrays(df, "basket", "items")
    want = brute(baskets, s)
    for strategy, kw in (("apriori", {}), ("son", {"chunks": 3}), ("fpgrowth", {})):
        got = sorted((r["itemset"], r["size"], r["freq"])
                     for r in frequent_itemsets(data, s, strategy=strategy, **kw).collect())
        assert got == want
        # downward closure: every subset of a frequent itemset is frequent
        names = {g[0] for g in got}
        for g in got:
            items = g[0].split(" ")
            for k in range(1, len(items)):
                for c in itertools.combinations(items, k):
                    assert " ".join(c) in names


def test_independent_of_row_order(spark):
    import random
    rng = random.Random(7)
    baskets = [rng.sample(list("abcdefg"), rng.randint(0, 5)) for _ in range(60)]
    shuffled = baskets[:]
    rng.shuffle(shuffled)
    out = []
    for bs in (baskets, shuffled):
        df = spark.createDataFrame([(i * 7 + 3, b) for i, b in enumerate(bs)],
                                   "basket bigint, items array<string>")
        out.append(sorted((r["itemset"], r["freq"]) for r in frequent_itemsets(
            from_arrays(df, "basket", "items"), 0.15).collect()))
    assert out[0] == out[1] == sorted((a, f) for a, _, f in brute(baskets, 0.15))
