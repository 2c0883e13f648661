"""IT-1: levelwise (Apriori) mining as a loop of DataFrame programs.

A basket's frequent items become one row of codes, and equal rows are merged
with their number (the one exchange of occurrences).  Level 2 counts pairs by
hashing (``operators/pairs.py``).  From level 3 on a row holds, for one prefix
that its baskets contain, the items that complete it to candidates of C_k
(JN-1 pruned by subsets): counts are a partial aggregate over the rows, and
the next level comes out of the same rows, without a join on baskets.  Each
level writes its hits and the next candidates by prefix.  The
driver sees row counts.

With ``part_cols=["chunk_id"]`` every key carries the chunk and every chunk
is mined at its own threshold ``s * n_c`` in the same jobs (SON pass 1).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.operators.dictionary import decode_itemsets, item_dictionary
from basketry.operators.levels import (basket_rows, candidate_gen, extend, first_level, hit_support,
                                        next_hits, only, prefix_groups, prune_candidates,
                                        start_hits)
from basketry.operators.pairs import pair_support
from basketry.operators.support import item_support, local_threshold, support_filter
from basketry.session import write_counted, write_table


@dataclass
class Levels:
    """Result of a levelwise run, all levels coded."""
    part_cols: tuple
    dictionary: DataFrame            # (item, code)
    occ1: DataFrame | None = None    # (*part, basket, code) of frequent items
    levels: list = field(default_factory=list)   # L_k: (*part, items, freq)
    occurrences: list = field(default_factory=list)  # occ_k, when asked

    def coded(self) -> DataFrame:
        out = self.levels[0]
        for lv in self.levels[1:]:
            out = out.unionByName(lv)
        return out

    def itemsets(self) -> DataFrame:
        """``(*part, itemset, size, freq)`` for every level."""
        return decode_itemsets(self.coded(), self.dictionary, list(self.part_cols))


def encode(occ: DataFrame, coded_items: DataFrame, part_cols=()) -> DataFrame:
    """F-5 + P-11: keep the occurrences of frequent items, as codes.
    ``coded_items(*part, item, code)``: with part columns an item that is
    frequent in one chunk only is kept in that chunk only."""
    on = [*part_cols, "item"]
    return occ.join(coded_items.select(*on, "code"), on).select(*part_cols, "basket", "code")


def frequent_items(occ: DataFrame, min_support: float, n=None, sizes=None, part_cols=()):
    """L1 with codes ``(*part, item, code, freq)``, its rows, the dictionary."""
    l1 = support_filter(item_support(occ, part_cols), min_support, n=n, sizes=sizes,
                        part_cols=part_cols)
    if not part_cols:
        coded, rows = write_counted(item_dictionary(l1), "items")
        return coded, rows, coded.select("item", "code")
    l1, rows = write_counted(l1, "items")
    dictionary = write_table(item_dictionary(l1.select("item").distinct()), "dictionary")
    return l1.join(dictionary, "item"), rows, dictionary


def level_occurrences(res: Levels) -> list[DataFrame]:
    """JN-2 to JN-4: per level, every basket's itemsets of it, ``(*part,
    basket, items, last)``."""
    out = [first_level(res.occ1, res.part_cols)]
    for level in res.levels[1:]:
        out.append(write_table(only(extend(out[-1], res.occ1, res.part_cols), level,
                                    res.part_cols), "kept"))
    return out


def local_floor(min_support: float, n=None, sizes=None) -> float:
    """The least count that can be frequent anywhere: with chunks, that of the
    smallest one."""
    if sizes is None:
        return float(min_support) * n
    least = sizes.agg(F.min(local_threshold(min_support, F.col("n")))).first()[0]
    return 1.0 if least is None else max(1.0, least)


def mine_levels(occ: DataFrame, min_support: float, n=None, sizes=None, part_cols=(),
                max_len: int | None = None, keep_occurrences: bool = False) -> Levels:
    part_cols = tuple(part_cols)
    keys = dict(n=n, sizes=sizes, part_cols=part_cols)
    l1, n1, dictionary = frequent_items(occ, min_support, **keys)
    res = Levels(part_cols, dictionary)
    res.levels.append(l1.select(*part_cols, F.array("code").alias("items"), "freq"))
    if n1 == 0:
        return res
    res.occ1 = encode(occ, l1, part_cols)
    if keep_occurrences:
        res.occ1 = write_table(res.occ1, "occ1")
    if n1 > 1 and (max_len is None or max_len > 1):
        rows = write_table(basket_rows(res.occ1, part_cols), "rows")
        mine_rows(res, rows, min_support, keys, max_len)
    if keep_occurrences:
        res.occurrences = level_occurrences(res)
    return res


def mine_rows(res: Levels, rows: DataFrame, min_support: float, keys: dict, max_len) -> None:
    """Levels 2 and up of basket rows, appended to ``res``.

    L_2 is written.  A later level is the filtered count of its written hits:
    the next candidates and the result take it from there, without a table of
    its own."""
    part_cols = res.part_cols
    floor = local_floor(min_support, keys["n"], keys["sizes"])
    level, n_sets = write_counted(support_filter(pair_support(rows, floor, part_cols),
                                                 min_support, **keys), "level")
    if n_sets == 0:
        return
    hits = next_hits(start_hits(rows, part_cols), prefix_groups(level, part_cols), part_cols)
    k = 2
    while True:
        res.levels.append(level)
        if k == max_len:
            return
        cand = prune_candidates(candidate_gen(level, part_cols), level, k, part_cols)
        groups, n_groups = write_counted(prefix_groups(cand, part_cols), "candidates")
        if n_groups == 0:
            return
        hits = write_table(next_hits(hits, groups, part_cols), "hits")
        level, k = support_filter(hit_support(hits, part_cols), min_support, **keys), k + 1
