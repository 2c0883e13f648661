"""JN-5 / IT-2: one walk of a prefix tree of all candidates per basket.

Candidates of every size are numbered in lexicographic order and cut into
runs of at most ``TREE_SETS``; a run's prefix tree is a few sorted arrays (a
node's key is its parent and its last code).  A task walks the tree with all
baskets of a batch at once: each step looks up the keys of the places
reached so far with the later codes of the same basket, in blocks of bounded
size.  All sizes come out of the one pass; there is no table per size, and no
join on baskets.  More candidates than a run holds take more passes, never a
larger tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.operators.pairs import blocks, combined, later, lists
from basketry.session import prepare_workers

#: Itemsets of one tree: bounds what the driver collects and tasks receive.
TREE_SETS = 1 << 18


class PrefixTree:
    """Itemsets ``(off, codes)`` in lexicographic order, numbered from
    ``first`` on.  A prefix that is no itemset itself is a node without a
    number."""

    def __init__(self, off: np.ndarray, codes: np.ndarray, first: int):
        sizes = np.diff(off)
        self.width = int(codes.max()) + 1 if len(codes) else 1
        at = np.zeros(len(sizes), np.int64)      # node of each itemset so far
        numbers = np.arange(first, first + len(sizes))
        self.keys, self.number, nodes = [], [], 1
        for depth in range(int(sizes.max()) if len(sizes) else 0):
            deep = np.flatnonzero(sizes > depth)
            key = at[deep] * self.width + codes[off[deep] + depth]
            keys, inverse = np.unique(key, return_inverse=True)
            number = np.full(len(keys), -1, np.int64)
            ends = sizes[deep] == depth + 1
            number[inverse[ends]] = numbers[deep[ends]]
            self.keys.append(keys)
            self.number.append(number)
            at[deep] = inverse
            nodes += len(keys)

    def contained(self, codes: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(row, number)`` of every itemset that a row holds, in blocks."""
        if not self.keys or not len(codes):
            return
        sizes = np.diff(off)
        row, end = np.repeat(np.arange(len(sizes)), sizes), np.repeat(off[1:], sizes)
        place = np.arange(len(codes))
        stack = [(0, place, np.zeros(len(codes), np.int64))]
        while stack:  # places reached and the node of the prefix before them
            depth, place, node = stack.pop()
            key = node * self.width + codes[place]
            at = np.minimum(np.searchsorted(self.keys[depth], key), len(self.keys[depth]) - 1)
            met = np.flatnonzero((self.keys[depth][at] == key) & (codes[place] < self.width))
            place, at = place[met], at[met]
            number = self.number[depth][at]
            yield row[place[number >= 0]], number[number >= 0]
            if depth + 1 == len(self.keys):
                continue
            for i, j in blocks(end[place] - place - 1):
                left, right = later(place[i:j], end[place[i:j]])
                if len(right):
                    stack.append((depth + 1, right, at[i:j][left]))


def trees(cand: DataFrame, n: int) -> Iterator[PrefixTree]:
    """A tree for each run of ``cand(items, id)``, whose ids are the places
    0 to n - 1 in lexicographic order."""
    for first in range(0, n, TREE_SETS):
        run = cand.where((F.col("id") >= first) & (F.col("id") < first + TREE_SETS)).orderBy(
            "id").select("items").toArrow().column(0).combine_chunks()
        codes, off = lists(run)
        yield PrefixTree(off, codes, first)


def contained_sets(rows: DataFrame, cand: DataFrame, n: int, key: str = "basket") -> DataFrame:
    """JN-5: ``(basket, items)`` of every candidate that a basket of
    ``rows(basket, codes)`` holds."""
    prepare_workers(rows.sparkSession)
    kind = rows.schema[key].dataType.simpleString()
    out = None
    for tree in trees(cand, n):
        def run(batches, tree=tree):
            for batch in batches:
                codes, off = lists(batch.column(1))
                for row, number in tree.contained(codes, off):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(row)), pa.array(number)], [key, "id"])

        found = rows.select(key, "codes").mapInArrow(run, f"{key} {kind}, id bigint")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = rows.select(key, F.lit(0).cast("bigint").alias("id")).limit(0)
    return out.join(cand.select("id", "items"), "id").select(key, "items")


def contained_support(rows: DataFrame, cand: DataFrame, n: int, part_cols=()) -> DataFrame:
    """A-8 / A-9: ``(*part, items, freq)``, in how many baskets of
    ``rows(*part, codes, n)`` each candidate is; absent where in none.  Counts
    are summed inside the task first."""
    prepare_workers(rows.sparkSession)
    names = [*part_cols, "id", "n"]
    out = None
    for tree in trees(cand, n):
        def run(batches, tree=tree):
            for batch in batches:
                codes, off = lists(batch.column(batch.num_columns - 2))
                weight = batch.column(batch.num_columns - 1).to_numpy()
                part = batch.column(0).to_numpy() if part_cols else np.zeros(len(weight), np.int64)
                for row, number in tree.contained(codes, off):
                    keys, total = combined([part[row], number], weight[row])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in [*keys[1 - len(part_cols):], total]], names)

        found = rows.select(*part_cols, "codes", "n").mapInArrow(
            run, ", ".join(f"{c} bigint" for c in names))
        out = found if out is None else out.unionByName(found)
    if out is None:
        return rows.select(*part_cols, F.col("codes").alias("items"), F.col("n").alias("freq")).limit(0)
    return out.groupBy(*part_cols, "id").agg(F.sum("n").alias("freq")).join(
        cand.select("id", "items"), "id").select(*part_cols, "items", "freq")
