"""A-2 / JN-2 by pair hashing.

Every pair of a basket adds to one slot of a table of ``SLOTS`` counts.  A
task fills its own table with numpy, block by block, and the tables are summed
by slot over the cluster, so this pass makes no pair a row.  A pair can reach
a count only if its slot does; the slots that do are a bitmap of fixed size
(``SLOTS`` bits).  The second pass makes rows of the pairs in those slots
alone, summed inside the task first, and their exact counts decide.

Both passes read basket rows ``(*part, codes ARRAY<BIGINT>, n)``; a part
column is part of the hashed key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.session import prepare_workers

SLOTS = 1 << 20
#: Pairs a task makes at a time.
BLOCK = 1 << 20
#: Bits of one row of Spark's bitmap aggregates, and odd
#: multipliers (any large odd numbers).
BITMAP_BITS = 32768
ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def blocks(sizes: np.ndarray, limit: int = BLOCK):
    """Ranges ``(i, j)`` whose sizes sum to about ``limit``; each has at least
    one entry."""
    ends = np.cumsum(sizes, dtype=np.int64)
    i = 0
    while i < len(sizes):
        done = int(ends[i - 1]) if i else 0
        j = max(i + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield i, j
        i = j


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column without nulls, and its row offsets."""
    off = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy()[off[0]:off[-1]], off - off[0]


def later(start: np.ndarray, end: np.ndarray):
    """For each place its later places up to ``end``: the number of the place
    and the later place, as two long arrays."""
    count = end - start - 1
    left = np.repeat(np.arange(len(start)), count)
    first = np.cumsum(count) - count
    return left, start[left] + 1 + np.arange(len(left)) - first[left]


def combined(keys: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct keys and the sums of ``n``."""
    if not len(n):
        return keys, n
    order = np.lexsort(keys[::-1])
    keys, n = [k[order] for k in keys], n[order]
    new = np.ones(len(n), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    at = np.flatnonzero(new)
    return [k[at] for k in keys], np.add.reduceat(n, at)


def pair_blocks(batch: pa.RecordBatch):
    """``(part, a, b, n)`` of all pairs of the batch's baskets, a block at a
    time; the batch is ``(*part, codes, n)``."""
    codes, off = lists(batch.column(batch.num_columns - 2))
    sizes = np.diff(off)
    row, end = np.repeat(np.arange(len(sizes)), sizes), np.repeat(off[1:], sizes)
    n = batch.column(batch.num_columns - 1).to_numpy()
    part = batch.column(0).to_numpy() if batch.num_columns > 2 else np.zeros(len(n), np.int64)
    place = np.arange(len(codes))
    for i, j in blocks(end - place - 1):
        left, right = later(place[i:j], end[i:j])
        left = left + i
        yield part[row[left]], codes[left], codes[right], n[row[left]]


def slots(part: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = sum(x.astype(np.uint64) * k for x, k in zip((part, a, b), ODD, strict=True))
    return ((h ^ (h >> np.uint64(29))) * ODD[0] >> np.uint64(44)).astype(np.int64) % SLOTS


def _rows(rows: DataFrame, part_cols) -> DataFrame:
    return rows.select(*part_cols, "codes", "n").where(F.size("codes") > 1)


def heavy_slots(rows: DataFrame, min_count: float, part_cols=()) -> np.ndarray:
    """Which slots reach ``min_count``, as packed bits."""
    prepare_workers(rows.sparkSession)

    def run(batches):
        table = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for part, a, b, n in pair_blocks(batch):
                at, inverse = np.unique(slots(part, a, b), return_inverse=True)
                total = np.zeros(len(at), np.int64)
                np.add.at(total, inverse, n)
                table[at] += total
        used = np.flatnonzero(table)
        for i in range(0, len(used), 1 << 16):
            at = used[i:i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at])], ["slot", "n"])

    counts = _rows(rows, part_cols).mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(
        F.sum("n").alias("n")).where(F.col("n") >= F.lit(float(min_count)))
    number = F.col("slot") + 1  # Spark's buckets hold the numbers from 1 on
    bits = counts.groupBy(F.bitmap_bucket_number(number).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits"))
    out = np.zeros(SLOTS // 8, np.uint8)
    for r in bits.collect():  # SLOTS / BITMAP_BITS rows at most
        at = (r["bucket"] - 1) * (BITMAP_BITS // 8)
        out[at:at + BITMAP_BITS // 8] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def pair_support(rows: DataFrame, min_count: float = 1.0, part_cols=()) -> DataFrame:
    """``(*part, items, freq)`` of every pair whose slot reaches
    ``min_count``: all pairs of at least that count, and few others."""
    heavy = heavy_slots(rows, min_count, part_cols)
    names = [*part_cols, "a", "b", "n"]

    def run(batches):
        wanted = np.unpackbits(heavy, bitorder="little").view(bool)
        for batch in batches:
            for part, a, b, n in pair_blocks(batch):
                kept = wanted[slots(part, a, b)]
                keys, n = combined([part[kept], a[kept], b[kept]], n[kept])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in [*keys[1 - len(part_cols):], n]], names)

    found = _rows(rows, part_cols).mapInArrow(
        run, ", ".join(f"{c} bigint" for c in names)).groupBy(*part_cols, "a", "b").agg(
        F.sum("n").alias("freq"))
    return found.select(*part_cols, F.array("a", "b").alias("items"), "freq")
