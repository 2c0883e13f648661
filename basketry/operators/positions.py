"""WIN-1: contiguous positions and chunks without a single-task window.

``row_number()`` over an unpartitioned window pulls every row into one
task.  Here the rows are range-partitioned by the order keys (a distributed
sort), each row is tagged with ``monotonically_increasing_id`` (partition
index in the upper 31 bits, row index inside the partition in the lower 33),
and a per-partition count table -- one row per partition, so bounded by the
partition count, not by the data -- gives every partition its offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.session import write_table

_ROW_BITS = 33


def with_positions(df: DataFrame, order_cols, pos_col: str = "pos") -> DataFrame:
    """Add ``pos`` = 0-based rank of each row in ``order_cols`` order.

    Ties get distinct positions in an arbitrary (but, once written, fixed)
    order.
    """
    cols = list(df.columns)
    tagged = write_table(
        df.orderBy(*order_cols).withColumn("_mid", F.monotonically_increasing_id()), "sorted")
    pid = F.shiftright("_mid", _ROW_BITS)
    per_part = tagged.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    # One row per non-empty partition: the window below sees only that many.
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(
        "_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")
    )
    row = F.col("_mid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        tagged.withColumn("_pid", pid)
        .join(F.broadcast(offsets), "_pid")  # one row per partition
        .select(*cols, (F.col("_off") + row).alias(pos_col))
    )


def chunk_size(n: int, chunks: int) -> int:
    """Rows per chunk: ``ceil(N / P)`` (at least 1 so empty input works)."""
    if chunks < 1:
        raise ValueError("chunks must be >= 1")
    return max(1, -(-n // chunks))


def assign_chunks(df: DataFrame, order_cols, chunks: int, n: int | None = None,
                  pos_col: str = "pos") -> DataFrame:
    """Contiguous chunks: ``chunk_id = floor(pos / ceil(N / P))``.

    Last chunks may be short or empty (N=10, P=4 gives 3, 3, 3, 1).
    """
    positioned = with_positions(df, order_cols, pos_col)
    if n is None:
        n = positioned.count()
    size = chunk_size(n, chunks)
    return positioned.withColumn("chunk_id", F.expr(f"{pos_col} div {size}").cast("bigint"))


def chunk_starts(df: DataFrame, key: str, chunks: int, n: int) -> DataFrame:
    """One row ``(starts)``: the keys of the first rows of all chunks but the
    first, in order (at most ``chunks`` - 1 of them)."""
    size = chunk_size(n, chunks)
    first = with_positions(df, [key], "_pos").where(
        (F.col("_pos") > 0) & (F.col("_pos") % size == 0))
    return first.agg(F.sort_array(F.collect_list(key)).alias("starts"))


def in_chunks(df: DataFrame, key, starts: DataFrame, chunks: int) -> DataFrame:
    """``df`` with the ``chunk_id`` of the ascending column ``key``: how many
    of ``starts`` are not above it, by binary search inside the row."""
    steps = max(1, chunks).bit_length()
    keyed = df.select("*", key.alias("_key"), starts.scalar().alias("_starts"))
    open_ = F.struct(F.lit(0).alias("lo"), F.size("_starts").alias("hi"))

    def halve(at, _):
        mid = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
        below = F.get("_starts", mid) <= F.col("_key")
        return F.when(at["lo"] >= at["hi"], at).otherwise(F.struct(
            F.when(below, mid + 1).otherwise(at["lo"]).alias("lo"),
            F.when(below, at["hi"]).otherwise(mid).alias("hi")))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), open_, halve)
    return keyed.select(*df.columns, found["lo"].cast("bigint").alias("chunk_id"))


def hash_chunks(df: DataFrame, key_col: str, chunks: int) -> DataFrame:
    """Chunks by hash of the basket key: no sort, same mining result."""
    if chunks < 1:
        raise ValueError("chunks must be >= 1")
    return df.withColumn(
        "chunk_id", F.pmod(F.xxhash64(F.col(key_col)), F.lit(chunks)).cast("bigint")
    )
