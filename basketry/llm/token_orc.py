"""Token-ID output: ORC files of ids in ascending document order.

The ORC writer run-length encodes the id columns per stripe and writes row
indexes and Bloom filters on ``doc_id``, so a reader takes stripes in
parallel, and a lookup of a few documents skips stripes and row groups by
metadata.

One range shuffle of the texts puts documents in order (the arrival number
breaks ties, so repeated ids or rows spread like any others); encoding runs
after it, inside the writing stage, with a running id count per partition.
Global starts need only one total per partition.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketry import session
from basketry.llm import tasks
from basketry.llm.pieces import coder

#: ORC settings: Bloom filter and row index on doc_id, stripes of 64 MB.
ORC_OPTIONS = {"compression": "zstd", "orc.bloom.filter.columns": "doc_id",
               "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true",
               "orc.row.index.stride": "1000", "orc.stripe.size": str(64 << 20)}


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = None,
                 cut: str = "word", id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text and write ``(doc_id, part, local_start,
    n_tokens, ids)`` as ORC files in ascending ``doc_id`` order (null ids
    first; equal ids in arrival order).

    A null or empty text gives only ``end_id`` (nothing when that is None);
    an empty table writes an empty, readable dataset.  ``part`` ascends with
    ``doc_id``; ``local_start`` counts the ids before the row in its part.
    Other columns of ``docs`` are ignored.
    """
    tasks.prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        enc, seen = coder(tokenizer_path, cut), 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            for i, j, data, off in tasks.sliced_texts(batch):
                ids, at = enc.encode(data, off)
                if end_id is not None:
                    ids = np.insert(ids, at[1:], end_id)
                    at = at + np.arange(len(at))
                n = np.diff(at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(np.full(j - i, part, np.int32)),
                     pa.array(seen + at[:-1]), pa.array(n),
                     pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))],
                    ["doc_id", "part", "local_start", "n_tokens", "ids"])
                seen += int(at[-1])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                       F.monotonically_increasing_id().alias("arrival"))
    ordered = (rows.repartitionByRange("doc_id", "arrival")
               .sortWithinPartitions("doc_id", "arrival").select("doc_id", "text"))
    (ordered.mapInArrow(run, f"doc_id {kind}, part int, local_start bigint, n_tokens bigint, "
                             "ids array<int>")
     .write.options(**ORC_OPTIONS).orc(path))


def read_tokens(spark: SparkSession, path: str, doc_ids: list | None = None) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` from the files.  With ``doc_ids``
    the filter reaches the ORC reader, which skips stripes and row groups by
    their statistics and Bloom filters; ids that no row has give none, null
    ids are not looked up.  Null and repeated ids, and rows without tokens,
    come back as written; an empty dataset gives an empty result."""
    rows = spark.read.orc(path)
    # One row per written partition: bounded by the file count, not the rows.
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    if doc_ids is not None:
        rows = rows.where(F.col("doc_id").isin(list(doc_ids)))
    return rows.join(F.broadcast(base), "part").select(
        "doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def token_digests(tokens: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of ``read_tokens`` rows; the
    checksum is over the ids as little-endian unsigned 32-bit integers (0 for
    a row without ids).  One row per input row; an empty table stays empty."""
    tasks.prepare(tokens.sparkSession)
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            ids = b.column(3)
            at = ids.offsets.to_numpy().astype(np.int64)
            raw = ids.values.to_numpy().astype("<u4")
            crc = [zlib.crc32(raw[at[k]:at[k + 1]].tobytes()) for k in range(len(ids))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(crc, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(
        run, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_file_rows(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write ``docs`` to a fresh folder in the shared checkpoint space, read
    the files back and return their digests."""
    spark = docs.sparkSession
    path = session.scratch_path(spark, "tokens")
    write_tokens(docs, path, tokenizer_path, end_id)
    return token_digests(read_tokens(spark, path))
