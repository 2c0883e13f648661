"""Token counts: batch encoding in Arrow functions that return lengths only.

Rows arrive in Arrow batches; each batch is worked in steps balanced by bytes
(``tasks.sliced_texts``) and every text is split at safe boundaries
(``pieces``), so one very long text costs its own bytes and no more.  Only the
lengths leave the worker.  One pass, no shuffle.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm import tasks
from basketry.llm.pieces import coder


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int, cut: str = "byte",
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)``, one row per input row.

    A null text counts as empty (0 bytes, 0 tokens); a null id is kept;
    repeated rows are each counted; an empty table gives an empty result.
    Other columns of ``docs`` are ignored, whatever their names.
    ``over_limit`` is ``n_tokens > limit``.
    """
    tasks.prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType

    def run(batches):
        enc = coder(tokenizer_path, cut)
        for batch in batches:
            for i, j, data, off in tasks.sliced_texts(batch):
                n = enc.counts(data, off)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(off[1:] - off[:-1]), pa.array(n)],
                    ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, f"doc_id {kind.simpleString()}, n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(int(limit)))
