"""Helpers shared by the Arrow tasks: worker path, byte-balanced batches,
byte views of string columns and hashes of byte windows."""

from __future__ import annotations

import ctypes
import gc
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Texts handed to one vectorised step hold about this many bytes; a single
#: longer text is a step of its own.
STEP_BYTES = 4 << 20

#: The same for steps that hold several words for every byte (hashes).
HASH_STEP = 1 << 20

#: Spark's limit on the bytes of a record batch, which by rows alone (10,000)
#: grows with the texts: a task holds batches in its executor's JVM, in the
#: pipe and in its worker.
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Odd base of the polynomial byte hashes (fixed value, any large odd number).
HASH_BASE = np.uint64(0x9E3779B97F4A7C15)


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package from the driver's path (on a
    cluster the package is installed or shipped; the path is then unused), and
    hand them batches of about a step, unless the session says how large."""
    if spark.conf.get(BATCH_LIMIT, None) is None:
        spark.conf.set(BATCH_LIMIT, str(STEP_BYTES))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join([x for x in (have, root) if x])


def steps(sizes: np.ndarray, limit: int = STEP_BYTES):
    """Row ranges ``(i, j)`` whose sizes sum to about ``limit`` bytes; every
    row is in exactly one range, an oversized row alone in its own."""
    if not len(sizes):
        return
    ends = np.cumsum(sizes, dtype=np.int64)
    i, done = 0, 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield i, j
        i, done = j, int(ends[j - 1])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the ``n + 1`` row offsets into them
    (null counts as the empty text)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def sliced_texts(batch, name: str = "text", limit: int = STEP_BYTES, row_bytes: int = 0):
    """``(rows i, j, bytes, offsets)`` of a record batch, balanced by bytes;
    a row counts ``row_bytes`` beside its text.  What the steps freed goes back
    to the system behind the last."""
    data, off = text_bytes(batch.column(batch.schema.get_field_index(name)))
    for i, j in steps(np.diff(off) + row_bytes, limit):
        yield i, j, data[off[i]:off[j]], off[i:j + 1] - off[i]
    _trim()


_model: dict[tuple, object] = {}
_malloc_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def model(key: tuple, make):
    """What a worker keeps between its tasks: one model, the one last asked
    for.  A worker goes from one operator to the next and would else hold the
    vocabularies and memos of all of them."""
    if key not in _model:
        release()
        _model[key] = make()
    return _model[key]


def release() -> None:
    """Give back what an operator before left in this worker: for those that
    hold no model themselves."""
    if _model:
        _model.clear()
        gc.collect()
        _trim()


def _trim() -> None:
    """Freed memory back to the system; glibc keeps it unless asked."""
    pa.default_memory_pool().release_unused()
    if _malloc_trim is not None:
        _malloc_trim(0)


def strings_at(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The texts that begin at ``starts`` (ascending, first 0) and run to the
    next start, without copying."""
    off = np.append(starts, len(data)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(off),
                                            pa.py_buffer(np.ascontiguousarray(data)))


#: Powers of the hash base kept by a worker; greater ones are products of two.
POWERS = 1 << 16


def _first_powers(base: int) -> np.ndarray:
    out = np.full(POWERS, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = _first_powers(int(HASH_BASE))
_DOWN = _first_powers(pow(int(HASH_BASE), -1, 1 << 64))


def _leaps(table: np.ndarray, n: int) -> np.ndarray:
    """Powers 0, ``POWERS``, 2 ``POWERS``, ... up to ``n``."""
    out = np.repeat(table[-1:] * table[1:2], n // POWERS + 1)
    out[0] = 1
    return np.multiply.accumulate(out)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """``n + 1`` running sums of ``(byte + 1) * base**i`` modulo 2**64."""
    out = np.zeros(len(data) + 1, np.uint64)
    sums = out[1:]
    leaps = _leaps(_UP, len(data))
    for k, i in enumerate(range(0, len(data), POWERS)):
        part = sums[i:i + POWERS]
        part[:] = data[i:i + POWERS]
        part += np.uint64(1)
        part *= _UP[:len(part)] * leaps[k]
    np.cumsum(sums, out=sums)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (public splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of ``data[start:end]`` for arrays of positions; equal bytes give
    equal hashes wherever they stand."""
    h = prefix[end] - prefix[start]
    h *= _DOWN[start % POWERS]
    h *= _leaps(_DOWN, len(prefix))[start // POWERS]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
