"""Fill-in-the-middle transformation by block rotation in place.

A text is cut into a prefix, a middle and a suffix at two token places drawn
from the digest of its id.  Sentinels are put into one bytearray in text
order, ``<P>prefix<M>middle<S>suffix``, and the parts exchange places there:
a rotation is three reversals, done in blocks, so the only other memory is
one block.  The inverse rotation and the removal of the sentinels restore the
text exactly, from the output and its form alone.

One pass, no shuffle: a text depends on nothing but itself, so a lost task is
simply run again.  Token places of a batch come from one vectorised byte scan.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm import tasks

#: The sentinels, the forms, and the shares in percent of texts
#: left plain and of cut texts written suffix first.
PRE, SUF, MID = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
PLAIN_FROM, SPM_BELOW = 90, 20
SEED = "1:"

#: Bytes moved at a time by a reversal.
BLOCK = 1 << 16

_letter = np.zeros(256, bool)
_letter[[*range(65, 91), *range(97, 123)]] = True


def reverse(view: np.ndarray) -> None:
    """Reverse the bytes of ``view`` in place, a block from each end at a time."""
    i, j = 0, len(view)
    while j - i > 1:
        n = min(BLOCK, (j - i) // 2)
        left = view[i:i + n][::-1].copy()
        view[i:i + n] = view[j - n:j][::-1]
        view[j - n:j] = left
        i, j = i + n, j - n


def rotate(buffer: bytearray, start: int, cut: int, end: int) -> None:
    """Exchange ``buffer[start:cut]`` and ``buffer[cut:end]`` in place:
    reverse each, then both together."""
    view = np.frombuffer(buffer, np.uint8)
    for a, b in ((start, cut), (cut, end), (start, end)):
        reverse(view[a:b])


def arrange(text: bytes, cut1: int, cut2: int, form: str) -> bytearray:
    """``text`` with its parts ``[:cut1]``, ``[cut1:cut2]``, ``[cut2:]`` in
    the order of ``form``, each behind its sentinel."""
    out = bytearray(text)
    if form == PLAIN:
        return out
    out[cut2:cut2] = SUF
    out[cut1:cut1] = MID
    out[0:0] = PRE
    middle = len(PRE) + cut1
    suffix = middle + len(MID) + cut2 - cut1
    rotate(out, middle if form == PSM else 0, suffix, len(out))
    return out


def rebuild(output: bytes, form: str) -> bytes:
    """The text of ``output``.  A text that holds a sentinel is plain, so each
    sentinel stands once in any other output."""
    out = bytearray(output)
    if form == PLAIN:
        return bytes(out)
    suffix, middle = out.index(SUF), out.index(MID)
    if form == PSM:  # <P>prefix<S>suffix<M>middle
        rotate(out, suffix, middle, len(out))
    else:  # <S>suffix<P>prefix<M>middle
        rotate(out, 0, out.index(PRE), len(out))
    middle, suffix = out.index(MID), out.index(SUF)
    del out[suffix:suffix + len(SUF)]
    del out[middle:middle + len(MID)]
    del out[:len(PRE)]
    return bytes(out)


def token_starts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Byte places where a token ``[A-Za-z]+|[^A-Za-z]`` begins: the first
    letter of a run, and the first byte of any other character."""
    letter = _letter[data]
    start = ~letter & ((data & 0xC0) != 0x80)
    fresh = letter.copy()
    fresh[1:] &= ~letter[:-1]
    start |= fresh
    first = off[:-1][np.diff(off) > 0]
    start[first] = True
    return np.flatnonzero(start)


def draws(doc_id) -> list[int]:
    """Four numbers from the id's digest (no digits for a null id)."""
    text = SEED + ("" if doc_id is None else str(doc_id))
    digest = hashlib.sha256(text.encode()).hexdigest()
    return [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]


def plan(doc_id, n: int, text: bytes) -> tuple[str, int, int]:
    """Form of a text of ``n`` tokens, and the numbers of tokens before its
    two cuts."""
    h1, h2, h3, h4 = draws(doc_id)
    cuts = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or h3 % 100 >= PLAIN_FROM or any(s in text for s in (PRE, SUF, MID)):
        return PLAIN, *cuts
    return (SPM if h4 % 100 < SPM_BELOW else PSM), *cuts


def _transformed(ids: list, data: np.ndarray, off: np.ndarray):
    """Columns of the rows of one step."""
    starts = token_starts(data, off)
    first = np.searchsorted(starts, off)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    whole = data.tobytes()
    forms, outputs, lengths = [], [], []
    for r, doc_id in enumerate(ids):
        a, b = int(off[r]), int(off[r + 1])
        n = int(first[r + 1] - first[r])
        text = whole[a:b]
        form, t1, t2 = plan(doc_id, n, text)
        c1, c2 = (int(starts[first[r] + t]) if t < n else b for t in (t1, t2))
        forms.append(form)
        outputs.append(bytes(arrange(text, c1 - a, c2 - a, form)))
        lengths.append((None, None) if form == PLAIN else
                       (int(chars[c1] - chars[a]), int(chars[c2] - chars[c1])))
    return [pa.array(np.diff(first), pa.int64()), pa.array(forms, pa.string()),
            pa.array([x for x, _ in lengths], pa.int64()),
            pa.array([y for _, y in lengths], pa.int64()),
            pa.array(outputs, pa.binary()).cast(pa.string())]


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)``, one row per
    input row: tokens, ``plain``, ``psm`` or ``spm``, code points of prefix
    and middle (null if plain), and the transformed text.

    A null text counts as empty; an empty text, or one that holds a sentinel,
    stays plain.  A null id draws from the digest of no digits.  Repeated
    rows, and different texts of one id, are each transformed (with the same
    draws); an empty table gives an empty result; other columns are ignored,
    whatever their names.  Texts of any length are one buffer each.
    """
    tasks.prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches):
        for batch in batches:
            for i, j, data, off in tasks.sliced_texts(batch):
                ids = batch.column(0).slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [ids, *_transformed(ids.to_pylist(), data, off)], names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, "
             "output string")


def restore(rows: DataFrame, output_col: str = "output", form_col: str = "form",
            text_col: str = "restored") -> DataFrame:
    """``rows`` with the text rebuilt from output and form as ``text_col``.

    A null output gives a null text; a null form counts as plain; a column
    already named ``text_col`` is replaced; an empty table stays empty.
    """
    tasks.prepare(rows.sparkSession)
    kept = [c for c in rows.columns if c != text_col]
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"),
                         F.col(f"`{output_col}`").alias("output"), F.col(f"`{form_col}`").alias("form"))

    def run(batches):
        for batch in batches:
            size = batch.column(1).cast(pa.large_binary()).fill_null(b"")
            sizes = np.diff(np.frombuffer(size.buffers()[1], np.int64)[
                size.offset:size.offset + len(size) + 1]) if len(size) else np.empty(0, np.int64)
            for i, j in tasks.steps(sizes):
                part = batch.slice(i, j - i)
                texts = part.column(1).cast(pa.binary()).to_pylist()
                got = [None if t is None else rebuild(t, f or PLAIN)
                       for t, f in zip(texts, part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(got, pa.binary()).cast(pa.string())],
                    ["row", "restored"])

    out = packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, "
                                 "restored string")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in kept],
                      F.col("restored").alias(text_col))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output_sha256,
    restored_sha256)`` of every document, transformed and restored."""
    return restore(transform(docs, id_col, text_col)).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.encode("output", "UTF-8"), 256).alias("output_sha256"),
        F.sha2(F.encode("restored", "UTF-8"), 256).alias("restored_sha256"))
