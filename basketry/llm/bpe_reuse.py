"""BPE encoding and decoding with content-defined chunk reuse.

Texts are cut where a rolling hash of the last bytes meets a mask, so equal
passages of different documents give equal chunks.  A distinct chunk is
encoded once per worker step and remembered (bounded memo); documents then
splice the ids of their chunks.

A cut may fall inside a word, so joins are repaired: the window from the last
whole word of the left chunk to the first whole word of the right one is
encoded again, and the splice is accepted when the window's ids begin and end
with exactly the ids those two words have in their own chunks.  Otherwise the
window grows to the whole neighbouring chunks, then to the whole document.
Words here end before a space or line feed, where the vocabulary's
pre-tokenizer always ends one (``pieces``).

One pass, no shuffle: the memo is per worker, since sending every text to
meet its copies would cost more than encoding it.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm import tasks
from basketry.llm.pieces import PieceCoder

#: Rolling-hash window in bytes, and mean chunk length (a power of two).
ROLL = 32
MEAN_CHUNK = 1024
#: Text of remembered chunks, in characters, per worker; their ids take about
#: as much again and their parts a little less.
MEMO_CHARS = 8 << 20
#: Pieces of new chunks and of joins that a worker remembers beside them.
MEMO_PIECES = 200_000


def chunk_starts(data: np.ndarray, off: np.ndarray, mean: int = MEAN_CHUNK) -> np.ndarray:
    """Chunk starts: non-empty rows, and places after a ``ROLL``-byte window
    of the same row whose hash ends in zero bits, before a whole character."""
    rows = off[:-1][np.diff(off) > 0]
    if len(data) <= ROLL:
        return rows
    prefix = tasks.prefix_hash(data)
    found = []
    for a in range(ROLL, len(data), tasks.POWERS):
        at = np.arange(a, min(a + tasks.POWERS, len(data)))
        h = tasks.window_hash(prefix, at - ROLL, at)
        found.append(at[((h & np.uint64(mean - 1)) == 0) & ((data[at] & 0xC0) != 0x80)])
    at = np.concatenate(found)
    row = np.searchsorted(off, at, side="right") - 1
    return np.union1d(at[at - off[row] >= ROLL], rows)


@dataclass
class Chunk:
    """A chunk split before blanks: ``head``, first whole word, middle, last
    whole word, ``tail``.  ``body`` holds the ids from the first to the last
    whole word; None where the chunk has fewer than two whole words."""
    text: str
    head: str = ""
    first: str = ""
    last: str = ""
    tail: str = ""
    inner: str = ""
    body: np.ndarray | None = None
    first_ids: np.ndarray | None = None
    last_ids: np.ndarray | None = None


def _blank(text: str, start: int) -> int:
    a, b = text.find(" ", start), text.find("\n", start)
    return max(a, b) if min(a, b) < 0 else min(a, b)


def split_chunk(text: str) -> Chunk:
    out = Chunk(text)
    b0 = _blank(text, 0)
    b1 = _blank(text, b0 + 1) if b0 >= 0 else -1
    bm = max(text.rfind(" "), text.rfind("\n"))
    bl = max(text.rfind(" ", 0, bm), text.rfind("\n", 0, bm)) if bm > 0 else -1
    if b1 < 0 or bl < b1:  # fewer than two whole words
        return out
    out.head, out.first, out.last = text[:b0], text[b0:b1], text[bl:bm]
    out.tail, out.inner = text[bm:], text[b0:bm]
    return out


class ReuseCoder:
    """Chunk memo over a ``PieceCoder``."""

    def __init__(self, enc: PieceCoder):
        self.enc, self.memo, self.held = enc, OrderedDict(), 0
        decoder = enc.tok.decoder
        self.names = None
        if decoder is None:  # decode then joins the vocabulary's strings
            n = enc.tok.get_vocab_size(with_added_tokens=True)
            self.names = [enc.tok.id_to_token(i) for i in range(n)]

    def chunks(self, texts: list[str]) -> list[Chunk]:
        """The chunk of each distinct text, encoding only new ones."""
        out = [self.memo.get(t) for t in texts]
        new = [i for i, c in enumerate(out) if c is None]
        for i in new:
            out[i] = split_chunk(texts[i])
        whole = [i for i in new if out[i].inner]
        ids = self.enc.encode_texts([t for i in whole for t in (
            out[i].inner, out[i].first, out[i].last)])
        for k, i in enumerate(whole):
            # copies: a view would keep the ids of the whole step
            out[i].body, out[i].first_ids, out[i].last_ids = (
                x.copy() for x in ids[3 * k:3 * k + 3])
            out[i].inner = ""  # encoded; the text is kept for wider windows
        for i in new:
            self.memo[texts[i]] = out[i]
            self.held += len(texts[i])
        for i in range(len(texts)):
            if texts[i] in self.memo:
                self.memo.move_to_end(texts[i])
        while self.held > MEMO_CHARS:
            old, _ = self.memo.popitem(last=False)
            self.held -= len(old)
        return out

    def encode(self, data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        """Ids of each row."""
        n = len(off) - 1
        if not len(data):
            return [np.empty(0, np.uint32)] * n
        starts = chunk_starts(data, off)
        coded = tasks.strings_at(data, starts).dictionary_encode()
        known = self.chunks(coded.dictionary.to_pylist())
        codes = coded.indices.to_numpy()
        first = np.searchsorted(starts, off)
        docs = [[known[c] for c in codes[first[r]:first[r + 1]]] for r in range(n)]
        # Windows to encode again: before, between and after anchored chunks.
        plans, windows = [], []
        for parts in docs:
            plan, left, text = [], None, ""
            for c in parts:
                if c.body is None:
                    text += c.text
                    continue
                plan.append((left, c, len(windows)))
                windows.append((left.last + text if left else text) + c.head + c.first)
                left, text = c, c.tail
            plan.append((left, None, len(windows)))
            windows.append((left.last + text) if left else text)
            plans.append(plan)
        # equal windows are encoded once
        place = {w: i for i, w in enumerate(dict.fromkeys(windows))}
        ids = self.enc.encode_texts(list(place))
        return [self._splice(docs[r], plans[r], windows, place, ids) for r in range(n)]

    def _splice(self, parts, plan, windows, place, ids) -> np.ndarray:
        out = []
        for left, right, w in plan:
            got = ids[place[windows[w]]]
            a = left.last_ids if left else got[:0]
            b = right.first_ids if right else got[:0]
            if not agrees(got, a, b):
                return self._wider(parts)
            out.append(got[len(a):len(got) - len(b)])
            if right is not None:
                out.append(right.body)
        return np.concatenate(out)

    def _wider(self, parts) -> np.ndarray:
        """Windows over whole neighbouring chunks, else the whole document."""
        text = "".join(c.text for c in parts)
        at, out = 0, []
        bodies = [c for c in parts if c.body is not None]
        gaps, left = [], None
        for c in parts:
            if c.body is None:
                at += len(c.text)
                continue
            a, b = at + len(c.head), at + len(c.text) - len(c.tail)
            gaps.append(text[left[0] if left else 0:b])
            left, at = (a, b), at + len(c.text)
        if bodies:
            gaps.append(text[left[0]:])
            got = self.enc.encode_texts(gaps)
            for k, g in enumerate(got):
                a = bodies[k - 1].body if k else g[:0]
                b = bodies[k].body if k < len(bodies) else g[:0]
                if not agrees(g, a, b):
                    break
                out += [g[len(a):len(g) - len(b)], b]
            else:
                return np.concatenate(out)
        return np.array(self.enc.tok.encode(text, add_special_tokens=False).ids, np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        """As the library decodes, special tokens kept."""
        if self.names is None:
            return self.enc.tok.decode(ids.tolist(), skip_special_tokens=False)
        names = self.names
        return " ".join([names[i] for i in ids.tolist()])


def agrees(window: np.ndarray, first: np.ndarray, last: np.ndarray) -> bool:
    """The window begins with ``first`` and ends with ``last``, apart."""
    n = len(window)
    return (n >= len(first) + len(last) and np.array_equal(window[:len(first)], first)
            and np.array_equal(window[n - len(last):], last))


def reuse_coder(path: str) -> ReuseCoder:
    """This worker's chunk coder for a vocabulary file."""
    return tasks.model(("reuse", path), lambda: ReuseCoder(PieceCoder(path, "word", MEMO_PIECES)))


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids ARRAY<INT>)``, one row per input row.

    A null or empty text has no ids; null ids and repeated rows are kept; an
    empty table gives an empty result; other columns are ignored.
    """
    tasks.prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        enc = reuse_coder(tokenizer_path)
        for b in batches:
            for i, j, data, off in tasks.sliced_texts(b, limit=tasks.HASH_STEP):
                ids = enc.encode(data, off)
                n = np.array([len(x) for x in ids], np.int64)
                at = np.concatenate([[0], np.cumsum(n)])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(n), pa.ListArray.from_arrays(
                        pa.array(at, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))],
                    ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_tokens bigint, ids array<int>")


def decode(tokens: DataFrame, tokenizer_path: str, id_col: str = "doc_id",
           ids_col: str = "ids") -> DataFrame:
    """``(doc_id, text)`` of ``encode`` rows, special tokens kept; null or
    empty ids give the empty text."""
    tasks.prepare(tokens.sparkSession)
    kind = tokens.schema[id_col].dataType.simpleString()

    def run(batches):
        enc = reuse_coder(tokenizer_path)
        for b in batches:
            texts = [enc.decode(np.array(x or [], np.int64)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())],
                                             ["doc_id", "text"])

    return tokens.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(
        run, f"doc_id {kind}, text string")


def digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: each text encoded
    as by ``encode`` and decoded again, as digests (see there for nulls)."""
    tasks.prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        enc = reuse_coder(tokenizer_path)
        for b in batches:
            for i, j, data, off in tasks.sliced_texts(b, limit=tasks.HASH_STEP):
                ids = enc.encode(data, off)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i),
                     pa.array([len(x) for x in ids], pa.int64()),
                     pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids],
                              pa.string()),
                     pa.array([hashlib.sha256(enc.decode(x).encode("utf-8")).hexdigest()
                               for x in ids], pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
