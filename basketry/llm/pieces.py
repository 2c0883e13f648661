"""Exact tokenizer results from distinct pieces.

A text is cut at places where the tokenizer's own pre-tokenizer always ends a
word; each distinct piece is encoded by the ``tokenizers`` library once per
worker (a bounded memo) and results are gathered with numpy.

Safe cuts.  Both vocabularies split with a pattern that never carries a word
over an ASCII blank:

* ``byte``: a blank begins the next word when the byte before it is an ASCII
  non-blank (no blank run ends there) or the byte after it is one (the run's
  last blank belongs to the word).  The cut is before that blank.
* ``word``: white space is dropped, so a cut before any space or line feed is
  safe; normalisation works on characters and a blank composes with nothing
  before it.

Special-token strings hold no blank, so no cut falls inside one.

A piece of Latin letters (U+00FF at most) and plain marks behind them is two
words to both patterns (letters; marks), unchanged by normalisation but for
the case.  It is cut between them, and lower-cased where the vocabulary is, so
fewer pieces are distinct; each goes straight to the library's BPE model, its
bytes as the characters that byte-level vocabularies use.  All other pieces
take the whole tokenizer.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa

from basketry.llm import tasks
from basketry.llm.tasks import strings_at

#: Distinct pieces a worker remembers.  More pieces are still encoded, only
#: not remembered, so results do not depend on it.
MEMO_PIECES = 500_000

#: Marks that no contraction or special token begins with, and a word of Latin
#: letters or of marks; a blank before it belongs to it or is dropped.
MARKS = ".,;:!?()-\"#$%&*+/=@[]\\^_`{}~"
_WORD = rf"[A-Za-zÀ-ÖØ-öø-ÿ]+|[{re.escape(MARKS)}]+"
PLAIN = {"byte": re.compile(rf"( ?(?:{_WORD}))"), "word": re.compile(rf"[ \n]?({_WORD})")}
#: The pre-tokenizer and normalizer steps for which that holds.
PLAIN_STEPS = {"byte": (["ByteLevel"], []),
               "word": (["Split", "ByteLevel"], ["NFC", "Replace", "Lowercase"])}


def byte_characters() -> list[str]:
    """Byte-level vocabularies write a byte as its own Latin-1 character where
    that is a visible one, else as the next of those from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, next_ = [""] * 256, 256
    for b in range(256):
        out[b] = chr(b if b in seen else next_)
        next_ += b not in seen
    return out


_BYTE_CHARACTERS = byte_characters()

#: Kinds of bytes.  U+00C0 to U+00FF are a lead 0xC3 and a byte from 0x80 on;
#: pieces with any other lead are not plain.
_LETTER, _MARK, _BLANK = 1, 2, 3
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)]] = _LETTER
_KIND[list(MARKS.encode())] = _MARK
_KIND[32] = _BLANK
#: Lower case of the bytes of a plain piece.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[0x80:0x9F] += 32


def load_tokenizer(path: str):
    """The tokenizers library's reading of ``path``, on one thread, with
    truncation and padding off."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def coder(path: str, cut: str) -> "PieceCoder":
    """This worker's coder for a vocabulary file (kept between tasks)."""
    return tasks.model(("pieces", path, cut), lambda: PieceCoder(path, cut))


class PieceCoder:
    """Encodes whole texts exactly, piece by piece."""

    def __init__(self, path: str, cut: str, memo_pieces: int = MEMO_PIECES):
        if cut not in ("byte", "word"):
            raise ValueError(f"unknown cut {cut!r}")
        self.tok, self.cut, self.memo = load_tokenizer(path), cut, {}
        self.memo_pieces = memo_pieces
        self.model = self.tok.model
        self.plain = PLAIN[cut] if self._has_plain_steps() else None

    def _has_plain_steps(self) -> bool:
        spec = json.loads(self.tok.to_str())

        def kinds(step, inner):
            return [] if step is None else [x["type"] for x in step.get(inner, [step])]

        steps = (kinds(spec["pre_tokenizer"], "pretokenizers"), kinds(spec["normalizer"], "normalizers"))
        return steps == PLAIN_STEPS[self.cut] and not any(
            self.plain_text(t["content"]) for t in spec["added_tokens"])

    def plain_text(self, text: str) -> bool:
        return PLAIN[self.cut].fullmatch(text) is not None

    def _plain_ids(self, piece: str) -> bytes | None:
        """Ids of one word that normalisation leaves as it is."""
        m = self.plain.fullmatch(piece) if self.plain else None
        if m is None:
            return None
        spelt = "".join([_BYTE_CHARACTERS[b] for b in m[1].encode()])
        return array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()

    def _words(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes with plain pieces as normalisation leaves them, and the
        starts of all pieces with plain ones cut into letters and marks."""
        kind = _KIND[data]
        if self.cut == "word":
            kind[data == 10] = _BLANK
        kind[1:][(data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))] = 0  # times, divided by
        mark = np.zeros(len(data), bool)
        mark[starts] = True
        before = np.append(np.uint8(0), kind[:-1])
        before[starts] = 0
        other = (kind == 0) | (kind == _BLANK) & ~mark | (kind == _LETTER) & (before == _MARK)
        plain = np.repeat(~np.logical_or.reduceat(other, starts), np.diff(starts, append=len(data)))
        if self.cut == "word":
            data = np.where(plain, _LOWER[data], data)
        mark |= plain & (kind == _MARK) & (before == _LETTER)
        return data, np.flatnonzero(mark)

    def starts(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Starts of all pieces: row starts (non-empty rows) and safe cuts."""
        mark = np.zeros(len(data), bool)
        if self.cut == "word":
            mark |= (data == 32) | (data == 10)
        else:
            plain = (data > 32) & (data < 127)
            space = data == 32
            mark[1:] |= space[1:] & plain[:-1]
            mark[:-1] |= space[:-1] & plain[1:]
        mark[off[:-1][np.diff(off) > 0]] = True
        return np.flatnonzero(mark)

    def lookup(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece as packed unsigned 32-bit integers."""
        memo = self.memo
        found = [memo.get(p) for p in pieces]
        new = []
        for i, x in enumerate(found):
            if x is None:
                found[i] = got = self._plain_ids(pieces[i])
                if got is None:
                    new.append(i)
                elif len(memo) < self.memo_pieces:
                    memo[pieces[i]] = got
        for a in range(0, len(new), 4096):
            part = new[a:a + 4096]
            got = self.tok.encode_batch_fast([pieces[i] for i in part], add_special_tokens=False)
            for i, e in zip(part, got, strict=True):
                found[i] = np.array(e.ids, np.uint32).tobytes()
                if len(memo) < self.memo_pieces:
                    memo[pieces[i]] = found[i]
        return found

    def _coded(self, data, off):
        starts = self.starts(data, off)
        if self.plain:
            data, starts = self._words(data, starts)
        coded = strings_at(data, starts).dictionary_encode()
        codes = coded.indices.to_numpy()
        ids = self.lookup(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first = np.searchsorted(starts, off)  # first piece of each row
        return codes, ids, sizes, first

    def counts(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Tokens of each row."""
        if not len(data):
            return np.zeros(len(off) - 1, np.int64)
        codes, _, sizes, first = self._coded(data, off)
        total = np.concatenate([[0], np.cumsum(sizes[codes])])
        return total[first[1:]] - total[first[:-1]]

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all rows, and the ``n + 1`` row offsets into them."""
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(off), np.int64)
        codes, ids, sizes, first = self._coded(data, off)
        flat = np.frombuffer(b"".join(ids), np.uint32)
        at = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        n = sizes[codes]
        total = np.concatenate([[0], np.cumsum(n)])
        take = np.repeat(at[codes] - total[:-1], n) + np.arange(total[-1])
        return flat[take], total[first]

    def encode_texts(self, texts: list[str]) -> list[np.ndarray]:
        from basketry.llm.tasks import text_bytes
        ids, off = self.encode(*text_bytes(pa.array(texts, pa.large_string())))
        return [ids[off[i]:off[i + 1]] for i in range(len(texts))]
