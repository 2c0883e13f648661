"""License scans: fuzzy search for short notices.

A text is normalised to its words (A-Z lower-cased, one blank between words).
Base phrases count wherever their words stand consecutively.  Notices may
hold errors: a notice that allows ``k`` errors is split into ``k + EXACT``
pieces, and by the pigeonhole principle any passage within ``k`` errors holds
at least ``EXACT`` of them unchanged, at offsets that differ by ``k`` at
most.  One Aho-Corasick pass finds all pieces and phrases; where enough
pieces of a notice agree, the regex library's bounded-error matching verifies
the passage and gives its span and errors.

One pass, no shuffle.  The texts of a step are normalised together in
vectorised byte work; Python sees hits only.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm import tasks

#: The base phrases and their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"),
           ("general public license", "gpl")]

#: Short notices as normalised words, and their labels.
NOTICES = [
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("licensed under the gnu general public license version", "gpl"),
    ("under the terms of the gnu general public license as published by", "gpl"),
    ("licensed under the gnu lesser general public license version", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under a creative commons attribution", "cc"),
    ("licensed under cc by nc", "cc"),
    ("distributed under the boost software license version 1 0", "boost"),
]

#: One error is allowed for so many characters of a notice (at least one).
CHARS_PER_ERROR = 15
#: Unchanged pieces asked for: more keep chance hits from the costly check.
EXACT = 3


@dataclass(frozen=True)
class Notice:
    text: str
    label: str
    errors: int

    def pieces(self) -> list[tuple[int, str]]:
        """``errors + EXACT`` pieces of about equal length and their offsets."""
        n = self.errors + EXACT
        cut = [len(self.text) * i // n for i in range(n + 1)]
        return [(a, self.text[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


def notices(texts=tuple(NOTICES), chars_per_error: int = CHARS_PER_ERROR) -> list[Notice]:
    return [Notice(t, label, max(1, len(t) // chars_per_error)) for t, label in texts]


def _word_table() -> np.ndarray:
    """Bytes of words as they are, A-Z lower-cased, all others a blank."""
    table = np.full(256, 32, np.uint8)
    for b in [*range(48, 58), *range(97, 123), *range(128, 256)]:
        table[b] = b
    for b in range(65, 91):
        table[b] = b + 32
    return table


_table = _word_table()
ROW = 10  # byte between rows of a step; no word and no piece holds it


class Normalised:
    """The rows of a step as one byte string ``\\n word word \\n ...``; every
    row's words stand between blanks."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        edge = np.tile(np.array([32, ROW, 32], np.uint8), len(off))
        wide = np.insert(_table[data], np.repeat(off, 3), edge)
        blank = wide == 32
        keep = np.ones(len(wide), bool)
        keep[1:] = ~(blank[1:] & blank[:-1])
        self.data, self.off, self.keep = data, off, keep
        self.norm = wide[keep]
        self.rows = np.flatnonzero(self.norm == ROW)  # row r lies between edges r and r + 1
        ordinary = (self.norm != 32) & (self.norm != ROW)
        begins = ordinary.copy()
        begins[1:] &= ~ordinary[:-1]
        self.words = np.concatenate([[0], np.cumsum(begins)])
        self.text = self.norm.tobytes().decode("latin-1")

    def n_words(self) -> np.ndarray:
        return np.diff(self.words[self.rows])

    def row_of(self, at: int) -> int:
        return int(np.searchsorted(self.rows, at, side="right")) - 1

    def word_of(self, row: int, at: int) -> int:
        """Number, in its row, of the word that begins at ``at``."""
        return int(self.words[at] - self.words[self.rows[row]])

    def place(self, row: int, a: int, b: int) -> tuple[int, int]:
        """Code points of the row's text that ``norm[a:b]`` comes from."""
        if not hasattr(self, "source"):
            self.source = np.flatnonzero(self.keep)
            self.chars = np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80)])
        start, last = (int(self.source[x]) - 3 * (row + 1) for x in (a, b - 1))
        base = self.chars[self.off[row]]
        return int(self.chars[start] - base), int(self.chars[last + 1] - base)


class Finder:
    """Phrases and notices over normalised rows."""

    def __init__(self, phrases, found: list[Notice]):
        self.phrases, self.notices = list(phrases), list(found)
        self.patterns = [regex.compile(f"(?:{regex.escape(n.text, literal_spaces=True)})"
                                       f"{{e<={n.errors}}}", regex.ENHANCEMATCH)
                         for n in self.notices]
        meant = defaultdict(list)
        for p, (words, _) in enumerate(self.phrases):
            meant[f" {words} "].append((None, p, 0))
        for i, n in enumerate(self.notices):
            for p, (offset, piece) in enumerate(n.pieces()):
                meant[piece].append((i, p, offset))
        self.machine = ahocorasick.Automaton()
        for piece, uses in meant.items():
            self.machine.add_word(piece, (len(piece), uses))
        self.machine.make_automaton()

    def find(self, norm: Normalised):
        """``(phrase hits, notice hits)``: ``(row, phrase, start word)`` and
        ``(row, notice, a, b, errors)`` with places in ``norm``."""
        exact, seeds = [], defaultdict(list)
        for end, (size, uses) in self.machine.iter(norm.text):
            start = end + 1 - size
            for i, p, offset in uses:
                if i is None:
                    row = norm.row_of(start)
                    exact.append((row, p, norm.word_of(row, start + 1)))
                else:
                    seeds[i].append((start - offset, p))
        fuzzy = []
        for i, hits in seeds.items():
            for a, b in self.regions(i, hits):
                fuzzy += self.verify(norm, i, a, b)
        return exact, fuzzy

    def regions(self, i: int, hits: list) -> list[tuple[int, int]]:
        """Where ``EXACT`` different pieces begin the notice within its errors
        of one another; regions that meet are one."""
        k, size = self.notices[i].errors, len(self.notices[i].text)
        hits.sort()
        out, held, a = [], defaultdict(int), 0
        for at, p in hits:
            held[p] += 1
            while hits[a][0] < at - k:
                old = hits[a][1]
                held[old] -= 1
                if not held[old]:
                    del held[old]
                a += 1
            if len(held) >= EXACT:
                start, end = hits[a][0] - k, at + size + k
                if out and start <= out[-1][1]:
                    out[-1] = (out[-1][0], end)
                else:
                    out.append((start, end))
        return out

    def verify(self, norm: Normalised, i: int, a: int, b: int):
        """Passages of the region within the notice's errors, row by row."""
        a, b = max(a, 0), min(b, len(norm.text))
        first, last = max(norm.row_of(a), 0), norm.row_of(b - 1)
        for row in range(first, min(last, len(norm.rows) - 2) + 1):
            lo, hi = max(a, int(norm.rows[row]) + 1), min(b, int(norm.rows[row + 1]))
            for m in self.patterns[i].finditer(norm.text, lo, hi):
                s, e = m.span()
                while s < e and norm.text[s] == " ":
                    s += 1
                while e > s and norm.text[e - 1] == " ":
                    e -= 1
                if s < e:
                    yield row, i, s, e, sum(m.fuzzy_counts)


def scan(docs: DataFrame, phrases=tuple(PHRASES), found: list[Notice] | None = None,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score, spans)``, one row per input row.

    Words are ``[0-9a-z]`` and non-ASCII characters.  ``n_base`` counts the
    places of all phrases, ``first_word`` and ``last_word`` their least and
    greatest start (null without one); ``labels`` adds those of the notices
    found.  ``score`` is 1 with a phrase, else the best notice's share of
    characters without error, else 0.  ``spans`` lists the notices as
    ``label:start:end:errors`` in code points of the text, by start.

    Errors are insertions, deletions and substitutions of the UTF-8 bytes of
    the normalised text.  A null or empty text has no words, no labels ('')
    and score 0; null ids and repeated rows are kept; an empty table gives an
    empty result; other columns are ignored, whatever their names.  A text of
    any length is searched whole.
    """
    tasks.prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    phrases, found = list(phrases), notices() if found is None else list(found)
    fields = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
              ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()),
              ("score", pa.float64()), ("spans", pa.string())]

    def rows(finder, data, off):
        norm = Normalised(data, off)
        exact, fuzzy = finder.find(norm)
        starts, base, labels = defaultdict(list), defaultdict(set), defaultdict(set)
        best, spans = defaultdict(float), defaultdict(list)
        for row, p, word in exact:
            starts[row].append(word)
            base[row].add(phrases[p][1])
            best[row] = 1.0
        for row, i, a, b, errors in fuzzy:
            n = found[i]
            labels[row].add(n.label)
            best[row] = max(best[row], 1.0 - errors / len(n.text))
            spans[row].append((*norm.place(row, a, b), n.label, errors))
        for row, n_words in enumerate(norm.n_words().tolist()):
            at = starts.get(row)
            yield (n_words, len(at) if at else 0, min(at) if at else None,
                   max(at) if at else None, ",".join(sorted(base.get(row, ()))),
                   ",".join(sorted(base.get(row, set()) | labels.get(row, set()))),
                   best.get(row, 0.0),
                   ",".join(f"{label}:{a}:{b}:{e}" for a, b, label, e
                            in sorted(set(spans.get(row, ())))))

    def run(batches):
        finder = None
        for batch in batches:
            finder = finder or Finder(phrases, found)
            for i, j, data, off in tasks.sliced_texts(batch):
                got = list(rows(finder, data, off))
                cols = [pa.array([x[k] for x in got], t) for k, (_, t) in enumerate(fields)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), *cols], ["doc_id", *[f for f, _ in fields]])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
             "base_labels string, labels string, score double, spans string")
