"""Word shingles of whole texts as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

from basketry.llm import tasks

_blank = np.zeros(256, bool)
_blank[[9, 10, 11, 12, 13, 32]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def word_spans(data: np.ndarray, off: np.ndarray):
    """Words ``[^\\x20\\x09-\\x0D]+`` of every row: starts, ends, and the
    ``n + 1`` row offsets into them.  Words never cross rows."""
    inside = ~_blank[data]
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    edge = off[:-1][np.diff(off) > 0]
    before[edge] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[edge[edge > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, off: np.ndarray):
    """Hash of every A-Z lower-cased word, and row offsets into them."""
    starts, ends, row = word_spans(data, off)
    prefix = tasks.prefix_hash(_lower[data])
    return tasks.window_hash(prefix, starts, ends), row


def shingles(words: np.ndarray, row: np.ndarray, size: int):
    """Hash of every ``size``-word shingle and row offsets into them; a row of
    fewer words has its whole sequence as one, a row of none has none."""
    n = np.diff(row)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    out_off = np.concatenate([[0], np.cumsum(count)])
    first = np.repeat(row[:-1] - out_off[:-1], count) + np.arange(out_off[-1])
    end = np.repeat(row[1:], count)
    h = np.zeros(len(first), np.uint64)
    for k in range(size):
        at = np.minimum(first + k, max(len(words) - 1, 0))
        part = words[at] if len(words) else h
        h = np.where(first + k < end, tasks.mix(h * np.uint64(0x2545F4914F6CDD1D) + part
                                                + np.uint64(k + 1)), h)
    return h, out_off


def distinct_sets(data: np.ndarray, off: np.ndarray, size: int):
    """Each row's sorted distinct shingles: values and row offsets."""
    words, row = word_hashes(data, off)
    h, at = shingles(words, row, size)
    owner = np.repeat(np.arange(len(off) - 1), np.diff(at))
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(len(off)))
