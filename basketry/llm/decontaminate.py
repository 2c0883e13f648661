"""Benchmark decontamination: word-pair seeds, then Smith-Waterman.

1. The benchmark is taken in blocks of bounded size; a block's seeds are the
   only thing sent to the tasks.  Blocks run one after the other, so a
   benchmark of any size is covered exactly.
2. A seed is a pair of item words next to each other or one apart, in order.
   It hits a text where the same two words stand next to each other or one
   apart.  An alignment that scores a share s of an item of L words holds at
   least sL - 1 hits: with m matches and e errors, 2m - e >= 2sL, and of the
   m - 1 steps from one match to the next those without a hit take two errors
   each, so m - 1 - e / 2 >= sL - 1 steps are hits, all at different places.
   One pass counts the documents that hold each pair.  Of an item's most
   frequent places as many may go unread as the bound allows; what is left of
   the bound is the number of hits asked for.
3. One more pass finds the seeds in every whole text and aligns an item with
   the text around each stretch that holds enough hits: local alignment over
   words, so edited and partly copied passages score.  A score is a share of
   the item's own score.  Where sL > 1 no alignment of ``min_score`` is left
   out, however often its words occur and wherever the copy was edited.

No shuffle of texts; the counts are one row per pair of the block and task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm import tasks
from basketry.llm.shingles import shingles, word_spans

#: Bytes of benchmark text in a block; a longer item is a block of its own.
BLOCK_BYTES = 4 << 20
MATCH, MISMATCH, GAP = 2.0, 1.0, 1.0
#: Hits asked for at least where the bound allows more; frequent places are
#: left out only down to this.
LEAST_HITS = 3
#: Pairs of a hit and an item that a task holds at a time.
HELD_HITS = 2_000_000

#: Lower-cases letters and turns ASCII punctuation into blanks, so that words
#: are compared without their marks.
_plain = np.arange(256, dtype=np.uint8)
_plain[65:91] += 32
_plain[[b for b in range(128) if not chr(b).isalnum()]] = 32


@dataclass(frozen=True)
class LeakParams:
    """Items of fewer words than ``ngram`` are looked for whole; places in more
    than ``max_seed_share`` of the documents are frequent; the least score of
    a leak."""
    ngram: int = 3
    max_seed_share: float = 1e-4
    min_score: float = 0.5


def plain_words(data: np.ndarray, off: np.ndarray):
    """Hashes of a text's words without case and ASCII punctuation, and row
    offsets into them."""
    plain = _plain[data]
    starts, ends, row = word_spans(plain, off)
    return tasks.window_hash(tasks.prefix_hash(plain), starts, ends), row


def align(item: np.ndarray, text: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment of two word sequences: score, and the range of
    ``text`` from the first to past the last aligned word."""
    n = len(text)
    best = (0.0, 0, 0)
    gaps = GAP * np.arange(n + 1)
    above, from_above = np.zeros(n + 1), np.arange(n + 1)
    cols = np.arange(n + 1)
    for w in item:
        diag = above[:-1] + np.where(text == w, MATCH, -MISMATCH)
        up = above[1:] - GAP
        cell, origin = np.zeros(n + 1), cols.copy()
        take = diag >= up
        cell[1:] = np.where(take, diag, up)
        origin[1:] = np.where(take, from_above[:-1], from_above[1:])
        dead = cell <= 0
        cell[dead], origin[dead] = 0.0, cols[dead]
        # gaps in the item: the best cell to the left, less its distance
        run = np.maximum.accumulate(cell + gaps)
        lead = np.maximum.accumulate(np.where(cell + gaps >= run, cols, 0))
        cell = run - gaps
        origin = origin[lead]
        dead = cell <= 0
        cell[dead], origin[dead] = 0.0, cols[dead]
        above, from_above = cell, origin
        j = int(cell.argmax())
        if cell[j] > best[0]:
            best = (float(cell[j]), int(origin[j]), j)
    return best


def word_pairs(words: np.ndarray, row: np.ndarray, step: int):
    """Hash of every word with the one ``step`` words on in its row, and the
    place of the first."""
    first = np.arange(max(0, len(words) - step))
    end = np.repeat(row[1:], np.diff(row))[:len(first)]
    first = first[first + step < end]
    return tasks.mix(tasks.mix(words[first] + np.uint64(0x632BE59BD9B4E019))
                     * np.uint64(0x2545F4914F6CDD1D) + words[first + step]), first


class Block:
    """A block of benchmark items, ready for tasks."""

    def __init__(self, ids: list, texts: list[str], ngram: int):
        data, off = tasks.text_bytes(pa.array(texts, pa.large_string()))
        self.ids = ids
        self.words, self.row = plain_words(data, off)
        self.own = np.diff(self.row)
        short = self.own < max(ngram, 2)
        self.short = short
        # sizes to look for: short items are their own n-gram
        self.sizes = sorted({int(x) for x in self.own[short] if x})
        seed, place = [], []
        for step in (1, 2):
            h, first = word_pairs(self.words, self.row, step)
            seed.append(h)
            place.append(first)
        for size in self.sizes:
            h, at = shingles(self.words, self.row, size)
            whole = np.flatnonzero(self.own == size)
            seed.append(h[at[whole]])
            place.append(self.row[whole])
        seed, place = np.concatenate(seed), np.concatenate(place)
        item = np.searchsorted(self.row, place, side="right") - 1
        pair = np.arange(len(seed)) < len(seed) - int((short & (self.own > 0)).sum())
        use = ~(pair & short[item])
        self._seeds(seed[use], item[use], place[use])

    def _seeds(self, seed, item, place) -> None:
        order = np.argsort(seed, kind="stable")
        self.seed, self.item, self.place = seed[order], item[order], place[order]
        self.all = np.unique(self.seed)

    def choose(self, df: np.ndarray, limit: float, least: float) -> None:
        """Keep each item's seeds for scores of ``least`` or more; ``df``:
        documents holding each of ``all``."""
        bound = np.maximum(np.ceil(least * self.own - 1e-9).astype(np.int64) - 1, 1)
        self.need = np.where(self.short, 1, bound)
        # words of text that such an alignment spans
        self.span = np.maximum(np.ceil(self.own * (3 - 2 * least)).astype(np.int64), self.own) + 2
        often = np.zeros(len(self.words), np.int64)
        np.add.at(often, self.place, df[np.searchsorted(self.all, self.seed)])
        item = np.repeat(np.arange(len(self.own)), self.own)
        order = np.lexsort((-often, item))  # an item's most frequent places first
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - self.row[item[order]]
        spare = self.need - np.minimum(self.need, LEAST_HITS)
        gone = (rank < spare[item]) & (often > limit)
        self.need = self.need - np.bincount(item[gone], minlength=len(self.own))
        use = ~gone[self.place]
        self._seeds(self.seed[use], self.item[use], self.place[use])

    def item_words(self, i: int) -> np.ndarray:
        return self.words[self.row[i]:self.row[i + 1]]

    def hits(self, grams: np.ndarray) -> np.ndarray:
        """Positions of ``grams`` that are seeds of the block."""
        if not len(self.all):
            return np.empty(0, np.int64)
        table = self._table()
        maybe = np.flatnonzero(table[(grams >> np.uint64(44)).astype(np.int64)])
        at = np.searchsorted(self.all, grams[maybe])
        return maybe[self.all[np.minimum(at, len(self.all) - 1)] == grams[maybe]]

    def _table(self) -> np.ndarray:
        if getattr(self, "_bits", None) is None or self._bits[0] is not self.all:
            bits = np.zeros(1 << 20, bool)
            bits[(self.all >> np.uint64(44)).astype(np.int64)] = True
            self._bits = (self.all, bits)
        return self._bits[1]

    def stretches(self, gram: np.ndarray, owner: np.ndarray, place: np.ndarray):
        """``(row, item, lo, hi)``: stretches of a row's words around enough
        hits of an item, overlapping ones as one; ``lo`` and ``hi`` may pass
        the row's ends."""
        first = np.searchsorted(self.seed, gram)
        times = np.searchsorted(self.seed, gram, side="right") - first
        before = np.concatenate([[0], np.cumsum(times)])
        at = np.repeat(first - before[:-1], times) + np.arange(before[-1])
        owner, pos, item = np.repeat(owner, times), np.repeat(place, times), self.item[at]
        order = np.lexsort((pos, item, owner))
        owner, item, pos = owner[order], item[order], pos[order]
        new = np.ones(len(pos), bool)  # a place counts once
        new[1:] = (owner[1:] != owner[:-1]) | (item[1:] != item[:-1]) | (pos[1:] != pos[:-1])
        owner, item, pos = owner[new], item[new], pos[new]
        end = np.arange(len(pos)) + self.need[item] - 1
        some = np.flatnonzero(end < len(pos))
        end = end[some]
        near = ((owner[end] == owner[some]) & (item[end] == item[some])
                & (pos[end] - pos[some] <= self.span[item[some]]))
        some, end = some[near], end[near]
        owner, item = owner[end], item[end]
        lo, hi = pos[end] - self.span[item], pos[some] + self.span[item]
        new = np.ones(len(lo), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (item[1:] != item[:-1]) | (lo[1:] > hi[:-1])
        begin = np.flatnonzero(new)
        last = np.append(begin[1:], len(lo))[:len(begin)] - 1
        return owner[begin], item[begin], lo[begin], hi[last]

    def best(self, i: int, text: np.ndarray, least: float) -> tuple[float, int, int]:
        """The best alignment of an item with ``text``, its score as a share;
        0 where the words in common cannot reach ``least``."""
        own = self.item_words(i)
        if np.isin(own, text).sum() < least * len(own) - 1e-9:
            return 0.0, 0, 0
        got = align(own, text)
        return got[0] / (MATCH * len(own)), got[1], got[2]


def blocks(benchmark: DataFrame, ngram: int, id_col: str = "item_id", text_col: str = "text"):
    """The benchmark's items with a word, in blocks of about ``BLOCK_BYTES``.
    Rows stream to the driver a partition at a time; only one block is held."""
    ids, texts, held = [], [], 0
    rows = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where(
        "t is not null").distinct()
    for r in rows.toLocalIterator():
        ids.append(r.i)
        texts.append(r.t)
        held += len(r.t)
        if held >= BLOCK_BYTES:
            yield Block(ids, texts, ngram)
            ids, texts, held = [], [], 0
    if ids:
        yield Block(ids, texts, ngram)


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.col(text_col).alias("text"))


def _steps(batches, block: Block):
    """Per step: batch, rows, words, row offsets, and the block's seeds in it
    with their rows and word places in the row."""
    for b in batches:
        for i, j, data, off in tasks.sliced_texts(b, limit=tasks.HASH_STEP):
            words, row = plain_words(data, off)
            gram, owner, place = [], [], []

            def take(h, first):
                hit = block.hits(h)
                at = first[hit]
                own = np.searchsorted(row, at, side="right") - 1
                gram.append(h[hit])
                owner.append(own)
                place.append(at - row[own])

            for step in (1, 2):
                take(*word_pairs(words, row, step))
            for size in block.sizes:
                h, at = shingles(words, row, size)
                first = np.arange(len(h)) + np.repeat(row[:-1] - at[:-1], np.diff(at))
                take(h, first)
            yield b, i, j, words, row, *map(np.concatenate, (gram, owner, place))


def _leaking(block: Block, words, row, gram, owner, place, least: float):
    """``(row of the step, (item index, score, start word, end word))``: the
    best alignment of each item that scores ``least`` or more in a row."""
    order = np.argsort(owner, kind="stable")
    gram, owner, place = gram[order], owner[order], place[order]
    times = (np.searchsorted(block.seed, gram, side="right") - np.searchsorted(block.seed, gram))
    total = np.bincount(owner, times, len(row) - 1).astype(np.int64)
    at = np.searchsorted(owner, np.arange(len(row)))
    for a, b in tasks.steps(total, HELD_HITS):
        found = {}
        part = slice(at[a], at[b])
        for k, i, lo, hi in zip(*(x.tolist() for x in block.stretches(
                gram[part], owner[part], place[part])), strict=True):
            lo = max(lo, 0)
            score, start, end = block.best(i, words[row[k]:row[k + 1]][lo:hi], least)
            if score >= least and score > found.get((k, i), (0.0,))[0]:
                found[k, i] = score, start + lo, end + lo
        for (k, i), x in sorted(found.items()):
            yield k, (i, *x)


def _choose_seeds(docs: DataFrame, block: Block, p: LeakParams, text_col: str) -> None:
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        blk = shared.value
        total = np.zeros(len(blk.all), np.int64)
        n_rows = 0
        for _, i, j, _, _, gram, owner, _ in _steps(batches, blk):
            n_rows += j - i
            pair = np.unique(owner * len(blk.all) + np.searchsorted(blk.all, gram))
            np.add.at(total, pair % max(1, len(blk.all)), 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(blk.all[some].view(np.int64), 0)),
             pa.array(np.append(total[some], n_rows)),
             pa.array(np.append(np.zeros(len(some), np.int32), np.int32(1)))], ["gram", "n", "kind"])

    rows = (_texts(docs, text_col).mapInArrow(run, "gram bigint, n bigint, kind int")
            .groupBy("kind", "gram").agg(F.sum("n").alias("n")).collect())  # the block's pairs
    n_docs = sum(r.n for r in rows if r.kind == 1)
    df = np.zeros(len(block.all), np.int64)
    some = [r for r in rows if r.kind == 0]
    df[np.searchsorted(block.all, np.array([r.gram for r in some], np.int64).view(np.uint64))] = [
        r.n for r in some]
    block.choose(df, p.max_seed_share * n_docs, p.min_score)
    shared.unpersist()


def find_leaks(docs: DataFrame, benchmark: DataFrame, params: LeakParams = LeakParams(),
               id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text") -> DataFrame:
    """``(doc_id, item_id, score, start_word, end_word)``: every document row
    and benchmark item whose best alignment scores ``min_score`` or more;
    words count from 0 in the text without punctuation, end exclusive.

    Null and empty texts and items without a word leak nothing; an item of
    fewer words than an n-gram is its own n-gram; repeated rows each report;
    null ids are kept; a text of any length is searched whole; with an empty
    table on either side the result is empty.
    """
    spark = docs.sparkSession
    tasks.prepare(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    item_kind = benchmark.schema[item_col].dataType.simpleString()
    schema = (f"doc_id {kind}, item_id {item_kind}, score double, start_word bigint, "
              "end_word bigint")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = spark.createDataFrame([], schema)
    for block in blocks(benchmark, params.ngram, item_col, item_text_col):
        _choose_seeds(rows, block, params, "text")
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            blk = shared.value
            for b, i, _, *step in _steps(batches, blk):
                got = [(i + k, *x) for k, x in _leaking(blk, *step, params.min_score)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array([g[0] for g in got], pa.int64())),
                     pa.array([blk.ids[g[1]] for g in got], item_type),
                     *[pa.array([g[c] for g in got], t) for c, t in
                       ((2, pa.float64()), (3, pa.int64()), (4, pa.int64()))]],
                    ["doc_id", "item_id", "score", "start_word", "end_word"])

        item_type = _arrow_type(benchmark, item_col)
        out = out.unionByName(rows.mapInArrow(run, schema))
    return out


def _arrow_type(df: DataFrame, col: str):
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(df.schema[col].dataType)


def without_leaks(docs: DataFrame, benchmark: DataFrame, params: LeakParams = LeakParams(),
                  text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text") -> DataFrame:
    """``docs``, all columns, without the rows in which an item leaks.  Rows
    stay in their partitions.

    Null and empty texts stay; null ids and repeated rows are judged each; an
    empty table on either side leaves ``docs`` as it is; a text of any length
    is searched whole; columns of any name are carried along.  Seeds are
    counted over all of ``docs`` for every block, so no count waits for the
    alignments of the blocks before it; all blocks are tested in one pass.
    """
    spark, every = docs.sparkSession, docs
    tasks.prepare(spark)
    for block in blocks(benchmark, params.ngram, item_col, item_text_col):
        _choose_seeds(every, block, params, text_col)
        shared = spark.sparkContext.broadcast(block)
        packed = docs.select(F.col(text_col).alias("text"),
                             F.struct(*[F.col(c) for c in docs.columns]).alias("row"))

        def run(batches, shared=shared):
            blk = shared.value
            for b, i, j, *step in _steps(batches, blk):
                keep = np.ones(j - i, bool)
                keep[[k for k, _ in _leaking(blk, *step, params.min_score)]] = False
                yield pa.RecordBatch.from_arrays(
                    [b.column(1).slice(i, j - i).filter(pa.array(keep))], ["row"])

        kept = packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}")
        docs = kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
    return docs
