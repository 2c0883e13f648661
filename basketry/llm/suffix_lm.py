"""Language-model scoring with a probabilistic suffix tree over words.

A text is its lower-cased words and an end token, all of them symbols of the
tree.  The empty context has the add-one distribution of the baseline.  The
tree grows a level at a time: a context (the last words) is a candidate when
the training texts hold it at least ``least`` times, and what follows the
candidates is counted in one pass per level.  A context is retained when its
next-symbol distribution diverges from that of its longest proper suffix, or
when a longer retained context needs it.  Distributions are smoothed towards
the suffix's; a next symbol seen fewer than ``next_least`` times has its share
of the suffix's alone.  A symbol is scored in the state of the longest
retained context.

While counting, a task holds the commonest contexts and words of stated number
and counts what stands behind them as a pair of their places; other pairs are
three hashes: the row, its context and its suffix's row.  A row is counted only
where its suffix's row, of a longer table before it, may have been kept: a
bitmap says so and only ever lets too many pass.  Counts travel as sorted
values in their differences, a few bytes each, dealt by ranges of equal width;
one task sums a range.

Contexts, counts and states are Spark tables keyed by 64-bit hashes, so the
tree is as large as the corpus makes it: divergence and smoothing are grouped
aggregates and joins by hash.  ``log10`` of a probability is a sum over the
retained suffixes of a position's context, each adding one weight for itself
and one for the next symbol if that was counted, on top of the word's.  The
tasks hold the commonest weights, of stated number, and a bitmap that passes
over most keys without a weight.  Other weights are looked up for a block of
texts at once: it asks for each of its keys a single time, with the documents
that have it, and gets back one sum per document and range of keys.  So are
words: those counted twice or more and those counted once have a bitmap each,
and a word of a training text that is not in the first was counted once.  None
of this decides a result.

Tables of a level go when the weights are written, and shuffles of a step when
the step ends.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry import session
from basketry.llm import tasks
from basketry.llm.shingles import word_hashes

#: Keys of the end token and of the empty context; the mark that tells a
#: context's own weight from that of the same words as context and symbol.
END, ROOT, OWN = 0x5EED0E4D, 0, 0x0F0F0F0F0F0F0F0F
#: Distinct values a counting task holds before it hands them on.
HELD_KEYS = 750_000
#: Bits of a bitmap of wanted keys: about 16 a key, 128 KB to 32 MB.
BITMAP_BITS = 1 << 20, 1 << 28
#: Training tokens for each range of counted pairs, and looked-up words and
#: weights in a range of their keys: what one task holds.
RANGE_TOKENS, RANGE_KEYS = 2 << 20, 2 << 20
#: Keys and documents of a block, whose keys are asked for together.
BLOCK_KEYS, BLOCK_DOCS = 1_500_000, 1 << 16
_SECOND = 32  # bits of a key below those of its second slot
_CHUNK = 1 << 15  # positions in one bitmap of Spark's bitmap_construct_agg
_SPREAD = 0x9E3779B97F4A7C15  # odd: spreads pairs of places over their ranges
_COUNTS = "part int, hashed boolean, first bigint, keys binary, times binary, ctx binary, parent binary"
_GRAM = "key bigint, ctx bigint, parent bigint, n bigint, word boolean"
#: Rows on their way to a range of keys: its words and weights, a block's keys,
#: and documents that only pass; behind it, documents and sums.
ANSWER, ASK, DOC, SUM = 0, 1, 2, 3


@dataclass(frozen=True)
class LmParams:
    """Fold rule: ids with ``crc32(id as text) mod folds = held_fold`` are
    held out.  A context is a candidate from ``least`` occurrences, whatever
    the size of the corpus; a caller who wants a smaller tree may ask for
    ``root_share * sqrt(training tokens)`` as well.  ``min_divergence`` is in
    nats over all occurrences of a context, beyond one nat per next symbol;
    ``smoothing`` is the weight of the suffix's distribution.  ``held_words``,
    ``held_contexts`` and ``held_weights`` bound what a task holds and do not
    change results."""
    folds: int = 7
    held_fold: int = 2
    depth: int = 3
    least: int = 64
    root_share: float = 0.0
    next_least: int = 4
    min_divergence: float = 10.0
    smoothing: float = 8.0
    held_words: int = 400_000
    held_contexts: int = 400_000
    held_weights: int = 800_000


# -- texts as symbols --------------------------------------------------------

def tokens_of(data: np.ndarray, off: np.ndarray):
    """Hash of every lower-cased word, with an end token behind each row: the
    tokens, their rows, and their places in the rows."""
    hashes, row = word_hashes(data, off)
    n = len(off) - 1
    size = np.diff(row)
    owner = np.repeat(np.arange(n), size + 1)
    out = np.full(len(owner), END, np.uint64)
    words = np.repeat(np.arange(n), size)
    out[np.arange(len(hashes)) + words] = hashes
    place = np.arange(len(owner)) - np.repeat(row[:-1] + np.arange(n), size + 1)
    return out, owner, place


def joined(ctx: np.ndarray, sym: np.ndarray) -> np.ndarray:
    """Key of a context followed by a symbol."""
    return tasks.mix(ctx * np.uint64(0xD1342543DE82EF95) + sym + np.uint64(1))


def contexts(tokens: np.ndarray, place: np.ndarray, depth: int):
    """For every width up to ``depth``: the positions that have a context of
    that many words in their row, and its key."""
    key = tokens
    for width in range(1, depth + 1):
        at = np.flatnonzero(place >= width)
        ctx = key[at - 1]
        yield at, ctx
        if width < depth:
            key = np.zeros(len(tokens), np.uint64)
            key[at] = joined(ctx, tokens[at])


# -- sorted values on their way -------------------------------------------------

def ranges(values: np.ndarray, n: int, bits: int = 64) -> np.ndarray:
    """Which of ``n`` ranges of equal width holds each value below ``2**bits``."""
    lead = (values << np.uint64(64 - bits)) >> np.uint64(32)
    return ((lead * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def squeezed(values: np.ndarray, width: int = 0) -> bytes:
    """An array compressed, all first bytes of its values before all second
    ones; of ``width`` bytes each where the others are zero."""
    size = values.itemsize
    raw = np.ascontiguousarray(values.view(np.uint8).reshape(-1, size)[:, :width or size].T)
    return raw.nbytes.to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def whole(data, n: int, kind) -> np.ndarray:
    """The ``n`` values of ``squeezed``."""
    size = int.from_bytes(memoryview(data)[:8], "little")
    out = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
    if size:
        raw = np.frombuffer(pa.decompress(memoryview(data)[8:], size, "zstd"), np.uint8)
        out[:, :size // n] = raw.reshape(-1, n).T
    return out.view(kind).reshape(n)


def size_of(data) -> int:
    return int.from_bytes(memoryview(data)[:8], "little")


def differences(values: np.ndarray) -> bytes:
    """Ascending values but for the first, as differences of the fewest bytes
    that hold them."""
    d = np.diff(values, prepend=values[:1])
    return squeezed(d, max(1, (int(d.max(initial=0)).bit_length() + 7) // 8))


def values_of(first: int, data, n: int) -> np.ndarray:
    out = whole(data, n, np.uint64)
    out[:1] = np.int64(first).view(np.uint64)
    return np.cumsum(out, dtype=np.uint64)


def in_bytes(n: np.ndarray):
    """Numbers above 0 as bytes, several for one above 255: the place of the
    number of each byte, and the bytes."""
    if not len(n) or n.max() < 256:
        return np.arange(len(n)), n.astype(np.uint8)
    times = (n + 254) // 255
    at = np.repeat(np.arange(len(n)), times)
    out = np.full(len(at), 255, np.uint8)
    last = np.cumsum(times) - 1
    out[last] = n - 255 * (times - 1)
    return at, out


def cut(part: np.ndarray):
    """``(part, i, j)`` of every run of equal parts."""
    at = np.flatnonzero(np.append(True, part[1:] != part[:-1])[:len(part)])
    return zip(part[at].tolist(), at.tolist(), np.append(at[1:], len(part)).tolist(), strict=True)


def runs(batches):
    """Slices of record batches with one value in the first column."""
    for b in batches:
        for value, i, j in cut(b.column(0).to_numpy(zero_copy_only=False)):
            yield value, b.slice(i, j - i)


def _first(value: np.ndarray) -> int:
    return int(value[:1].view(np.int64)[0])


# -- sets of keys in tasks ------------------------------------------------------

def bitmap(keys: DataFrame, column: str = "key") -> np.ndarray:
    """A bitmap with the two slots of every key set: a key without both bits
    is not in ``keys``.  Its size ends at 32 MB, so in a very large table it
    passes more keys that a join then drops."""
    least, most = BITMAP_BITS
    size = min(max(least, 1 << (16 * keys.count()).bit_length()), most)
    slots = [x.bitwiseAND(F.lit(size - 1))
             for x in (F.col(column), F.shiftrightunsigned(column, _SECOND))]
    got = keys.select(F.explode(F.array(*slots)).alias("slot")).groupBy(F.shiftright("slot", 15).alias("chunk")).agg(
        F.bitmap_construct_agg(F.col("slot").bitwiseAND(F.lit(_CHUNK - 1))).alias("bits")).toArrow()
    out = np.zeros(size // 8, np.uint8)
    for chunk, bits in zip(got["chunk"].to_pylist(), got["bits"], strict=True):  # 4 KB each
        part = np.frombuffer(bits.as_buffer(), np.uint8)
        out[chunk * (_CHUNK // 8):][:len(part)] = part
    return out


def maybe_in(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    mask = np.uint64(8 * len(bits) - 1)

    def has(slot):
        slot = (slot & mask).astype(np.int64)
        return (bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)

    out = has(keys)
    first = np.flatnonzero(out)
    out[first] = has(keys[first] >> np.uint64(_SECOND))
    return out


class Sent:
    """What goes to tasks with its bitmaps compressed."""

    def __getstate__(self):
        return {k: (squeezed(x), len(x)) if isinstance(x, np.ndarray) else x for k, x in vars(self).items()}

    def __setstate__(self, state):
        vars(self).update({k: whole(*x, np.uint8) if isinstance(x, tuple) else x for k, x in state.items()})


@dataclass
class Held:
    """The commonest keys (ascending) and their values."""
    keys: np.ndarray
    value: np.ndarray
    _first: np.ndarray | None = None  # first key of each range of leading bits

    def __getstate__(self):
        return {"n": len(self.keys), "first": _first(self.keys) if len(self.keys) else 0,
                "keys": differences(self.keys), "kind": self.value.dtype.str,
                "value": (squeezed(self.value), len(self.value))}

    def __setstate__(self, state):
        self.keys = values_of(state["first"], state["keys"], state["n"])
        self.value, self._first = whole(*state["value"], state["kind"]), None

    def index(self, wanted: np.ndarray) -> np.ndarray:
        """Place of each wanted key among the held ones, -1 for others."""
        out = np.full(len(wanted), -1, np.int64)
        if not len(self.keys):
            return out
        bits = len(self.keys).bit_length() + 1
        if self._first is None:
            edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
            self._first = np.append(np.searchsorted(self.keys, edges), len(self.keys)).astype(np.int32)
        slot = (wanted >> np.uint64(64 - bits)).astype(np.int64)
        at, end = self._first[slot], self._first[slot + 1]
        todo = np.flatnonzero(at < end)
        at, end = at[todo], end[todo]
        while len(todo):
            hit = self.keys[at] == wanted[todo]
            out[todo[hit]] = at[hit]
            at = at + 1
            more = ~hit & (at < end)
            todo, at, end = todo[more], at[more], end[more]
        return out

    def find(self, wanted: np.ndarray):
        """Value of each wanted key (0 for others) and whether it is held."""
        at = self.index(wanted)
        hit = at >= 0
        value = np.zeros(len(wanted))
        value[hit] = self.value[at[hit]]
        return value, hit


def commonest(table: DataFrame, value: str, limit: int) -> tuple[Held, DataFrame]:
    """Of ``table(key, n, value)`` at most ``limit`` keys of the greatest
    ``n``, and the rest of the table."""
    grade = F.floor(F.log2("n") * 16)
    least, room = None, limit
    for r in sorted(table.groupBy(grade.alias("grade")).count().collect(), reverse=True):
        room -= r["count"]
        if room < 0:
            break
        least = r.grade
    if least is None:
        return Held(np.empty(0, np.uint64), np.empty(0)), table
    got = table.where(grade >= least).select("key", value).toArrow()
    keys = got["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return Held(keys[order], got[value].to_numpy()[order]), table.where(grade < least)


# -- counting -----------------------------------------------------------------

def _rows(*columns):
    """Record batches of ``(ctx, sym, n)``."""
    for a in range(0, len(columns[0]), 200_000):
        yield pa.RecordBatch.from_arrays(
            [pa.array(x[a:a + 200_000].view(np.int64), pa.int64()) for x in columns],
            ["ctx", "sym", "n"])


def _plain(value, n):
    return _rows(value, np.zeros(len(value), np.int64), n)


class Tally:
    """Counts of 64-bit values, merged as they grow; handed on in ascending
    order as ``make`` has it, without it as ``(ctx, sym, n)`` with the value in
    ``ctx`` and zero in ``sym``.  ``more`` columns follow from the value."""

    def __init__(self, make=_plain):
        self.held: list[tuple] = []
        self.size, self.make = 0, make

    def add(self, values, *more):
        if more:
            value, at, n = np.unique(values, return_index=True, return_counts=True)
        else:
            (value, n), at = np.unique(values, return_counts=True), None
        self.put(value, n, *(x[at] for x in more))
        if self.size > HELD_KEYS:
            self.merge()
            if self.size > HELD_KEYS // 2:
                yield from self.rest()

    def put(self, *columns) -> None:
        self.held.append(columns)
        self.size += len(columns[0])

    def merge(self) -> None:
        value, n, *more = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.argsort(value, kind="stable")
        value = value[order]
        new = np.flatnonzero(np.append(True, value[1:] != value[:-1])[:len(value)])
        self.held = [(value[new], np.add.reduceat(n[order], new) if len(new) else n,
                      *(x[order[new]] for x in more))]
        self.size = len(new)

    def rest(self):
        if self.size:
            self.merge()
            yield from self.make(*self.held.pop())
        self.held, self.size = [], 0


class Sums:
    """Counts of a range from many tasks."""

    def __init__(self):
        self.tally, self.least = Tally(), HELD_KEYS

    def put(self, *columns) -> None:
        self.tally.put(*columns)
        if self.tally.size > 2 * self.least:
            self.tally.merge()
            self.least = max(HELD_KEYS, self.tally.size)

    def all(self):
        """The columns in ascending order, None if nothing came."""
        if not self.tally.held:
            return None
        self.tally.merge()
        return self.tally.held[0]


def packed(n_ranges: int, hashed: bool, bits: int = 64):
    """For a tally: its values as rows of ``_COUNTS``, one per range."""
    kind = pa.schema([("part", pa.int32()), ("hashed", pa.bool_()), ("first", pa.int64()),
                      *((x, pa.binary()) for x in ("keys", "times", "ctx", "parent"))])

    def make(value, n, *more):
        at, n = in_bytes(n)
        value, more = value[at], [x[at] for x in more]
        yield pa.RecordBatch.from_pylist([
            dict(part=part, hashed=hashed, first=_first(value[i:]), keys=differences(value[i:j]),
                 times=squeezed(n[i:j]), **{k: squeezed(x[i:j]) for k, x in zip(("ctx", "parent"), more)})
            for part, i, j in cut(ranges(value, n_ranges, bits))], kind)

    return make


def _counts(piece):
    """Of rows of ``_COUNTS``: values and counts, and of hashed ones contexts
    and suffix rows."""
    for hashed, first, keys, times, ctx, parent in zip(*(piece.column(i) for i in range(1, 7)), strict=True):
        times = times.as_buffer()
        n = whole(times, size_of(times), np.uint8).astype(np.int64)
        value = values_of(first.as_py(), keys.as_buffer(), len(n))
        more = [whole(x.as_buffer(), len(n), np.uint64) for x in (ctx, parent)] if hashed.as_py() else []
        yield value, n, *more


def by_part(rows: DataFrame) -> DataFrame:
    return rows.repartition("part").sortWithinPartitions("part")


@dataclass
class Wanted(Sent):
    """What a task holds to count a level: the commonest contexts (with their
    suffixes) and words, and bitmaps of all others (None without any) and of
    the rows of the level before."""
    contexts: Held
    more_contexts: np.ndarray | None
    words: Held
    more_words: np.ndarray | None
    before: np.ndarray

    @property
    def shift(self) -> np.uint64:
        return np.uint64(len(self.words.keys).bit_length())

    @property
    def bits(self) -> int:
        return max(1, int(self.shift) + len(self.contexts.keys).bit_length())

    @property
    def mask(self) -> np.uint64:
        return np.uint64((1 << self.bits) - 1)

    def split(self, tokens, place, width: int):
        """The pairs of a context of ``width`` words and the token behind it
        that may be kept: as one value where both are held, else the keys of
        the row, of its context and of its suffix's row."""
        *shorter, (at, ctx) = contexts(tokens, place, width)
        c = self.contexts.index(ctx)
        use = c >= 0
        if self.more_contexts is not None:
            use |= maybe_in(self.more_contexts, ctx)
        at, ctx, c = at[use], ctx[use], c[use]
        key = tokens
        if shorter:  # the suffix's row
            key = np.zeros(len(tokens), np.uint64)
            key[shorter[-1][0]] = shorter[-1][1]
            key[at] = joined(key[at], tokens[at])
        use = maybe_in(self.before, key[at])
        at, ctx, c = at[use], ctx[use], c[use]
        sym, parent = tokens[at], key[at]
        s = self.words.index(sym)
        both = (c >= 0) & (s >= 0)
        other = ~both & (s >= 0)
        if self.more_words is not None:
            other |= ~both & maybe_in(self.more_words, sym)
        pairs = c[both].view(np.uint64) << self.shift | s[both].view(np.uint64)
        return (pairs * np.uint64(_SPREAD) & self.mask,
                joined(ctx[other], sym[other]), ctx[other], parent[other])

    def rows(self, value, width: int):
        """Of pairs the keys of their rows, contexts and suffix rows, and
        whether a word stands behind the context."""
        pairs = value * np.uint64(pow(_SPREAD, -1, 1 << 64)) & self.mask
        c = pairs >> self.shift
        ctx = self.contexts.keys[c]
        sym = self.words.keys[pairs & ((np.uint64(1) << self.shift) - np.uint64(1))]
        parent = sym if width == 1 else joined(self.contexts.value[c].view(np.uint64), sym)
        return joined(ctx, sym), ctx, parent, sym != np.uint64(END)


def next_counts(rows: DataFrame, width: int, wanted, least: int, n_ranges: int) -> DataFrame:
    """``(key, ctx, parent, n, word)``: how often each symbol follows each
    context of ``width`` words in ``rows(text)``, from ``least`` times on,
    where the broadcast ``wanted`` lets both pass; ``parent`` is the key of the
    same row behind the context's suffix."""
    def run(batches):
        w = wanted.value
        pairs = Tally(packed(n_ranges, False, w.bits))
        others = Tally(packed(n_ranges, True))
        for b in batches:
            for _, _, data, off in tasks.sliced_texts(b, limit=tasks.HASH_STEP):
                tokens, _, place = tokens_of(data, off)
                both, *other = w.split(tokens, place, width)
                yield from pairs.add(both)
                yield from others.add(*other)
        yield from pairs.rest()
        yield from others.rest()

    def summed(batches):
        w = wanted.value
        for _, group in groupby(runs(batches), lambda x: x[0]):
            pairs, others = Sums(), Sums()
            for _, piece in group:
                for columns in _counts(piece):
                    (others if len(columns) > 2 else pairs).put(*columns)
            for got in (pairs.all(), others.all()):
                if got is None:
                    continue
                keep = got[1] >= least
                value, n, *more = (x[keep] for x in got)
                if more:
                    key, (ctx, parent) = value, more
                    word = key != joined(ctx, np.full(len(ctx), END, np.uint64))
                else:
                    key, ctx, parent, word = w.rows(value, width)
                for a in range(0, len(key), 50_000):
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(x[a:a + 50_000].view(np.int64)) for x in (key, ctx, parent, n)),
                         pa.array(word[a:a + 50_000])], ["key", "ctx", "parent", "n", "word"])

    return by_part(rows.mapInArrow(run, _COUNTS)).mapInArrow(summed, _GRAM)


def word_counts(rows: DataFrame) -> DataFrame:
    """``(key, n)``: the tokens of ``rows(text)``."""
    n_ranges = session.shuffle_partitions(rows.sparkSession)

    def run(batches):
        tally = Tally(packed(n_ranges, False))
        for b in batches:
            for _, _, data, off in tasks.sliced_texts(b, limit=tasks.HASH_STEP):
                yield from tally.add(tokens_of(data, off)[0])
        yield from tally.rest()

    def summed(batches):
        for _, group in groupby(runs(batches), lambda x: x[0]):
            sums = Sums()
            for _, piece in group:
                for columns in _counts(piece):
                    sums.put(*columns)
            value, n = sums.all()
            for a in range(0, len(value), 100_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[a:a + 100_000].view(np.int64)) for x in (value, n)], ["key", "n"])

    return by_part(rows.mapInArrow(run, _COUNTS)).mapInArrow(summed, "key bigint, n bigint")


# -- the tree -------------------------------------------------------------------

def words(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """Counts of all tokens of ``rows(text)``, how many there are, and how
    many different ones."""
    got = session.write_table(word_counts(rows), "lm-words")
    one = got.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    return got, one.n or 0, one.v


def _others(rest: DataFrame, column: str = "key") -> np.ndarray | None:
    return None if rest.isEmpty() else bitmap(rest, column)


def _level(rows: DataFrame, last: DataFrame, symbols: tuple, width: int, least: float, n: int, p: LmParams):
    """One level from the one before, ``last(key, parent, n, word, p)``: its
    own table with ``ctx`` and ``weight``, and its contexts ``(ctx, suffix,
    total, free, diverges)``; nothing when there is no candidate.

    A kept row's suffix row is kept: its words occur where the row's do."""
    spark = rows.sparkSession
    known = last.where((F.col("n") >= least) & F.col("word")).select(
        F.col("key").alias("ctx"), F.col("n").alias("total"), F.col("parent").alias("suffix"))
    if known.isEmpty():
        return None
    held, rest = commonest(known.select(F.col("ctx").alias("key"), F.col("total").alias("n"), "suffix"),
                           "suffix", p.held_contexts)
    wanted = spark.sparkContext.broadcast(Wanted(held, _others(rest), *symbols, bitmap(last)))
    old = last.select(F.col("key").alias("parent"), F.col("p").alias("old"))
    with session.work(spark) as keep:
        counted = session.write_table(
            next_counts(rows, width, wanted, p.next_least, n // RANGE_TOKENS + 1), "lm-counted")
        wanted.destroy()
        found = session.write_table(counted.join(old, "parent"), "lm-grams")
        # sum of n * log(n / total / old)
        gain = F.col("gain") - F.col("kept") * F.log("total")
        sums = found.groupBy("ctx").agg(
            F.sum("n").alias("kept"), F.count(F.lit(1)).alias("next"),
            F.sum(F.col("n") * F.log(F.col("n") / F.col("old"))).alias("gain"))
        scale = F.col("total") + p.smoothing
        states = keep(known.join(sums, "ctx").select(
            "ctx", "suffix", "total", (gain >= p.min_divergence + F.col("next")).alias("diverges"),
            ((scale - F.col("kept")) / scale).alias("free")), "lm-states")
        prob = F.col("n") / scale + F.col("free") * F.col("old")
        table = keep(found.join(states.select("ctx", "total", "free", "diverges"), "ctx").select(
            "ctx", "key", "parent", "n", "word", "diverges", prob.alias("p"),
            F.log10(prob / F.col("old") / F.col("free")).alias("weight")), "lm-level")
    return table, states


def weights(rows: DataFrame, counts: DataFrame, n: int, v: int, p: LmParams) -> DataFrame:
    """``(key, n, weight)`` of the tree of ``rows(text)``: a retained context
    adds log10 of what it leaves to its suffix (its key marked with ``OWN``),
    a symbol counted behind it the rest of its probability."""
    least = max(p.least, p.next_least, p.root_share * n ** 0.5)
    last = counts.where(F.col("n") >= p.next_least).select(
        "key", F.lit(ROOT).cast("bigint").alias("parent"), "n", (F.col("key") != END).alias("word"),
        ((F.col("n") + 1) / F.lit(float(n + v + 1))).alias("p"))
    held, rest = commonest(last.select("key", "n"), "n", p.held_words)
    symbols = Held(held.keys, np.empty(0)), _others(rest)
    with session.work(rows.sparkSession) as keep_table:
        levels = []
        for width in range(1, p.depth + 1):
            got = _level(rows, last, symbols, width, least, n, p)
            if got is None:
                break
            levels.append(got)
            last = got[0]
        parts, needed = [], None
        for table, states in reversed(levels):
            # a retained context's suffixes are retained, so the weights add up
            kept, grams = states.where("diverges"), table.where("diverges")
            if needed is not None:
                more = session.write_table(states.where("not diverges").join(needed, "ctx"), "lm-kept")
                kept = kept.unionByName(more)
                grams = grams.unionByName(table.where("not diverges").join(more.select("ctx"), "ctx"))
            needed = kept.select(F.col("suffix").alias("ctx")).distinct()
            parts += [kept.select(F.col("ctx").bitwiseXOR(F.lit(OWN)).alias("key"),
                                  F.col("total").alias("n"), F.log10("free").alias("weight")),
                      grams.select("key", "n", "weight")]
        if not parts:
            return rows.sparkSession.createDataFrame([], "key bigint, n bigint, weight double")
        return keep_table(reduce(DataFrame.union, parts), "lm-weights")


# -- scoring -------------------------------------------------------------------

@dataclass
class Model(Sent):
    """What tasks hold: the commonest words (log10 of the count plus one) and
    weights, and bitmaps of the other words counted once, of those counted
    more often, and of all other weights (None without any)."""
    depth: int
    words: Held
    weights: Held
    once: np.ndarray | None
    often: np.ndarray | None
    others: np.ndarray | None

    def _words(self, tokens, owner, learned):
        """Base score of each token, whether it is known, and which tokens
        must be looked up; ``learned`` rows hold no unknown word."""
        base, known = self.words.find(tokens)
        left = np.flatnonzero(~known)
        mine = learned[owner[left]]
        look = np.zeros(len(left), bool)
        if self.often is not None:
            look |= maybe_in(self.often, tokens[left])
        single = left[mine & ~look]
        base[single], known[single] = np.log10(2.0), True
        if self.once is not None:
            look |= ~mine & maybe_in(self.once, tokens[left])
        return base, known, left[look]

    def scores(self, tokens, owner, place, learned):
        """Per row the base score of the words told here, how many are known,
        and the sum of held weights; rows and keys that must be looked up."""
        n = len(learned)
        base, hit, more = self._words(tokens, owner, learned)
        ask = [(owner[more], tokens[more])]
        added = np.zeros(n)
        alive = np.ones(len(tokens), bool)  # the context's suffixes may be retained
        for at, ctx in contexts(tokens, place, self.depth):
            use = alive[at]
            at, ctx = at[use], ctx[use]
            alive[at] = False
            at, ctx = self._look(at, ctx ^ np.uint64(OWN), owner, n, added, ask, ctx)
            alive[at] = True
            self._look(at, joined(ctx, tokens[at]), owner, n, added, ask, ctx)
        rows, keys = (np.concatenate(x) for x in zip(*ask, strict=True))
        return np.bincount(owner, base, n), np.bincount(owner[hit], minlength=n), added, rows, keys

    def _look(self, at, keys, owner, n: int, added, ask, ctx):
        """Add the held weights of ``keys`` to ``added`` and those that may
        have another to ``ask``; the positions and contexts of both."""
        value, found = self.weights.find(keys)
        added += np.bincount(owner[at], value, n)
        if self.others is not None:
            more = ~found & maybe_in(self.others, keys)
            ask.append((owner[at[more]], keys[more]))
            found |= more
        return at[found], ctx[found]


_DOC = "doc_id {}, held_out boolean, n_tokens bigint, known bigint, base double, score double"
_LOOKUP = "first bigint, keys binary, times binary, more binary"
_ROUTE = f"slot bigint, part int, block bigint, {_LOOKUP}, place int, {_DOC}"
_SUMS = f"block bigint, kind int, has binary, base_sums binary, sums binary, found binary, place int, {_DOC}"
_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(),
          "double": pa.float64()}


def _schema(columns: str, id_type: pa.DataType) -> pa.Schema:
    fields = (x.split() for x in columns.split(", "))
    return pa.schema([(name, _TYPES.get(kind, id_type)) for name, kind in fields])


def _batch(columns: dict, schema: pa.Schema, n: int) -> pa.RecordBatch:
    """Of the columns given; the others are null."""
    def column(f):
        x = columns.get(f.name)
        return pa.nulls(n, f.type) if x is None else x if isinstance(x, pa.Array) else pa.array(x, f.type)

    return pa.RecordBatch.from_arrays([column(f) for f in schema], schema=schema)


class Block:
    """The keys that a block of documents asks for."""

    def __init__(self, number: int, n_ranges: int, schema: pa.Schema):
        self.number, self.n_ranges, self.schema = number, n_ranges, schema
        self.docs, self.held, self.size = 0, [], 0

    def add(self, n: int, rows: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Places in the block of ``n`` more documents, which ask for ``keys``."""
        self.held.append((keys, (rows + self.docs).astype(np.uint32)))
        self.size += len(keys)
        self.docs += n
        return np.arange(self.docs - n, self.docs, dtype=np.int32)

    def full(self, more: int) -> bool:
        return self.size >= BLOCK_KEYS or self.docs > 0 and self.docs + more > BLOCK_DOCS

    def asks(self):
        """A row for each range: the distinct keys, how many documents ask for
        each (for each time it occurs), and those documents."""
        if not self.size:
            return
        keys, docs = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held = []
        order = np.argsort(keys)
        keys = keys[order]
        docs = docs[order].astype(np.uint16 if self.docs <= 1 << 16 else np.uint32)
        new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        at, times = in_bytes(np.diff(np.append(new, len(keys))))
        keys = keys[new][at]
        behind = np.append(0, np.cumsum(times, dtype=np.int64))
        out = [dict(slot=part << 2 | ASK, part=part, block=self.number, first=_first(keys[i:]),
                    keys=differences(keys[i:j]), times=squeezed(times[i:j]),
                    more=squeezed(docs[behind[i]:behind[j]]))
               for part, i, j in cut(ranges(keys, self.n_ranges))]
        for row in out:
            yield _batch({k: [v] for k, v in row.items()}, self.schema, 1)


def _answers(table: DataFrame, n_ranges: int) -> DataFrame:
    """``table(key, weight, word)`` as rows of its ranges."""
    columns = f"slot bigint, part int, {_LOOKUP}"

    def run(batches):
        schema = _schema(columns, None)

        def rows(held):
            key, weight, word = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(key)
            key, weight, word = key[order], weight[order], word[order]
            yield pa.RecordBatch.from_pylist([
                dict(slot=part << 2 | ANSWER, part=part, first=_first(key[i:]),
                     keys=differences(key[i:j]), times=squeezed(word[i:j]), more=squeezed(weight[i:j]))
                for part, i, j in cut(ranges(key, n_ranges))], schema)

        held = []
        for b in batches:
            if b.num_rows:
                key, weight, word = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                held.append((key.view(np.uint64), weight, word.astype(np.uint8)))
            if sum(len(x[0]) for x in held) > HELD_KEYS:
                yield from rows(held)
                held = []
        if held:
            yield from rows(held)

    return table.mapInArrow(run, columns)


class Lookup:
    """Words and weights of a range."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.keys = None

    def add(self, first, keys, times, more) -> None:
        times = times.as_buffer()
        word = whole(times, size_of(times), np.uint8)
        self.rows.append((values_of(first.as_py(), keys.as_buffer(), len(word)), word,
                          whole(more.as_buffer(), len(word), np.float64)))

    def sums(self, first, keys, times, more) -> dict | None:
        """For the documents that ask for a known key: which they are, and
        the sums of their words' weights, of all weights, and of the words."""
        if self.keys is None:
            key, word, weight = (np.concatenate(x) for x in zip(*self.rows, strict=True)) if self.rows else (
                np.empty(0, np.uint64), np.empty(0, np.uint8), np.empty(0))
            order = np.argsort(key)
            self.rows, self.keys, self.word, self.weight = [], key[order], word[order], weight[order]
        times, more = times.as_buffer(), more.as_buffer()
        times = whole(times, size_of(times), np.uint8).astype(np.int64)
        key = values_of(first.as_py(), keys.as_buffer(), len(times))
        n = int(times.sum())
        docs = whole(more, n, np.uint16 if size_of(more) == 2 * n else np.uint32)
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        hit = self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)
        docs, at = docs[np.repeat(hit, times)].astype(np.int64), np.repeat(at[hit], times[hit])
        if not len(docs):
            return None
        word, weight = self.word[at], self.weight[at]
        n = np.bincount(docs)
        has = n > 0
        base, found = np.bincount(docs, weight * word)[has], np.bincount(docs, word)[has]
        return dict(has=np.packbits(has).tobytes(), base_sums=squeezed(base),
                    sums=squeezed(np.bincount(docs, weight)[has]), found=squeezed(found.astype(np.int64)))


def _resolved(rows: DataFrame, kind: str) -> DataFrame:
    """Rows of ``_ROUTE`` to documents and their sums by block."""
    def run(batches):
        for _, group in groupby(runs(batches), lambda x: x[0] >> 2):
            lookup = Lookup()
            for slot, piece in group:
                schema = _schema(_SUMS, piece.schema.field("doc_id").type)
                columns = dict(zip(piece.schema.names, piece.columns, strict=True))
                each = [columns[x] for x in ("first", "keys", "times", "more")]
                if slot & 3 == DOC:
                    yield _batch(columns | {"kind": np.full(len(each[0]), DOC)}, schema, len(each[0]))
                elif slot & 3 == ANSWER:
                    for row in zip(*each, strict=True):
                        lookup.add(*row)
                else:
                    for block, *row in zip(columns["block"].to_pylist(), *each, strict=True):
                        if got := lookup.sums(*row):
                            got |= {"block": block, "kind": SUM}
                            yield _batch({k: [x] for k, x in got.items()}, schema, 1)

    return rows.repartition("part").sortWithinPartitions("slot").mapInArrow(run, _SUMS.format(kind))


def _added(rows: DataFrame, kind: str, n: int) -> DataFrame:
    """Documents with the sums of their blocks."""
    def run(batches):
        for _, group in groupby(runs(batches), lambda x: x[0]):
            docs, sums = [], None
            for _, block in group:
                for row_kind, i, j in cut(block.column(1).to_numpy()):
                    piece = block.slice(i, j - i)
                    columns = dict(zip(piece.schema.names, piece.columns, strict=True))
                    if row_kind == DOC:
                        docs.append(columns)
                        continue
                    if sums is None:
                        sums = np.zeros((3, sum(len(x["place"]) for x in docs)))
                    for has, base, every, found in zip(*(columns[x] for x in (
                            "has", "base_sums", "sums", "found")), strict=True):
                        at = np.flatnonzero(np.unpackbits(np.frombuffer(has.as_buffer(), np.uint8)))
                        sums[0, at] += whole(base.as_buffer(), len(at), np.float64)
                        sums[1, at] += whole(every.as_buffer(), len(at), np.float64)
                        sums[2, at] += whole(found.as_buffer(), len(at), np.int64)
            for x in docs:
                known, base, total = (x[k].to_numpy() for k in ("known", "base", "score"))
                if sums is not None:
                    more = sums[:, x["place"].to_numpy()]
                    base, total, known = base + more[0], total + more[1], known + more[2].astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [x["doc_id"], x["held_out"], x["n_tokens"], pa.array(known),
                     pa.array(np.full(len(known), n, np.int64)), pa.array(base), pa.array(total)],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return rows.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
             "base_score double, score double")


def score(docs: DataFrame, params: LmParams = LmParams(), id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score)``, one row per input row.

    A null or empty text is the end token alone.  A null id counts as the
    empty text for the fold.  Repeated rows are learned and scored each.  A
    text of any length is scored whole.  An empty table gives an empty result;
    without training rows every token is unknown and has probability one.
    Other columns are ignored.
    """
    tasks.prepare(docs.sparkSession)
    with session.work(docs.sparkSession) as keep, session.shuffles_freed(docs.sparkSession):
        return keep(_scored(docs, params, id_col, text_col), "lm-scores")


def _scored(docs: DataFrame, params: LmParams, id_col: str, text_col: str) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    fold = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % params.folds
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                       (fold == params.held_fold).alias("held_out"))
    learned = rows.where("not held_out").select("text")
    counts, n, v = words(learned)
    known = counts.select("key", "n", F.log10(F.col("n") + 1).alias("weight"))
    tree = weights(learned, counts, n, v, params)
    held_words, rare = commonest(known, "weight", params.held_words)
    held, rest = commonest(tree, "weight", params.held_weights)
    shared = docs.sparkSession.sparkContext.broadcast(Model(
        params.depth, held_words, held, _others(rare.where("n = 1")), _others(rare.where("n > 1")),
        _others(rest)))
    unit = float(np.log10(n + v + 1))
    n_ranges = (rare.count() + rest.count()) // RANGE_KEYS + 1

    def run(batches):
        m, block, task = shared.value, None, TaskContext.get().partitionId()
        for b in batches:
            schema = _schema(_ROUTE, b.schema.field(0).type)
            for i, j, data, off in tasks.sliced_texts(b, limit=tasks.HASH_STEP):
                if block is None or block.full(j - i):
                    if block is not None:
                        yield from block.asks()
                    seq = 0 if block is None else seq + 1
                    block, part = Block(task << 32 | seq, n_ranges, schema), (task + seq) % n_ranges
                tokens, owner, place = tokens_of(data, off)
                learned = ~b.column(2).slice(i, j - i).to_numpy(zero_copy_only=False)
                base, found, added, ask, keys = m.scores(tokens, owner, place, learned)
                size = np.bincount(owner, minlength=j - i)
                base -= size * unit
                yield _batch({
                    "slot": np.full(j - i, part << 2 | DOC), "part": np.full(j - i, part),
                    "block": np.full(j - i, block.number), "place": block.add(j - i, ask, keys),
                    "doc_id": b.column(0).slice(i, j - i), "held_out": b.column(2).slice(i, j - i),
                    "n_tokens": size, "known": found, "base": base, "score": base + added}, schema, j - i)
        if block is not None:
            yield from block.asks()

    answers = _answers(rare.select("key", "weight", F.lit(True).alias("word")).union(
        rest.select("key", "weight", F.lit(False).alias("word"))), n_ranges)
    route = rows.mapInArrow(run, _ROUTE.format(kind)).unionByName(answers, allowMissingColumns=True)
    return _added(_resolved(route, kind), kind, n)
