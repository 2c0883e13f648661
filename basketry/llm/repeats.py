"""Suffix-array dedup: every byte covered by a string of ``length`` bytes that
starts in two places is removed.

The suffixes that are sorted start at anchors.  The anchor of a window of
``length`` bytes is the place of its least ``SEED``-byte hash (leftmost on
ties), so it depends on the window's bytes alone: equal windows have their
anchors at equal offsets, and comparing the suffixes of anchors compares all
windows.  An anchor's entry holds the text of the windows it serves: the
bytes from the anchor on, then the bytes before it in reverse.

1. The texts are dealt evenly into parts, once, in a bucketed table.
2. Fingerprints: each part sends the seed hashes of its anchors to hash
   buckets and gets back those that occur in another part.  All others have
   no equal window.
3. Runs: each part sorts its remaining entries, equal ones as one with a
   count, and sends them front-coded (common prefix with the entry before,
   then the rest) to key ranges.
4. Merge: a range combines its runs with a loser tree that keeps, for every
   run's head, its common prefix with the last output: heads compare by that
   number, and bytes are read only past a known prefix.  Entries that share a
   seed come out together; equal entries make all their windows repeats, and
   within a seed's entries the windows are compared.
5. A seed met by a range splitter is frequent: its entries may lie in several
   ranges (no range gets all of them), so their windows are compared in hash
   buckets instead.  The answer is the same.
6. The repeated windows go back to their parts and mark the bytes.

Work is packed in binary rows, so a shuffle moves bytes, not one row per
suffix.  A task holds one part, one bucket or one range; their number follows
``spark.sql.shuffle.partitions``.
"""

from __future__ import annotations

import bisect
import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry import session
from basketry.llm import tasks

SEED = 64
#: Splitters come from at most this many sampled suffixes.
SAMPLE = 20_000
SAMPLE_PER_TASK = 64
#: Bytes of text and of entries in one vectorised step.
STEP_BYTES = 1 << 20

#: Text of one part, and the greatest number of parts (Spark's own limit on
#: the buckets of a table); parts are larger beyond that.
PART_BYTES = 8 << 20
MAX_PARTS = 100_000
GROUP_BYTES = 1 << 20
MARK = b"\xff"  # stands in no UTF-8 text
EMPTY = np.empty(0, np.int64)


def anchors(data: np.ndarray, off: np.ndarray, length: int):
    """Anchors of all windows of ``length`` bytes within rows: ``(place, first
    window, last window, seed hash)``, one per run of windows it serves."""
    n = len(data)
    if n < length:
        return EMPTY, EMPTY, EMPTY, np.empty(0, np.uint64)
    prefix = tasks.prefix_hash(data)
    h = tasks.window_hash(prefix, np.arange(n - SEED + 1), np.arange(SEED, n + 1))
    # Half of the hash above, the place below: the least is the leftmost of
    # the least hashes.  A fixed split keeps the choice the same everywhere.
    bits = np.uint64(32)
    key = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    width, span = length - SEED + 1, 1
    while span * 2 <= width:
        key = np.minimum(key[:len(key) - span], key[span:])
        span *= 2
    rest = width - span
    if rest:
        key = np.minimum(key[:len(key) - rest], key[rest:])
    place = (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    inside = np.zeros(n - length + 1, bool)  # windows that end in their row
    whole = np.flatnonzero(np.diff(off) >= length)
    edge = np.zeros(n - length + 2, np.int32)
    np.add.at(edge, off[whole], 1)
    np.add.at(edge, off[whole + 1] - length + 1, -1)
    inside = np.cumsum(edge[:-1]) > 0
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | ~inside[:-1]
    rows = off[(off > 0) & (off < len(new))]
    new[rows] = True
    first = np.flatnonzero(new & inside)
    last = np.flatnonzero(inside & np.append(new[1:] | ~inside[1:], True))
    return place[first], first, last, h[place[first]]


def pack(*parts) -> bytes:
    """A tuple of arrays as compressed bytes."""
    raw = pickle.dumps(parts, protocol=5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes) -> tuple:
    size = int.from_bytes(blob[:8], "little")
    return pickle.loads(pa.decompress(blob[8:], size, codec="zstd", asbytes=True))


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def by_bucket(h: np.ndarray, buckets: int):
    """``(bucket, indices)`` of the non-empty buckets."""
    at = bucket_of(h, buckets)
    order = np.argsort(at, kind="stable")
    edge = np.searchsorted(at[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(edge)):
        yield int(b), order[edge[b]:edge[b + 1]]


# -- entries ---------------------------------------------------------------

def entry(raw: bytes, place: int, first: int, last: int, length: int) -> bytes:
    """From the anchor on, a mark, then the bytes before it in reverse."""
    return raw[place:last + length] + MARK + raw[first:place][::-1]


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes are known."""
    n = min(len(a), len(b))
    i = known
    while i < n:
        m = min(i + 32, n)
        x, y = a[i:m], b[i:m]
        if x != y:  # the first byte that differs is the highest of the xor
            d = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
            return m - (d.bit_length() + 7) // 8
        i = m
    return n


def front_code(entries: list[bytes], counts: np.ndarray, first_no: int) -> bytes:
    """Sorted distinct entries as common prefixes and rests."""
    shared = np.zeros(len(entries), np.int32)
    rest = []
    before = b""
    for i, e in enumerate(entries):
        k = common(before, e, 0) if i else 0
        shared[i] = k
        rest.append(e[k:])
        before = e
    size = np.fromiter(map(len, rest), np.int32, len(rest))
    return pack(first_no, shared, size, counts, b"".join(rest))


class Run:
    """A front-coded run read from its start."""

    def __init__(self, part: int, blob: bytes):
        self.part = part
        first, shared, size, counts, raw = unpack(blob)
        self.no, self.left = first - 1, len(size)
        self.shared, self.size, self.counts = shared.tolist(), size.tolist(), counts.tolist()
        self.raw, self.at, self.i = raw, 0, -1
        self.head, self.known, self.count = b"", 0, 0

    def step(self) -> bool:
        """The next entry; ``known`` is its common prefix with the last."""
        self.i += 1
        if self.i >= self.left:
            return False
        k, n = self.shared[self.i], self.size[self.i]
        self.head = self.head[:k] + self.raw[self.at:self.at + n]
        self.known, self.count = k, self.counts[self.i]
        self.at += n
        self.no += 1
        return True


class LoserTree:
    """Merges sorted runs; every head's ``known`` is its common prefix with
    the last output, and no known byte is compared again."""

    def __init__(self, runs: list[Run]):
        self.runs = [r for r in runs if r.step()]
        for r in self.runs:
            r.known = 0
        self.size = 1
        while self.size < max(1, len(self.runs)):
            self.size *= 2
        self.loser = [None] * self.size
        self.top = self._play(1) if self.runs else None

    def _play(self, node: int):
        if node >= self.size:
            i = node - self.size
            return i if i < len(self.runs) else None
        a, b = self._play(2 * node), self._play(2 * node + 1)
        win, lose = self._game(a, b)
        self.loser[node] = lose
        return win

    def _game(self, a, b):
        if a is None or b is None:
            return (b, a) if a is None else (a, b)
        x, y = self.runs[a], self.runs[b]
        if x.known != y.known:  # more in common with the last output: smaller
            return (a, b) if x.known > y.known else (b, a)
        k = common(x.head, y.head, x.known)
        if x.head[k:k + 1] <= y.head[k:k + 1]:
            y.known = k
            return a, b
        x.known = k
        return b, a

    def __iter__(self):
        """``(run, common prefix with the entry before)`` in sorted order; the
        run's head is the entry."""
        while self.top is not None:
            run = self.runs[self.top]
            yield run, run.known
            node = (self.top + self.size) // 2
            win = self.top if run.step() else None
            while node >= 1:
                win, self.loser[node] = self._game(win, self.loser[node])
                node //= 2
            self.top = win


# -- windows of entries that share a seed ----------------------------------

def entry_windows(entries: list[bytes], length: int):
    """Hashes of the windows of each entry in text order, and their owners."""
    texts = []
    for e in entries:
        m = e.index(MARK)
        texts.append(e[:m:-1] + e[:m])
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    n = size - length + 1
    owner = np.repeat(np.arange(len(texts)), n)
    index = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = np.repeat(np.cumsum(size) - size, n) + index
    prefix = tasks.prefix_hash(data)
    return tasks.window_hash(prefix, start, start + length), owner, index


def ranges(owner: np.ndarray, index: np.ndarray):
    """Sorted (owner, window) pairs as ``(owner, from, to)`` ranges."""
    if not len(owner):
        return EMPTY, EMPTY, EMPTY
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (index[1:] != index[:-1] + 1)
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(owner)) - 1
    return owner[a], index[a], index[b] + 1


def met_twice(h: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
    """Mask of the hashes that stand more than once (within their ``of``)."""
    of = np.zeros(len(h), np.int8) if of is None else of
    order = np.lexsort((h, of))
    same = (h[order][1:] == h[order][:-1]) & (of[order][1:] == of[order][:-1])
    again = np.zeros(len(h), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return again


class Marks:
    """Repeated windows by part: entry number and range of windows."""

    def __init__(self):
        self.found: dict[int, list] = {}

    def add(self, part: int, no: int, a: int, b: int) -> None:
        self.found.setdefault(part, []).append((no, a, b))

    def rows(self):
        for part, x in self.found.items():
            yield part, pack(np.array(x, np.int64).reshape(-1, 3))


class Merge:
    """Receives sorted entries and settles the windows of each seed."""

    def __init__(self, length: int, split: frozenset, buckets: int):
        self.length, self.split, self.buckets = length, split, buckets
        self.marks, self.far = Marks(), {}
        self.group, self.ready, self.held = [], [], 0

    def take(self, run: Run, known: int) -> None:
        head = run.head
        if self.group and known == len(head) == len(self.group[-1][0]):
            last = self.group[-1]
            last[1] += run.count
            last[2].append((run.part, run.no))
            return
        if self.group and known < SEED:
            self._close()
        self.group.append([head, run.count, [(run.part, run.no)]])

    def _close(self) -> None:
        group, self.group = self.group, []
        for head, count, places in group:
            if count > 1:  # an equal entry elsewhere: every window repeats
                n = len(head) - 1 - self.length + 1
                for part, no in places:
                    self.marks.add(part, no, 0, n)
        if group[0][0][:SEED] in self.split:
            self._send(group)
        elif len(group) > 1 and any(c == 1 for _, c, _ in group):
            self.ready.append(group)
            self.held += sum(len(e) for e, _, _ in group)
            if self.held > GROUP_BYTES:
                self.settle()

    def settle(self) -> None:
        """Compare the windows of the waiting seeds, each seed apart."""
        groups, self.ready, self.held = self.ready, [], 0
        if not groups:
            return
        flat = [x for g in groups for x in g]
        of = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
        h, owner, index = entry_windows([e for e, _, _ in flat], self.length)
        again = met_twice(h, of[owner])
        for o, a, b in zip(*ranges(owner[again], index[again]), strict=True):
            if flat[o][1] == 1:
                self.marks.add(*flat[o][2][0], int(a), int(b))

    def _send(self, group) -> None:
        """Windows of a frequent seed, to hash buckets.  Those that meet
        another entry right here are settled, and sent once for the others."""
        for i in range(0, len(group), 4096):
            some = group[i:i + 4096]
            h, owner, index = entry_windows([e for e, _, _ in some], self.length)
            again = met_twice(h)
            for o, a, b in zip(*ranges(owner[again], index[again]), strict=True):
                if some[o][1] == 1:
                    self.marks.add(*some[o][2][0], int(a), int(b))
            once = np.unique(h, return_index=True)[1]
            part = np.array([p[0][0] if c == 1 else -1 for _, c, p in some], np.int32)
            no = np.array([p[0][1] for _, _, p in some], np.int64)
            h, owner, index, again = h[once], owner[once], index[once], again[once]
            part = np.where(again, np.int32(-1), part[owner])
            for b, at in by_bucket(h, self.buckets):
                self.far.setdefault(b, []).append(
                    (h[at], part[at], no[owner[at]], index[at].astype(np.int32)))

    def finish(self):
        if self.group:
            self._close()
        self.settle()
        for part, blob in self.marks.rows():
            yield part, -1, blob
        for b, x in self.far.items():
            yield -1, b, pack(*(np.concatenate(c) for c in zip(*x, strict=True)))


def settle_bucket(blobs: list[bytes]) -> Marks:
    """Windows of frequent seeds that meet another entry's."""
    h, part, no, index = (np.concatenate(c) for c in zip(*map(unpack, blobs), strict=True))
    again = met_twice(h) & (part >= 0)
    part, no, index = part[again], no[again], index[again]
    order = np.lexsort((index, no, part))
    part, no, index = part[order], no[order], index[order]
    marks = Marks()
    key = part.astype(np.int64) << 40 | no
    for k, a, b in zip(*ranges(key, index.astype(np.int64)), strict=True):
        marks.add(int(k >> 40), int(k & ((1 << 40) - 1)), int(a), int(b))
    return marks


# -- Spark program ----------------------------------------------------------

def _part_texts(table: pa.Table):
    """A part's rows in arrival order: bytes and row offsets."""
    order = np.argsort(table.column("rid").to_numpy(), kind="stable")
    table = table.take(pa.array(order))
    return table, *tasks.text_bytes(table.column("text"))


def _batch(names, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(cols), list(names))


def _fingerprints(texts: DataFrame, length: int, buckets: int) -> DataFrame:
    """``(part, bucket, blob)``: distinct seed hashes of each step of a part;
    bucket -1 holds sampled suffixes."""
    def run(batches):
        sampled = 0
        for b in batches:
            parts = b.column(0).to_numpy()
            for part in np.unique(parts):
                own = b.filter(pa.array(parts == part))
                for _, _, data, off in tasks.sliced_texts(own, limit=STEP_BYTES):
                    place, _, last, h = anchors(data, off, length)
                    seen = np.unique(h)
                    out = [(int(part), k, pack(seen[at]))
                           for k, at in by_bucket(seen, buckets)]
                    if len(place) and sampled < SAMPLE_PER_TASK:
                        raw = data.tobytes()
                        some = np.argsort(tasks.mix(place.astype(np.uint64)))[:8]
                        sampled += len(some)
                        out.append((int(part), -1, pack([raw[place[i]:last[i] + length]
                                                         for i in some])))
                    yield _batch(("part", "bucket", "blob"),
                                 *(pa.array([o[i] for o in out], t) for i, t in
                                   enumerate((pa.int32(), pa.int32(), pa.binary()))))

    return texts.select("part", "text").mapInArrow(run, "part int, bucket int, blob binary")


def _met_elsewhere(prints: DataFrame, buckets: int) -> DataFrame:
    """``(part, blob)``: the seed hashes of a part that another row sent too."""
    def run(table: pa.Table) -> pa.Table:
        part = table.column("part").to_pylist()
        sent = [unpack(x)[0] for x in table.column("blob").to_pylist()]
        _, place, times = np.unique(np.concatenate(sent), return_inverse=True, return_counts=True)
        again = np.split(times[place] > 1, np.cumsum([len(h) for h in sent])[:-1])
        out: dict[int, list] = {}
        for p, h, met in zip(part, sent, again, strict=True):
            out.setdefault(p, []).append(h[met])
        return pa.table({"part": pa.array(list(out), pa.int32()),
                         "blob": pa.array([pack(np.concatenate(x)) for x in out.values()],
                                          pa.binary())})

    return _dealt(prints.where("bucket >= 0"), "bucket", buckets).applyInArrow(
        run, "part int, blob binary")


def _dealt(rows: DataFrame, key: str, count: int):
    """Grouped by ``key``, a task for each of its ``count`` values: packed
    rows are few and small, and say little of the work they hold."""
    return rows.repartition(count, key).groupBy(key)


def _splitters(prints: DataFrame, count: int) -> list[bytes]:
    """At most ``count - 1`` entries that cut the sampled suffixes evenly."""
    rows = prints.where("bucket < 0").select("blob").orderBy(F.xxhash64("part", "blob")).limit(
        SAMPLE // 8).collect()
    found = sorted(x for r in rows for x in unpack(r.blob)[0])
    return [found[len(found) * k // count] for k in range(1, count)] if found else []


def _runs(texts: DataFrame, met: DataFrame, length: int, cuts: list[bytes]) -> DataFrame:
    """``(reducer, part, blob)``: front-coded run slices; reducer -1 holds the
    places of a part's entries."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if len(left):
            part = left.column("part")[0].as_py()
            _, data, off = _part_texts(left)
            far = [unpack(x)[0] for x in right.column("blob").to_pylist()]
            far = np.unique(np.concatenate(far)) if far else np.empty(0, np.uint64)
            raw, found = data.tobytes(), {}
            place, first, last, h = all_anchors(data, off, length)
            seen, inverse, times = np.unique(h, return_inverse=True, return_counts=True)
            use = ((times > 1) | np.isin(seen, far))[inverse]
            for p, a, b in zip(place[use].tolist(), first[use].tolist(), last[use].tolist(),
                               strict=True):
                found.setdefault(entry(raw, p, a, b, length), []).append(a)
            del place, first, last, h, seen, inverse, times, use
            entries = sorted(found)
            counts = np.array([len(found[e]) for e in entries], np.int64)
            where = np.array([x for e in entries for x in found[e]], np.int64)
            out.append((-1, part, pack(counts, where)))
            edges = [0, *(bisect.bisect_left(entries, c) for c in cuts), len(entries)]
            for r, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                if a < b:
                    out.append((r, part, front_code(entries[a:b], counts[a:b], a)))
        return pa.table({k: pa.array([o[i] for o in out], t) for i, (k, t) in enumerate(
            (("reducer", pa.int32()), ("part", pa.int32()), ("blob", pa.binary())))})

    return texts.select("part", "rid", "text").groupBy("part").cogroup(
        met.groupBy("part")).applyInArrow(run, "reducer int, part int, blob binary")


def all_anchors(data: np.ndarray, off: np.ndarray, length: int):
    """``anchors`` of a whole part, a step of rows at a time."""
    got = []
    for i, j in tasks.steps(np.diff(off), STEP_BYTES):
        p, a, b, h = anchors(data[off[i]:off[j]], off[i:j + 1] - off[i], length)
        got.append((p + off[i], a + off[i], b + off[i], h))
    if not got:
        return anchors(data, off, length)
    return tuple(np.concatenate(x) for x in zip(*got, strict=True))


def _merged(runs: DataFrame, length: int, cuts: list[bytes], buckets: int) -> DataFrame:
    """``(part, bucket, blob)``: marks for parts, windows for buckets."""
    split = frozenset(c[:SEED] for c in cuts)

    def run(table: pa.Table) -> pa.Table:
        own = [Run(p, x) for p, x in zip(table.column("part").to_pylist(),
                                         table.column("blob").to_pylist(), strict=True)]
        merge = Merge(length, split, buckets)
        for r, known in LoserTree(own):
            merge.take(r, known)
        out = list(merge.finish())
        return pa.table({k: pa.array([o[i] for o in out], t) for i, (k, t) in enumerate(
            (("part", pa.int32()), ("bucket", pa.int32()), ("blob", pa.binary())))})

    return _dealt(runs.where("reducer >= 0"), "reducer", len(cuts) + 1).applyInArrow(
        run, "part int, bucket int, blob binary")


def _far_marks(merged: DataFrame, buckets: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        rows = list(settle_bucket(table.column("blob").to_pylist()).rows())
        return pa.table({"part": pa.array([r[0] for r in rows], pa.int32()),
                         "blob": pa.array([r[1] for r in rows], pa.binary())})

    return _dealt(merged.where("bucket >= 0"), "bucket", buckets).applyInArrow(
        run, "part int, blob binary")


def removed_bytes(n: int, counts: np.ndarray, where: np.ndarray, marks: list[np.ndarray],
                  length: int) -> np.ndarray:
    """Mask of the part's bytes that some marked window covers."""
    edge = np.zeros(n + 1, np.int32)
    at = np.concatenate([[0], np.cumsum(counts)])
    for m in marks:
        no, a, b = m[:, 0], m[:, 1], m[:, 2]
        k = counts[no]
        start = where[np.repeat(at[no] - (np.cumsum(k) - k), k) + np.arange(k.sum())]
        np.add.at(edge, start + np.repeat(a, k), 1)
        np.add.at(edge, start + np.repeat(b, k) - 1 + length, -1)
    return np.cumsum(edge[:-1], dtype=np.int32, out=edge[:-1]) > 0


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id",
                   text_col: str = "text", keep_bytes: bool = False) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)``, one row per
    input row (and ``kept BINARY``, the remaining bytes, if asked).

    Texts are UTF-8 bytes; matches stay within a row.  A null or empty text
    has no bytes; texts shorter than ``length`` lose nothing; of repeated
    rows every copy loses what the others hold; null ids are kept; a text of
    any length is taken whole, in a part with others; an empty table gives an
    empty result; other columns are ignored.  ``length`` is at
    least twice the seed of 64 bytes.
    """
    if length < 2 * SEED:
        raise ValueError(f"length must be at least {2 * SEED}")
    spark = docs.sparkSession
    tasks.prepare(spark)
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    parts = min(MAX_PARTS, -(-size // PART_BYTES) or 1)
    buckets, reducers = -(-parts // 4), -(-parts // 2)
    kind = docs.schema[id_col].dataType.simpleString()
    rid = F.monotonically_increasing_id()
    dealt = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                        rid.alias("rid")).withColumn(
        "part", F.pmod(F.xxhash64("rid"), F.lit(parts)).cast("int"))
    texts = session.write_bucketed(dealt.repartition(parts, "part"), ["part"], parts, "texts")
    prints = session.write_table(_fingerprints(texts, length, buckets), "prints")
    cuts = _splitters(prints, reducers)
    runs = session.write_table(_runs(texts, _met_elsewhere(prints, buckets), length, cuts), "runs")
    merged = session.write_table(_merged(runs, length, cuts, buckets), "merged")
    marks = merged.where("bucket < 0").select("part", "blob").unionByName(
        _far_marks(merged, buckets))
    places = runs.where("reducer < 0").select("part", "blob")
    side = marks.select("part", F.lit(1).alias("mark"), "blob").unionByName(
        places.select("part", F.lit(0).alias("mark"), "blob"))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        table, data, off = _part_texts(left)
        mark = right.column("mark").to_pylist()
        blobs = right.column("blob").to_pylist()
        counts, where = EMPTY, EMPTY
        for m, x in zip(mark, blobs, strict=True):
            if m == 0:
                counts, where = unpack(x)
        gone = removed_bytes(len(data), counts, where,
                             [unpack(x)[0] for m, x in zip(mark, blobs, strict=True) if m], length)
        kept, removed, spans = [], [], []
        for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
            own = gone[a:b]
            removed.append(int(own.sum()))
            spans.append(int((own[1:] & ~own[:-1]).sum() + own[:1].sum()))
            kept.append((data[a:b][~own] if removed[-1] else data[a:b]).tobytes())
        cols = {"doc_id": table.column("doc_id"), "n_bytes": pa.array(np.diff(off), pa.int64()),
                "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())}
        if keep_bytes:
            cols["kept"] = pa.array(kept, pa.binary())
        return pa.table(cols)

    schema = (f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
              + (", kept binary" if keep_bytes else ""))
    return texts.select("part", "rid", "doc_id", "text").groupBy("part").cogroup(
        side.groupBy("part")).applyInArrow(finish, schema)
