"""MinHash near-duplicates: one-permutation hashing with optimal
densification, banded buckets and star-shaped candidate edges.

1. One pass over the texts gives each row its distinct shingles' digest and a
   one-permutation sketch: the least hash of every bin, empty bins filled from
   a non-empty bin chosen by a universal hash of the bin and the attempt
   (optimal densification).  The first bins make the band hashes; a byte of
   every bin is kept to compare sketches.
2. Equal sets are one node from here on, so groups of exact copies never meet
   in a bucket.  Buckets with the same members are one bucket.
3. In rounds, every open bucket takes hubs (the members that meet most others
   in all their buckets) and compares each with the members that are not yet
   connected to it: a star.  Only pairs whose sketches agree in enough bins
   are candidate edges; they are confirmed on full sets and links joined into
   components.  Used hubs leave their bucket, and a bucket closes when its
   members are connected.  The first round's single hub connects most groups
   and makes at most one candidate a member.  Later rounds take more hubs, so
   no pair of unconnected members of a bucket is left uncompared, and none is
   compared in two buckets or rounds.  There a candidate is never a row: the
   sketches only say which members have one, those meet again with their full
   sets, and what comes out are links between members that the task has not
   connected yet.  A large bucket's members are dealt over tasks, and its hubs
   stream past each deal.  Deals and their sizes both grow with the square root
   of the bucket, so n members are sent as at most about n**1.5 / 32 rows.

At the production settings a pair at the least similarity shares no bucket
with probability (1 - 0.8**3)**24 = 3e-8, and fails the comparison of sketches
(358 of 512 bins, 5.7 standard deviations below the mean) with 1e-8.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry import session
from basketry.llm import tasks
from basketry.llm.components import components
from basketry.llm.shingles import distinct_sets


@dataclass(frozen=True)
class NearDupParams:
    """Shingle size in words, least similarity in percent, bands x rows, bins
    of the sketch, and the share of them that a candidate edge agrees in."""
    shingle: int = 5
    percent: int = 80
    bands: int = 24
    rows: int = 3
    bins: int = 512
    agree: float = 0.7


#: A bucket of ``n`` members is dealt over ``sqrt(n / DEAL)`` tasks, or as many
#: as hold its full sets in ``DEAL_BYTES`` each; hubs of the first round, and how
#: many times more each next round takes.
DEAL, DEAL_BYTES = 1024, 64 << 20
HUBS, MORE = 1, 64


_donors: dict[int, np.ndarray] = {}


def _donor_table(bins: int, attempts: int) -> np.ndarray:
    """``[attempt, bin]`` -> bin to borrow from."""
    have = _donors.get(bins)
    if have is None or len(have) < attempts:
        a = np.arange(attempts, dtype=np.uint64)[:, None]
        b = np.arange(bins, dtype=np.uint64)[None, :]
        have = (tasks.mix(a * np.uint64(1 << 20) + b + np.uint64(1)) % np.uint64(bins)).astype(np.int64)
        _donors[bins] = have
    return have


def sketches(sets: np.ndarray, off: np.ndarray, bins: int) -> np.ndarray:
    """``rows x bins`` densified one-permutation sketch of sorted sets.  Rows
    without a shingle are all zero."""
    n = len(off) - 1
    out = np.zeros((n, bins), np.uint64)
    if not len(sets):
        return out
    owner = np.repeat(np.arange(n), np.diff(off))
    # the bin grows with the hash, so a row's bins are runs and the run's
    # first value is its least
    at = (((sets >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64)
    key = owner * bins + at
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    filled = np.zeros(n * bins, bool)
    out.reshape(-1)[key[first]] = sets[first]
    filled[key[first]] = True
    filled = filled.reshape(n, bins)
    row, col = np.nonzero(~filled & (np.diff(off) > 0)[:, None])
    attempt, size = 0, 64
    while len(row):
        if attempt >= size:
            size *= 2
        donor = _donor_table(bins, size)[attempt, col]
        ok = filled[row, donor]
        out[row[ok], col[ok]] = out[row[ok], donor[ok]]
        row, col = row[~ok], col[~ok]
        attempt += 1
    return out


def band_hashes(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(sketch), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(sketch), b + 1, np.uint64)
        for k in range(rows):
            h = tasks.mix(h * np.uint64(0x2545F4914F6CDD1D) + sketch[:, b * rows + k])
        out[:, b] = h
    return out


def set_digests(sets: np.ndarray, off: np.ndarray) -> list[bytes | None]:
    """128-bit digest of each row's set; None for an empty one."""
    total = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(f, dtype=np.uint64)])
             for f in (tasks.mix(sets), tasks.mix(sets ^ np.uint64(0xA5A5A5A5A5A5A5A5)))]
    n = np.diff(off).astype(np.uint64)
    halves = np.stack([tasks.mix((t[off[1:]] - t[off[:-1]]) * np.uint64(3) + n) for t in total], 1)
    raw = np.ascontiguousarray(halves).astype(">u8").tobytes()
    return [raw[16 * i:16 * i + 16] if n[i] else None for i in range(len(n))]


def _signed(rows: DataFrame, p: NearDupParams) -> DataFrame:
    """``(doc_id, tkey, n_shingles, node, bands, sketch)`` of
    ``rows(doc_id, tkey, text)``; the sketch is one byte per bin."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        tasks.release()
        for b in batches:
            for i, j, data, off in tasks.sliced_texts(b, limit=tasks.HASH_STEP, row_bytes=p.bins):
                sets, at = distinct_sets(data, off, p.shingle)
                full = sketches(sets, at, p.bins)
                keys = band_hashes(full, p.bands, p.rows)
                raw = tasks.mix(full).astype(np.uint8).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i),
                     pa.array(np.diff(at), pa.int64()), pa.array(set_digests(sets, at), pa.binary()),
                     pa.ListArray.from_arrays(
                         pa.array(np.arange(0, keys.size + 1, p.bands), pa.int32()),
                         pa.array(keys.reshape(-1).view(np.int64))),
                     pa.array([raw[k * p.bins:(k + 1) * p.bins] for k in range(j - i)], pa.binary())],
                    ["doc_id", "tkey", "n_shingles", "node", "bands", "sketch"])

    return rows.mapInArrow(run, f"doc_id {kind}, tkey bigint, n_shingles bigint, node binary, "
                                "bands array<bigint>, sketch binary")


def _full_sets(rows: DataFrame, p: NearDupParams) -> DataFrame:
    """``(node, shingles)`` of ``rows(node, text)``; a set is packed 64-bit
    hashes in ascending order."""
    def run(batches):
        tasks.release()
        for b in batches:
            for i, j, data, off in tasks.sliced_texts(b, limit=tasks.HASH_STEP):
                sets, at = distinct_sets(data, off, p.shingle)
                raw = sets.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i),
                     pa.array([raw[8 * at[k]:8 * at[k + 1]] for k in range(j - i)], pa.binary())],
                    ["node", "shingles"])

    return rows.mapInArrow(run, "node binary, shingles binary")


def similar(a: bytes, b: bytes, percent: int) -> bool:
    """100 * intersection >= percent * union of two packed sorted sets."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are similar."""
    full = (pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
            .select("a", "b", "x", "y"))

    def run(batches):
        tasks.release()
        for batch in batches:
            ok = [similar(x.as_py(), y.as_py(), percent)
                  for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [c.filter(pa.array(ok, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    return full.mapInArrow(run, "a binary, b binary")


def _buckets(nodes: DataFrame) -> DataFrame:
    """``(bucket, n, node, rank)`` of distinct buckets with ``n`` >= 2 members;
    first rank those that meet most members in all their buckets."""
    rows = nodes.select("node", F.explode("bands").alias("bucket"))
    sign = rows.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"),
        F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).where("n > 1")
    one = sign.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "n")
    members = session.write_table(rows.join(one, "bucket"), "members")
    weight = members.groupBy("node").agg(F.sum("n").alias("weight"))
    by = Window.partitionBy("bucket").orderBy(F.desc("weight"), "node")
    return session.write_table(members.join(weight, "node").select(
        "bucket", "n", "node", F.row_number().over(by).alias("rank")), "buckets")


def _labels(nodes: DataFrame, docs: DataFrame, p: NearDupParams) -> DataFrame | None:
    """``(node, label)`` of linked nodes, or None when nothing is linked."""
    members = _buckets(nodes)
    if members.isEmpty():
        return None
    need = members.select("node").distinct().join(nodes.select("node", "rep"), "node")
    texts = docs.join(need.select("node", F.col("rep.doc_id").alias("_i"),
                                  F.col("rep.tkey").alias("_t")),
                      F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("tkey") == F.col("_t")))
    sets = session.write_table(_full_sets(texts.select("node", "text"), p)
                               .dropDuplicates(["node"]), "sets")
    places = members.groupBy("node").agg(  # at most one per band
        F.sort_array(F.collect_list(F.struct("bucket", "rank"))).alias("_p")).select(
        "node", F.col("_p.bucket").alias("buckets"), F.col("_p.rank").alias("ranks"))
    light = session.write_table(places.join(nodes, "node").select(
        "node", F.col("n_shingles").alias("size"), "sketch", "buckets", "ranks"), "light")
    open_rows = members.withColumn("label", F.col("node"))
    labels, hubs = None, HUBS
    while True:
        if hubs == HUBS:  # at most one pair a row
            new = _confirmed(_agreeing(open_rows, hubs, light, p), sets, p.percent)
        else:
            may = session.write_table(_having_candidates(open_rows, hubs, light, p), "candidates")
            new = _linked(_counted(open_rows.join(may, ["bucket", "node"])),
                          hubs, light.join(sets, "node"), p)
        new, found = session.write_counted(new, "links")
        if labels is None:
            labels = components(new)
        elif found:
            labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
                                .unionByName(new))
        # used hubs leave their bucket; a bucket closes when one label is left
        left = (open_rows.where(F.col("rank") > hubs).drop("label", "n").join(labels, "node", "left")
                .select("bucket", "node", "rank", F.coalesce("label", "node").alias("label")))
        many = left.groupBy("bucket").agg(
            F.count(F.lit(1)).alias("n"), F.min("label").alias("l0"), F.max("label").alias("l1")).where(
            "l0 <> l1").select("bucket", "n")
        open_rows, n_open = session.write_counted(left.join(many, "bucket"), "open")
        if not n_open:
            return labels
        hubs *= MORE


def _counted(members: DataFrame) -> DataFrame:
    """``members`` with ``n``, the rows that each bucket has there, and where
    they have a ``size`` the ``bytes`` of the bucket's full sets."""
    sums = [F.count(F.lit(1)).alias("n")]
    if "size" in members.columns:
        sums.append((F.sum("size") * 8).alias("bytes"))
    return members.drop("n").join(members.groupBy("bucket").agg(*sums), "bucket")


def _dealt(members: DataFrame, hubs: int, light: DataFrame) -> DataFrame:
    """The rows to compare: every deal of a bucket's members, each member in
    one, and behind it all hubs of the bucket (ranks up to ``hubs``)."""
    deals = F.ceil(F.sqrt(F.col("n") / F.lit(DEAL)))
    if "bytes" in members.columns:
        deals = F.greatest(deals, F.ceil(F.col("bytes") / F.lit(DEAL_BYTES)))
    deals = deals.cast("int")
    one = members.withColumn("deal", F.pmod(F.xxhash64("node"), deals).cast("int")).withColumn(
        "hub", F.lit(0))
    all_ = members.where(F.col("rank") <= hubs).withColumn(
        "deal", F.explode(F.sequence(F.lit(0), deals - 1))).withColumn("hub", F.lit(1))
    rows = one.unionByName(all_).select("bucket", "deal", "hub", "node", "label")
    rows = rows.join(light, "node").repartition("bucket", "deal")
    return rows.sortWithinPartitions("bucket", "deal", "hub").select(
        "bucket", "deal", "hub", "node", "label", "size", "sketch", "buckets", "ranks",
        *[c for c in light.columns if c == "shingles"])


def _meet(batches, p: NearDupParams):
    """For every record batch of ``_dealt`` rows the meetings ``(group, hub,
    places)`` of a hub and the members of greater rank and another label whose
    sizes and sketches allow the similarity, and None at its end.

    Of two hubs only the lesser rank meets the other as a member.  Two nodes
    that share several buckets are compared in one of them only: where one of
    them has the least rank of all, so becomes a hub first.
    """
    tasks.release()
    least = int(np.ceil(p.agree * p.bins))
    key, group = None, None
    for whole in batches:
        for i in range(0, whole.num_rows, DEAL):
            for bucket, deal, hub, *row in zip(
                    *(c.to_pylist() for c in whole.slice(i, DEAL).columns), strict=True):
                if (bucket, deal) != key:
                    key, group = (bucket, deal), Members(bucket)
                row = Row(*row)
                if hub:
                    yield group, row, group.agreeing(row, p.percent, least)
                else:
                    group.add(row)
        yield None


def _pairs(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in (a, b)], ["a", "b"])


def _agreeing(members: DataFrame, hubs: int, light: DataFrame, p: NearDupParams) -> DataFrame:
    """Candidate edges ``(a, b)`` between members of a bucket and its hubs."""
    def run(batches):
        a, b = [], []
        for met in _meet(batches, p):
            if met is None:
                yield _pairs(a, b)
                a, b = [], []
                continue
            group, hub, places = met
            for k in places:
                if responsible(hub.rank, group.rows[k].rank) == group.bucket:
                    a.append(min(hub.node, group.rows[k].node))
                    b.append(max(hub.node, group.rows[k].node))

    return _dealt(members, hubs, light).mapInArrow(run, "a binary, b binary")


def _having_candidates(members: DataFrame, hubs: int, light: DataFrame,
                       p: NearDupParams) -> DataFrame:
    """``(bucket, node, size)`` of the members and hubs that have a candidate
    edge, each once however many it has."""
    def run(batches):
        buckets, nodes, sizes = [], [], []

        def tell(bucket, row):
            buckets.append(bucket)
            nodes.append(row.node)
            sizes.append(row.size)

        for met in _meet(batches, p):
            if met is None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(buckets, pa.int64()), pa.array(nodes, pa.binary()),
                     pa.array(sizes, pa.int64())], ["bucket", "node", "size"])
                buckets.clear()
                nodes.clear()
                sizes.clear()
                continue
            group, hub, places = met
            for k in places:
                row = group.rows[k]
                if hub.told and row.told or responsible(hub.rank, row.rank) != group.bucket:
                    continue
                for one in (hub, row):
                    if not one.told:
                        tell(group.bucket, one)
                        one.told = True

    return _dealt(members, hubs, light).mapInArrow(
        run, "bucket bigint, node binary, size bigint").distinct()


def _linked(members: DataFrame, hubs: int, full: DataFrame, p: NearDupParams) -> DataFrame:
    """Links ``(a, b)`` that connect the members of a bucket and its hubs whose
    full sets are similar: of each group of rows that meet, a forest."""
    def run(batches):
        a, b = [], []
        for met in _meet(batches, p):
            if met is None:
                yield _pairs(a, b)
                a, b = [], []
                continue
            group, hub, places = met
            for k in places:
                row = group.rows[k]
                if group.root(row.label) == group.root(hub.label):
                    continue
                if responsible(hub.rank, row.rank) == group.bucket and similar(
                        row.shingles, hub.shingles, p.percent):
                    group.above[group.root(row.label)] = group.root(hub.label)
                    a.append(min(row.node, hub.node))
                    b.append(max(row.node, hub.node))

    return _dealt(members, hubs, full).mapInArrow(run, "a binary, b binary")


def responsible(one: dict[int, int], other: dict[int, int]) -> int:
    """The bucket that compares two nodes, of those that hold both (bucket ->
    rank): that of the least rank of either, the least bucket of equal ones."""
    return min((min(r, other[b]), b) for b, r in one.items() if b in other)[1]


class Row:
    """A member or hub as it comes to a task, with its buckets' ranks."""
    __slots__ = ("node", "label", "size", "sketch", "rank", "shingles", "told")

    def __init__(self, node, label, size, sketch, buckets, ranks, shingles=None):
        self.node, self.label, self.size, self.sketch = node, label, size, sketch
        self.rank = dict(zip(buckets, ranks, strict=True))
        self.shingles, self.told = shingles, False


class Members:
    """A deal of a bucket's members, to compare hubs with all at once, and
    which labels have been connected there."""

    def __init__(self, bucket: int):
        self.bucket, self.rows, self.table = bucket, [], None
        self.above: dict[bytes, bytes] = {}

    def add(self, row: Row) -> None:
        self.rows.append(row)

    def root(self, label: bytes) -> bytes:
        top = label
        while top in self.above:
            top = self.above[top]
        while label != top:
            self.above[label], label = top, self.above[label]
        return top

    def agreeing(self, row: Row, percent: int, least: int):
        """Places of the members of greater rank than ``row`` and another
        label that may be similar."""
        if not self.rows:
            return []
        if self.table is None:
            self.table = (np.frombuffer(b"".join(r.label for r in self.rows), np.uint64).reshape(-1, 2),
                          np.array([r.size for r in self.rows]),
                          np.array([r.rank[self.bucket] for r in self.rows]),
                          np.frombuffer(b"".join(r.sketch for r in self.rows), np.uint8).reshape(
                              len(self.rows), -1))
        labels, sizes, ranks, sketches_ = self.table
        may = (labels != np.frombuffer(row.label, np.uint64)).any(1)
        may &= ranks > row.rank[self.bucket]
        may &= 100 * np.minimum(sizes, row.size) >= percent * np.maximum(sizes, row.size)
        at = np.flatnonzero(may)
        same = (sketches_[at] == np.frombuffer(row.sketch, np.uint8)).sum(1)
        return at[same >= least].tolist()


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(
        F.coalesce(F.col(text_col), F.lit(""))).alias("tkey"), F.col(text_col).alias("text"))


def near_duplicates(docs: DataFrame, params: NearDupParams = NearDupParams(),
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept, tkey, node)``, one row per
    input row.  Different components may share a ``component_id``: that of
    null ids, or an id that several texts have.

    ``component_id`` is the least doc_id of the row's component (nulls apart),
    ``kept`` whether that is the row's own.  A text without words (null and
    empty included) has no shingle, is linked with nothing and kept.  A text
    of fewer words than a shingle has its whole sequence as one.  Repeated
    rows are one set.  A null id is kept only where its component has no
    other.  A text of any length is one set, taken whole.  An empty table gives
    an empty result; other columns are ignored.
    """
    return _labelled(docs, params, id_col, text_col).drop("label")


def _labelled(docs: DataFrame, params: NearDupParams, id_col: str, text_col: str) -> DataFrame:
    """``near_duplicates`` and the label of the row's component, a node of it
    (null for a text without words)."""
    spark = docs.sparkSession
    tasks.prepare(spark)
    rows = _keyed(docs, id_col, text_col)
    signed = session.write_table(_signed(rows, params), "signed")
    nodes = session.write_table(
        signed.where("node is not null").groupBy("node").agg(
            F.min(F.struct("doc_id", "tkey")).alias("rep"), F.min("doc_id").alias("least"),
            F.first("bands").alias("bands"), F.first("sketch").alias("sketch"),
            F.first("n_shingles").alias("n_shingles")), "nodes")
    labels = _labels(nodes, rows, params)
    named = nodes.select("node", "least")
    if labels is None:
        comp = named.select("node", F.col("least").alias("component_id"), F.col("node").alias("label"))
    else:
        named = named.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        linked = named.join(labels.select("node"), "node", "left_semi")
        best = linked.groupBy("label").agg(F.min("least").alias("best"))
        comp = named.join(best, "label", "left").select(
            "node", F.coalesce("best", "least").alias("component_id"), "label")
    out = signed.drop("bands", "sketch").join(comp, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"),
                      "tkey", "node", "label")


def keep_one(docs: DataFrame, params: NearDupParams = NearDupParams(), id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, all columns: that of the
    least doc_id (of repeated rows, any one).  Rows without words (null and
    empty texts included) all stay.  Null ids and ids of several texts are
    told apart by their texts; an empty table stays empty; a text of any
    length is one set; columns of any name are carried along."""
    found = _labelled(docs, params, id_col, text_col).where("kept and node is not null")
    # The kept rows of a component have one id; where it holds several of the
    # component's texts, one text stays.
    one = found.groupBy("label").agg(F.min(F.struct("doc_id", "tkey")).alias("_k")).select(
        F.col("_k.doc_id").alias("_i"), F.col("_k.tkey").alias("_t"))
    keyed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_in"),
                        F.col(id_col).alias("_id"), F.coalesce(
                            F.col(text_col), F.lit("")).alias("_text"))
    keyed = keyed.select("_in", "_id", F.xxhash64("_text").alias("_key"),
                         F.rlike("_text", F.lit(r"[^\x20\x09-\x0D]")).alias("_words"))
    rows = keyed.where("_words").join(
        one, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_key") == F.col("_t"))).select(
        "_in", "_id", "_key").dropDuplicates(["_id", "_key"])
    rows = rows.select("_in").unionByName(keyed.where("not _words").select("_in"))
    return rows.select(*[F.col(f"_in.`{c}`").alias(c) for c in docs.columns])
