"""Near-duplicates, repeated strings and components against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from basketry.llm import near_dup, repeats
from basketry.llm.components import components
from basketry.llm.near_dup import NearDupParams
from basketry.llm.shingles import distinct_sets
from basketry.llm.tasks import text_bytes

BLANK = re.compile(r"[\x20\x09-\x0D]+")
FOUR = NearDupParams(shingle=4)


def shingle_set(text, size):
    words = [w for w in BLANK.split(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)}


def brute_components(rows, size):
    """``rows(doc_id, text)`` -> (doc_id, set size, least id, kept)."""
    sets = [shingle_set(t, size) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    out = []
    for i, (d, _) in enumerate(rows):
        c = least.get(root(i)) if sets[i] else d
        out.append((d, len(sets[i]), c, c is None or d == c))
    return out


def near_texts():
    """Families whose links need other members than the least: a base that
    links copies which are not linked with each other, and chains."""
    rnd = random.Random(3)
    word = lambda: "w" + str(rnd.randint(0, 5000))
    out = []
    for size in (12, 40, 200):
        base = [word() for _ in range(size)]
        family = [base]
        for k in range(14):
            copy = list(base)
            for _ in range(max(1, size // 45)):
                copy[rnd.randrange(size)] = word()
            family.append(copy)
        chain = list(base)
        for k in range(6):
            chain = chain[max(1, size // 30):] + [word() for _ in range(max(1, size // 30))]
            family.append(chain)
        rnd.shuffle(family)
        out += [" ".join(f) for f in family]
    out += ["a b", "A  b", "a", "a b c", "", None, "a b c d e", "a b c d e"]
    rnd.shuffle(out)
    return out


def test_shingles(texts):
    for size in (1, 4, 5):
        _, at = distinct_sets(*text_bytes(pa.array(texts)), size)
        assert np.diff(at).tolist() == [len(shingle_set(t, size)) for t in texts]


def test_sketch_estimates_and_fills():
    rnd = np.random.default_rng(1)
    a = np.sort(rnd.integers(0, 1 << 63, 400, dtype=np.int64).astype(np.uint64) * np.uint64(2))
    b = np.sort(np.concatenate([a[:320], rnd.integers(0, 1 << 63, 80).astype(np.uint64)]))
    one = a[:1]
    sets, off = np.concatenate([a, b, one]), np.array([0, 400, 800, 801, 801])
    s = near_dup.sketches(sets, off, 1024)
    assert abs((s[0] == s[1]).mean() - 320 / 480) < 0.08
    assert (s[2] == one[0]).all() and not s[3].any()


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates(spark, bag, size):
    rows = list(enumerate(near_texts()))
    rows += [(None, rows[0][1]), rows[1], rows[2], (None, "only null"), (None, "only null"), (None, "")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows],
                                 "doc_id bigint, text string, node string, component_id int").repartition(3)
    got = near_dup.near_duplicates(docs, NearDupParams(shingle=size))
    assert bag(got.drop("tkey", "node").collect()) == bag(brute_components(rows, size))


def test_near_duplicates_edges(spark, docs, empty, bag):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert bag(near_dup.near_duplicates(docs, FOUR).drop("tkey", "node").collect()) == bag(
        brute_components(rows, 4))
    assert near_dup.near_duplicates(empty, FOUR).count() == 0
    assert near_dup.keep_one(empty).count() == 0


def similar_group(name, n, changes):
    """Texts of 400 words of a base with ``changes`` words of their own."""
    rnd = random.Random(name)
    out = []
    for i in range(n):
        text = [f"{name}{k}" for k in range(400)]
        for at in rnd.sample(range(2, 400, 5), changes):
            text[at] = f"{name}own{i}at{at}"
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("deal", [16, 1024])
def test_group_below_the_similarity_makes_no_pair_rows(spark, bag, monkeypatch, deal):
    """Texts that are just not similar to each other: all pairs have agreeing
    sketches and none is a link, but no table has a row for each of them."""
    tables = []
    write = near_dup.session.write_table

    def counted(df, tag="table"):
        out = write(df, tag)
        tables.append((tag, out.count()))
        return out

    monkeypatch.setattr(near_dup.session, "write_table", counted)
    monkeypatch.setattr(near_dup, "DEAL", deal)
    rows = list(enumerate(similar_group("a", 120, 7) + similar_group("b", 30, 3)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = near_dup.near_duplicates(docs, FOUR)
    want = brute_components(rows, 4)
    assert bag(got.drop("tkey", "node").collect()) == bag(want)
    assert 20 < sum(kept for *_, kept in want) < 150
    made = [n for tag, n in tables if tag in ("pairs", "candidates", "links")]
    members = dict(tables)["members"]
    assert len(made) > 3 and max(made) <= members < 120 * 119 // 2


def test_large_bucket_is_sent_by_the_square_root_of_its_size(spark, monkeypatch):
    """Every member is sent once and every hub to each deal, so four times the
    members are eight times the rows, not sixteen times."""
    monkeypatch.setattr(near_dup, "DEAL", 16)
    made = []
    for n in (256, 1024):
        nodes = [(i, bytes([i // 256, i % 256])) for i in range(n)]
        members = near_dup._counted(spark.createDataFrame(
            [(1, node, i + 1, node) for i, node in nodes],
            "bucket bigint, node binary, rank int, label binary").withColumn("n", near_dup.F.lit(0)))
        light = spark.createDataFrame(
            [(node, 5, b"", [1], [i + 1]) for i, node in nodes],
            "node binary, size bigint, sketch binary, buckets array<bigint>, ranks array<int>")
        rows = near_dup._dealt(members, n, light).select("deal", "hub", "node").collect()
        assert sorted(r.node for r in rows if not r.hub) == sorted(node for _, node in nodes)
        deals = {r.deal for r in rows}
        assert Counter((r.deal, r.node) for r in rows if r.hub) == Counter(
            (d, node) for d in deals for _, node in nodes)
        made.append(len(rows))
    assert made == [256 + 256 * 4, 1024 + 1024 * 8]


def test_large_sets_are_dealt_over_more_tasks(spark, bag, monkeypatch):
    sent = []
    dealt = near_dup._dealt

    def counted(members, hubs, light):
        out = dealt(members, hubs, light)
        if "shingles" in light.columns:
            sent.append(out.agg(near_dup.F.max("deal")).first()[0])
        return out

    monkeypatch.setattr(near_dup, "_dealt", counted)
    monkeypatch.setattr(near_dup, "DEAL_BYTES", 20_000)
    rows = list(enumerate(similar_group("a", 40, 7) + similar_group("b", 20, 3)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = near_dup.near_duplicates(docs, FOUR)
    assert bag(got.drop("tkey", "node").collect()) == bag(brute_components(rows, 4))
    assert max(x for x in sent if x is not None) > 1


def test_release_frees_the_last_model():
    from basketry.llm import tasks
    tasks.model(("x",), lambda: [1])
    tasks.release()
    assert not tasks._model


def test_keep_one(docs, bag):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = {(r, t) for (r, t), (_, n, c, k) in zip(rows, brute_components(rows, 5), strict=True) if k}
    got = near_dup.keep_one(docs)
    assert got.columns == docs.columns
    assert bag((r.doc_id, r.text) for r in got.collect()) == bag(want)


def test_keep_one_of_null_and_equal_ids(spark, bag):
    """Texts that are nobody's duplicate stay, whatever ids they share; of a
    component one row stays."""
    rnd = random.Random(7)
    prose = lambda n: " ".join("w" + str(rnd.randint(0, 5000)) for _ in range(n))
    alone = [(d, prose(40)) for d in (None, None, None, 7, 7, 7, 3, 8)]
    base = prose(60).split()
    near = [" ".join([*base[:k], "changed", *base[k + 1:]]) for k in (0, 1, 59)]
    other, third = prose(50), prose(50)
    rows = alone + [(None, near[0]), (None, near[1]), (None, near[2]), (None, near[2])]
    rows += [(3, other), (9, other + " end"), (None, other), (7, third), (7, third + " end"), (12, third)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = [tuple(r) for r in near_dup.keep_one(docs).collect()]
    rest = [r for r in got if r not in alone]
    assert bag(r for r in got if r in alone) == bag(alone)
    assert len(rest) == 3 and sum(d is None and t in near for d, t in rest) == 1
    assert (3, other) in rest and sum(d == 7 and t.startswith(third) for d, t in rest) == 1


def test_components(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rnd.randint(0, 60), 100 + rnd.randint(0, 60))
                                               for _ in range(40)] + [(200, i) for i in range(201, 260)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    want = {x: root(x) for x in up if any(x in e and e[0] != e[1] for e in edges)}
    got = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.node: r.label for r in got} == want and len(got) == len(want)


@pytest.fixture
def written(monkeypatch):
    """Tags of the scratch tables that the operators of this module write."""
    tags = []
    write = near_dup.session.write_table

    def noted(df, tag="table"):
        tags.append(tag)
        return write(df, tag)

    monkeypatch.setattr(near_dup.session, "write_table", noted)
    return tags


@pytest.mark.parametrize("edges, rounds", [
    ([], 1), ([(1, 1)], 1), ([(1, 2), (2, 1), (1, 3), (1, 3)], 1), ([(9, 1), (9, 2), (9, 3)], 1),
    ([(1, 9), (2, 9), (2, 8), (3, 8), (20, 21)], 2)])
def test_components_end_with_the_round_that_makes_stars(spark, written, edges, rounds):
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: 20 if x > 19 else 1 for e in edges for x in e if e[0] != e[1]}
    assert Counter(written) == {"edges": rounds, "labels": rounds}


def test_linked_texts_take_few_tables(spark, bag, written):
    """The first hubs' candidates are confirmed as they come, and labels that
    are stars end the search for components."""
    rows = list(enumerate(similar_group("a", 20, 1) + similar_group("b", 5, 1)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = near_dup.near_duplicates(docs, FOUR)
    assert bag(got.drop("tkey", "node").collect()) == bag(brute_components(rows, 4))
    assert written == ["signed", "nodes", "members", "buckets", "sets", "light", "links",
                       *["edges", "labels"] * written.count("labels"), "open"]


def brute_repeats(texts, length):
    seen = Counter()
    raw = [(t or "").encode() for t in texts]
    for b in raw:
        for i in range(len(b) - length + 1):
            seen[b[i:i + length]] += 1
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def repeat_texts():
    rnd = random.Random(6)
    prose = lambda n: "".join(rnd.choice("etaoin shrdlué\n") for _ in range(n))
    shared = [prose(n) for n in (127, 128, 129, 200, 260, 300, 700)]
    out = [prose(rnd.randint(0, 300)) + rnd.choice(shared)[rnd.randint(0, 40):] + prose(rnd.randint(0, 300))
           for _ in range(120)]
    common = prose(180)  # a passage of a third of all texts
    out += [prose(rnd.randint(0, 50)) + common + prose(rnd.randint(0, 50)) for _ in range(60)]
    out += ["ab" * 300, "ab" * 250 + "c", "x" * 129, "x" * 128, "x" * 127, out[0], out[0], None, "", "é" * 70]
    out += [shared[6][:i] + "#" + shared[6][i:] for i in range(100, 600, 50)]
    return out


def test_repeats(spark, bag):
    rows = list(enumerate(repeat_texts()))
    docs = spark.createDataFrame([(i if i != 5 else None, t, 0, 1) for i, t in rows],
                                 "doc_id bigint, text string, part int, rid int").repartition(5)
    got = repeats.remove_repeats(docs, 128, keep_bytes=True)
    want = brute_repeats([t for _, t in rows], 128)
    assert bag(got.drop("kept").collect()) == bag(
        (i if i != 5 else None, *x) for (i, _), x in zip(rows, want, strict=True))
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got.collect())


def test_repeats_edges(docs, empty, bag):
    rows = docs.select("doc_id", "text").collect()
    want = brute_repeats([r.text for r in rows], 200)
    assert bag(repeats.remove_repeats(docs).collect()) == bag(
        (r.doc_id, *x) for r, x in zip(rows, want, strict=True))
    assert repeats.remove_repeats(empty).count() == 0
    with pytest.raises(ValueError):
        repeats.remove_repeats(docs, 100)


def test_frequent_seeds_take_the_other_way(spark, bag, monkeypatch):
    """Every seed as if a splitter met it, and none: the same answer."""
    texts = repeat_texts()
    rows = [bytes(x) for x in {t.encode() for t in texts if t}]
    data = np.frombuffer(b"".join(rows), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    raw = data.tobytes()
    place, first, last, _ = repeats.anchors(data, off, 128)
    found = {}
    for p, a, b in zip(place, first, last):
        found.setdefault(repeats.entry(raw, p, a, b, 128), []).append(a)
    entries = sorted(found)
    counts = np.array([len(found[e]) for e in entries])
    where = np.array([x for e in entries for x in found[e]], np.int64)

    def gone(split):
        run = repeats.Run(0, repeats.front_code(entries, counts, 0))
        merge = repeats.Merge(128, split, 3)
        for r, known in repeats.LoserTree([run]):
            merge.take(r, known)
        out = list(merge.finish())
        marks = [repeats.unpack(x)[0] for p, _, x in out if p >= 0]
        for b in {b for p, b, _ in out if p < 0}:
            more = repeats.settle_bucket([x for _, c, x in out if c == b])
            marks += [repeats.unpack(x)[0] for _, x in more.rows()]
        return repeats.removed_bytes(len(data), counts, where, marks, 128)

    near = gone(frozenset())
    assert near.any() and (near == gone(frozenset(e[:repeats.SEED] for e in entries))).all()


def test_loser_tree_merges():
    rnd = random.Random(8)
    runs, every = [], []
    for part in range(7):
        own = sorted({bytes(rnd.choice(b"ab") for _ in range(rnd.randint(1, 9))) for _ in range(30)})
        every += own
        runs.append(repeats.Run(part, repeats.front_code(own, np.ones(len(own), np.int64), 0)))
    runs.append(repeats.Run(9, repeats.front_code([], np.ones(0, np.int64), 0)))
    got, before = [], b""
    for r, known in repeats.LoserTree(runs):
        assert known == repeats.common(before, r.head, 0)
        got.append(r.head)
        before = r.head
    assert got == sorted(every)
