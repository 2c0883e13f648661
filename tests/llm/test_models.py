"""Language model and decontamination against plain Python."""

import math
import pickle
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from basketry.llm import decontaminate, suffix_lm
from basketry.llm.decontaminate import LeakParams, align
from basketry.llm.suffix_lm import LmParams

BLANK = re.compile(r"[\x20\x09-\x0D]+")
SMALL = LmParams(least=8, min_divergence=2.0)


def words_of(text):
    return [w for w in BLANK.split(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def base_scores(rows):
    train = Counter()
    for d, t in rows:
        if not held_out(d):
            train.update(words_of(t))
            train[None] += 1
    n, v = sum(train.values()), len(train)
    out = []
    for d, t in rows:
        tokens = [*words_of(t), None]
        out.append((d, held_out(d), len(tokens), sum(train[w] > 0 for w in tokens), n,
                    sum(math.log10((train[w] + 1) / (n + v + 1)) for w in tokens)))
    return out


@pytest.mark.parametrize("held_words", [0, 30, 100_000])
def test_base_score(docs, empty, held_words):
    """Whatever number of words the tasks hold."""
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = suffix_lm.score(docs, LmParams(least=8, held_words=held_words)).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[2])
    for g, w in zip(sorted(got, key=key), sorted(base_scores(rows), key=key), strict=True):
        assert tuple(g)[:5] == w[:5]
        assert g.base_score == pytest.approx(w[5], abs=1e-6) and g.score < 0


def test_lm_without_rows(empty, docs):
    assert suffix_lm.score(empty, SMALL).count() == 0
    only = docs.where("crc32(cast(doc_id as string)) % 7 = 2")
    got = suffix_lm.score(only, SMALL).collect()
    assert got and all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 for r in got)


def plain_scores(texts, train, p):
    """The model in dicts: contexts, tests and smoothing."""
    grams, total = {}, Counter()
    for t in train:
        s = [*words_of(t), None]
        for i in range(len(s)):
            for d in range(min(i, p.depth) + 1):
                grams.setdefault(tuple(s[i - d:i]), Counter())[s[i]] += 1
    for c, nxt in grams.items():
        total[c] = sum(nxt.values())
    n, v = total[()], len(grams.get((), ()))
    least = max(p.least, p.next_least, p.root_share * n ** 0.5)
    prob, keep = {}, {()}

    def smooth(c):
        if not c:
            return lambda x: (grams.get((), {}).get(x, 0) + 1) / (n + v + 1)
        own = {x: k for x, k in grams[c].items() if k >= p.next_least}
        scale = total[c] + p.smoothing
        free = (scale - sum(own.values())) / scale
        return lambda x: own.get(x, 0) / scale + free * prob[c[1:]](x)

    for c in sorted([()] + [c for c in total if c and total[c] >= least], key=len):
        prob[c] = smooth(c)
        own = {x: k for x, k in grams[c].items() if k >= p.next_least} if c else {}
        gain = sum(k * math.log(k / total[c] / prob[c[1:]](x)) for x, k in own.items())
        if own and gain >= p.min_divergence + len(own):
            keep |= {c[i:] for i in range(len(c) + 1)}
    out = []
    for t in texts:
        s = [*words_of(t), None]
        states = [next(c for d in range(min(i, p.depth), -1, -1)
                       if (c := tuple(s[i - d:i])) in keep) for i in range(len(s))]
        out.append(sum(math.log10(prob[c](x)) for c, x in zip(states, s, strict=True)))
    return out, keep, prob, {x for c in grams.values() for x in c}


def lm_rows(texts):
    return [(i, t) for i, t in enumerate(texts)] + [(100 + i, "a b c d a b e d x b c") for i in range(60)]


@pytest.mark.parametrize("depth,held", [(1, 1000), (3, 1000), (4, 0), (4, 40)])
def test_scores_equal_plain_model(spark, texts, depth, held):
    """At every depth, whether weights are held by the tasks or joined."""
    p = LmParams(depth=depth, least=6, root_share=0.05, next_least=2, min_divergence=1.0,
                 held_words=held, held_weights=held)
    rows = lm_rows(texts)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want, keep, _, _ = plain_scores([t for _, t in rows], [t for d, t in rows if not held_out(d)], p)
    got = {r.doc_id: r.score for r in suffix_lm.score(docs, p).collect()}
    assert max(map(len, keep)) == depth and len(keep) > 5
    assert [got[d] for d, _ in rows] == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("contexts,words", [(0, 1000), (40, 12), (1000, 1000)])
def test_counting_does_not_depend_on_what_is_held(spark, texts, contexts, words):
    """Pairs that travel as hashes, as both and as places."""
    p = LmParams(depth=3, least=6, root_share=0.05, next_least=2, min_divergence=1.0,
                 held_words=words, held_contexts=contexts, held_weights=0)
    rows = lm_rows(texts)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want, *_ = plain_scores([t for _, t in rows], [t for d, t in rows if not held_out(d)], p)
    got = {r.doc_id: r.score for r in suffix_lm.score(docs, p).collect()}
    assert [got[d] for d, _ in rows] == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("held", [0, 40])
def test_scores_do_not_depend_on_the_ranges(spark, texts, monkeypatch, held):
    """Counts, words and weights dealt over many tasks, few keys each."""
    monkeypatch.setattr(suffix_lm, "RANGE_TOKENS", 100)
    monkeypatch.setattr(suffix_lm, "RANGE_KEYS", 30)
    p = LmParams(depth=3, least=6, root_share=0.05, next_least=2, min_divergence=1.0,
                 held_words=held, held_contexts=held, held_weights=held)
    rows = lm_rows(texts)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want, *_ = plain_scores([t for _, t in rows], [t for d, t in rows if not held_out(d)], p)
    got = {r.doc_id: r for r in suffix_lm.score(docs, p).collect()}
    assert [got[d].score for d, _ in rows] == pytest.approx(want, rel=1e-9)
    assert [got[d].n_known for d, _ in rows] == [x[3] for x in base_scores(rows)]


def test_tables_on_disk_while_scoring(spark, texts, monkeypatch, tmp_path):
    """When the scores are written, only words and weights are left: no table
    of a level, and none with a key for every document that asks for it."""
    left = []
    write = suffix_lm.session._write
    monkeypatch.setattr(suffix_lm.session, "_root", lambda _: f"file://{tmp_path}/scratch")

    def watched(df, path):
        if "lm-scores" in path:
            left.extend(x.name.rpartition("-")[0] for x in tmp_path.glob("scratch/*/lm-*"))
            left.extend(x.name for x in tmp_path.glob("scratch/*/*/lm-*"))
        return write(df, path)

    monkeypatch.setattr(suffix_lm.session, "_write", watched)
    p = LmParams(depth=3, least=6, next_least=2, min_divergence=1.0, held_words=0, held_weights=0)
    docs = spark.createDataFrame(lm_rows(texts), "doc_id bigint, text string")
    assert suffix_lm.score(docs, p).count() == len(lm_rows(texts))
    assert sorted(left) == ["lm-weights", "lm-words"]


def test_shuffle_files_go_with_their_query(spark):
    def files():
        env = spark._jvm.org.apache.spark.SparkEnv.get()
        found = env.blockManager().diskBlockManager().getAllFiles()
        return {n for i in range(found.size()) if (n := found.apply(i).getName()).startswith("shuffle_")}

    key, old = suffix_lm.session.FREE_SHUFFLES, files()
    before = spark.conf.get(key, None)
    with suffix_lm.session.shuffles_freed(spark):
        assert spark.range(2000).repartition(3, "id").count() == 2000
        assert files() <= old
    assert spark.conf.get(key, None) == before


@pytest.mark.parametrize("docs", [7, 70_000])
def test_block_asks_once_for_a_key(docs):
    """Each key of a block is sent once, however many documents ask for it,
    and the sums that come back are those of every document's own keys."""
    rng = np.random.default_rng(docs)
    keys = np.unique(rng.integers(0, 2 ** 63, 90).astype(np.uint64) * np.uint64(2))
    ask, owner = rng.choice(keys, 400_000, p=(w := np.arange(1., len(keys) + 1) ** 3) / w.sum()), np.sort(
        rng.integers(0, docs, 400_000))
    block = suffix_lm.Block(5, 4, suffix_lm._schema(suffix_lm._ROUTE, pa.int64()))
    half = owner < docs // 2
    assert block.add(docs // 2, owner[half], ask[half]).tolist() == list(range(docs // 2))
    block.add(docs - docs // 2, owner[~half] - docs // 2, ask[~half])
    known, weight = keys[::2], rng.random(len(keys[::2]))
    word = rng.integers(0, 2, len(known)).astype(np.uint8)
    sums, sent, table = np.zeros((3, docs)), [], suffix_lm.ranges(known, 4)
    for b in block.asks():
        part, first, asked, times, more = (b.column(b.schema.get_field_index(x))[0] for x in (
            "part", "first", "keys", "times", "more"))
        n = suffix_lm.size_of(times.as_buffer())
        sent += np.unique(suffix_lm.values_of(first.as_py(), asked.as_buffer(), n)).tolist()
        lookup, mine = suffix_lm.Lookup(), table == part.as_py()
        if mine.any():
            lookup.add(pa.scalar(suffix_lm._first(known[mine])), pa.scalar(suffix_lm.differences(known[mine])),
                       pa.scalar(suffix_lm.squeezed(word[mine])), pa.scalar(suffix_lm.squeezed(weight[mine])))
        if got := lookup.sums(first, asked, times, more):
            at = np.flatnonzero(np.unpackbits(np.frombuffer(got["has"], np.uint8)))
            for k, (name, kind) in enumerate([("base_sums", "f8"), ("sums", "f8"), ("found", "i8")]):
                sums[k, at] += suffix_lm.whole(got[name], len(at), kind)
    assert sorted(sent) == np.unique(ask).tolist()
    place = {int(k): i for i, k in enumerate(known)}
    at = np.array([place.get(int(k), -1) for k in ask])
    hit = at >= 0
    for got, each in zip(sums, (weight * word, weight, word), strict=True):
        assert got == pytest.approx(np.bincount(owner[hit], each[at[hit]], docs))


@pytest.mark.parametrize("n", [0, 1, 2000])
def test_sorted_values_travel(n):
    rng = np.random.default_rng(n)
    values = np.unique(np.append(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1),
                                 np.array([0, 2 ** 64 - 1][:n], np.uint64)))
    first = suffix_lm._first(values) if len(values) else 0
    assert (suffix_lm.values_of(first, suffix_lm.differences(values), len(values)) == values).all()
    part = suffix_lm.ranges(values, 7)
    assert (np.diff(part) >= 0).all() and set(part) <= set(range(7))
    times = rng.integers(1, 1000, len(values))
    at, each = suffix_lm.in_bytes(times)
    assert each.dtype == np.uint8 and (np.bincount(at, each, len(values)) == times).all()
    assert (suffix_lm.whole(suffix_lm.squeezed(times), len(times), times.dtype) == times).all()


def test_what_tasks_hold_travels():
    keys = np.array([1, 5, 2 ** 64 - 1], np.uint64)
    held = suffix_lm.Held(keys, np.array([0.5, 0.1, 3.0]))
    empty = suffix_lm.Held(np.empty(0, np.uint64), np.empty(0))
    bits = np.arange(256, dtype=np.uint8)
    got = pickle.loads(pickle.dumps(suffix_lm.Wanted(held, None, empty, bits, bits[::-1])))
    assert got.contexts.find(keys)[0].tolist() == [0.5, 0.1, 3.0] and got.words.index(keys).tolist() == [-1] * 3
    assert got.more_contexts is None and (got.more_words == bits).all() and (got.before == bits[::-1]).all()


def test_tally_handed_on_early(monkeypatch):
    monkeypatch.setattr(suffix_lm, "HELD_KEYS", 50)
    rng = np.random.default_rng(3)
    steps = [rng.integers(0, 120, 40).astype(np.uint64) for _ in range(30)]
    tally, got, parts = suffix_lm.Tally(), Counter(), 0
    for b in [*(b for s in steps for b in tally.add(s)), *tally.rest()]:
        parts += 1
        assert b.column(0).to_pylist() == sorted(b.column(0).to_pylist())
        for value, _, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            got[value] += n
    assert parts > 1 and got == Counter(int(x) for s in steps for x in s)


@pytest.mark.parametrize("n", [0, 1, 5, 3000])
def test_held_keys_are_found(n):
    rng = np.random.default_rng(n)
    keys = np.unique(np.append(rng.integers(0, 1 << 63, n).astype(np.uint64),
                               np.arange(min(n, 4), dtype=np.uint64)))  # some share their range
    held = suffix_lm.Held(keys, np.arange(len(keys), dtype=float))
    wanted = np.concatenate([keys, rng.integers(0, 1 << 63, 500).astype(np.uint64),
                             np.array([0, 9, 2 ** 64 - 1], np.uint64)])
    place = {int(k): i for i, k in enumerate(keys)}
    assert held.index(wanted).tolist() == [place.get(int(w), -1) for w in wanted]


def test_distributions_sum_to_one(texts):
    """Next symbols below the least count share what is left, in every state."""
    train = [t for _, t in lm_rows(texts)]
    p = LmParams(least=6, root_share=0.05, next_least=3, min_divergence=1.0)
    _, keep, prob, symbols = plain_scores([], train, p)
    for c in keep:
        assert sum(map(prob[c], symbols | {"never seen"})) == pytest.approx(1.0)


def test_tree_grows_with_the_corpus(spark):
    """Twice the passages, twice the states and more, whatever their share."""
    p = LmParams(least=8, root_share=0.0, next_least=4, min_divergence=1.0)

    def states(groups):
        rows = [(f"w{g}a w{g}b w{g}c w{g}d",) for g in range(groups) for _ in range(12)]
        table = spark.createDataFrame(rows, "text string")
        counts, n, v = suffix_lm.words(table)
        return suffix_lm.weights(table, counts, n, v, p).count()

    small = states(40)
    assert small >= 40 * 9 and states(80) >= 2 * small


def test_contexts_do_not_depend_on_the_size_of_the_corpus(spark):
    """A context that occurs often enough stays one, however many texts of
    other words come beside it (3 million tokens here)."""
    passage = spark.range(80).selectExpr("'a b c d e f' as text")
    filler = spark.range(1_500_000).selectExpr("concat('x', id % 100) as text")

    def keys(table):
        counts, n, v = suffix_lm.words(table)
        return {r.key for r in suffix_lm.weights(table, counts, n, v, LmParams()).collect()}

    small = keys(passage)
    assert len(small) >= 12 and small <= keys(passage.union(filler))


def test_bitmap_has_every_key(spark):
    keys = [0, 1, -1, 2 ** 63 - 1, -2 ** 63, 32767, 32768, 1 << 26]
    bits = suffix_lm.bitmap(spark.createDataFrame([(k,) for k in keys], "key bigint"))
    assert suffix_lm.maybe_in(bits, np.array(keys, np.int64).view(np.uint64)).all()
    assert not suffix_lm.maybe_in(bits, np.array([5, 70000], np.uint64)).any()


def test_held_out_text_is_scored_better_than_by_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = suffix_lm.score(docs).where("held_out").agg(
        {"score": "sum", "base_score": "sum"}).first()
    assert got["sum(score)"] > got["sum(base_score)"]


def plain_align(a, b):
    best = 0.0
    h = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0.0, h[i - 1][j - 1] + (2.0 if a[i - 1] == b[j - 1] else -1.0),
                          h[i - 1][j] - 1.0, h[i][j - 1] - 1.0)
            best = max(best, h[i][j])
    return best


def test_align():
    rnd = random.Random(9)
    for _ in range(200):
        a = np.array([rnd.randint(0, 5) for _ in range(rnd.randint(1, 12))])
        b = np.array([rnd.randint(0, 5) for _ in range(rnd.randint(0, 20))])
        score, i, j = align(a, b)
        assert score == plain_align(a, b)
        if score:
            assert plain_align(a, b[i:j]) == score


def plain_words(text):
    return "".join(c if ord(c) > 127 or c.isalnum() else " " for c in text or "").lower().split()


def leak_tables(spark):
    rnd = random.Random(10)
    word = lambda: rnd.choice("abcdefghij") + rnd.choice("klmnop") + rnd.choice("qrstuv")
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [prose(n) for n in (30, 40, 25, 8, 12)] + ["two words", "", None, "!!", "one"]
    filler = prose(50)  # a common passage that holds an item
    items.append(filler[:120])
    docs, want = [], set()
    for i, item in enumerate(items[:5]):
        own = item.split()
        for kind in range(4):
            copy = list(own)
            if kind == 1:
                copy[len(copy) // 2] = "changed"
            if kind == 2:
                copy = copy[:-(len(copy) // 4)]
            if kind == 3:
                copy.insert(3, "inserted")
                copy[0] = copy[0].upper() + ","
            docs.append(prose(20) + " " + " ".join(copy) + ".\n" + prose(30))
            want.add((len(docs) - 1, i))
    docs += [prose(60) for _ in range(30)] + [None, "", "nothing here of two words, really"]
    want.add((len(docs) - 1, 5))
    first = len(docs)
    docs += [prose(5) + " " + filler for _ in range(10)]
    want |= {(first + k, 10) for k in range(10)}
    return (spark.createDataFrame([(i, t, "z") for i, t in enumerate(docs)],
                                  "doc_id bigint, text string, item_id string").repartition(3),
            spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string"), want, docs)


@pytest.mark.parametrize("block", [100, 1 << 20])
def test_leaks(spark, monkeypatch, block):
    """Found leaks equal an alignment of every item with every whole text."""
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    docs, bench, want, texts = leak_tables(spark)
    items = {r.item_id: plain_words(r.text) for r in bench.collect()}
    brute = {(i, k) for i, t in enumerate(texts) for k, w in items.items()
             if w and plain_align(w, plain_words(t)) >= 0.5 * 2 * len(w)}
    got = decontaminate.find_leaks(docs, bench).collect()
    pairs = {(r.doc_id, r.item_id) for r in got}
    assert want <= pairs <= brute
    assert {p for p in brute if len(items[p[1]]) >= 20} <= pairs
    for r in got:
        own, text = items[r.item_id], plain_words(texts[r.doc_id])
        assert r.score == plain_align(own, text[r.start_word:r.end_word]) / (2 * len(own))
    kept = decontaminate.without_leaks(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {p[0] for p in pairs}


def test_leak_edges(spark, docs, empty):
    _, bench, _, _ = leak_tables(spark)
    assert decontaminate.find_leaks(empty, bench).count() == 0
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.without_leaks(docs, bench.limit(0)).count() == docs.count()
    assert decontaminate.without_leaks(empty, bench).count() == 0
    same = docs.where("doc_id = 1").selectExpr("1L as item_id", "text")
    got = decontaminate.find_leaks(docs, same, LeakParams(min_score=0.9)).collect()
    assert sorted(r.doc_id for r in got) == [0, 0, 1, 2, 3]


@pytest.mark.parametrize("times", [1, 12])
@pytest.mark.parametrize("exact", [False, True])
def test_leaks_of_spread_edits(spark, times, exact):
    """Copies whose edits break most or all trigrams, alone and in many
    documents, beside exact copies or without, equal full alignment."""
    rnd = random.Random(12)
    prose = lambda n: " ".join("w" + str(rnd.randint(0, 400)) for _ in range(n))
    items = [prose(n) for n in (3, 9, 16, 30, 41)]
    texts = [prose(60) for _ in range(40)]
    for item in items:
        own = item.split()
        copies = [[f"x{k}" if k % m == m - 1 else w for k, w in enumerate(own)] for m in (3, 4, 5)]
        copies.append([w for k, w in enumerate(own) if k % 4 != 3])
        copies.append([x for w in own for x in (w, "in")])  # a word after each
        copies += [own[:len(own) // 2 + 1], own[len(own) // 2 - 1:]]
        for copy in copies + [own] * exact:
            texts += [prose(25) + " " + " ".join(copy) + " " + prose(25) for _ in range(times)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    want = {}
    for k, item in enumerate(items):
        code = {}
        number = lambda ws: np.array([code.setdefault(w, len(code)) for w in ws])  # noqa: B023, E731
        own = number(item.split())
        for d, t in enumerate(texts):
            score = align(own, number(t.split()))[0] / (2 * len(own))
            if score >= 0.5:
                want[d, k] = score
    assert len(want) >= 5 * 7 * times
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.find_leaks(docs, bench).collect()}
    assert got == want


@pytest.mark.parametrize("seed", range(12))
def test_stretches_hold_every_alignment(seed):
    """Few words, many items and texts in one step: nothing is passed over."""
    rnd = random.Random(seed)
    words = rnd.choice([4, 20, 60])
    prose = lambda n: " ".join(f"w{rnd.randrange(words)}" for _ in range(n))
    items = [prose(rnd.randint(3, 14)) for _ in range(8)]
    texts = [prose(9) + " " + " ".join(w + rnd.choice(["", "", "", " x", "y"]) for w in rnd.choice(
        items).split()) + " " + prose(rnd.randint(0, 4)) for _ in range(40)]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    for least in (0.5, 0.9):
        block = decontaminate.Block(list(range(8)), items, 3)
        block.choose(np.array([rnd.randint(0, 9) for _ in block.all]), 4, least)
        got = {(k, x[0]): x[1] for _, _, _, *step in decontaminate._steps([batch], block)
               for k, x in decontaminate._leaking(block, *step, least)}
        plain = decontaminate.Block(texts, texts, 3)
        score = {(d, i): align(block.item_words(i), plain.item_words(d))[0] / (2 * block.own[i])
                 for d in range(40) for i in range(8)}
        assert got == {k: x for k, x in score.items() if x >= least}


def test_stretch_at_the_end_of_a_step():
    """A stray hit of a long item before the last copy of a short one."""
    items = ["a b c d e f g h i j k l", "p q r"]
    text = "a b " + " ".join(f"z{k}" for k in range(40)) + " p q r"
    block = decontaminate.Block([0, 1], items, 3)
    block.choose(np.zeros(len(block.all), np.int64), 4, 0.9)
    batch = pa.RecordBatch.from_pydict({"text": [text]})
    got = [x for _, _, _, *step in decontaminate._steps([batch], block)
           for x in decontaminate._leaking(block, *step, 0.9)]
    assert got == [(0, (1, 1.0, 42, 45))]
