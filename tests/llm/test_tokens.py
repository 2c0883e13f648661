"""Token counts, token files and chunk-reuse BPE against the library itself."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from basketry import session
from basketry.llm import bpe_reuse, tasks, token_orc
from basketry.llm.pieces import MARKS, PieceCoder, coder, load_tokenizer
from basketry.llm.tasks import steps, text_bytes
from basketry.llm.token_counts import count_tokens

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")


def library(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path,cut", [(BYTE, "byte"), (WORD, "word")])
def test_pieces_equal_library(path, cut, texts):
    import random
    import pyarrow as pa
    rnd = random.Random(2)
    marks = ["a", "Zz", " ", "  ", "\n", "\t", "\u00a0", "'s", "'", "é", "e\u0301", "1", "!", ".",
             "<|endoftext|>", "<|startoftext|>", "\x85", "\x1c", "Σς", "中", "-", "(", "😀"]
    every = [t or "" for t in texts] + [
        "".join(rnd.choice(marks) for _ in range(rnd.randint(0, 14))) for _ in range(3000)]
    enc = PieceCoder(path, cut)
    assert enc.plain is not None
    ids, off = enc.encode(*text_bytes(pa.array(every)))
    want = Tokenizer.from_file(path).encode_batch(every, add_special_tokens=False)
    for i, w in enumerate(want):
        assert ids[off[i]:off[i + 1]].tolist() == w.ids, every[i]
    assert enc.counts(*text_bytes(pa.array(every))).tolist() == [len(w.ids) for w in want]


@pytest.mark.parametrize("path,cut", [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_latin_words_equal_library(path, cut):
    """Words of Latin letters, and of characters that stand near them."""
    rnd = random.Random(1)
    letters = [chr(c) for c in [*range(65, 91), *range(97, 123), *range(0xC0, 0x100), 0xAA, 0xB5, 0xBA,
                                0x301, 0x130, 0x131, 0x17F]]
    texts = [" ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(1, 9)))
                      + rnd.choice(["", ".", "!?", ",", "\n", " x"]) for _ in range(20)) for _ in range(200)]
    want = load_tokenizer(P.path(path)).encode_batch(texts, add_special_tokens=False)
    got = coder(P.path(path), cut).encode_texts(texts)
    assert [g.tolist() for g in got] == [w.ids for w in want]


@pytest.mark.parametrize("path,cut", [(WORD, "word"), (BYTE, "byte")])
def test_marked_words_need_no_tokenizer(path, cut):
    """Letters with marks behind them are cut into both and go to the model,
    in any case; other orders of them are left to the library."""
    import pyarrow as pa
    rnd = random.Random(4)
    word = lambda: rnd.choice("abT") + "".join(
        rnd.choice("abTÀéÿß") for _ in range(rnd.randint(0, 3)))
    marks = lambda: "".join(rnd.choice(MARKS) for _ in range(rnd.randint(0, 3)))
    plain = [" ".join(word() + marks() for _ in range(30)) for _ in range(100)]
    mixed = [" ".join(rnd.choice([word, marks])() + rnd.choice([word, marks, lambda: "×÷Āא<|"])()
                      + marks() for _ in range(30)) for _ in range(100)]
    enc, tok = PieceCoder(path, cut), load_tokenizer(path)
    for texts in (plain, mixed):
        enc.tok = None if texts is plain else tok
        ids, off = enc.encode(*text_bytes(pa.array(texts)))
        for i, w in enumerate(tok.encode_batch(texts, add_special_tokens=False)):
            assert ids[off[i]:off[i + 1]].tolist() == w.ids, texts[i]
        if texts is plain:
            assert not any(p[0] in MARKS and p.strip(MARKS) or p[-1] in MARKS and p[0] not in MARKS
                           for p in enc.memo)
            assert cut == "byte" or not any(p != p.lower() for p in enc.memo)


def test_steps_cover_every_row_once():
    sizes = np.array([0, 5, 0, 100, 1, 1, 1, 0])
    got = list(steps(sizes, 6))
    assert [i for a, b in got for i in range(a, b)] == list(range(8))
    assert all(b - a == 1 or sizes[a:b].sum() <= 6 for a, b in got)


def test_count_tokens(docs, empty, bag):
    rows = docs.select("doc_id", "text").collect()
    want = bag((r.doc_id, len((r.text or "").encode()), n := len(library(BYTE, r.text)), n > 50)
               for r in rows)
    assert bag(count_tokens(docs, BYTE, 50).collect()) == want
    assert count_tokens(empty, BYTE, 50).count() == 0


def test_token_files(spark, docs, empty, bag):
    got = token_orc.token_file_rows(docs, WORD, 1).collect()
    rows = docs.select("doc_id", "text").collect()
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append(library(WORD, r.text) + [1])
    at = 0
    order = sorted(got, key=lambda r: r.start)
    ids = [r.doc_id for r in order]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    for r in order:
        own = by_id[r.doc_id].pop()  # equal ids hold equal texts here
        assert (r.start, r.n_tokens) == (at, len(own))
        assert r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
        at += len(own)
    assert token_orc.token_file_rows(empty, WORD, 1).count() == 0


def test_token_files_lookup(spark, docs):
    path = session.scratch_path(spark, "test-tokens")
    token_orc.write_tokens(docs, path, WORD, 1)
    every = {r.doc_id: r for r in token_orc.read_tokens(spark, path).collect()}
    some = token_orc.read_tokens(spark, path, [3, 9])
    assert {r.doc_id: (r.start, r.ids) for r in some.collect()} == {
        k: (every[k].start, every[k].ids) for k in (3, 9)}
    assert "PushedFilters: [In(doc_id" in some._jdf.queryExecution().toString()


def test_chunks_follow_content():
    import pyarrow as pa
    import random
    rnd = random.Random(1)
    shared = " ".join("w%d" % rnd.randint(0, 9999) for _ in range(3000))
    a, b = "start of a " + shared, "another, longer beginning é " + shared
    data, off = text_bytes(pa.array([a, b]))
    at = bpe_reuse.chunk_starts(data, off, 64)
    one = {bytes(data[x:y]) for x, y in zip(at[:-1], at[1:]) if y <= off[1]}
    two = {bytes(data[x:y]) for x, y in zip(at[:-1], at[1:]) if x >= off[1]}
    assert len(one & two) > 0.9 * len(one)


@pytest.mark.parametrize("mean", [16, 256])
def test_reuse_equals_library(texts, mean, monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(bpe_reuse.chunk_starts, "__defaults__", (mean,))
    enc = bpe_reuse.ReuseCoder(coder(WORD, "word"))
    every = [t or "" for t in texts] + ["".join(x) for x in zip(*[["a b", "'s é", "\u0301x "]] * 3)]
    tok = Tokenizer.from_file(WORD)
    for _ in range(2):  # the second time from the memo
        got = enc.encode(*text_bytes(pa.array(every)))
        for t, ids in zip(every, got, strict=True):
            want = tok.encode(t, add_special_tokens=False).ids
            assert ids.tolist() == want
            assert enc.decode(ids) == tok.decode(want, skip_special_tokens=False)


def test_chunk_starts_of_long_rows():
    """Cuts are found in blocks of positions, as if by one pass."""
    rnd = random.Random(8)
    data = np.frombuffer("".join(rnd.choices("abc é\n", k=170_000)).encode(), np.uint8)
    off = np.array([0, 70_000, 70_000, 70_020, len(data)])
    prefix = tasks.prefix_hash(data)
    at = np.arange(bpe_reuse.ROLL, len(data))
    h = tasks.window_hash(prefix, at - bpe_reuse.ROLL, at)
    cut = at[(h % np.uint64(64) == 0) & (data[at] & 0xC0 != 0x80)]
    row = np.searchsorted(off, cut, side="right") - 1
    want = sorted({0, 70_000, 70_020, *cut[cut - off[row] >= bpe_reuse.ROLL].tolist()})
    assert bpe_reuse.chunk_starts(data, off, 64).tolist() == want


def test_remembered_chunks_hold_their_own_ids(texts):
    """No chunk keeps the ids of the step that it was encoded in."""
    enc = bpe_reuse.ReuseCoder(PieceCoder(WORD, "word"))
    enc.encode(*text_bytes(pa.array([t or "" for t in texts])))
    held = [a for c in enc.memo.values() if c.body is not None
            for a in (c.body, c.first_ids, c.last_ids)]
    assert held and all(a.base is None for a in held)


def test_coder_remembers_so_many_pieces(texts, monkeypatch):
    monkeypatch.setattr(bpe_reuse, "MEMO_PIECES", 30)
    tasks.release()
    enc = bpe_reuse.reuse_coder(WORD)
    got = enc.encode(*text_bytes(pa.array([t or "" for t in texts])))
    tasks.release()
    assert len(enc.enc.memo) == 30
    assert [x.tolist() for x in got] == [library(WORD, t) for t in texts]


def test_batches_hold_about_a_step(spark):
    """Long texts come in batches of bounded bytes, one longer than that
    alone; a limit that the session names stays."""
    sizes = [3_000_000] * 6 + [9_000_000, 10, 10]
    rows = spark.createDataFrame([(k,) for k in sizes], "k int").coalesce(1).selectExpr(
        "repeat('x', k) AS text")

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([b.num_rows]), pa.array([len(text_bytes(b.column(0))[0])])], ["n", "size"])

    before = spark.conf.get(tasks.BATCH_LIMIT, None)
    try:
        spark.conf.unset(tasks.BATCH_LIMIT)
        tasks.prepare(spark)
        got = rows.mapInArrow(run, "n bigint, size bigint").collect()
        assert sum(r.n for r in got) == len(sizes) and sum(r.size for r in got) == sum(sizes)
        assert all(r.size < tasks.STEP_BYTES + 9_000_000 for r in got) and len(got) >= 4
        spark.conf.set(tasks.BATCH_LIMIT, "12345")
        tasks.prepare(spark)
        assert spark.conf.get(tasks.BATCH_LIMIT) == "12345"
    finally:
        spark.conf.unset(tasks.BATCH_LIMIT)
        if before is not None:
            spark.conf.set(tasks.BATCH_LIMIT, before)


def test_disagreeing_join_is_widened(texts):
    enc = bpe_reuse.ReuseCoder(coder(WORD, "word"))
    chunks = enc.chunks([texts[12][:905], texts[12][905:]])
    want = enc.enc.tok.encode(chunks[0].text + chunks[1].text, add_special_tokens=False).ids
    assert enc._wider(chunks).tolist() == want
    chunks[1].first_ids = chunks[1].first_ids + 1  # as if the join disagreed
    chunks[1].body = chunks[1].body + 1
    assert enc._wider(chunks).tolist() == want  # the whole document again


def test_bpe_digests_and_decode(docs, empty, bag):
    tok = Tokenizer.from_file(WORD)

    def want(r):
        ids = library(WORD, r.text)
        return (r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest())

    rows = docs.select("doc_id", "text").collect()
    assert bag(bpe_reuse.digests(docs, WORD).collect()) == bag(map(want, rows))
    coded = bpe_reuse.encode(docs, WORD)
    assert bag((r.doc_id, r.ids) for r in coded.collect()) == bag(
        (r.doc_id, library(WORD, r.text)) for r in rows)
    assert bag(bpe_reuse.decode(coded, WORD).collect()) == bag(
        (r.doc_id, tok.decode(library(WORD, r.text), skip_special_tokens=False)) for r in rows)
    assert bpe_reuse.digests(empty, WORD).count() == 0
