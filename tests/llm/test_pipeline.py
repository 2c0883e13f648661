"""The registered queries and the pipeline on the test tables."""

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from basketry.llm import bpe_reuse, oracle, queries
from conftest_tables import tables
from test_copies import brute_components, brute_repeats
from test_filters import base_spans, measures
from test_models import base_scores
from test_transforms import plain_base, plain_whitening

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(
        "doc_id", "text").collect()]


def test_registered():
    names = __spark_entry__.queries()
    assert [n for n in names if n.startswith("op")] == list(queries.QUERIES)
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert "pipeline" in names and set(oracle.ORACLE) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_oracle(spark, name):
    got = queries.QUERIES[name](spark, SF)
    want = tables(SF).sql(oracle.ORACLE[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert sorted(map(tuple, got.select(cols).collect()), key=repr) == sorted(
        want.select(*[duckdb.ColumnExpression(c) for c in cols]).fetchall(), key=repr)


def test_near_dup_query(spark, rows):
    assert sorted(map(tuple, queries.op6_near_dup(spark, SF).collect())) == sorted(
        brute_components(rows, 4))


def test_repeats_query(spark, rows):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op8_suffix_dedup(spark, SF).collect()}
    assert got == {d: x for (d, _), x in zip(rows, brute_repeats([t for _, t in rows], 200), strict=True)}


def test_lm_query(spark, rows):
    got = {r.doc_id: r for r in queries.op4_suffix_lm(spark, SF).collect()}
    for d, out, n, known, total, base in base_scores(rows):
        assert tuple(got[d])[1:5] == (out, n, known, total)
        assert got[d].base_score == pytest.approx(base, abs=1e-6)


def test_token_queries(spark, rows):
    byte, word = (Tokenizer.from_file(P.path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    n_byte = {d: len(byte.encode(t, add_special_tokens=False).ids) for d, t in rows}
    assert {r.doc_id: r.n_tokens for r in queries.op2_token_counts(spark, SF).collect()} == n_byte
    n_word = {d: len(word.encode(t, add_special_tokens=False).ids) for d, t in rows}
    assert {r.doc_id: r.n_tokens for r in queries.op9_bpe_reuse(spark, SF).collect()} == n_word
    assert {r.doc_id: r.n_tokens - 1 for r in queries.op7_token_orc(spark, SF).collect()} == n_word


def test_leak_query_finds_copies(spark, rows):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    found = {(r.doc_id, r.item_id) for r in queries.op3_decontamination(spark, SF).collect()}
    whole = {(d, i) for d, t in rows for i, x in items.items() if x in t}
    assert whole <= found


def test_whitening_query(spark):
    table = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select(
        "vec_id", "embedding").collect()]
    kept, fit, values, vectors, trace = plain_whitening(table)
    got = {(r.vec_id, r.component): r for r in queries.op11_whitening(spark, SF).collect()}
    assert len(got) == 4 * len(kept)
    sums = [sum(c) for c in zip(*fit, strict=True)]
    centre = np.array(sums) / len(fit)
    want = (np.array([x for _, x in kept]) - centre) @ vectors / np.sqrt(values)
    have = np.array([[got[i, c].whitened for c in (1, 2, 3, 4)] for i, _ in kept])
    np.testing.assert_allclose(have, want * np.sign((have * want).sum(0)), atol=1e-9)
    for i, x in kept:
        r = got[i, 1]
        assert (r.n, r.deviation) == (len(fit), sum((len(fit) * v - s) ** 2
                                                    for v, s in zip(x, sums, strict=True)))
        assert r.explained == pytest.approx(values[0] / trace) and r.identity_error < 1e-9


def test_license_query(spark, rows):
    got = {r.doc_id: r for r in queries.op12_license_scan(spark, SF).collect()}
    for d, text in rows:
        n, at = plain_base(text)
        starts = [a for a, _ in at]
        r = got[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (
            n, len(at), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in at}))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}
        assert ("cc" in r.labels) == ("licensed under cc by-nc" in (text or "").lower())


def test_stages_of_odd_tables(spark, docs, empty):
    """No rows, and null ids, empty and repeated texts."""
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for table in (empty, docs):
        now = table.select(columns)
        for name, stage in corpus_pipeline.STAGES:
            out = corpus_pipeline.session.write_table(stage(spark, now, SF), name)
            if name != "bpe":
                assert out.columns == columns
                assert out.join(now, "doc_id", "left_anti").where("doc_id is not null").count() == 0
                assert table is docs or out.count() == 0
            else:
                assert out.count() == now.count()
            now = out
    decoded = bpe_reuse.decode(bpe_reuse.encode(empty, P.path("word_bpe_49k.json")),
                               P.path("word_bpe_49k.json"))
    assert decoded.collect() == []


def test_pipeline_stages(spark, rows):
    """Each stage's output against its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "bpe":
            assert out.columns == docs.columns
            out = corpus_pipeline.session.write_table(out, name)
        got[name] = (docs.collect(), out.collect())
        docs = out
    before, after = got["quality_rules"]
    kept = {r.doc_id for r in after}
    good = {r.doc_id for r in before if not measures(r.text)[5]}
    assert kept <= good and len(good - kept) <= 0.02 * len(good)
    before, after = got["near_duplicates"]
    want = brute_components([(r.doc_id, r.text) for r in before], 5)
    assert sorted(r.doc_id for r in after) == sorted(w[0] for w in want if w[3])
    before, after = got["decontamination"]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not [r for r in after if any(x in r.text for x in items)]
    assert len(after) > 0.9 * len(before)
    before, after = got["secret_scan"]
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before)
    assert not [r for r in after if base_spans(r.text) and "<secret>" not in r.text]
    before, after = got["bpe"]
    word = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    assert {r.doc_id: r.ids for r in after} == {
        r.doc_id: word.encode(r.text, add_special_tokens=False).ids for r in before}
    run = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.ids for r in run} == {r.doc_id: r.ids for r in after}
