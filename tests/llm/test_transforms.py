"""Whitening, license scans and the fill-in-the-middle transformation."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from basketry.llm import fill_middle, licenses, whitening

# -- whitening ------------------------------------------------------------------


def plain_whitening(rows, want=4):
    """Integer rows, fit list, eigenvalues and vectors with numpy."""
    kept = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(x) for _, x in kept), default=0)
    kept = [(i, x + [0] * (width - len(x))) for i, x in kept]
    fit = sorted({tuple(x) for _, x in kept})
    a = np.array(fit, float) - np.mean(np.array(fit, float), 0)
    values, vectors = np.linalg.eigh(a.T @ a / len(fit))
    return kept, fit, values[::-1][:want], vectors[:, ::-1][:, :want], values.sum()


def check_whitening(spark, rows, block=None):
    df = spark.createDataFrame([(i, v, 1, "r") for i, v in rows],
                               "vec_id bigint, embedding array<float>, x int, component string")
    got = whitening.whiten(df.repartition(3), block=block).collect()
    rows = [(i, None if v is None else [None if c is None else np.float32(c) for c in v])
            for i, v in rows]
    kept, fit, values, vectors, trace = plain_whitening(rows)
    r = int((values > 1e-9 * values[0]).sum())
    assert len(got) == len(kept) * r
    n, sums = len(fit), np.sum(np.array(fit, object), 0)
    by_id = {}
    for g in got:
        by_id.setdefault(g["vec_id"], []).append(g)
    cols = []
    for i, x in kept:
        mine = [g for g in by_id[i]]
        dev = sum((n * v - int(s)) ** 2 for v, s in zip(x, sums, strict=True))
        assert any(g["deviation"] == (dev if dev < 2 ** 63 else None) for g in mine)
        assert {g["component"] for g in mine} == set(range(1, r + 1))
    first = {(g["vec_id"], g["component"]): g for g in got}
    for c in range(1, r + 1):
        some = first[kept[0][0], c]
        assert some["n"] == n and some["identity_error"] < 1e-9
        assert some["explained"] == pytest.approx(values[c - 1] / trace, rel=1e-9)
        cols.append([first[i, c]["whitened"] for i, _ in kept])
    return kept, fit, values[:r], vectors[:, :r], np.array(cols).T


def test_whitening_matches_numpy(spark):
    rnd = np.random.default_rng(3)
    base = rnd.standard_normal((60, 12)) * np.linspace(3, 0.2, 12)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(100 + i, rows[0][1]) for i in range(40)]            # a hot vector
    rows += [(200, None), (201, [1.0, None]), (202, [float("nan")] * 12),
             (203, [float("inf")] * 12), (204, [0.5]), (205, []), (None, rows[1][1])]
    for block in (None, 1, 2):
        kept, fit, values, vectors, white = check_whitening(spark, rows, block)
        a = np.array([x for _, x in kept], float) - np.mean(np.array(fit, float), 0)
        want = a @ vectors / np.sqrt(values)
        sign = np.sign((white * want).sum(0))
        np.testing.assert_allclose(white, want * sign, atol=1e-9)


@pytest.mark.parametrize("block", [None, 1])
def test_whitening_of_equal_eigenvalues(spark, block):
    """Ties: any orthonormal base of the shared space is right."""
    d = 6
    rows = [(2 * i + s, [float((j == i) * (1 - 2 * s)) for j in range(d)])
            for i in range(d) for s in (0, 1)]
    kept, fit, values, vectors, white = check_whitening(spark, rows, block)
    np.testing.assert_allclose(values, values[0], rtol=1e-12)
    np.testing.assert_allclose(white.T @ white / len(fit), np.eye(4), atol=1e-9)


def test_whitening_of_few_directions(spark):
    rows = [(i, [float(i), 2.0 * i, 1.0]) for i in range(8)]
    kept, fit, values, vectors, white = check_whitening(spark, rows)
    assert white.shape[1] == 1


def test_whitening_without_variance(spark):
    schema = "vec_id bigint, embedding array<float>"
    for rows in ([], [(1, [1.0, 2.0])] * 3, [(1, None)], [(1, [])]):
        assert whitening.whiten(spark.createDataFrame(rows, schema)).collect() == []


def test_whitening_of_great_entries(spark):
    """Sums beyond a long are exact; a deviation beyond one is null."""
    rows = [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 2.0])]
    check_whitening_rows = whitening.whiten(spark.createDataFrame(
        rows, "vec_id bigint, embedding array<double>")).collect()
    assert check_whitening_rows and all(r["deviation"] is None or r["deviation"] >= 0
                                        for r in check_whitening_rows)
    assert whitening.deviations(np.array([[2 ** 62, 0], [-2 ** 62, 5]]), 2, [0, 5]) == [None, None]
    assert whitening.deviations(np.array([[3, 1]]), 2, [4, 4]) == [4 + 4]


# -- license scans -----------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_base(text):
    words = WORD.findall(lower(text))
    at = []
    for phrase, label in licenses.PHRASES:
        p = phrase.split(" ")
        at += [(i, label) for i in range(len(words)) if words[i:i + len(p)] == p]
    return len(words), at


def least_errors(notice, text):
    """Errors of the best passage: edit distance with free ends (bytes)."""
    a, b = notice.encode(), (" " + " ".join(WORD.findall(lower(text))) + " ").encode()
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def edited(rnd, text, n):
    for _ in range(n):
        i = rnd.randrange(1, len(text) - 1)
        text = rnd.choice([text[:i] + rnd.choice("abcxyz") + text[i + 1:], text[:i] + text[i + 1:],
                           text[:i] + rnd.choice("abcxyz") + text[i:]])
    return text


def test_licenses_match_brute_force(spark):
    rnd = random.Random(11)
    filler = "Die Lizenz der license von mit general public ville ätna apache licenses".split()
    texts = [None, "", " \n", "MIT License", "the mit\n*license mit license", "mit licenses",
             "GENERAL-PUBLIC, License", "apache  license mit license"]
    for text, _ in licenses.NOTICES:
        for n in (0, 1, 2, 4, 6, 9):
            pad = " ".join(rnd.choice(filler) for _ in range(rnd.randint(0, 12)))
            body = edited(rnd, text, n).replace(" ", rnd.choice([" ", ", ", "\n// "]))
            texts.append(f"{pad}. {body.upper() if rnd.random() < .3 else body} — {pad}")
    rows = [(i, t, i, "l") for i, t in enumerate(texts)] + [(None, texts[3], 1, "l"), (3, texts[3], 1, "l")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_words int, labels string")
    got = licenses.scan(df.repartition(3)).collect()
    assert len(got) == len(rows)
    seen = {r["doc_id"]: r for r in got}
    for i, text in enumerate(texts):
        r = seen[i]
        n, at = plain_base(text)
        starts = [a for a, _ in at]
        assert (r["n_words"], r["n_base"]) == (n, len(at))
        assert (r["first_word"], r["last_word"]) == ((min(starts), max(starts)) if at else (None, None))
        base = {label for _, label in at}
        assert r["base_labels"] == ",".join(sorted(base))
        best, labels = 1.0 if at else 0.0, set(base)
        for notice in licenses.notices():
            errors = least_errors(notice.text, text)
            if errors <= notice.errors:
                labels.add(notice.label)
        assert r["labels"] == ",".join(sorted(labels)), text
        assert 0.0 <= r["score"] <= 1.0 and (r["score"] > 0) == bool(labels) and r["score"] >= best
        for span in filter(None, r["spans"].split(",")):
            label, a, b, errors = span.split(":")
            notice = [x for x in licenses.notices() if x.label == label
                      and least_errors(x.text, text[int(a):int(b)]) <= int(errors) <= x.errors]
            assert notice, (span, text)
    assert licenses.scan(df.limit(0)).collect() == []


def test_license_in_a_long_text(spark):
    """A text of more than one step, with a notice across its middle."""
    text = "wort " * 900_000 + licenses.NOTICES[1][0] + " ende" * 400_000 + " MIT license"
    assert len(text) > 4 << 20
    r, = licenses.scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).collect()
    at = text.index(licenses.NOTICES[1][0])
    assert r["spans"] == f"mit:{at}:{at + len(licenses.NOTICES[1][0])}:0"
    assert (r["n_base"], r["first_word"], r["n_words"]) == (1, r["n_words"] - 2, len(text.split()))


# -- fill in the middle ---------------------------------------------------------------

def plain_fim(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(tokens)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k:k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(tokens[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    if not text or h[2] % 100 >= 90 or any(s in text for s in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_fill_middle_matches_brute_force(spark, docs, texts):
    extra = ["a<P>b", "<S>", "x <M", "P><S", "é", "日本 a", "< M >", "w" * 200_000, "é " * 150_000]
    more = spark.createDataFrame([(1000 + i, t, "en", "h", 1, 1, "a", "b")
                                  for i, t in enumerate(extra * 6)], docs.schema)
    rows = docs.unionByName(more)
    out = fill_middle.transform(rows).collect()
    want = [(r["doc_id"], *plain_fim(r["doc_id"], r["text"])) for r in rows.collect()]
    assert sorted(map(tuple, out), key=repr) == sorted(want, key=repr)
    assert {r["form"] for r in out} == {"plain", "psm", "spm"}
    clash = fill_middle.restore(fill_middle.transform(rows).withColumn("row", fill_middle.F.lit(1))
                                .withColumn("restored", fill_middle.F.lit("old")))
    assert sorted(r["restored"] for r in clash.collect()) == sorted(
        r["text"] or "" for r in rows.collect())
    assert fill_middle.restore(clash.limit(0)).collect() == []
    assert fill_middle.digests(docs.limit(0)).collect() == []


def test_rotation_in_blocks(monkeypatch):
    monkeypatch.setattr(fill_middle, "BLOCK", 3)
    rnd = random.Random(2)
    for _ in range(200):
        text = bytes(rnd.randrange(97, 123) for _ in range(rnd.randint(0, 40)))
        a, b = sorted((rnd.randint(0, len(text)), rnd.randint(0, len(text))))
        buffer = bytearray(b"##" + text + b"#")
        fill_middle.rotate(buffer, 2, 2 + a, 2 + b)
        assert bytes(buffer) == b"##" + text[a:b] + text[:a] + text[b:] + b"#"
        for form in ("plain", "psm", "spm"):
            assert fill_middle.rebuild(fill_middle.arrange(text, a, b, form), form) == text


def test_fill_middle_of_a_long_text(spark):
    text = "Ünter dem Baum, 12 x " * 260_000
    assert len(text.encode()) > 4 << 20
    rows = spark.createDataFrame([(i, text) for i in range(4)], "doc_id bigint, text string")
    got = fill_middle.restore(fill_middle.transform(rows)).collect()
    assert all(r["restored"] == text and tuple(r)[1:6] == plain_fim(r["doc_id"], text) for r in got)
