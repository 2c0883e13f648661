"""Secret scans: patterns, plus random strings found by token efficiency.

Ordinary text packs several characters into a token of a public vocabulary;
a random string packs few.  A long run of key characters with a low
characters-per-token ratio is reported, unless it is a known digest length,
a UUID, a number or an identifier made of plain words.  Words are told by
their own characters per token, not by their shape.

One pass, no shuffle.  A vectorised byte scan finds the texts that hold a
long enough run, and a substring test those that hold a keyword; only they
reach the regular expressions, over their whole text.
"""

from __future__ import annotations

import base64
import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm import tasks

#: The base patterns and the least lengths of their matches.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
                    r"([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "random")

RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
DIGEST = re.compile(r"[0-9A-Fa-f]+")
#: Hex lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512.
DIGEST_LENGTHS = frozenset({32, 40, 56, 64, 96, 128})
LETTERS = re.compile(r"[A-Za-z]+")
IDENTIFIER = re.compile(r"[+/=_-]*([A-Za-z][a-z]*|[A-Z]+|[0-9]+)([+/=_-]+([A-Za-z][a-z]*|[A-Z]+|[0-9]+))*[+/=_-]*")


@dataclass(frozen=True)
class SecretLimits:
    """A run of ``min_run`` characters or more is random below
    ``max_chars_per_token`` characters per token."""
    min_run: int = 20
    max_chars_per_token: float = 2.2


_key_bytes = np.zeros(256, bool)
_key_bytes[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True


def load_encoding(path: str, pattern: str):
    """The tiktoken encoding of a rank file (kept by the worker)."""
    def make():
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    return tasks.model(("ranks", path, pattern), make)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the base patterns, sorted."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= MIN_HEX]
    return sorted(out)


def plain(run: str, encoding, least: float) -> bool:
    """Whether the letters of an identifier are words: each part and all
    together pack ``least`` characters per token, as written or in lower case
    after a blank.  A part of fewer letters than ``least`` is judged only with
    the others; a run without letters is a number."""
    parts = LETTERS.findall(run)
    tokens = [min(len(encoding.encode_ordinary(p)), len(encoding.encode_ordinary(" " + p.lower())))
              for p in parts]
    return (all(len(p) >= least * n for p, n in zip(parts, tokens, strict=True) if len(p) >= least)
            and sum(map(len, parts)) >= least * sum(tokens))


def known(run: str, encoding, least: float) -> bool:
    """Digests, UUIDs, numbers and identifiers of plain words."""
    return bool((DIGEST.fullmatch(run) and len(run) in DIGEST_LENGTHS) or UUID.fullmatch(run)
                or (IDENTIFIER.fullmatch(run) and plain(run, encoding, least)))


def _random(run: str, encoding, limits: SecretLimits) -> bool:
    return (len(run) < limits.max_chars_per_token * len(encoding.encode_ordinary(run))
            and not known(run, encoding, limits.max_chars_per_token))


def random_spans(text: str, encoding, limits: SecretLimits, taken) -> list[tuple[int, int, int]]:
    """Spans of kind random outside the sorted spans ``taken``; a run that
    holds some of them is cut there and its pieces judged as runs.  Runs and
    spans are walked together, both from left to right."""
    out, met, k = [], [], 0  # met: spans begun before the end of the run and not past it
    for m in RUN.finditer(text):
        if m.end() - m.start() < limits.min_run:
            continue
        while k < len(taken) and taken[k][0] < m.end():
            met.append((taken[k][0], taken[k][2]))
            k += 1
        met = [(a, b) for a, b in met if m.start() < b]
        at = m.start()
        for a, b in [*met, (m.end(), m.end())]:  # what the base spans leave of the run
            if a - at >= limits.min_run and _random(text[at:a], encoding, limits):
                out.append((at, 3, a))
            at = max(at, b)
    return out


def suspects(data: np.ndarray, off: np.ndarray, least: int) -> np.ndarray:
    """Rows that may hold a run of ``least`` key bytes (a superset)."""
    breaks = np.concatenate([[-1], np.flatnonzero(~_key_bytes[data]), [len(data)]])
    long = np.flatnonzero(np.diff(breaks) > least)
    hit = np.zeros(len(off) - 1, bool)
    first = np.searchsorted(off, breaks[long] + 1, side="right") - 1
    last = np.searchsorted(off, breaks[long + 1], side="left") - 1
    for a, b in zip(first, last, strict=True):
        hit[max(a, 0):b + 1] = True
    return hit


def find_spans(text: str, runs: bool, encoding, limits: SecretLimits):
    """Base spans and added spans of one text."""
    low = text.lower()
    if not runs and not any(k in low for k in KEYWORDS):
        return [], []
    base = base_spans(text)
    return base, random_spans(text, encoding(), limits, base) if runs else []


def _label(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def _scan(batches, rank_path, pattern, limits, row):
    least = min(limits.min_run, MIN_ACCESS, MIN_HEX)
    encoding = lambda: load_encoding(rank_path, pattern)
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text"))
        for i, j, data, off in tasks.sliced_texts(batch):
            runs = suspects(data, off, least)
            found = []
            for k, text in enumerate(texts.slice(i, j - i).to_pylist()):
                found.append(row(text, *(([], []) if not text else
                                         find_spans(text, runs[k], encoding, limits))))
            yield batch.slice(i, j - i), found


def scan(docs: DataFrame, rank_path: str, pattern: str, limits: SecretLimits = SecretLimits(),
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans)``,
    one row per input row; positions are code points, ends exclusive.

    A null or empty text has no span (``spans`` is '' and ``base_sha256`` the
    digest of ''); repeated rows and null ids are kept; an empty table gives
    an empty result; other columns are ignored.  A text of any length is
    scanned whole, in time linear in its runs and spans.
    """
    tasks.prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def row(text, base, added):
        n = [sum(k == want for _, k, _ in base) for want in (0, 1, 2)]
        return (*n, len(added), hashlib.sha256(_label(base).encode()).hexdigest(),
                _label(base + added))

    names = ["n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"]
    types = [pa.int64()] * 4 + [pa.string()] * 2

    def run(batches):
        for part, found in _scan(batches, rank_path, pattern, limits, row):
            cols = [pa.array([x[k] for x in found], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([part.column(0), *cols], ["doc_id", *names])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, n_random bigint, "
             "base_sha256 string, spans string")


def redact(docs: DataFrame, rank_path: str, pattern: str, limits: SecretLimits = SecretLimits(),
           text_col: str = "text", chars_col: str | None = "n_chars",
           mask: str = "<secret>") -> DataFrame:
    """All documents and columns, every span (overlapping ones as one)
    replaced by ``mask`` and ``chars_col`` recomputed where one was.

    Null and empty texts, and texts without a span, stay as they are; null ids
    and repeated rows are kept; an empty table stays empty; a text of any
    length is scanned whole; columns of any name are carried along.
    """
    tasks.prepare(docs.sparkSession)
    cols = docs.columns

    def row(text, base, added):
        if not base and not added:
            return None
        out, at = [], 0
        for a, _, b in sorted(base + added):
            if a >= at:
                out += [text[at:a], mask]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def run(batches):
        for part, found in _scan(batches, rank_path, pattern, limits, row):
            new = pa.array(found, pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], part.columns[-1], new],
                                             ["row", "text", "masked"])

    packed = docs.select(F.struct(*[F.col(c) for c in cols if c != text_col]).alias("row")
                         if len(cols) > 1 else F.struct(F.lit(0).alias("_")).alias("row"),
                         F.col(text_col).alias("text"))
    rows = packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, "
                                  "text string, masked string")
    hit = F.col("masked").isNotNull()
    out = []
    for c in cols:
        if c == text_col:
            out.append(F.coalesce("masked", "text").alias(c))
        elif c == chars_col:
            out.append(F.when(hit, F.char_length("masked").cast(docs.schema[c].dataType))
                       .otherwise(F.col(f"row.`{c}`")).alias(c))
        else:
            out.append(F.col(f"row.`{c}`").alias(c))
    return rows.select(*out)
