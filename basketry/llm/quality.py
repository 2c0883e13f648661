"""Quality rules by cross-document line frequency (DataFrame functions only).

Lines are normalised and hashed; a line that stands in more than a share of
a host's distinct documents (and in a least number of them) is boilerplate.
Boilerplate lines are removed, and a document that keeps too small a share of
its words is rejected.  Exact copies of a text count as one document of their
host, so a copied document is not taken for boilerplate.

Plan: one pass over the texts hashes lines; copies collapse in a partial
aggregate by (host, text hash), line counts in another by (host, line), so
hot hosts and lines are one row per map task.  At most ``lines per document /
max_share`` lines of a host can pass the limit, so they fit one row per host;
that table is written to the shared folder, which gives the join its real
size.  Everything else is computed inside each document's row, so texts are
never shuffled unless the host table is too large to broadcast (then AQE
splits hot hosts).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry import session

#: White space between words, and symbol characters.
BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5


@dataclass(frozen=True)
class QualityLimits:
    """Production limits.

    min_words, max_repeat_pct: base rules.  A line is boilerplate above
    ``max(min_line_docs, max_line_share * documents of the host)`` distinct
    documents; a document is depleted when it keeps fewer than
    ``min_kept_share`` of its words, or none.
    """
    min_words: int = 10
    max_repeat_pct: int = 20
    min_line_docs: int = 20
    max_line_share: float = 0.1
    min_kept_share: float = 0.3


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS), "")


def normal_line(line: Column) -> Column:
    """A line for comparison: A-Z lowered, digits as 0, blanks collapsed."""
    lowered = F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789",
                          "abcdefghijklmnopqrstuvwxyz000000000")
    return F.trim(F.regexp_replace(lowered, BLANKS, " "))


def _line_hashes(text: Column) -> Column:
    """One hash per line of the text, null for lines without a word."""
    return F.transform(F.split(text, "\n"), lambda x: F.when(
        normal_line(x) != "", F.xxhash64(normal_line(x))))


def boilerplate(docs: DataFrame, limits: QualityLimits, text_col: str = "text",
                host_col: str = "source") -> DataFrame:
    """``(_host, _frequent ARRAY<BIGINT>)``: hashes of each host's lines above
    the limits; hosts without any are absent.  A null host is host ''."""
    texts = docs.select(F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("_host"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    lines = texts.select(
        "_host", F.xxhash64("_text").alias("_t"), F.length("_text").alias("_len"),
        F.array_distinct(F.array_compact(_line_hashes(F.col("_text")))).alias("_lines"))
    distinct = lines.groupBy("_host", "_t", "_len").agg(F.first("_lines").alias("_lines"))
    hosts = distinct.groupBy("_host").agg(F.count(F.lit(1)).alias("_docs"))
    counts = (distinct.select("_host", F.explode("_lines").alias("_line"))
              .groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_n"))
              .where(F.col("_n") > limits.min_line_docs))
    over = counts.join(hosts, "_host").where(
        F.col("_n") > F.lit(limits.max_line_share) * F.col("_docs"))
    return over.groupBy("_host").agg(F.sort_array(F.collect_list("_line")).alias("_frequent"))


def measured(docs: DataFrame, limits: QualityLimits = QualityLimits(), text_col: str = "text",
             host_col: str = "source") -> DataFrame:
    """``(row, q, at)``: each input row as a struct, whatever its columns are
    called, its number, and its measures: n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words (BIGINT), base_failed, removed_words (BIGINT), kept
    (BOOLEAN), kept_text (the text without boilerplate lines).

    Null and empty texts have no words and fail the base rule; equal rows get
    equal values; an empty table stays empty.
    """
    frequent = session.write_table(boilerplate(docs, limits, text_col, host_col), "boilerplate")
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_in")).select(
        "_in", F.coalesce(F.col(f"_in.{host_col}").cast("string"), F.lit("")).alias("_host"),
        F.coalesce(F.col(f"_in.{text_col}"), F.lit("")).alias("_text"))
    rows = rows.join(frequent, "_host", "left")
    rows = rows.select("*", _words(F.col("_text")).alias("_w"), F.split("_text", "\n").alias("_l"))
    rows = rows.select("*", F.size("_w").alias("_n"),
                       F.filter("_l", lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))).alias("_ll"))
    # One 64-bit hash per window; within one text a false repeat needs a
    # collision among its own windows.
    grams = F.when(F.col("_n") > WINDOW, F.transform(
        F.expr(f"slice(_w, 1, _n - {WINDOW - 1})"),
        lambda x, i: F.xxhash64(x, *[F.get(F.col("_w"), i + k) for k in range(1, WINDOW)])))
    rows = rows.select("*", grams.alias("_g"))
    pairs = F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.sort_array(F.transform(
        "_g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    rows = rows.select("*", pairs.alias("_p"))
    twice = F.filter("_p", lambda x, k: F.coalesce(
        x["h"] == F.get(F.col("_p"), k - 1)["h"], F.lit(False)) | F.coalesce(
        x["h"] == F.get(F.col("_p"), k + 1)["h"], F.lit(False)))
    rows = rows.select("*", F.sort_array(F.transform(twice, lambda x: x["i"])).alias("_r"))
    # Words covered: each repeated window adds what the one before left open.
    covered = F.aggregate(
        "_r", F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).alias("n")),
        lambda a, i: F.struct(i.alias("at"), (a["n"] + F.least(F.lit(WINDOW), i - a["at"])).alias("n")),
        lambda a: a["n"])
    rows = rows.select("*", F.coalesce(covered, F.lit(0)).cast("bigint").alias("_rep"))
    keep_line = lambda x: ~F.coalesce(F.array_contains(
        F.col("_frequent"), F.xxhash64(normal_line(x))) & (normal_line(x) != ""), F.lit(False))
    rows = rows.select("*", F.when(F.col("_frequent").isNull(), F.col("_text")).otherwise(
        F.array_join(F.filter("_l", keep_line), "\n")).alias("_kept"))
    rows = rows.select("*", F.when(F.col("_frequent").isNull(), F.col("_n")).otherwise(
        F.size(_words(F.col("_kept")))).alias("_kw"))
    failed = (F.col("_n") < limits.min_words) | (
        100 * F.col("_rep") > limits.max_repeat_pct * F.col("_n"))
    left = (F.col("_kw") > 0) & (F.col("_kw") >= F.lit(limits.min_kept_share) * F.col("_n"))
    q = F.struct(
        F.col("_n").cast("bigint").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        (F.size("_ll") - F.size(F.array_distinct("_ll"))).cast("bigint").alias("n_dup_lines"),
        F.col("_rep").alias("n_repeat_words"), failed.alias("base_failed"),
        (F.col("_n") - F.col("_kw")).cast("bigint").alias("removed_words"),
        (~failed & left).alias("kept"), F.col("_kept").alias("kept_text"))
    # The row number keeps filters on the measures above them: pushed down,
    # they would repeat the whole computation inside one expression.
    return rows.select(F.col("_in").alias("row"), q.alias("q"),
                       F.monotonically_increasing_id().alias("at"))


def judge(docs: DataFrame, limits: QualityLimits = QualityLimits(), id_col: str = "doc_id",
          text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per document: its id, the base measures and ``kept``."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                         F.col(host_col).alias("source"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
             "base_failed", "kept", "removed_words"]
    return measured(narrow, limits).select("row.doc_id", *[F.col(f"q.{n}") for n in names])


def clean(docs: DataFrame, limits: QualityLimits = QualityLimits(), text_col: str = "text",
          host_col: str = "source", chars_col: str | None = "n_chars") -> DataFrame:
    """The kept documents, all columns, boilerplate lines removed from the
    text (and ``chars_col`` recomputed where a line went).

    Null and empty texts have no words and go; a null host is the host '';
    null ids and repeated rows are judged each; an empty table stays empty; a
    text of any length is judged whole; columns of any name are carried along.
    """
    rows = measured(docs, limits, text_col, host_col).where(
        F.col("q.kept") & (F.col("at") >= 0))  # reading the number keeps it in the plan
    gone = F.col("q.removed_words") > 0
    out = []
    for c in docs.columns:
        value = F.col(f"row.`{c}`")
        if c == text_col:
            value = F.when(gone, F.col("q.kept_text")).otherwise(value)
        elif c == chars_col:
            value = F.when(gone, F.char_length("q.kept_text").cast(
                docs.schema[c].dataType)).otherwise(value)
        out.append(value.alias(c))
    return rows.select(*out)
