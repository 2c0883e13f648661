"""Text sources and sinks.

Paths are any Hadoop path; scratch paths come from ``session.scratch_path``
(the shared checkpoint folder).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketry.functions.expressions import (WS, basket_canonical, drop_last, report_line,
                                            tokens_whitespace)
from basketry.operators.positions import chunk_size, with_positions
from basketry.session import write_table
from basketry.sources.baskets import BasketData, from_arrays

# Fixed value: the report line pattern read back by SRC-6.
REPORT_PATTERN = r"^(.*) \((\d+)\)$"


def scan_text(spark: SparkSession, path: str) -> DataFrame:
    """SRC-1: one row per line (LF, CRLF, CR), blank lines kept."""
    return spark.read.text(path)


def text_baskets(spark: SparkSession, path: str, first_file_only: bool = False) -> BasketData:
    """SRC-1 + P-3 + P-4: every line is a basket of whitespace tokens.

    The basket id is ``monotonically_increasing_id`` (unique, no shuffle);
    contiguous line numbers, when needed, come from ``line_numbers``.
    ``first_file_only`` reads only the first file of a directory (Q8).
    """
    if first_file_only:
        first = first_file(spark, path)
        if first is None:
            raise FileNotFoundError(path)
        path = first
    lines = scan_text(spark, path).select(
        F.monotonically_increasing_id().alias("basket"),
        tokens_whitespace("value").alias("items"))
    return from_arrays(lines, "basket", "items", tokens=True)


def line_numbers(df: DataFrame) -> DataFrame:
    """``df`` (a text scan) with ``line_no`` in file order: files by path,
    then lines as they stand.

    The lines of a split are contiguous and in order inside one partition of
    the scan.  A first scan, of no column, counts the lines of every split;
    prefix sums over the splits (one row each) give each its first number, and
    the second scan adds the place of the line in its split.  The text is
    neither sorted, nor shuffled, nor written.  Should the second scan be
    split in another way than the first, the job fails rather than number
    lines wrongly.
    """
    return _numbered(df, _line_counts(df))


def _places(df: DataFrame, *cols) -> DataFrame:
    return df.select(*cols, F.col("_metadata.file_path").alias("_file"),
                     F.col("_metadata.file_block_start").alias("_start"),
                     F.monotonically_increasing_id().alias("_row"))


def _line_counts(df: DataFrame) -> DataFrame:
    """``(_file, _start, _first, _n, _before)`` of every split: the row id of
    its first line, its lines, and the lines of all splits before it."""
    counts = _places(df).groupBy("_file", "_start").agg(
        F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # One row per split: the window below sees only that many.
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    return write_table(counts.select("*", F.coalesce(F.sum("_n").over(before), F.lit(0))
                                     .alias("_before")), "splits")


def _numbered(df: DataFrame, splits: DataFrame) -> DataFrame:
    placed = _places(df, "*").join(F.broadcast(splits), ["_file", "_start"], "left")
    place = F.col("_row") - F.col("_first")
    known = (place >= 0) & (place < F.col("_n"))
    return placed.select(*df.columns, F.when(known, F.col("_before") + place).otherwise(
        F.raise_error(F.lit("the text was split in another way than when its lines were counted"))
    ).alias("line_no"))


def first_file(spark: SparkSession, path: str) -> str | None:
    """SRC-2: the first file (by path) under ``path``; None when missing.

    Lists file paths only (``binaryFile`` without its content column), so
    no data is read.
    """
    try:
        files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
                 .load(path).select(F.min("path").alias("p")).first())
    except Exception as e:  # missing path
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return None
        raise
    return files["p"] if files else None


def scan_first_file(spark: SparkSession, path: str) -> DataFrame | None:
    f = first_file(spark, path)
    return None if f is None else spark.read.text(f)


def scan_whole_files(spark: SparkSession, path: str) -> DataFrame:
    """SRC-3: one record per file: ``(file_name, value)`` (whole text)."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("file_name"), "*")


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """SRC-4: lines ``items<TAB>count`` -> canonical item array (count dropped)."""
    t = tokens_whitespace("value")
    return scan_text(spark, path).select(basket_canonical(drop_last(t)).alias("items"))


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """SRC-5: lines ``itemset<TAB>count`` -> ``(itemset, freq)``."""
    s = F.split("value", "\t")
    return scan_text(spark, path).select(s[0].alias("itemset"),
                                         s[1].cast("bigint").alias("freq"))


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """SRC-6: report lines back to ``(itemset, freq)``; the header line does
    not match the pattern and is dropped."""
    lines = scan_text(spark, path).where(F.col("value").rlike(REPORT_PATTERN))
    return lines.select(F.regexp_extract("value", REPORT_PATTERN, 1).alias("itemset"),
                        F.regexp_extract("value", REPORT_PATTERN, 2).cast("bigint")
                        .alias("freq"))


def ingest(spark: SparkSession, src: str, dst: str) -> None:
    """SNK-1: copy an outside text dataset into the working store."""
    spark.read.text(src).write.mode("overwrite").text(dst)


def text_chunks(spark: SparkSession, path: str, chunks: int) -> DataFrame:
    """SRC-1 + WIN-1: the lines of a text dataset in file order, blank ones
    kept, in ``chunks`` contiguous chunks: ``(pos, chunk_id, value)``.  Two
    scans, no exchange of the text (see ``line_numbers``)."""
    lines = scan_text(spark, path)
    splits = _line_counts(lines)
    n = splits.agg(F.sum("_n")).first()[0] or 0
    return _numbered(lines, splits).select(
        F.col("line_no").alias("pos"),
        F.expr(f"line_no div {chunk_size(n, chunks)}").cast("bigint").alias("chunk_id"), "value")


def write_chunks(chunked_lines: DataFrame, dst: str, split: bool = True) -> None:
    """SNK-2: ``(chunk_id, value, pos)`` -> ``dst/chunk_id=<i>/``.  A chunk
    may take several tasks: lines are range-partitioned in order, so a
    chunk's part files in name order are its lines in order.  Without
    ``split`` a chunk is one file, written by one task."""
    dealt = (chunked_lines.repartitionByRange("chunk_id", "pos") if split
             else chunked_lines.repartition("chunk_id"))
    (dealt.sortWithinPartitions("chunk_id", "pos")
     .select("chunk_id", "value").write.mode("overwrite").partitionBy("chunk_id").text(dst))


def write_counts(itemsets: DataFrame, dst: str, count_col: str = "freq") -> None:
    """SNK-3: tab-separated ``itemset<TAB>count`` lines."""
    itemsets.select(F.concat_ws("\t", "itemset", F.col(count_col).cast("string"))
                    .alias("value")).write.mode("overwrite").text(dst)


def _report_order() -> list:
    return [F.col("freq").desc(), F.col("itemset").asc()]


def report_lines(itemsets: DataFrame) -> DataFrame:
    """SNK-4 / S-1 / P-10: ``(line_no, value)``: line 0 is the number of
    itemsets, then ``itemset (freq)`` by count desc, itemset asc.  Positions
    come from a distributed sort (no single-task window)."""
    ranked = with_positions(itemsets.select("itemset", "freq"), _report_order(), "pos")
    body = ranked.select((F.col("pos") + 1).alias("line_no"),
                         report_line("itemset", "freq").alias("value"))
    header = itemsets.agg(F.count(F.lit(1)).cast("string").alias("value")).select(
        F.lit(0).cast("bigint").alias("line_no"), "value")
    return header.unionByName(body)


def write_report(itemsets: DataFrame, dst: str) -> None:
    """SNK-4: the report as text, in order, across ordered part files (one
    global sort, no ``coalesce(1)``): reading the part files in name order
    gives the report."""
    body = itemsets.select(F.lit(1).alias("_body"), "freq", "itemset",
                           report_line("itemset", "freq").alias("value"))
    header = itemsets.agg(F.count(F.lit(1)).cast("string").alias("value")).select(
        F.lit(0).alias("_body"), F.lit(None).cast("bigint").alias("freq"),
        F.lit(None).cast("string").alias("itemset"), "value")
    (header.unionByName(body).orderBy("_body", *_report_order()).select("value")
     .write.mode("overwrite").text(dst))


__all__ = ["WS", "scan_text", "text_baskets", "line_numbers", "first_file",
           "scan_first_file", "scan_whole_files", "read_candidates", "read_counts",
           "read_report", "ingest", "text_chunks", "write_chunks", "write_counts", "report_lines",
           "write_report"]
