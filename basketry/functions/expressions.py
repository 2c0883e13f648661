"""Column expressions (scalar functions of SURVEY §2.2).

All of them are built-in Spark expressions, so they stay inside whole-stage
codegen; none is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace class of the basket tokenizer (space, tab,
# line feed, carriage return, form feed) and the report line format.
WS = r"[ \t\n\r\f]+"
REPORT_FORMAT = "%s (%d)"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def split_lines(text, keep_trailing: bool = False) -> Column:
    """P-1: the lines of a text, trailing empty lines dropped (array)."""
    t = _c(text)
    if not keep_trailing:
        t = F.regexp_replace(t, r"\n+$", "")
    return F.split(t, "\n")


def tokens_single_space(line) -> Column:
    """P-2: split on one space; inner empties kept, trailing ones dropped."""
    return F.split(F.regexp_replace(_c(line), " +$", ""), " ")


def tokens_whitespace(line) -> Column:
    """P-3: split on runs of whitespace, empty tokens skipped."""
    return F.array_remove(F.split(_c(line), WS), "")


def basket_canonical(tokens) -> Column:
    """P-4: distinct, sorted items."""
    return F.sort_array(F.array_distinct(_c(tokens)))


def itemset_key(items) -> Column:
    """P-5: the itemset text: items sorted and joined by one space."""
    return F.concat_ws(" ", F.sort_array(_c(items)))


def itemset_prefix(items) -> Column:
    """P-6: all items but the last."""
    i = _c(items)
    return F.slice(i, 1, F.size(i) - 1)


def itemset_last(items) -> Column:
    """P-6: the last item."""
    return F.element_at(_c(items), -1)


def drop_last(tokens) -> Column:
    """P-8: drop the last token (the count column of a read-back line)."""
    t = _c(tokens)
    return F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0)))


def report_line(itemset, freq) -> Column:
    """P-10: ``items (count)``."""
    return F.format_string(REPORT_FORMAT, _c(itemset), _c(freq))
