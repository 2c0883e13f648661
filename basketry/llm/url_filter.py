"""URL filters as a sort-merge range join.

A rule ``host/path`` fits a host and its subdomains when the path starts with
the rule's.  Its canonical key is the host's labels in reverse order, a mark,
then the path, so the rule covers exactly the interval of keys that begin
with it.  A url gives one key for each of its host's ancestors that has as
many labels as some rule.  Rules and url keys are sorted together, and one
sweep keeps the stack of rules whose interval is open; the top of the stack
is the longest match.

Scale: distinct (host, path) pairs are swept, so a hot url is one row after
the partial aggregate.  Keys are range-partitioned by splitters from a sample
of bounded size; a rule is copied to the partitions its interval meets, at
most its nesting depth more than once per splitter.  Rules are never
broadcast or collected.
"""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry import session
from basketry.llm import tasks

#: Keys sampled for the splitters: at most this many reach the driver.
SAMPLE_KEYS = 20_000
LABEL, PATH = "\x01", "\x02"  # order below all printable characters
ALLOW, BLOCK = "allow", "block"


def _after_scheme(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    return F.get(F.split(url, "://", 2), 1)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; '' without ``://``."""
    host = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                                  "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; '' without ``://``."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*(/[^?#]*)", 1), F.lit(""))


def _reversed(labels: Column) -> Column:
    return F.array_join(F.reverse(labels), LABEL)


def _text_order(x: str) -> bytes:
    return x.encode("utf-8", "surrogatepass")


def sweep(rows):
    """``rows`` of ``(key, is_url, payload)`` in key order, rules before urls
    of the same key; yields ``(payload of url, payload of longest rule)`` for
    urls under an open rule."""
    stack: list[tuple[str, object]] = []
    for key, is_url, payload in rows:
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        if not is_url:
            stack.append((key, payload))
        elif stack:
            yield payload, [p for _, p in stack]


def match_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """``hosts(host, path)`` (distinct) with the longest fitting rule of
    ``rules(verdict, host, path)``: ``(host, path, rule, verdict)``; pairs
    that no rule fits are absent.

    Longest is the rule text's length; ties go to the longer host, then to
    block.  Null parts of a rule count as ''; a rule with an empty host fits
    nothing; equal rules count once.
    """
    spark = hosts.sparkSession
    tasks.prepare(spark)
    low = F.translate(F.coalesce("host", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                      "abcdefghijklmnopqrstuvwxyz")
    r = rules.select(low.alias("host"), F.coalesce("path", F.lit("")).alias("path"),
                     "verdict").where("host <> ''")
    r = r.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block > allow
    r = r.select(F.split("host", r"\.").alias("labels"), "host", "path", "verdict")
    r = session.write_table(r.select(
        F.concat(_reversed(F.col("labels")), F.lit(PATH), "path").alias("key"),
        F.concat("host", "path").alias("rule"), F.char_length("host").alias("host_len"),
        "verdict", F.size("labels").alias("depth")), "url-rules")
    # Label counts of the rules: a handful of numbers.
    depths = sorted(x.depth for x in r.select("depth").distinct().collect())

    u = hosts.where("host <> ''").select(
        "host", "path", F.split("host", r"\.").alias("labels"))
    u = u.select("host", "path", "labels", F.explode(F.filter(
        F.array(*[F.lit(d) for d in depths]).cast("array<int>"),
        lambda d: d <= F.size("labels"))).alias("d"))
    u = session.write_table(u.select("host", "path", F.concat(
        _reversed(F.expr("slice(labels, size(labels) - d + 1, d)")),
        F.lit(PATH), "path").alias("key")), "url-keys")

    n = u.count()
    share = min(1.0, SAMPLE_KEYS / max(1, 2 * n))
    sample = sorted((x.key for x in u.select("key").sample(share, seed=7).limit(SAMPLE_KEYS)
                     .collect()), key=_text_order)
    parts = max(1, session.shuffle_partitions(spark))
    cuts = sorted({sample[len(sample) * k // parts] for k in range(1, parts)} if sample else set(),
                  key=_text_order)
    order = [_text_order(c) for c in cuts]

    def place_urls(batches):
        for b in batches:
            at = [bisect.bisect_right(order, _text_order(k)) for k in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int32())],
                                             ["host", "path", "key", "part"])

    def place_rules(batches):
        for b in batches:
            rows = []
            for x in b.to_pylist():
                k = _text_order(x["key"])
                i = bisect.bisect_right(order, k)
                rows.append(x | {"part": i})
                while i < len(order) and order[i].startswith(k):  # the interval goes on
                    i += 1
                    rows.append(x | {"part": i})
            yield pa.RecordBatch.from_pylist(rows, schema=rule_schema)

    rule_schema = pa.schema([("key", pa.string()), ("rule", pa.string()), ("host_len", pa.int32()),
                             ("verdict", pa.string()), ("part", pa.int32())])
    pu = u.mapInArrow(place_urls, "host string, path string, key string, part int")
    pr = r.select("key", "rule", "host_len", "verdict").mapInArrow(
        place_rules, "key string, rule string, host_len int, verdict string, part int")
    both = pu.select("part", "key", F.lit(1).alias("is_url"), "host", "path",
                     F.lit(None).cast("string").alias("rule"),
                     F.lit(None).cast("int").alias("host_len"),
                     F.lit(None).cast("string").alias("verdict")).unionByName(
        pr.select("part", "key", F.lit(0).alias("is_url"), F.lit(None).cast("string").alias("host"),
                  F.lit(None).cast("string").alias("path"), "rule", "host_len", "verdict"))
    # Range on part keeps a partition's keys together; equal keys never split.
    both = both.repartitionByRange(parts, "part").sortWithinPartitions("part", "key", "is_url")

    def run(batches):
        def stream():
            for b in batches:
                for x in b.to_pylist():
                    # the part leads the key, so rules close with their part
                    yield f"{x['part']}{PATH}{x['key']}", x["is_url"], x
        out: list[tuple] = []

        def batch():
            return pa.RecordBatch.from_arrays(
                [pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names)

        for url, open_rules in sweep(stream()):
            best = open_rules[-1]  # the innermost rule is the longest of this host
            out.append((url["host"], url["path"], best["rule"], best["host_len"], best["verdict"]))
            if len(out) >= 8192:
                yield batch()
                out.clear()
        yield batch()

    names = ["host", "path", "rule", "host_len", "verdict"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()]
    found = both.mapInArrow(run, "host string, path string, rule string, host_len int, verdict string")
    best = F.max(F.struct(F.char_length("rule"), "host_len", "verdict", "rule")).alias("b")
    return found.groupBy("host", "path").agg(best).select(
        "host", "path", F.col("b.rule").alias("rule"), F.col("b.verdict").alias("verdict"))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = ALLOW, id_col: str = "page_id",
               url_col: str = "url") -> DataFrame:
    """``(page_id, host, path, rule, verdict)``, one row per input row.

    A null url, or one without ``://``, has empty host and path.  Where no
    rule fits, ``rule`` is null and ``verdict`` is ``default``.  Repeated
    rows and null ids are kept; urls of any length are taken whole; an empty
    table of pages gives an empty result, one of rules fits nothing; other
    columns are ignored.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"),
                        path_of(F.col(url_col)).alias("path"))
    found = match_rules(rows.select("host", "path").distinct(), rules)
    out = rows.join(found, ["host", "path"], "left")
    return out.select("page_id", "host", "path", "rule",
                      F.coalesce("verdict", F.lit(default)).alias("verdict"))
