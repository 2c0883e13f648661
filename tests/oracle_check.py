"""Run registered queries on Spark and their oracle SQL on DuckDB and
compare rows as multisets (columns matched by name)."""

from __future__ import annotations

import datetime
import decimal

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings"
          " pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (int, decimal.Decimal)):
        return int(v)
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows),
                  key=lambda t: tuple((x is None, str(x)) for x in t))


def compare(spark, con, name, fn, sql_text, sf_dir):
    df = fn(spark, sf_dir)
    s_cols = df.columns
    s_rows = rows_of(s_cols, [tuple(r) for r in df.collect()])
    cur = con.execute(sql_text)
    d_cols = [c[0] for c in cur.description]
    d_rows = rows_of(d_cols, cur.fetchall())
    ok_cols = sorted(s_cols) == sorted(d_cols)
    ok = ok_cols and s_rows == d_rows
    info = f"{name}: spark {len(s_rows)} rows {sorted(s_cols)} / duckdb {len(d_rows)} {sorted(d_cols)}"
    if not ok and ok_cols:
        sa, da = set(s_rows), set(d_rows)
        info += f"\n  only spark: {list(sa - da)[:3]}\n  only duckdb: {list(da - sa)[:3]}"
    return ok, info
