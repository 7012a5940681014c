"""Runs registered queries next to their SQL counterparts and compares the rows.

``python tests/compare.py [sf_dir] [name ...]``
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

sys.path.insert(0, __file__.rsplit("/", 2)[0])


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    from geoloom.plans.views import TABLES
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def check(spark, con, sf_dir, fn, sql):
    """None when equal, else a short account of the difference."""
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None, len(got)
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    want = rows_of(cols, rel.fetchall())
    if sorted(df.columns) != sorted(cols):
        return f"columns {sorted(df.columns)} != {sorted(cols)}", len(got)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}", len(got)
    diff = [(g, w) for g, w in zip(got, want) if g != w]
    if diff:
        return f"{len(diff)} of {len(got)} differ, cols {sorted(cols)}, e.g. {diff[0]}", len(got)
    types = [(c, type(a).__name__, type(b).__name__) for c, a, b in zip(sorted(cols), got[0], want[0])
             if a is not None and b is not None and type(a) is not type(b)] if got else []
    return (f"types {types}" if types else None), len(got)


def main(argv):
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    import __spark_entry__ as entry
    from geoloom.session import build_session
    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    qs, oracles = entry.queries(), entry.oracle_sql()
    names = argv[1:] or list(qs)
    names = [n for n in qs if any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in names)]
    bad = 0
    for n in names:
        t = time.time()
        try:
            problem, count = check(spark, con, sf_dir, qs[n], oracles.get(n))
        except Exception as exc:  # report and go on
            problem, count = f"{type(exc).__name__}: {str(exc)[:700]}", -1
        bad += problem is not None
        print(f"{'BAD ' if problem else 'ok  '} {n:32s} {count:7d} rows {time.time() - t:6.2f}s "
              f"{'' if n in oracles else '(no sql)'} {problem or ''}", flush=True)
    print(f"{len(names)} checked, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
