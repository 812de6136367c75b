"""Runs registered queries against their SQL: python tests/oracle_check.py [sf_dir] [name ...]"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, bool) or v is None:
        return repr(v)
    if hasattr(v, "tzinfo") and v.tzinfo is not None:
        v = v.replace(tzinfo=None)
    return str(v)


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    got = df.collect()
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    want = res.fetchall()
    if sorted(df.columns) != sorted(cols):
        return f"columns {sorted(df.columns)} != {sorted(cols)}", len(got)
    a, b = bag(df.columns, got), bag(cols, want)
    if a != b:
        extra, lack = list((a - b).items())[:3], list((b - a).items())[:3]
        return f"rows {len(got)} vs {len(want)}; spark-only {sum((a - b).values())} {extra}; sql-only {lack}", len(got)
    return None, len(got)


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def main():
    import __spark_entry__ as entry
    from tests.conftest import make_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark, con, sqls = make_session(), connect(sf), entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if names and name not in names:
            continue
        t = time.time()
        try:
            if name in sqls:
                err, n = compare(spark, con, fn, sqls[name], sf)
            else:
                err, n = None, fn(spark, sf).count()
        except Exception as e:  # noqa: BLE001
            err, n = f"{type(e).__name__}: {str(e)[:700]}", -1
        bad += err is not None
        tag = "FAIL" if err else ("ok" if name in sqls else "rows")
        print(f"{tag:4} {time.time() - t:6.2f}s {n:8d} {name} {err or ''}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
