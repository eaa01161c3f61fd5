"""Compare queries with their SQL twins; run as a script to see all of them.

    python tests/twins.py [data folder] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS FROM '{sf_dir}/{table}.parquet'")
    return con


def _cell(x):
    if isinstance(x, float) and math.isnan(x):
        return "NaN"
    return repr(x)


def normal(columns, rows):
    """Rows as sorted tuples of texts, columns in name order."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return (
        [columns[i] for i in order],
        sorted(tuple(_cell(r[i]) for i in order) for r in rows),
    )


def differences(spark, con, fn, sql, sf_dir) -> list[str]:
    df = fn(spark, sf_dir)
    got_cols, got = normal(df.columns, [tuple(r) for r in df.collect()])
    twin = con.sql(sql)
    want_cols, want = normal(twin.columns, twin.fetchall())
    problems = []
    if got_cols != want_cols:
        problems.append(f"columns {got_cols} != {want_cols}")
    if len(got) != len(want):
        problems.append(f"{len(got)} rows != {len(want)}")
    bad = [(g, w) for g, w in zip(got, want, strict=False) if g != w]
    if bad:
        problems.append(f"{len(bad)} rows differ, first: {bad[0]}")
    return problems


if __name__ == "__main__":
    import __spark_entry__ as entry
    from conftest import session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark, con = session(), connect(sf_dir)
    twins = entry.oracle_sql()
    failed = 0
    for name, fn in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            if name in twins:
                problems = differences(spark, con, fn, twins[name], sf_dir)
            else:
                problems = [] if fn(spark, sf_dir).count() >= 0 else ["?"]
        except Exception as e:  # noqa: BLE001 - report and go on
            problems = [f"{type(e).__name__}: {str(e)[:1500]}"]
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.2f}s", flush=True)
        for p in problems:
            print("     ", p[:2000])
    print("failed:", failed)
