"""Compare registered queries with their SQL: names, row counts and every value.

Run as a script for a report:  python tests/oracle.py [sf_dir] [query ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float) and v == 0:
        return 0.0
    if isinstance(v, dt.datetime) and v.tzinfo is not None:
        return v.replace(tzinfo=None)
    return v


def _kind(v) -> str:
    return "number" if isinstance(v, (int, float)) and not isinstance(v, bool) else type(v).__name__


def compare(spark_df, con, sql: str) -> str | None:
    """None if both sides agree, otherwise what differs."""
    got_names = list(spark_df.columns)
    got = [tuple(_plain(v) for v in r) for r in spark_df.collect()]
    cur = con.execute(sql)
    want_names = [c[0] for c in cur.description]
    want = [tuple(_plain(v) for v in r) for r in cur.fetchall()]
    if sorted(got_names) != sorted(want_names):
        return f"columns {sorted(got_names)} != {sorted(want_names)}"
    names = sorted(got_names)
    got = [tuple(r[got_names.index(n)] for n in names) for r in got]
    want = [tuple(r[want_names.index(n)] for n in names) for r in want]
    for i, n in enumerate(names):
        a = {type(r[i]).__name__ for r in got if r[i] is not None}
        b = {type(r[i]).__name__ for r in want if r[i] is not None}
        if a and b and a != b:
            return f"type of {n}: {a} != {b}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    key = lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)
    got, want = sorted(got, key=key), sorted(want, key=key)
    for a, b in zip(got, want):
        if a != b:
            return f"first difference {dict(zip(names, a))} != {dict(zip(names, b))}"
    return None


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from tablewright.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(sf_dir), oracle_sql(), 0
    for name, fn in queries().items():
        if only and name not in only:
            continue
        at = time.time()
        try:
            df = fn(spark, sf_dir)
            problem = compare(df, con, sqls[name]) if name in sqls else f"rows only: {len(df.collect())}"
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        ok = problem is None or problem.startswith("rows only")
        bad += not ok
        print(f"{'ok  ' if ok else 'BAD '} {name:24s} {time.time() - at:6.2f}s {problem or ''}", flush=True)
    print(f"{bad} bad of {len(queries())}; with SQL: {len(sqls)}")


if __name__ == "__main__":
    main()
