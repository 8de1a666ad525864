"""Compare registered queries with their SQL on DuckDB, value by value.

Run as a script: ``python -m tests.oracle [-s DIR] [name-prefix ...]``.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return f"b:{v}"
    if isinstance(v, int):
        return f"i:{v}"
    if isinstance(v, float):
        return "∅" if math.isnan(v) else f"f:{v!r}"
    if isinstance(v, decimal.Decimal):
        return f"d:{v.normalize()}"
    if isinstance(v, dt.datetime):
        return f"t:{v.replace(tzinfo=None).isoformat()}"
    if isinstance(v, dt.date):
        return f"D:{v.isoformat()}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    return f"s:{v}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([columns[i] for i in order]), sorted(
        tuple(canon(r[i]) for i in order) for r in rows
    )


def compare(df, con, sql):
    """None when equal, else a short account of the difference; and the row count."""
    got_c, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    want_c, want = rows_of([d[0] for d in rel.description], rel.fetchall())
    if got_c != want_c:
        return f"columns {got_c} != {want_c}", len(got)
    if got == want:
        return None, len(got)
    only_got = [r for r in got if r not in set(want)][:2]
    only_want = [r for r in want if r not in set(got)][:2]
    short = lambda rs: [tuple(x[:160] for x in r) for r in rs]
    return f"rows {len(got)} vs {len(want)}\n   spark {short(only_got)}\n   duck  {short(only_want)}", len(got)


def main(argv):
    root = Path(__file__).resolve().parent.parent
    sys.path.insert(0, str(root))
    import __spark_entry__ as entry
    from almanack import build_session

    sf = "/root/testdata/sf0.01"
    if argv and argv[0] == "-s":
        sf, argv = argv[1], argv[2:]
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if argv and not any(name.startswith(a) for a in argv):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            if name in oracle:
                diff, n = compare(df, con, oracle[name])
            else:
                diff, n = None, len(df.collect())
        except Exception as exc:
            diff, n = f"{type(exc).__name__}: {str(exc)[:700]}", 0
        state = "FAIL" if diff else ("ok" if name in oracle else "rows")
        if diff:
            bad += 1
        flag = " EMPTY" if n == 0 else ""
        print(f"{state:5}{name:44}{n:8} rows {time.time() - t0:6.2f}s{flag}", flush=True)
        if diff:
            print("   " + diff, flush=True)
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
