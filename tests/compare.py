"""Run registered queries against their SQL on the given tables (also usable from a shell)."""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, (Decimal, float)):
        number = float(value)
        return "nan" if math.isnan(number) else f"{round(number, 6) + 0.0:.6f}"
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, int):
        return f"{value:.6f}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    return rows_of(columns, cursor.fetchall())


def main(argv):
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from tidemark.session import local_session

    sf = f"/root/testdata/sf{argv[0]}"
    if os.environ.get("PLAIN"):  # a session without this package's settings
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    else:
        spark = local_session("compare")
    con = connect(sf)
    queries, oracle = entry.queries(), entry.oracle_sql()
    wanted = [q for q in queries if not argv[1:] or any(a in q for a in argv[1:])]
    bad = []
    for name in wanted:
        try:
            t0 = time.time()
            got = spark_rows(queries[name](spark, sf))
            t1 = time.time()
            if name not in oracle:
                print(f"rows {name:34s} {len(got[1]):7d} rows {t1 - t0:6.2f}s", flush=True)
                continue
            want = duck_rows(con, oracle[name])
            t2 = time.time()
            ok = got == want
            mark = "ok  " if ok else "DIFF"
            print(f"{mark} {name:34s} {len(got[1]):7d} rows {t1 - t0:6.2f}s sql {t2 - t1:.2f}s", flush=True)
            if not ok:
                bad.append(name)
                print("   columns", got[0], want[0], len(got[1]), len(want[1]))
                a, b = set(got[1]), set(want[1])
                print("   spark only", sorted(a - b)[:4])
                print("   sql only  ", sorted(b - a)[:4])
        except Exception as error:  # noqa: BLE001
            bad.append(name)
            print(f"FAIL {name}: {type(error).__name__} {str(error)[:1500]}", flush=True)
    print(len(wanted), "queries,", len(bad), "bad:", bad)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
