"""Compare a query's rows with its oracle's: python tests/compare.py [--sf DIR] NAME..."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def plain(v):
    if isinstance(v, float):
        return ("f", None if math.isnan(v) else float(f"{v:.9g}"))
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, bytearray):
        return bytes(v)
    return v


def rows_of(spark, query, sf):
    df = query(spark, sf)
    names = sorted(df.columns)
    return names, sorted((repr(tuple(plain(r[n]) for n in names)) for r in df.collect()))


def oracle_rows(sql, sf):
    import duckdb

    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    cur = db.execute(sql)
    cols = [d[0] for d in cur.description]
    names = sorted(cols)
    at = [cols.index(n) for n in names]
    return names, sorted((repr(tuple(plain(r[i]) for i in at)) for r in cur.fetchall()))


def main(args):
    sf = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        sf, args = args[1], args[2:]
    import __spark_entry__ as e

    spark, bad = session(), []
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = e.queries(), e.oracle_sql()
    for name in args or queries:
        t = time.time()
        try:
            names, got = rows_of(spark, queries[name], sf)
        except Exception as x:  # noqa: BLE001  a report of all queries
            print(f"{name}: ERROR {str(x)[:1500]}", flush=True)
            bad.append(name)
            continue
        took = time.time() - t
        if name not in oracles:
            print(f"{name}: {len(got)} rows {took:.1f}s, no oracle", flush=True)
            continue
        t = time.time()
        try:
            want_names, want = oracle_rows(oracles[name], sf)
        except Exception as x:  # noqa: BLE001
            print(f"{name}: ORACLE ERROR {str(x)[:800]}", flush=True)
            bad.append(name)
            continue
        same = names == want_names and got == want
        print(f"{name}: {'ok' if same else 'DIFFERS'} {len(got)}/{len(want)} rows {took:.1f}s, oracle {time.time() - t:.1f}s", flush=True)
        if not same:
            bad.append(name)
            print("  columns", names, want_names)
            print("  only ours  ", [x[:300] for x in sorted(set(got) - set(want))[:3]])
            print("  only oracle", [x[:300] for x in sorted(set(want) - set(got))[:3]])
    print("bad:", bad)
    return int(bool(bad))


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
