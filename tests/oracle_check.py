"""Run registered queries next to their SQL: `python tests/oracle_check.py [sf] [name-prefix ...]`."""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

DATA = "/root/testdata"


def session(cpus: int = int(os.environ.get("TEST_CPUS", "8"))):
    from pyspark.sql import SparkSession

    return (SparkSession.builder.master(f"local[{cpus}]").appName("tieline-tests")
            .config("spark.sql.shuffle.partitions", str(cpus)).config("spark.ui.enabled", "false")
            .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "10g").config("spark.ui.showConsoleProgress", "false").getOrCreate())


def duck(folder: str):
    from tieline.registry import BASE_TABLES

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([tuple(canon(r[i]) for i in order) for r in rows], key=str)


def compare(spark, con, name, folder):
    from tieline.registry import ORACLES, QUERIES

    t0 = time.time()
    df = QUERIES[name](spark, folder)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if name not in ORACLES:
        return (len(got) > 0, f"rows={len(got)} (no oracle) {t1 - t0:.1f}s")
    rel = con.execute(ORACLES[name])
    want_cols = [d[0] for d in rel.description]
    want = rel.fetchall()
    gc, g = rows_of(df.columns, got)
    wc, w = rows_of(want_cols, want)
    took = f"{t1 - t0:.1f}s / duckdb {time.time() - t1:.1f}s"
    if gc != wc:
        return False, f"columns {gc} != {wc}"
    if g != w:
        diff = [(a, b) for a, b in zip(g, w) if a != b][:3]
        return False, f"rows {len(g)} vs {len(w)}; differing {sum(a != b for a, b in zip(g, w))}: {diff} {took}"
    return len(g) > 0, f"rows={len(g)} {took}"


def main(argv):
    import tieline.plans.all  # noqa: F401
    from tieline.registry import QUERIES

    sf = argv[0] if argv else "0.01"
    names = [n for n in QUERIES if not argv[1:] or any(n.startswith(p) for p in argv[1:])]
    spark, con = session(), duck(f"{DATA}/sf{sf}")
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for n in names:
        try:
            ok, msg = compare(spark, con, n, f"{DATA}/sf{sf}")
        except Exception as e:  # report and go on with the next query
            ok, msg = False, f"{type(e).__name__}: {str(e)[:600]}"
        bad += not ok
        print(("ok  " if ok else "FAIL"), n, msg, flush=True)
    print(f"{len(names) - bad} of {len(names)} good")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
