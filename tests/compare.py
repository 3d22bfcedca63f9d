"""Run registered queries and their SQL side by side.

    python tests/compare.py [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def spark_session():
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~null"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    if isinstance(v, float):
        return repr(v)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(df, got_rows, con, sql):
    """Empty string when equal, else the first difference."""
    rel = con.execute(sql)
    cols = [c[0] for c in rel.description]
    types = {c[0]: str(c[1]) for c in rel.description}
    want = rows_of(cols, rel.fetchall())
    got = rows_of(df.columns, got_rows)
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(cols)}"
    known = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN"}
    odd = [f"{c}: {t} vs {types[c]}" for c, t in df.dtypes if known.get(t) != types[c]]
    if odd:
        return f"types {odd}"
    if len(want) != len(got):
        return f"rows {len(got)} != {len(want)}"
    for g, w in zip(got, want):
        if g != w:
            n = sum(a != b for a, b in zip(got, want))
            return f"{n} of {len(got)} rows differ: {sorted(cols)}\n  spark {g}\n  sql   {w}"
    return "" if got else "both empty"


if __name__ == "__main__":
    import __spark_entry__ as entry

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = spark_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not sys.argv[1:] or any(a in n for a in sys.argv[1:])]
    bad = 0
    for n in names:
        t = time.time()
        took = 0.0
        try:
            df = queries[n](spark, sf_dir)
            rows = df.collect()
            took = time.time() - t
            out = compare(df, rows, con, oracles[n]) if n in oracles else f"rows only: {len(rows)}"
        except Exception as e:  # report and go on
            out = f"{type(e).__name__}: {str(e)[:700]}"
        fine = out == "" or out.startswith("rows only")
        bad += not fine
        print(f"{'ok  ' if fine else 'FAIL'} {n} {took:.1f}s (+{time.time() - t - took:.1f}s) {out}", flush=True)
        spark.catalog.clearCache()
    print(f"{len(names)} queries, {bad} failing")
    spark.stop()
