"""Compare registered queries with their SQL, row for row.

    python tools/check.py [--sf DIR] [name-prefix ...]
"""
from __future__ import annotations

import argparse
import math
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()
SAME = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
        "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT"}


def session(cores: int = 8) -> SparkSession:
    return (SparkSession.builder.master(f"local[{cores}]").appName("check")
            .config("spark.sql.shuffle.partitions", "8")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.driver.memory", "12g")
            .config("spark.ui.enabled", "false")
            .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
            .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
            .getOrCreate())


def connect(sf: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def norm(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, q, sf):
    df = q.build(spark, sf)
    types = dict(df.dtypes)
    got = [tuple(r) for r in df.collect()]
    if q.sql is None:
        return "rows", len(got), ""
    rel = con.execute(q.sql)
    names = [d[0] for d in rel.description]
    kinds = {d[0]: str(d[1]) for d in rel.description}
    want = rel.fetchall()
    if sorted(names) != sorted(df.columns):
        return "FAIL", len(got), f"columns {sorted(df.columns)} != {sorted(names)}"
    odd = {c: (types[c], kinds[c]) for c in names if SAME.get(types[c], types[c]) != kinds[c]}
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a != b:
        left = [r for r in a if r not in set(b)][:3]
        right = [r for r in b if r not in set(a)][:3]
        return "FAIL", len(got), (f"{sorted(names)}\n   spark {len(a)} {left}\n   sql   {len(b)} {right}"
                                  f"\n   types {odd}")
    return ("ok" if not odd else "TYPE"), len(got), str(odd) if odd else ""


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("prefix", nargs="*")
    args = parser.parse_args()
    from tripwright.plans import load_registry
    from tripwright.storage import clean_up

    registry = load_registry()
    spark, con = session(), connect(args.sf)
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name, q in registry.items():
        if args.prefix and not any(name.startswith(p) for p in args.prefix):
            continue
        start = time.time()
        try:
            status, n, note = compare(spark, con, q, args.sf)
        except Exception as exc:
            status, n, note = "ERROR", -1, str(exc)[:1500]
        clean_up(spark)
        bad += status not in ("ok", "rows")
        print(f"{status:5} {name:45} {n:7} rows {time.time() - start:6.1f}s {note}", flush=True)
    print("bad", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
