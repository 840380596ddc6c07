"""Compare registered queries with their SQL twins: python tests/oracle_check.py [--sf DIR] [names...]"""

from __future__ import annotations

import argparse
import datetime
import decimal
import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def spark_session(cores: str = "8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir: str):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for name in TABLES.split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def norm(value):
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6f}f"
    if isinstance(value, decimal.Decimal):
        return f"D{value}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(norm(v) for v in value) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{norm(v)}" for k, v in sorted(value.items())) + "}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def normal_rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> tuple[bool, str, float, float]:
    start = time.time()
    got = normal_rows([tuple(r) for r in df.collect()], df.columns)
    mid = time.time()
    result = con.sql(sql)
    want = normal_rows(result.fetchall(), result.columns)
    end = time.time()
    if sorted(df.columns) != sorted(result.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(result.columns)}", mid - start, end - mid
    if got == want:
        return True, f"{len(got)} rows", mid - start, end - mid
    extra = [r for r in got if r not in set(want)][:3]
    missing = [r for r in want if r not in set(got)][:3]
    return False, f"{len(got)} vs {len(want)} rows; only Spark {extra}; only SQL {missing}", mid - start, end - mid


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    import __spark_entry__ as entry
    from keysift.session import clear_scratch

    spark, con = spark_session(), connect(args.sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not args.names or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args.names)]
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = queries[name](spark, args.sf)
            plan_time = time.time() - start
            if name in oracles:
                ok, note, ts, td = compare(df, con, oracles[name])
            else:
                rows = df.collect()
                ok, note, ts, td = True, f"{len(rows)} rows, no SQL; first {rows[:2]}"[:300], time.time() - start - plan_time, 0.0
            print(f"{'ok  ' if ok else 'FAIL'} {name} plan {plan_time:.1f}s run {ts:.1f}s sql {td:.1f}s {note}", flush=True)
        except Exception as error:
            ok = False
            print(f"FAIL {name} {type(error).__name__}: {str(error)[:700]}", flush=True)
            if args.names:
                traceback.print_exc(limit=4)
        bad += not ok
        clear_scratch(spark)
    print(f"{len(names) - bad}/{len(names)} ok")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
