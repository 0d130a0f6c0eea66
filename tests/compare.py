"""Runs registered queries against their oracle statements in DuckDB."""

from __future__ import annotations

import datetime as dt
import logging
import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

import __spark_entry__ as entry_module  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return ("bool", v)
    if isinstance(v, (int,)):
        return ("int", v)
    if isinstance(v, float):
        return ("float", round(v, 9))
    if isinstance(v, (dt.datetime, dt.date)):
        return ("time", v.isoformat())
    if isinstance(v, (list, tuple)):
        return ("list", tuple(plain(x) for x in v))
    return (type(v).__name__, v)


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def difference(name: str, spark, con, sf_dir: str) -> tuple[str | None, float, int]:
    """What differs (null: nothing), the Spark seconds and the row count."""
    start = time.time()
    df = entry_module.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    took = time.time() - start
    sql = entry_module.oracle_sql().get(name)
    if sql is None:
        return None, took, len(rows)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}", took, len(rows)
    at = [names.index(c) for c in cols]
    expected = [tuple(plain(r[i]) for i in at) for r in cur.fetchall()]
    ours, theirs = Counter(rows), Counter(expected)
    if ours == theirs:
        return None, took, len(rows)
    text = f"{len(rows)} vs {len(expected)} rows {cols}\n  only Spark: {list((ours - theirs).items())[:3]}"
    return text + f"\n  only oracle: {list((theirs - ours).items())[:3]}", took, len(rows)


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    logging.getLogger("DataFrameQueryContextLogger").disabled = True
    logging.getLogger("SQLQueryContextLogger").disabled = True
    con = connect(sf_dir)
    bad = 0
    for name in entry_module.queries():
        if wanted and not any(w in name for w in wanted):
            continue
        has = "" if name in entry_module.oracle_sql() else " (no oracle)"
        try:
            diff, took, n = difference(name, spark, con, sf_dir)
        except Exception as e:  # noqa: BLE001
            diff, took, n = f"{type(e).__name__}: {str(e)[:900]}", 0.0, 0
        bad += diff is not None
        print(f"{'FAIL' if diff else 'ok  '} {name} {n} rows {took:.2f}s{has}", flush=True)
        if diff:
            print("  " + diff, flush=True)
    print("failed:", bad)
