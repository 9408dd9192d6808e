"""Run registered queries next to their SQL: ``python -m tests.compare SF_DIR [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb


def _norm(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in rows)


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def compare(spark, con, sf_dir: str, name: str, query, sql: str) -> str | None:
    """None if both sides agree on columns and rows, else what differs."""
    df = query(spark, sf_dir)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    theirs = rows_of(columns, cursor.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(columns)}"
    if ours != theirs:
        a, b = list((ours - theirs).items())[:2], list((theirs - ours).items())[:2]
        return f"{sum(ours.values())} vs {sum(theirs.values())} rows; only ours {a}; only SQL {b}"
    return None


def main() -> int:
    from pyspark.sql import SparkSession

    from veilspark.plans.oracle import ORACLE
    from veilspark.plans.queries import QUERIES

    sf_dir, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con, bad = connect(sf_dir), 0
    for name in names:
        if name not in ORACLE:
            print(f"{name:26s} no SQL", flush=True)
            continue
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, name, QUERIES[name], ORACLE[name])
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{name:26s} {'ok' if problem is None else 'DIFFERS ' + problem[:1200]} ({time.time() - start:.1f}s)", flush=True)
    print("differing:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
