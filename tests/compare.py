"""Run registered queries next to their SQL oracles and compare the rows.

Usage: python tests/compare.py [-s sf] [key ...]
"""

from __future__ import annotations

import sys
import time
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session(cpus: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float):
        return value + 0.0
    return value


def difference(df, con, sql: str) -> str | None:
    """None when columns and rows agree, otherwise what differs."""
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    order = sorted(names)
    theirs = [tuple(plain(r[names.index(c)]) for c in order) for r in rel.fetchall()]
    ours = [tuple(plain(r[c]) for c in order) for r in df.collect()]
    key = lambda row: tuple((v is None, type(v).__name__ if not isinstance(v, (int, float)) else "n", str(v) if v is None else v) for v in row)
    ours, theirs = sorted(ours, key=key), sorted(theirs, key=key)
    if len(ours) != len(theirs):
        return f"{len(ours)} rows != {len(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b:
            return "row " + str([(c, x, y) for c, x, y in zip(order, a, b) if x != y])
        if [type(x) for x in a] != [type(y) for y in b]:
            return "types " + str([(c, type(x), type(y)) for c, x, y in zip(order, a, b) if type(x) != type(y)])
    return None if ours else "EMPTY"


def main() -> int:
    args = sys.argv[1:]
    scale = "0.01"
    if args[:1] == ["-s"]:
        scale, args = args[1], args[2:]
    import __spark_entry__ as entry

    folder = f"/root/testdata/sf{scale}"
    spark, con = session(4), database(folder)
    plans, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for key in args or plans:
        start = time.time()
        try:
            df = plans[key](spark, folder)
            if key in oracles:
                outcome = difference(df, con, oracles[key])
            else:
                outcome = None if df.count() else "EMPTY"
        except Exception as error:  # noqa: BLE001
            outcome = "ERROR " + str(error)[:900]
        bad += outcome is not None
        mark = "ok  " if outcome is None else "FAIL"
        print(f"{mark} {key}{'' if key in oracles else ' (rows only)'} {time.time() - start:.2f}s {outcome or ''}", flush=True)
    print(f"{bad} differ")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
