"""Run queries and compare them with DuckDB: ``python -m checks.compare [sf_dir] [name ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession

from . import ORACLES, QUERIES

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def canonical(rows: list[tuple], names: list[str]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def difference(df: DataFrame, db: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when both give the same columns and rows, else the first difference."""
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    wanted = canonical(result.fetchall(), names)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} instead of {sorted(names)}"
    if len(got) != len(wanted):
        return f"{len(got)} rows instead of {len(wanted)}"
    for mine, theirs in zip(got, wanted):
        if mine != theirs:
            return f"{mine}\n   instead of\n     {theirs}"
    return None


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]").appName("checks")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv and Path(argv[0]).is_dir() else "/root/testdata/sf0.001"
    names = [a for a in argv if a in QUERIES] or list(QUERIES)
    spark, db, failed = session(), connect(sf_dir), 0
    for name in names:
        started = time.time()
        try:
            problem = difference(QUERIES[name](spark, sf_dir), db, ORACLES[name]) if name in ORACLES else None
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - started:.1f}s {problem or ''}", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
