"""Compare every registered query with its SQL counterpart: ``python -m checks.compare SF_DIR [name…]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession

from checks.oracle import ORACLE
from checks.registry import QUERIES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _rows(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def difference(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None if both results have equal columns and rows, else what differs."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(set(names) ^ set(df.columns))}"
    want = _rows(names, result.fetchall())
    have = _rows(df.columns, [tuple(r) for r in df.collect()])
    if len(want) != len(have):
        return f"rows {len(have)} instead of {len(want)}"
    for h, w in zip(have, want):
        if h != w:
            return f"row {h} instead of {w}"
        if [type(x) for x in h] != [type(x) for x in w]:
            return f"types {h} instead of {w}"
    return None


def main(sf_dir: str, *only: str) -> int:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    for name in only or QUERIES:
        start = time.time()
        found = difference(QUERIES[name](spark, sf_dir), con, ORACLE[name])
        bad += found is not None
        print(f"{name:34} {time.time() - start:6.2f}s {found or 'equal'}", flush=True)
    print(f"{bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(min(main(*sys.argv[1:]), 1))
