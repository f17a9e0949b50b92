"""Run queries beside their SQL and compare rows: `python -m checks.compare [sf] [name...]`."""

from __future__ import annotations

import math
import sys
import tempfile
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

from checks import oracle, queries

DATA = "/root/testdata"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        files = f"{path}/*.parquet" if path.is_dir() else path
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{files}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if hasattr(value, "tzinfo"):
        return value.replace(tzinfo=None)
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def difference(spark: SparkSession, con, name: str, sf_dir: str) -> str | None:
    """What differs between the query and its SQL, or None."""
    query = {q.__name__: q for q in queries.QUERIES}[name]
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    cursor = con.execute(oracle.SQL[name])
    columns = [d[0] for d in cursor.description]
    want = rows_of(columns, cursor.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} for {sorted(columns)}"
    if got == want:
        return None
    missing = [r for r in want if r not in set(got)][:2]
    extra = [r for r in got if r not in set(want)][:2]
    return f"{len(got)} rows for {len(want)}; missing {str(missing)[:300]}; extra {str(extra)[:300]}"


def main() -> None:
    sf_dir = f"{DATA}/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    names = sys.argv[2:] or [q.__name__ for q in queries.QUERIES]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="chatprep-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = []
    for name in names:
        start = time.time()
        try:
            found = difference(spark, con, name, sf_dir) if name in oracle.SQL else "no SQL"
        except Exception as error:  # noqa: BLE001 - report and go on with the others
            found = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{name:28s} {time.time() - start:6.1f}s  {'ok' if found is None else found}", flush=True)
        if found:
            failed.append(name)
    print(f"{len(names) - len(failed)} of {len(names)} agree", failed)


if __name__ == "__main__":
    main()
