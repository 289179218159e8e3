"""Run registered queries and their SQL side by side."""

from __future__ import annotations

import glob
import math
import os
import time

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


def as_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


TYPES = {
    "bigint": "BIGINT",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "double": "DOUBLE",
    "int": "INTEGER",
    "string": "VARCHAR",
}


def schema_differences(frame, con, sql: str) -> dict:
    """Columns whose types differ between the two engines."""
    got = {name: TYPES.get(kind, kind) for name, kind in frame.dtypes}
    want = {row[0]: row[1] for row in con.execute(f"DESCRIBE {sql}").fetchall()}
    return {c: (got.get(c), want.get(c)) for c in got | want if got.get(c) != want.get(c)}


def compare(spark, con, sf_dir: str, query, sql: str) -> dict:
    started = time.time()
    frame = query(spark, sf_dir)
    got = as_rows(frame.columns, frame.collect())
    spark_seconds = time.time() - started
    started = time.time()
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    want = as_rows(names, result.fetchall())
    return {
        "columns": sorted(frame.columns) == sorted(names),
        "types": schema_differences(frame, con, sql),
        "rows": (len(got), len(want)),
        "equal": got == want,
        "differences": [(g, w) for g, w in zip(got, want) if g != w][:3],
        "spark": round(spark_seconds, 2),
        "sql": round(time.time() - started, 2),
    }
