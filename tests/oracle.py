"""Compares a Spark result with a DuckDB result as unordered rows."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def connect(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{directory}/{t}.parquet')")
    return con


def normal(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(normal(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP",
}


def compare(spark_df, con, sql):
    """(equal, message)."""
    got_types = {c: KINDS.get(t, t) for c, t in spark_df.dtypes}
    want_types = {c: str(t) for c, t, *_ in con.execute(f"DESCRIBE {sql}").fetchall()}
    if got_types != want_types:
        return False, f"types {set(got_types.items()) ^ set(want_types.items())}"
    got_columns, got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cursor = con.execute(sql)
    want_columns, want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if got_columns != want_columns:
        return False, f"columns {got_columns} != {want_columns}"
    if got != want:
        odd = [(g, w) for g, w in zip(got, want, strict=False) if g != w][:3]
        return False, f"{len(got)} vs {len(want)} rows; first differences {odd}"
    return True, f"{len(got)} rows"
