"""Run a registered query in Spark and its SQL in DuckDB and compare the rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pyarrow as pa


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return value


def _kind(column_type: pa.DataType) -> str:
    return str(column_type).removeprefix("large_")


def _rows(table) -> tuple[list[str], list[tuple]]:
    names = sorted(table.column_names)
    columns = [[_plain(v) for v in table[n].to_pylist()] for n in names]
    return names, sorted(zip(*columns), key=repr)


def mismatch(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None if both sides agree, else what differs first."""
    ours, theirs = spark_df.toArrow(), con.sql(sql).to_arrow_table()
    left_names, left = _rows(ours)
    right_names, right = _rows(theirs)
    if left_names != right_names:
        return f"columns {left_names} != {right_names}"
    for name in left_names:
        kinds = _kind(ours.schema.field(name).type), _kind(theirs.schema.field(name).type)
        if kinds[0] != kinds[1]:
            return f"type of {name}: {kinds[0]} != {kinds[1]}"
    if len(left) != len(right):
        return f"{len(left)} rows != {len(right)} rows"
    for a, b in zip(left, right):
        if a != b:
            return f"{repr(a)[:600]} != {repr(b)[:600]}"
    return None
