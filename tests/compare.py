"""Compare a Spark result with its SQL counterpart in DuckDB, ignoring row order."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def differences(spark_df, con, sql: str) -> list[str]:
    """Empty when both results are equal."""
    mine = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    result = con.execute(sql)
    theirs = rows_of([d[0] for d in result.description], result.fetchall())
    if mine[0] != theirs[0]:
        return [f"columns {mine[0]} against {theirs[0]}"]
    if mine[1] == theirs[1]:
        return []
    only_mine, only_theirs = set(mine[1]) - set(theirs[1]), set(theirs[1]) - set(mine[1])
    return [f"rows {len(mine[1])} against {len(theirs[1])}", f"only Spark: {sorted(only_mine)[:3]}", f"only SQL: {sorted(only_theirs)[:3]}"]
