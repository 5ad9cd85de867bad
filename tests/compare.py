"""Rows of Spark and DuckDB as sets of comparable text."""

from __future__ import annotations

import decimal

import duckdb
import numpy as np

from conftest import DATA, TABLES


def _text(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, (list, tuple, np.ndarray)):
        return str([_text(x) for x in v])
    if isinstance(v, dict):
        return str({k: _text(x) for k, x in v.items()})
    if isinstance(v, (float, decimal.Decimal)):
        return "null" if v != v else f"{float(v):.9g}"
    return str(v)


def rows_of(table) -> list[tuple]:
    names = sorted(table.column_names)
    return sorted(tuple(_text(r[n]) for n in names) for r in table.to_pylist())


def duck(sql: str, folder: str = DATA):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con.sql(sql).to_arrow_table()
