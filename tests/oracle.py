"""Comparison of a Spark result with the oracle's, as sets of rows with named columns."""

from __future__ import annotations

import math
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        if Path(f"{folder}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    return value


def bag(rows, columns) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def spark_type(kind: str) -> str:
    return {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}.get(kind, kind)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    out = []
    if sorted(df.columns) != sorted(columns):
        return [f"columns {sorted(df.columns)} against {sorted(columns)}"]
    for name, kind in df.dtypes:
        if spark_type(kind) != types[name]:
            out.append(f"type of {name}: {kind} against {types[name]}")
    got = bag([tuple(r) for r in df.collect()], df.columns)
    want = bag(result.fetchall(), columns)
    if got != want:
        extra, lacking = got - want, want - got
        out.append(f"{sum(got.values())} rows against {sum(want.values())}; {sum(extra.values())} differ")
        for label, rows in (("spark", extra), ("sql", lacking)):
            for row in sorted(rows, key=repr)[:2]:
                out.append(f"{label}: " + repr(row)[:1500])
    if not got:
        out.append("no rows")
    return out
