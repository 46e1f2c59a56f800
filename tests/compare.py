"""Value comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def oracle(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(folder) / f"{name}.parquet"
        if path.exists():
            con.sql(f"CREATE VIEW {name} AS FROM '{path}'")
    return con


def _kind(value) -> object:
    if isinstance(value, float):
        return ("nan",) if math.isnan(value) else round(value, 6) + 0.0
    return value


def _sorted_rows(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_kind(r[i]) for i in order) for r in rows), key=repr)


def differences(spark_df, relation) -> str:
    """Empty when both results hold the same rows under the same names."""
    left_names, right_names = list(spark_df.columns), list(relation.columns)
    if sorted(left_names) != sorted(right_names):
        return f"columns {sorted(left_names)} != {sorted(right_names)}"
    left = _sorted_rows(left_names, [tuple(r) for r in spark_df.collect()])
    right = _sorted_rows(right_names, relation.fetchall())
    if len(left) != len(right):
        return f"{len(left)} rows != {len(right)} rows"
    bad = [(a, b) for a, b in zip(left, right) if a != b or any(type(x) is not type(y) for x, y in zip(a, b))]
    return f"{len(bad)} of {len(left)} rows differ, first: {bad[0]}" if bad else ""
