"""Runs a registered query and its SQL on the same folder and compares the rows, order aside."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        path = Path(folder) / f"{name}.parquet"
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _kind(name: str) -> str:
    name = name.lower()
    for kind, words in {
        "int": ("bigint", "hugeint", "int", "long"),
        "float": ("double", "float", "decimal"),
        "text": ("varchar", "string"),
        "bool": ("bool",),
    }.items():
        if any(name.startswith(w) for w in words):
            return kind
    return name


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(repr(value + 0.0))
    return value


def compare(result: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when the results agree, otherwise what differs."""
    relation = connection.sql(sql)
    names = sorted(result.columns)
    if names != sorted(relation.columns):
        return f"columns {names} and {sorted(relation.columns)}"
    spark_kinds = dict(result.dtypes)
    sql_kinds = dict(zip(relation.columns, map(str, relation.types), strict=True))
    for name in names:
        if _kind(spark_kinds[name]) != _kind(sql_kinds[name]):
            return f"{name}: {spark_kinds[name]} and {sql_kinds[name]}"
    ours = sorted((tuple(_plain(r[n]) for n in names) for r in result.collect()), key=repr)
    order = [relation.columns.index(n) for n in names]
    theirs = sorted((tuple(_plain(r[i]) for i in order) for r in relation.fetchall()), key=repr)
    if len(ours) != len(theirs):
        return f"{len(ours)} and {len(theirs)} rows"
    differing = [(a, b) for a, b in zip(ours, theirs, strict=True) if a != b]
    if differing:
        a, b = differing[0]
        return f"{len(differing)} of {len(ours)} rows differ, first {str(a)[:300]} and {str(b)[:300]}"
    return None
