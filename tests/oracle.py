"""Run a registered query and its SQL side by side and compare rows, names and types."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
_TYPES = {
    "bigint": "bigint", "int": "integer", "double": "double", "string": "varchar",
    "boolean": "boolean", "timestamp_ntz": "timestamp", "float": "float", "date": "date",
}


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark_df, con, sql: str) -> list[str]:
    """Differences found; empty when the two results are the same."""
    relation = con.sql(sql)
    names = [c.lower() for c in relation.columns]
    types = {n: str(t).lower() for n, t in zip(names, relation.types)}
    expected = _rows(names, relation.fetchall())
    got_names = [c.lower() for c in spark_df.columns]
    problems = []
    if sorted(names) != sorted(got_names):
        return [f"columns {sorted(got_names)} != {sorted(names)}"]
    for name, kind in spark_df.dtypes:
        if _TYPES.get(kind, kind) != types[name.lower()]:
            problems.append(f"type of {name}: {kind} != {types[name.lower()]}")
    got = _rows(got_names, [tuple(r) for r in spark_df.collect()])
    if len(got) != len(expected):
        problems.append(f"rows {len(got)} != {len(expected)}")
    different = [(g, e) for g, e in zip(got, expected) if g != e]
    if different:
        problems.append(f"{len(different)} rows differ, first: {different[0][0]} != {different[0][1]}")
    return problems
