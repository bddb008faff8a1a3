"""Compare a Spark result with its SQL check, cell by cell and regardless of order."""

from __future__ import annotations

import os

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark",
    "labels", "conversations",
]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def rows_of_spark(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, [tuple(r) for r in df.select(*names).collect()]


def rows_of_duck(con, sql: str) -> tuple[list[str], list[tuple]]:
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], [tuple(r[i] for i in order) for r in result.fetchall()]


TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "BOOLEAN": "boolean", "DOUBLE": "double"}


def type_differences(df, con, sql: str) -> list[str]:
    spark_types = dict(df.dtypes)
    duck_types = {d[0]: TYPES.get(str(d[1]), str(d[1])) for d in con.execute(f"DESCRIBE {sql}").fetchall()}
    return [f"{n}: {t} <> {duck_types.get(n)}" for n, t in spark_types.items() if t != duck_types.get(n)]


def difference(df, con, sql: str) -> str:
    """'' when equal, else a short account."""
    unlike = type_differences(df, con, sql)
    if unlike:
        return f"types {unlike}"
    names, got = rows_of_spark(df)
    want_names, want = rows_of_duck(con, sql)
    if names != want_names:
        return f"columns {names} <> {want_names}"
    if len(got) != len(want):
        return f"{len(got)} rows, want {len(want)}"
    got, want = sorted(got, key=repr), sorted(want, key=repr)
    for a, b in zip(got, want):
        if a != b:
            return f"got {a!r:.900}\nwant {b!r:.900}"
    return ""
