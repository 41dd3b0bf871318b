"""Spark results against SQL over the same tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return c


def rows(names, records) -> list[tuple]:
    """Columns by name, floats rounded, rows sorted."""
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(v):
        if isinstance(v, float):
            return None if v != v else round(v, 6)
        return list(v) if isinstance(v, (list, tuple)) else v

    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


def check(df, connection, sql: str) -> None:
    want = connection.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())
