"""Compares a query with its SQL on the same tables, whatever the order of rows."""

from __future__ import annotations

from collections import Counter
from pathlib import Path


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v if v is None or isinstance(v, (int, str, bool)) else str(v)


def database(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p / '*.parquet' if p.is_dir() else p}'")
    return con


def assert_same(df, con, sql: str) -> None:
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = Counter(tuple(plain(r[i]) for i in at) for r in cursor.fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
