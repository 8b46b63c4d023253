"""Holds a query's rows against its SQL, the way a reader of both would: columns by name, rows in any order."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb

SKIPPED = {"NaN", "nan"}


def plain(x):
    """A value that compares and sorts: floats at 9 digits, containers as tuples."""
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, Decimal):
        return plain(float(x)) if x % 1 else int(x)
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if hasattr(x, "asDict"):
        return tuple(plain(v) for v in x)
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if hasattr(x, "isoformat"):
        return x.isoformat()
    return x


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)


def sql_rows(sql, sf_dir):
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    got = db.execute(sql)
    columns = [d[0] for d in got.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in got.fetchall()), key=repr)


def assert_same(df, sql, sf_dir):
    names, left = spark_rows(df)
    others, right = sql_rows(sql, sf_dir)
    assert names == others
    assert len(left) == len(right), (len(left), len(right))
    for a, b in zip(left, right):
        assert a == b
