"""Comparison of a query with its SQL over the same Parquet tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def rows(columns, found):
    """Rows as sorted tuples, columns by name, numbers alike whatever their width."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: "" if v is None else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in found)


def same(spark, query, sql: str, sf_dir: str) -> None:
    frame = query(spark, sf_dir)
    got = rows(frame.columns, [tuple(r) for r in frame.collect()])
    told = connect(sf_dir).sql(sql)
    want = rows(told.columns, told.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
