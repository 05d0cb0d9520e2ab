"""Compare a query with its SQL in DuckDB, column by column, as bags of rows."""

import math
from collections import Counter
from pathlib import Path

import duckdb


def tables(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def assert_same(df, sql, sf_dir):
    cur = tables(sf_dir).execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = Counter(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall())
    got = Counter(tuple(plain(r[c]) for c in sorted(names)) for r in df.collect())
    assert got == want, (list((got - want).items())[:2], list((want - got).items())[:2])
    return sum(got.values())
