"""Holds a query's rows against its SQL in DuckDB."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _value(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool) or isinstance(v, str):
        return v
    return round(float(v), 6)


def rows_of(records, columns):
    return sorted((tuple(_value(r[c]) for c in columns) for r in records), key=repr)


def assert_same(df, sql, sf_dir):
    mine = [r.asDict() for r in df.collect()]
    cursor = connection(sf_dir).execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = [dict(zip(names, r)) for r in cursor.fetchall()]
    columns = sorted(df.columns)
    assert columns == sorted(names)
    a, b = rows_of(mine, columns), rows_of(theirs, columns)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for p, q in zip(x, y):
            assert p == q or isinstance(p, float) and isinstance(q, float) and abs(p - q) <= 2e-6 * max(1, abs(p)), (x, y)
