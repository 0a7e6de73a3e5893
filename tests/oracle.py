"""Compare a query with its SQL in DuckDB, rows in any order."""

import decimal
import glob
import os

import duckdb


def text(v):
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, decimal.Decimal):
        return f"D{v.normalize():f}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(text, v)) + "]"
    return str(v)


def database(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def assert_equal(df, con, sql):
    cols = sorted(df.columns)
    got = sorted("|".join(text(r[c]) for c in cols) for r in df.collect())
    done = con.execute(sql)
    names = [d[0] for d in done.description]
    assert sorted(names) == cols
    want = sorted("|".join(text(r[names.index(c)]) for c in cols) for r in done.fetchall())
    assert got == want
    assert got
