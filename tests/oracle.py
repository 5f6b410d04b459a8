"""Compare a query with its SQL on the same tables."""

import decimal
import glob
import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connection(sf_dir=SF):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    assert not isinstance(v, decimal.Decimal), "cast decimals to double in the SQL"
    return str(v)


def compare(con, df, sql):
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[n]) for n in names) for r in df.collect())
    res = con.execute(sql)
    cols = [c[0] for c in res.description]
    assert sorted(cols) == names
    at = [cols.index(n) for n in names]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in res.fetchall())
