"""Every query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from sedimenta.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    own = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        if f.endswith(".parquet"):
            own.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{SF}/{f}{'/*.parquet' if os.path.isdir(f'{SF}/{f}') else ''}')")
    return own


def cell(v):
    return "~" if v is None else f"{float(v):.9g}" if isinstance(v, (int, float)) else str(v)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(cell, r)) for r in df.select(*columns).collect())
    if name in catalogue.SQL:
        want = con.sql(f"SELECT {', '.join(f'\"{c}\"' for c in columns)} FROM ({catalogue.SQL[name]})").fetchall()
        assert got == sorted(tuple(map(cell, r)) for r in want)
