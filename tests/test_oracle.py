"""Every query of the catalog runs; those that SQL can express give the rows that DuckDB gives."""

import math

import duckdb
import pytest

from tidewrack.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DIR}/{name}.parquet'")
    return con


def order(row):
    return tuple((v is None, str(type(v)), round(v, 3) if isinstance(v, float) else v) for v in row)


def alike(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, DIR)
    rows = df.collect()
    assert rows and len(set(df.columns)) == len(df.columns)
    if name not in catalog.ORACLE_SQL:
        return
    want = con.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted((tuple(r[n] for n in names) for r in rows), key=order)
    expected = sorted(want.fetchall(), key=order)
    assert len(got) == len(expected)
    for a, b in zip(got, expected):
        assert all(map(alike, a, b)), (a, b)
