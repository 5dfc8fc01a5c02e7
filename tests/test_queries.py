"""Every registered query of the library against its SQL at the smallest size."""

import math

import duckdb
import pytest

from astroloom.plans.registry import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda x: ("nan" if math.isnan(x) else repr(round(x, 9) + 0.0)) if isinstance(x, float) else repr(x)
    return sorted(tuple(value(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, small, name):
    df = QUERIES[name](spark, small)
    got = [tuple(r) for r in df.collect()]
    if name in ORACLE_SQL:
        want = con.sql(ORACLE_SQL[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert plain(got, df.columns) == plain(want.fetchall(), want.columns)
    else:
        assert got
