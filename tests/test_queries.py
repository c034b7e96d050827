"""Every engine query that has SQL, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from tallyframe.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    return "nan" if isinstance(v, float) and v != v else repr(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    made, expected = df.collect(), db.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    at = [expected.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in made) == sorted(tuple(plain(r[i]) for i in at) for r in expected.fetchall())
