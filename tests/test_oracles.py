"""Every query with SQL gives the rows that DuckDB gives, at the smallest size."""

import os
from collections import Counter

import pytest

from weftline import catalog

FOLDER = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{FOLDER}/{file}'")
    return con


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = catalog.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    mine = Counter(tuple(repr(r[c]) for c in columns) for r in df.collect())
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    theirs = Counter(tuple(repr(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert mine == theirs


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, FOLDER).columns
    catalog.queries()[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
