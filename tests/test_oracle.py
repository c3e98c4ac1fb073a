"""Every query with SQL agrees with DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tidewire.plans.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    found = duckdb.connect()
    found.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        found.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return found


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    expected = con.execute(ORACLE[name])
    names = [d[0] for d in expected.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, expected.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
