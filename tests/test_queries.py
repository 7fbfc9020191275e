"""Every query with SQL gives DuckDB's rows over the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

from tracewright.plans import registry

DIR = os.environ.get("TRACEWRIGHT_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def canonical(v):
    if isinstance(v, float):
        return repr(round(v, 9))
    if isinstance(v, list | tuple):
        return str([canonical(x) for x in v])
    return str(v)


@pytest.fixture(scope="module")
def connection():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, connection, name):
    df = registry.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted(tuple(canonical(r[c]) for c in columns) for r in df.collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return
    result = connection.sql(sql)
    at = [result.columns.index(c) for c in columns]
    assert sorted(result.columns) == columns
    assert got == sorted(tuple(canonical(r[i]) for i in at) for r in result.fetchall())
