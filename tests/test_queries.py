"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from fathomline.registry import load
from fathomline.sources.bindings import TABLES

FOLDER = "/root/testdata/sf0.001"
TYPES = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
    "boolean": "BOOLEAN",
}
QUERIES = load()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    query = QUERIES[name]
    df = query.run(spark, FOLDER)
    got = df.collect()
    assert got
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if query.sql is None:
        return
    relation = duck.sql(query.oracle())
    assert sorted(relation.columns) == sorted(df.columns)
    kinds = dict(zip(relation.columns, map(str, relation.types)))
    assert {c: TYPES[k] for c, k in df.dtypes} == kinds
    columns = list(relation.columns)
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got) == sorted(map(repr, relation.fetchall()))
