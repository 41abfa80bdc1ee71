import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from wardcast.catalog import all_queries, all_sql

QUERIES, SQL = all_queries(), all_sql()
KINDS = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR"}


@pytest.fixture(scope="module")
def duck(folder):
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def comparable(row):
    return tuple(None if isinstance(v, float) and math.isnan(v) else v for v in row)


def rank(row):
    return tuple((v is None, 0 if v is None else v) for v in row)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, folder, name):
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    result = duck.execute(SQL[name])
    order = [d[0] for d in result.description]
    assert sorted(order) == columns
    assert {d[0]: str(d[1]) for d in result.description} == {c: KINDS[t] for c, t in df.dtypes}
    expected = sorted((comparable([r[order.index(c)] for c in columns]) for r in result.fetchall()), key=rank)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan and "BatchEvalPython" not in plan
    got = sorted((comparable([r[c] for c in columns]) for r in df.collect()), key=rank)
    assert got == expected


def test_registry_is_complete(spark):
    assert set(SQL) == set(QUERIES) and len(QUERIES) > 150
    assert set(QUERIES) <= set(entry_points.queries()) and set(SQL) <= set(entry_points.oracle_sql())
    assert entry_points.entry(spark).count() > 0
