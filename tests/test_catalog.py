"""Every query against its SQL, on the smallest tables."""

from __future__ import annotations

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SMALL
from lurewatch.plans.catalog import REGISTERED

TABLES = ("documents", "pages", "events", "labels")
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return float(value)
    return value if isinstance(value, (str, bool)) else str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in data)


@pytest.mark.parametrize("name", list(REGISTERED))
def test_query_equals_sql(spark, database, name):
    result = database.execute(SQL[name])
    columns = [c[0] for c in result.description]
    expected = rows(columns, result.fetchall())
    df = REGISTERED[name](spark, SMALL)
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == expected
    assert expected
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_entry(spark):
    assert entry.entry(spark).count() == 200
    assert set(REGISTERED) <= set(SQL) <= set(entry.queries())
