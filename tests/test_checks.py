"""Every registered query against its DuckDB check on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry_module
from tests.conftest import SMALLEST

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALLEST}/{name}.parquet'")
    return connection


def cell(value):
    return repr(round(value, 9) + 0.0) if isinstance(value, float) else repr(value)


@pytest.mark.parametrize("name", list(entry_module.queries()))
def test_query_equals_check(spark, con, name):
    df = entry_module.queries()[name](spark, SMALLEST)
    order = sorted(df.columns)
    ours = sorted(tuple(cell(r[c]) for c in order) for r in df.collect())
    plan = df._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    if name not in entry_module.oracle_sql():
        assert ours
        return
    result = con.execute(entry_module.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == order
    expected = sorted(tuple(cell(dict(zip(names, r))[c]) for c in order) for r in result.fetchall())
    assert ours == expected


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_every_check_belongs_to_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
