from __future__ import annotations

import tempfile

import pytest

from haulwise.session import build_session

SMALLEST = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    work = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    session = build_session(
        "haulwise-tests", "local[8]",
        {
            "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "6g",
            "spark.checkpoint.dir": f"{work}/checkpoints", "spark.sql.warehouse.dir": f"{work}/warehouse",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def rows(df, *columns):
    """Sorted tuples of the given (or all) columns, floats rounded."""
    cell = lambda v: round(v, 6) if isinstance(v, float) else v
    names = columns or df.columns
    return sorted((tuple(cell(r[c]) for c in names) for r in df.select(*names).collect()), key=repr)
