"""Named queries over a folder of driver tables, each with the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from haulwise.plans import fixtures
from haulwise.session import apply_runtime_conf

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}

# The reference instant of every query that needs a clock.
NOW = "2024-01-30 23:59:00"


class Views:
    """Loads views by name for one session and folder; ``text`` is also valid Spark SQL for a literal instant."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return fixtures.view(self.spark, self.sf_dir, name)


def now():
    return F.expr(f"TIMESTAMP_NTZ '{NOW}'")


def query(name: str, check: str | None = None):
    """Register ``fn(views) -> DataFrame`` under ``name``."""

    def wrap(fn: Callable[[Views], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Views(apply_runtime_conf(spark), sf_dir))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if check is not None:
            CHECKS[name] = check
        return fn

    return wrap


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})
