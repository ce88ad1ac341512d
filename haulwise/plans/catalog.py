"""All registered queries. Importing the modules registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from haulwise.plans import (  # noqa: F401 - registration
    cleaning_queries, landing_queries, metric_queries, network_queries, service_queries, system_queries,
)
from haulwise.plans.registry import CHECKS, QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def checks() -> dict[str, str]:
    return dict(CHECKS)
