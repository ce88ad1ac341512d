"""All registered queries of the subpackage. Importing the modules registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from haulwise.llm import archive_queries, chat_queries, corpus_queries, mining_queries, token_queries  # noqa: F401 - registration
from haulwise.llm.registry import CHECKS, QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def checks() -> dict[str, str]:
    return dict(CHECKS)
