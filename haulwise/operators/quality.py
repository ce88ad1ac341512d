"""Data-quality report, repair and source diagnostics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from haulwise.functions.times import age_seconds
from haulwise.operators.cleaning import FRESH_SECONDS

CHECK_SCHEMA = "table_name string, check_name string, passed boolean, measured double"


@dataclass(frozen=True)
class TableSpec:
    """What a table has to satisfy. A missing ``key`` or ``ts`` skips the checks that need it."""

    name: str
    key: tuple[str, ...] = ()
    ts: str | None = None
    max_age_seconds: int = FRESH_SECONDS


def check_table(df: DataFrame, spec: TableSpec, now: Column) -> DataFrame:
    """One row per check. Figures come from one pass over per-key counts, so a hot key is counted map-side."""
    keys = [F.col(c) for c in spec.key]
    null_key = reduce(lambda a, b: a | b, [k.isNull() for k in keys]) if keys else F.lit(False)
    newest = F.max(spec.ts) if spec.ts else F.lit(None).cast("timestamp_ntz")
    if keys:
        per_key = df.groupBy(*spec.key).agg(F.count(F.lit(1)).alias("_n"), newest.alias("_newest"))
        figures = per_key.agg(
            F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(null_key, F.col("_n"))), F.lit(0)).alias("null_keys"),
            F.coalesce(F.sum(F.when(~null_key, F.col("_n") - 1)), F.lit(0)).alias("duplicates"), F.max("_newest").alias("newest"),
        )
    else:
        figures = df.agg(F.count(F.lit(1)).alias("n"), F.lit(0).alias("null_keys"), F.lit(0).alias("duplicates"), newest.alias("newest"))
    age = age_seconds(now, "newest")
    checks = [("exists", F.lit(True), F.lit(1.0)), ("not_empty", F.col("n") > 0, F.col("n"))]
    if keys:
        checks += [("no_null_keys", F.col("null_keys") == 0, F.col("null_keys")), ("no_duplicate_keys", F.col("duplicates") == 0, F.col("duplicates"))]
    if spec.ts:
        checks.append(("fresh", F.coalesce(age <= spec.max_age_seconds, F.lit(False)), age))
    rows = F.array(*[
        F.struct(F.lit(spec.name).alias("table_name"), F.lit(c).alias("check_name"), ok.alias("passed"), m.cast("double").alias("measured"))
        for c, ok, m in checks
    ])
    return figures.select(F.inline(rows))


def quality_report(spark: SparkSession, specs: list[TableSpec], now: Column) -> DataFrame:
    """All checks of all tables; a table that does not exist fails its one row."""
    parts = []
    for spec in specs:
        if spark.catalog.tableExists(spec.name):
            parts.append(check_table(spark.table(spec.name), spec, now))
        else:
            parts.append(spark.createDataFrame([(spec.name, "exists", False, 0.0)], CHECK_SCHEMA))
    return reduce(DataFrame.unionByName, parts)


def repair_if_empty(spark: SparkSession, table: str, reload: Callable[[], None]) -> bool:
    """Run ``reload`` when the table is missing or empty; True when it ran."""
    if spark.catalog.tableExists(table) and not spark.table(table).isEmpty():
        return False
    reload()
    return True


def smoke_query(spark: SparkSession, first: str, second: str, order: str, n: int = 1) -> DataFrame:
    """Newest rows of the first table, or of the second where the first does not exist."""
    name = first if spark.catalog.tableExists(first) else second
    return spark.table(name).orderBy(F.col(order).desc()).limit(n)


def source_report(sources: dict[str, tuple[DataFrame, str]], now: Column, max_age: int = FRESH_SECONDS) -> DataFrame:
    """Rows, newest time and fresh/stale counts of each source; ``sources`` maps a name to (frame, time column)."""
    parts = []
    for name, (df, ts) in sources.items():
        fresh = F.coalesce(age_seconds(now, ts) <= max_age, F.lit(False))
        parts.append(df.agg(
            F.count(F.lit(1)).alias("row_count"), F.count_if(fresh).alias("fresh_rows"), F.count_if(~fresh).alias("stale_rows"),
            F.max(F.col(ts).cast("timestamp_ntz")).alias("newest"),
        ).select(F.lit(name).alias("source_name"), "*"))
    return reduce(DataFrame.unionByName, parts)
