"""Catalog tables, keyed serving tables and the choice between sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

from haulwise.sinks import keyed


def read_keyed_table(spark: SparkSession, name: str, keyspace: str | None = None) -> DataFrame:
    """A keyed serving table: from a Cassandra connector when a keyspace is named, else from the catalog, a keyed store or Parquet files."""
    if keyspace:
        return spark.read.format("org.apache.spark.sql.cassandra").options(keyspace=keyspace, table=name).load()
    if "/" in name:
        return keyed.read(spark, name) if keyed.is_store(spark, name) else spark.read.parquet(name)
    return spark.table(name)


def first_existing(spark: SparkSession, names: list[str], empty_schema: T.StructType) -> DataFrame:
    """The first table of ``names`` that exists, or an empty frame of the given schema."""
    for name in names:
        if spark.catalog.tableExists(name):
            return spark.table(name)
    return spark.createDataFrame([], empty_schema)
