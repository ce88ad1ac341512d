"""Table and file sinks."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from haulwise import schemas
from haulwise.session import cut_lineage
from haulwise.sources.files import read_master_csv

log = logging.getLogger(__name__)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def save_table(df: DataFrame, name: str) -> None:
    df.write.mode("overwrite").saveAsTable(name)


def append_or_fallback(df: DataFrame, table: str, fallback: str, batch_id: int | None = None) -> str:
    """Append to a table, created from the frame's schema if missing; on failure write to a folder instead.

    With a ``batch_id`` that folder is the batch's own, so a replay replaces what it diverted before, and one that reaches
    the table removes it. Returns where the rows went: "table", "fallback" or "empty".
    """
    if df.isEmpty():
        return "empty"
    spark, folder = df.sparkSession, fallback if batch_id is None else f"{fallback}/batch={batch_id}"
    try:
        if not spark.catalog.tableExists(table):
            df.limit(0).write.mode("ignore").saveAsTable(table)
        df.select(*spark.table(table).columns).write.insertInto(table)
    except Exception as error:  # the stream must go on: keep the rows and say so
        log.warning("append to %s failed, rows go to %s: %s", table, folder, error)
        df.write.mode("append" if batch_id is None else "overwrite").parquet(folder)
        return "fallback"
    if batch_id is not None and path_exists(spark, folder):
        remove_path(spark, folder)
    return "table"


def _diverted(spark: SparkSession, fallback: str) -> DataFrame | None:
    if not path_exists(spark, fallback):
        return None
    rows = spark.read.option("mergeSchema", True).parquet(fallback)
    return rows.drop("batch")


def read_appended(spark: SparkSession, table: str, fallback: str) -> DataFrame:
    """The rows of a table together with those that were diverted; a column that one side lacks is NULL there."""
    rows, diverted = spark.table(table), _diverted(spark, fallback)
    return rows if diverted is None else rows.unionByName(diverted, allowMissingColumns=True)


def restore_diverted(spark: SparkSession, table: str, fallback: str, key: str) -> int:
    """Bring diverted rows into their table, then delete the folder; returns how many came in.

    Rows are fitted by column name: missing columns are NULL, further ones are left out, values that do not fit a column's type are
    NULL. Keys that the table holds already are passed over, so a restore that was interrupted after its insert adds nothing.
    """
    diverted = _diverted(spark, fallback)
    if diverted is None:
        return 0
    stored, names = spark.table(table), {name.lower() for name in diverted.columns}
    fitted = diverted.select(*[
        (F.col(f.name).try_cast(f.dataType) if f.name.lower() in names else F.lit(None).cast(f.dataType)).alias(f.name) for f in stored.schema
    ])
    # Written first: the insert must not read the table that it changes.
    rows = cut_lineage(fitted.join(stored.select(key), key, "left_anti").select(*stored.columns))
    rows.write.insertInto(table)
    remove_path(spark, fallback)
    return rows.count()


def without_stored(batch: DataFrame, table: str, key: str, ts: str) -> DataFrame:
    """Rows of a batch whose key the table does not hold yet; only stored rows as new as the batch's oldest are read."""
    spark = batch.sparkSession
    if not spark.catalog.tableExists(table):
        return batch
    oldest = batch.agg(F.min(ts).alias("oldest")).scalar()
    stored = spark.table(table).filter(F.col(ts) >= oldest).select(key)
    return batch.join(stored, key, "left_anti")


def publish_masters(spark: SparkSession, folder: str, database: str) -> None:
    for name, schema in (("warehouses", schemas.WAREHOUSE), ("vehicles", schemas.VEHICLE)):
        save_table(read_master_csv(spark, f"{folder}/{name}.csv", schema), f"{database}.master_{name}")


DELAY_TABLE, WEATHER_TABLE = "delay_metrics_streaming", "weather_observations_streaming"


def ensure_schema(spark: SparkSession, database: str, zone: str = "Europe/Madrid") -> None:
    """Database, streaming tables and their local-time views; safe to repeat."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, schema in ((DELAY_TABLE, schemas.DELAY_WINDOW), (WEATHER_TABLE, schemas.WEATHER)):
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")
    for name, times in ((DELAY_TABLE, ("window_start", "window_end")), (WEATHER_TABLE, ("weather_timestamp",))):
        rest = [f.name for f in spark.table(f"{database}.{name}").schema if f.name not in times]
        shown = ", ".join(
            rest + [f"{t} AS {t}_utc" for t in times] + [f"from_utc_timestamp({t}, '{zone}') AS {t}_local" for t in times]
        )
        spark.sql(f"CREATE OR REPLACE VIEW {database}.v_{name}_local AS SELECT {shown} FROM {database}.{name}")


def archive_raw(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Bronze copy of raw lines by ingest day, each with the whole path of its source file; the checkpoint makes it exactly once per source file."""
    stamped = stream.withColumns({"source_file": F.col("_metadata.file_path"), "ingested_at": F.current_timestamp(), "ingest_date": F.current_date()})
    return (
        stamped.writeStream.format("parquet").partitionBy("ingest_date").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def reload_weather(source: DataFrame, target: str) -> None:
    """Replace the weather table by the cleaned export, one row per event id."""
    from haulwise.operators.cleaning import normalize_weather_export
    from haulwise.operators.metrics import latest_weather

    columns = [f.name for f in schemas.WEATHER]
    rows = latest_weather(normalize_weather_export(source)).select(*columns)
    if not source.sparkSession.catalog.tableExists(target):
        rows.limit(0).write.saveAsTable(target)
    rows.write.insertInto(target, overwrite=True)


def write_edges(edges: DataFrame, path: str) -> None:
    """CSV files in order of (distance, src, dst): every part is sorted and parts follow each other by the number in their names."""
    edges.select("src", "dst", "distance_km", "avg_delay_minutes").orderBy("distance_km", "src", "dst").write.mode("overwrite").option(
        "header", True
    ).csv(path)


def write_snapshots(snapshots: DataFrame, path: str) -> None:
    snapshots.write.mode("append").partitionBy("bucket").parquet(path)


def remove_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def reset_stream_state(spark: SparkSession, tables: list[str], paths: list[str]) -> None:
    for table in tables:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    for path in paths:
        remove_path(spark, path)
