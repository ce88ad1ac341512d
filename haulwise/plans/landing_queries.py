"""Queries on what lands and what is kept: stream input, overwriting sinks, catalogue set-up, all flows together, late rows, repair."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from haulwise.operators import cleaning, enrich, quality
from haulwise.plans.cleaning_queries import RAW, raw_lines, weather_lines
from haulwise.plans.fixtures import check_sql
from haulwise.plans.registry import Views, query
from haulwise.plans.system_queries import config, land, run_to_parquet, scratch, stream_of
from haulwise.session import cut_lineage
from haulwise.sinks import keyed, tables
from haulwise.sources.streams import StreamSource, read_event_stream
from haulwise.streaming import flows
from haulwise.streaming.progress import FlowLog

LATE_DELAY = "10 days"


def fresh_name(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex[:12]}"


def without_zone(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query("a4_read_event_stream", check_sql("telemetry", extra=RAW, body="""
SELECT event_id, vehicle_id, event_time FROM raw WHERE NOT cut UNION ALL SELECT NULL, NULL, NULL FROM raw WHERE cut"""))
def a4(v):
    """Lines of many files, read a few files at a time."""
    lines = land(v, raw_lines(v).repartition(6))
    stream = read_event_stream(v.spark, StreamSource(path=lines, max_files_per_trigger=2))
    return run_to_parquet(v, cleaning.parse_events(stream)).select("event_id", "vehicle_id", "event_time")


@query("b1_write_parquet", check_sql("telemetry", body="SELECT event_id, event_type, delay_minutes FROM telemetry"))
def b1(v):
    """The second write replaces all of the first, also where it has other partitions."""
    path = scratch(v)
    names = ["event_id", "event_type", "delay_minutes"]
    tables.write_parquet(v("telemetry_dups").select(*names).withColumn("event_type", F.lit("old")), path, ["event_type"])
    tables.write_parquet(v("telemetry").select(*names), path, ["event_type"])
    return v.spark.read.parquet(path)


@query("b2_save_table", check_sql("telemetry", body="SELECT event_id, delay_minutes FROM telemetry"))
def b2(v):
    """The second write replaces rows and schema of the first."""
    name = fresh_name("saved")
    tables.save_table(v("telemetry_dups"), name)
    tables.save_table(v("telemetry").select("event_id", "delay_minutes"), name)
    stored = cut_lineage(v.spark.table(name))
    tables.reset_stream_state(v.spark, [name], [])
    return stored


@query("b10_publish_masters", check_sql("warehouses", "vehicles", body="""
SELECT 'warehouses' AS master, warehouse_id AS id, criticality AS detail FROM warehouses
UNION ALL SELECT 'vehicles', vehicle_id, CAST(capacity_kg AS STRING) FROM vehicles"""))
def b10(v):
    """Both CSV masters as tables of one database, published twice."""
    folder, database = scratch(v), fresh_name("masters")
    for name in ("warehouses", "vehicles"):
        v(name).write.option("header", True).csv(f"{folder}/{name}.csv")
    v.spark.sql(f"CREATE DATABASE {database}")
    for _ in range(2):
        tables.publish_masters(v.spark, folder, database)
    stored = v.spark.table(f"{database}.master_warehouses").select(
        F.lit("warehouses").alias("master"), F.col("warehouse_id").alias("id"), F.col("criticality").alias("detail")
    ).unionByName(v.spark.table(f"{database}.master_vehicles").select(
        F.lit("vehicles").alias("master"), F.col("vehicle_id").alias("id"), F.col("capacity_kg").cast("string").alias("detail")
    ))
    stored = cut_lineage(stored)
    v.spark.sql(f"DROP DATABASE {database} CASCADE")
    return stored


@query("b11_ensure_schema", check_sql("weather", body="""
SELECT weather_event_id, warehouse_id, temperature_c, weather_timestamp AS weather_timestamp_utc,
  weather_timestamp + INTERVAL 1 HOUR AS weather_timestamp_local FROM weather"""))
def b11(v):
    """The set-up is repeated after rows came in: they stay, and the view shows them in winter time."""
    database = fresh_name("setup")
    tables.ensure_schema(v.spark, database)
    target = f"{database}.{tables.WEATHER_TABLE}"
    v("weather").withColumn("weather_timestamp", F.col("weather_timestamp").cast("timestamp")).select(
        *v.spark.table(target).columns
    ).write.insertInto(target)
    tables.ensure_schema(v.spark, database)
    shown = cut_lineage(v.spark.table(f"{database}.v_{tables.WEATHER_TABLE}_local").select(
        "weather_event_id", "warehouse_id", "temperature_c", "weather_timestamp_utc", "weather_timestamp_local"
    ))
    v.spark.sql(f"DROP DATABASE {database} CASCADE")
    return without_zone(shown, "weather_timestamp_utc", "weather_timestamp_local")


@query("d3_enrich_stream", check_sql("telemetry", "warehouses", "vehicles", body="""
SELECT event_id, warehouse_name, country, vehicle_type, capacity_kg
FROM telemetry LEFT JOIN warehouses USING (warehouse_id) LEFT JOIN vehicles USING (vehicle_id)"""))
def d3(v):
    events = stream_of(v, v("telemetry").select("event_id", "warehouse_id", "vehicle_id"))
    wide = enrich.enrich_events(events, v("warehouses"), v("vehicles"))
    return run_to_parquet(v, wide.select("event_id", "warehouse_name", "country", "vehicle_type", "capacity_kg"))


@query("k6_start_all", check_sql("telemetry", "weather", extra=RAW, body="""
SELECT 'delay_windows' AS flow, (SELECT count(*) FROM raw) AS rows_read,
  (SELECT count(*) FROM (SELECT DISTINCT time_bucket(INTERVAL 15 MINUTE, event_timestamp), warehouse_id FROM raw
    WHERE NOT cut AND vehicle_id IS NOT NULL)) AS rows_kept
UNION ALL SELECT 'latest_state', (SELECT count(*) FROM raw), (SELECT count(DISTINCT vehicle_id) FROM raw WHERE NOT cut)
UNION ALL SELECT 'weather', count(*), count(DISTINCT weather_event_id) FROM weather"""))
def k6(v):
    """The three main flows side by side over everything that landed: what each read, by the log, and what its store holds."""
    cfg = config(v, events=land(v, raw_lines(v)), weather=land(v, weather_lines(v)))
    with FlowLog(v.spark) as log:
        for started in flows.start_all(v.spark, cfg, v("warehouses"), v("vehicles")):
            log.wait_for(started)
        read = log.batches().groupBy("flow").agg(F.sum("rows_read").alias("rows_read"))
    tables.reset_stream_state(v.spark, [cfg.events_table, cfg.weather_table], [])
    stores = {"delay_windows": "delay_windows", "latest_state": "latest_state", "weather": "weather_recent"}
    kept = None
    for flow, store in stores.items():
        rows = keyed.read(v.spark, cfg.store(store)).agg(F.lit(flow).alias("flow"), F.count(F.lit(1)).alias("rows_kept"))
        kept = rows if kept is None else kept.unionByName(rows)
    return read.join(kept, "flow")


LATE_SQL = f"""clean AS (SELECT event_id, event_timestamp, n % 7 = 0 AS second FROM raw WHERE NOT cut AND vehicle_id IS NOT NULL),
mark AS (SELECT max(event_timestamp) - INTERVAL '{LATE_DELAY}' AS watermark FROM clean WHERE NOT second)"""


def _late_run(v: Views, folder: str, path: str, checkpoint: str, log: FlowLog) -> None:
    stream = flows.clean_event_stream(read_event_stream(v.spark, StreamSource(path=folder)), LATE_DELAY).select("event_id")
    writer = stream.writeStream.format("parquet").queryName("late").option("path", path).option("checkpointLocation", checkpoint)
    with flows.state_partitions(v.spark, v.spark.sparkContext.defaultParallelism):
        started = writer.trigger(availableNow=True).start()
    started.awaitTermination()
    log.wait_for(started)


@query("k7_late_rows", check_sql("telemetry", extra=f"{RAW},\n{LATE_SQL}", body="""
SELECT event_id, (SELECT count(*) FROM clean, mark WHERE second AND event_timestamp <= watermark) AS late_rows
FROM clean, mark WHERE NOT second OR event_timestamp > watermark"""))
def k7(v):
    """A seventh of the events lands after the rest was processed and the stream restarted: those behind the watermark are
    dropped, and the log says how many."""
    folder, path, checkpoint = scratch(v), scratch(v), scratch(v)
    with FlowLog(v.spark) as log:
        for where in ("n % 7 <> 0", "n % 7 = 0"):
            raw_lines(v, where).write.mode("append").text(folder)
            _late_run(v, folder, path, checkpoint, log)
        late = log.batches().agg(F.sum("late_rows").alias("late_rows")).scalar()
    return v.spark.read.parquet(path).select("event_id", late.alias("late_rows"))


@query("m5_repair_if_empty", check_sql("weather", body="""
SELECT weather_event_id, warehouse_id, date_trunc('second', weather_timestamp) AS weather_timestamp, 1 AS repairs FROM weather"""))
def m5(v):
    """A table that does not exist is reloaded; one with rows is left alone."""
    name = fresh_name("weather")
    export = v("weather").select(
        F.lit("all").alias("bucket"), *[F.col(c).cast("string").alias(c) for c in v("weather").columns if c != "weather_timestamp"],
        F.date_format("weather_timestamp", "yyyy-MM-dd HH:mm:ss").alias("weather_timestamp"),
    )
    repairs = sum(quality.repair_if_empty(v.spark, name, lambda: tables.reload_weather(export, name)) for _ in range(2))
    stored = cut_lineage(v.spark.table(name))
    tables.reset_stream_state(v.spark, [name], [])
    return without_zone(stored.select("weather_event_id", "warehouse_id", "weather_timestamp", F.lit(repairs).alias("repairs")), "weather_timestamp")


@query("m6_smoke_query", check_sql("telemetry", body="""
SELECT 'first' AS found, max(event_timestamp) AS event_timestamp FROM telemetry WHERE event_type = 'view'
UNION ALL SELECT 'second', max(event_timestamp) FROM telemetry"""))
def m6(v):
    """The newest row of the first table, and of the second where there is no first."""
    first, second = fresh_name("smoke"), fresh_name("smoke")
    tables.save_table(v("telemetry").filter("event_type = 'view'").select("event_timestamp"), first)
    tables.save_table(v("telemetry").select("event_timestamp"), second)
    both = quality.smoke_query(v.spark, first, second, "event_timestamp").withColumn("found", F.lit("first"))
    only = quality.smoke_query(v.spark, f"missing_{first}", second, "event_timestamp").withColumn("found", F.lit("second"))
    stored = cut_lineage(both.unionByName(only))
    tables.reset_stream_state(v.spark, [first, second], [])
    return stored
