"""Queries on sources, sinks, streams, models, drift and quality (inventory 2A, 2B, 2K, 2L, 2M)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window, functions as F

from haulwise.operators import cleaning, drift, enrich, latest, learning, metrics, quality, telemetry
from haulwise.plans import check_parts as parts
from haulwise.plans.cleaning_queries import RAW, raw_lines, weather_lines
from haulwise.plans.fixtures import check_sql
from haulwise.plans.metric_queries import FACTOR, LATEST, WINDOWS, latest_of
from haulwise.plans.network_queries import LIVE_VIEWS, planned_latest
from haulwise.plans.registry import NOW, Views, now, query, rounded
from haulwise.session import cut_lineage, shared_dir
from haulwise.sinks import keyed, tables
from haulwise.sources import files
from haulwise.sources.streams import StreamSource
from haulwise.sources.tables import first_existing, read_keyed_table
from haulwise.streaming import flows, stateful


def scratch(v: Views) -> str:
    """A new folder in the shared area for the tables and checkpoints one query writes."""
    return f"{shared_dir(v.spark)}/{v.spark.sparkContext.applicationId}/query-{uuid.uuid4().hex}"


# Sources and sinks -------------------------------------------------------------------------------------------------

@query("a1_read_events_jsonl", check_sql("telemetry", extra=RAW, body="""
SELECT event_id, vehicle_id, event_time FROM raw WHERE NOT cut UNION ALL SELECT NULL, NULL, NULL FROM raw WHERE cut"""))
def a1(v):
    path = scratch(v)
    raw_lines(v).write.text(path)
    return files.read_events_jsonl(v.spark, path).select("event_id", "vehicle_id", "event_time")


@query("a2_read_master_csv", check_sql("warehouses", body="SELECT * FROM warehouses"))
def a2(v):
    from haulwise import schemas

    path = scratch(v)
    v("warehouses").write.option("header", True).csv(path)
    return files.read_master_csv(v.spark, path, schemas.WAREHOUSE)


@query("a7_csv_view", check_sql("vehicles", body="SELECT vehicle_id, CAST(capacity_kg AS STRING) AS capacity_kg, status FROM vehicles"))
def a7(v):
    path, name = scratch(v), f"export_{uuid.uuid4().hex[:12]}"
    v("vehicles").write.option("header", True).csv(path)
    files.csv_view(v.spark, path, name)
    return v.spark.table(name).select("vehicle_id", "capacity_kg", "status")


@query("a11_first_existing", check_sql("telemetry", extra=LATEST, body="SELECT vehicle_id, speed_kmh FROM latest"))
def a11(v):
    from haulwise import schemas

    name = f"latest_{uuid.uuid4().hex[:12]}"
    latest_of(v).createOrReplaceTempView(name)
    found = first_existing(v.spark, [f"missing_{name}", name], schemas.LATEST_STATE)
    nothing = first_existing(v.spark, [f"missing_{name}"], schemas.LATEST_STATE)
    return found.select("vehicle_id", "speed_kmh").unionByName(nothing.select("vehicle_id", "speed_kmh"))


@query("a3_read_edges_csv", check_sql("roads", body="SELECT * FROM roads"))
def a3(v):
    path = scratch(v)
    tables.write_edges(v("roads"), path)
    return files.read_edges_csv(v.spark, path, infer=True)


@query("b14_write_edges", check_sql("roads", body="""
SELECT src, dst, distance_km, row_number() OVER (ORDER BY distance_km, src, dst) AS line FROM roads"""))
def b14(v):
    """Edges written in order to many files; the line of each is found again from its part and its place there."""
    path = scratch(v)
    tables.write_edges(v("roads").repartition(16), path)
    parts_read = files.read_ordered_edges(v.spark, path)
    place = F.row_number().over(Window.partitionBy("part").orderBy("distance_km", "src", "dst"))
    sizes = parts_read.groupBy("part").count()
    # The rows before a part: a running sum over one row per file.
    before = sizes.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))
    return parts_read.withColumn("place", place).join(before, "part").select(
        "src", "dst", "distance_km", (F.col("place") + F.col("before")).alias("line")
    )


@query("a5_read_keyed_table", check_sql("telemetry", extra=LATEST, body="SELECT * FROM latest"))
def a5(v):
    path = scratch(v)
    keyed.upsert_latest(latest_of(v), path)
    return read_keyed_table(v.spark, path)


@query("a8_read_recent_files", check_sql("telemetry", extra=RAW, body="""
SELECT event_id, vehicle_id, event_timestamp FROM raw WHERE NOT cut AND vehicle_id IS NOT NULL
ORDER BY event_timestamp DESC, event_id DESC LIMIT 3000"""))
def a8(v):
    path = scratch(v)
    raw_lines(v).write.text(path)
    rows = files.read_recent_files(v.spark, path, max_files=1_000, max_rows=3_000)
    return rows.select("event_id", "vehicle_id", F.col("event_timestamp").cast("timestamp_ntz").alias("event_timestamp"))


SNAPSHOT_SQL = """docs AS (SELECT date_trunc('minute', weather_timestamp) AS observed_at, temperature_c, precipitation_mm, wind_kmh,
  CASE WHEN CAST(substr(weather_event_id, 3) AS BIGINT) % 5 = 0 THEN 'unknown' ELSE weather_code END AS weather_code
  FROM weather WHERE CAST(substr(weather_event_id, 3) AS BIGINT) % 19 <> 0)"""


def weather_documents(v: Views, *more) -> DataFrame:
    """Nested snapshots; some have no time, some no code."""
    n = F.expr("CAST(substr(weather_event_id, 3) AS BIGINT)")
    return v("weather").select(*more, F.lit("UTC").alias("timezone"), F.struct(
        F.when(n % 19 != 0, F.date_format("weather_timestamp", "yyyy-MM-dd'T'HH:mm")).alias("time"),
        F.col("temperature_c").alias("temperature_2m"), F.col("precipitation_mm").alias("precipitation"),
        F.col("wind_kmh").alias("wind_speed_10m"), F.when(n % 5 != 0, F.col("weather_code")).alias("weather_code"),
    ).alias("current"))


@query("a9_read_weather_snapshots", check_sql("weather", extra=SNAPSHOT_SQL, body="SELECT * FROM docs"))
def a9(v):
    """Files that each hold one array of some hundred documents over several lines, and a broken one."""
    path, batch = scratch(v), F.expr("CAST(substr(weather_event_id, 3) AS BIGINT) DIV 500").alias("batch")
    arrays = weather_documents(v, batch).groupBy("batch").agg(
        F.to_json(F.collect_list(F.struct("timezone", "current")), {"pretty": "true"}).alias("value")
    )
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
    v.spark.range(1).select(F.lit('[{"timezone": "UTC", "current": {').alias("value")).write.mode("append").text(path)
    rows = files.read_weather_snapshots(v.spark, path).drop("source", "timezone")
    return rows.withColumn("observed_at", F.col("observed_at").cast("timestamp_ntz"))


@query("i39_weather_event_id", check_sql("weather", extra=SNAPSHOT_SQL, body="""
SELECT concat('snap_', strftime(observed_at, '%Y%m%dT%H%M%SZ'), '_nightly_feed_', CAST(row_number() OVER (
  ORDER BY observed_at DESC, temperature_c, precipitation_mm, wind_kmh) - 1 AS STRING)) AS weather_event_id FROM docs"""))
def i39(v):
    rows = files.flatten_weather_snapshots(weather_documents(v), "nightly feed")
    return files.weather_event_id(rows).select("weather_event_id")


@query("a10_explode_plans", check_sql("plans", "plan_rows", body="""
SELECT p.vehicle_id, planned_origin, planned_destination, planned_route_origin, planned_route_destination, planned_route_label,
  array_to_string([planned_route_origin, concat('W', CAST(d AS STRING)), planned_route_destination], ',') AS stops
FROM plans p JOIN plan_rows USING (vehicle_id)"""))
def a10(v):
    rows = v("plan_rows")
    node = lambda c: F.concat(F.lit("W"), F.col(c).cast("string"))
    # Every other vehicle states its ends, every third its label; the rest follows from the node list.
    # Origins are given by alias, as are the first of the stops: WHn is the n-th of the sorted vertex ids.
    aliases = cleaning.warehouse_aliases(v("vertices")).withColumnRenamed("canonical_id", "origin")
    rows = rows.withColumn("origin", node("o")).join(aliases, "origin", "left")
    plan = F.struct(
        F.col("alias").alias("origin"), node("d").alias("destination"),
        F.when(F.col("user_id") % 2 == 0, node("o")).alias("planned_route_origin"),
        F.when(F.col("user_id") % 2 == 0, node("e")).alias("planned_route_destination"),
        F.array(F.col("alias"), F.lit(" "), node("d"), node("e")).alias("planned_route_nodes"),
        F.when(F.col("user_id") % 3 == 0, F.concat_ws(" -> ", node("o"), node("d"), node("e"))).alias("planned_route_label"),
    )
    documents = rows.select(F.to_json(F.create_map("vehicle_id", plan)).alias("value"))
    found = files.explode_plans(documents, v("vertices"))
    return found.withColumn("stops", F.array_join("planned_route_nodes", ",")).drop("planned_route_nodes")


@query("b3_append_or_fallback", check_sql("telemetry", body="SELECT event_id, speed_kmh FROM telemetry UNION ALL SELECT event_id, speed_kmh FROM telemetry"))
def b3(v):
    """Two batches: one creates the table, one does not fit, falls back to its folder and is replayed."""
    table, fallback = f"appended_{uuid.uuid4().hex[:12]}", scratch(v)
    rows = v("telemetry").select("event_id", "speed_kmh")
    tables.append_or_fallback(rows, table, fallback, 0)
    for _ in range(2):
        tables.append_or_fallback(rows.withColumnRenamed("speed_kmh", "speed"), table, fallback, 1)
    stored = cut_lineage(v.spark.table(table))
    tables.reset_stream_state(v.spark, [table], [])
    return stored.unionByName(v.spark.read.parquet(fallback).drop("batch").withColumnRenamed("speed", "speed_kmh"))


@query("b7_reload_weather", check_sql("weather", body="""
SELECT * REPLACE (date_trunc('second', weather_timestamp) AS weather_timestamp) FROM weather"""))
def b7(v):
    """Reload twice from an export that holds every row twice: the second load replaces the first."""
    table = f"weather_{uuid.uuid4().hex[:12]}"
    text = v("weather").select(
        F.lit("all").alias("bucket"), *[F.col(c).cast("string").alias(c) for c in v("weather").columns if c != "weather_timestamp"],
        F.date_format("weather_timestamp", "yyyy-MM-dd HH:mm:ss").alias("weather_timestamp"),
    )
    for _ in range(2):
        tables.reload_weather(text.unionByName(text), table)
    stored = cut_lineage(v.spark.table(table))
    tables.reset_stream_state(v.spark, [table], [])
    return stored.withColumn("weather_timestamp", F.col("weather_timestamp").cast("timestamp_ntz"))


@query("b5_upsert_latest", check_sql("telemetry", extra=LATEST, body="SELECT * FROM latest"))
def b5(v):
    """The newer half of the events first, then the older half: a late batch must not set any vehicle back."""
    path, events = scratch(v), v("telemetry")
    half = F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'")
    for part in (events.filter(F.col("event_timestamp") >= half), events.filter(F.col("event_timestamp") < half)):
        keyed.upsert_latest(latest.latest_state(part), path)
    return keyed.read(v.spark, path)


@query("b6_upsert_weather", check_sql("weather", body="SELECT * FROM weather"))
def b6(v):
    path, rows = scratch(v), v("weather")
    earlier = rows.withColumn("weather_timestamp", F.col("weather_timestamp") - F.expr("INTERVAL 5 MINUTES"))
    for batch in (rows, earlier):
        keyed.upsert_weather(batch, path)
    return keyed.read(v.spark, path)


@query("b13_upsert_retrain_state", check_sql("telemetry", extra="""
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY event_timestamp DESC, event_id DESC) AS rn FROM telemetry) WHERE rn = 1)""", body="""
SELECT vehicle_id AS model_name,
  CASE WHEN delay_minutes % 2 = 0 THEN event_timestamp ELSE TIMESTAMP '2023-12-01 00:00:00' END AS last_success_at,
  event_timestamp AS last_run_at, CASE WHEN delay_minutes % 2 = 0 THEN 'done' ELSE 'error' END AS last_status,
  CASE WHEN delay_minutes % 2 = 0 THEN speed_kmh ELSE 1.0 END AS last_selected_rmse FROM newest"""))
def b13(v):
    """One model per vehicle: the newest run of each meets the stored state."""
    done = F.col("delay_minutes") % 2 == 0
    none = F.lit(None).cast("double")
    runs = v("telemetry").select(
        F.col("vehicle_id").alias("model_name"), F.when(done, "done").otherwise("error").alias("status"),
        F.col("event_timestamp").alias("finished_at"), F.lit(None).cast("string").alias("selected_model"),
        none.alias("baseline_rmse"), none.alias("tuned_baseline_rmse"), none.alias("enhanced_rmse"),
        F.when(done, F.col("speed_kmh")).alias("selected_rmse"),
    )
    then = F.expr("TIMESTAMP_NTZ '2023-12-01 00:00:00'")
    state = v("vehicles").select(
        F.col("vehicle_id").alias("model_name"), then.alias("last_success_at"), then.alias("last_run_at"), F.lit("done").alias("last_status"),
        F.lit(True).alias("last_recommendation"), F.lit(60).alias("last_score"), F.lit("baseline_rf").alias("last_selected_model"),
        *[F.lit(1.0).alias(f"last_{c}_rmse") for c in ("baseline", "tuned_baseline", "enhanced", "selected")],
    )
    return drift.upsert_retrain_state(state, runs).select("model_name", "last_success_at", "last_run_at", "last_status", "last_selected_rmse")


# Streaming ---------------------------------------------------------------------------------------------------------

def land(v: Views, lines: DataFrame) -> str:
    path = scratch(v)
    lines.write.text(path)
    return path


def config(v: Views, **folders: str) -> flows.FlowConfig:
    nowhere = StreamSource(path="/nonexistent")
    sources = {name: StreamSource(path=path) for name, path in folders.items()}
    root = scratch(v)
    tag = uuid.uuid4().hex[:12]
    return flows.FlowConfig(
        events=sources.get("events", nowhere), weather=sources.get("weather", nowhere), root=root, once=True,
        events_table=f"events_{tag}", weather_table=f"weather_{tag}", state_partitions=v.spark.sparkContext.defaultParallelism,
    )


CLEAN = """clean AS (SELECT event_id, vehicle_id, warehouse_id, route_id, event_timestamp, coalesce(delay_minutes, 0) AS delay_minutes, speed_kmh
  FROM raw WHERE NOT cut AND vehicle_id IS NOT NULL)"""


@query("k3_window_stream", check_sql("telemetry", extra=f"{RAW},\n{CLEAN}", body="""
SELECT time_bucket(INTERVAL 15 MINUTE, event_timestamp) AS window_start, warehouse_id, avg(delay_minutes) AS avg_delay_minutes,
  avg(speed_kmh) AS avg_speed_kmh, max(event_timestamp) AS last_event_timestamp, count(*) AS event_count FROM clean GROUP BY 1, 2"""))
def k3(v):
    """JSON lines with every line sent twice, through dedup and windows into the keyed store."""
    lines = raw_lines(v)
    cfg = config(v, events=land(v, lines.unionByName(lines)))
    flows.run_window_stream(v.spark, cfg).awaitTermination()
    rows = keyed.read(v.spark, cfg.store("delay_windows")).drop("window_end")
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "last_event_timestamp")})


@query("k4_state_stream", check_sql("telemetry", extra=f"{RAW},\n{CLEAN}", body="""
SELECT vehicle_id, warehouse_id, route_id, event_timestamp AS last_event_timestamp, delay_minutes, speed_kmh FROM (
  SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY event_timestamp DESC, event_id DESC) AS rn FROM clean) WHERE rn = 1"""))
def k4(v):
    cfg = config(v, events=land(v, raw_lines(v)))
    flows.run_state_stream(v.spark, cfg, v("warehouses"), v("vehicles")).awaitTermination()
    tables.reset_stream_state(v.spark, [cfg.events_table], [])
    rows = keyed.read(v.spark, cfg.store("latest_state")).drop("latitude", "longitude")
    return rows.withColumn("last_event_timestamp", F.col("last_event_timestamp").cast("timestamp_ntz"))


@query("k5_weather_stream", check_sql("weather", body="""
SELECT * REPLACE (date_trunc('second', weather_timestamp) AS weather_timestamp) FROM weather"""))
def k5(v):
    cfg = config(v, weather=land(v, weather_lines(v)))
    flows.run_weather_stream(v.spark, cfg).awaitTermination()
    tables.reset_stream_state(v.spark, [cfg.weather_table], [])
    rows = keyed.read(v.spark, cfg.store("weather_recent"))
    return rows.withColumn("weather_timestamp", F.col("weather_timestamp").cast("timestamp_ntz"))


@query("k13_router_stream", check_sql("telemetry", extra=RAW, body="""
SELECT 'raw' AS route, count(*) AS line_count FROM raw WHERE NOT cut
UNION ALL SELECT 'filtered', count(*) FROM raw WHERE NOT cut AND delay_minutes >= 5
UNION ALL SELECT 'rejected', count(*) FROM raw WHERE cut"""))
def k13(v):
    cfg = config(v, events=land(v, raw_lines(v)))
    flows.run_router(v.spark, cfg).awaitTermination()
    return metrics.table_counts(
        {r: v.spark.read.parquet(cfg.store(f"routed/{r}")) for r in ("raw", "filtered", "rejected")}
    ).select(F.col("table_name").alias("route"), F.col("row_count").alias("line_count"))


@query("b12_archive_raw", check_sql("telemetry", extra=RAW, body="SELECT cut, count(*) AS line_count, TRUE AS named FROM raw GROUP BY cut"))
def b12(v):
    source, path, checkpoint = land(v, raw_lines(v)), scratch(v), scratch(v)
    for _ in range(2):  # the second run finds nothing new
        tables.archive_raw(v.spark.readStream.text(source), path, checkpoint).awaitTermination()
    cut = ~F.endswith("value", F.lit("}"))
    return v.spark.read.parquet(path).groupBy(cut.alias("cut")).agg(
        F.count(F.lit(1)).alias("line_count"), F.bool_and(F.col("source_file").rlike("^file:/.*/part-[^/]*$") & F.contains("source_file", F.lit(source))).alias("named")
    )


def run_to_parquet(v: Views, stream: DataFrame) -> DataFrame:
    path, checkpoint = scratch(v), scratch(v)
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    with flows.state_partitions(v.spark, v.spark.sparkContext.defaultParallelism):
        started = writer.trigger(availableNow=True).start()
    started.awaitTermination()
    return v.spark.read.parquet(path)


def stream_of(v: Views, df: DataFrame) -> DataFrame:
    path = scratch(v)
    df.write.parquet(path)
    return v.spark.readStream.schema(df.schema).parquet(path)


# Vehicles and routes of the tables report some three times a day.
SLOT_SECONDS = 7 * 86_400

WALK = """ordered AS MATERIALIZED (SELECT *, epoch_us(event_timestamp) / 1e6::DOUBLE AS sec,
  row_number() OVER (PARTITION BY vehicle_id ORDER BY event_timestamp, event_id) AS rn FROM telemetry)"""


@query("k10_stabilize_eta", check_sql("telemetry", recursive=True, extra=f"""{WALK},
steps AS MATERIALIZED (SELECT vehicle_id, rn, event_id, sec, speed_kmh + delay_minutes * 0.35::DOUBLE AS raw, warehouse_id AS place FROM ordered),
walk(vehicle_id, rn, event_id, shown, minutes, place, updated) AS (
  SELECT vehicle_id, rn, event_id, raw, raw, place, sec FROM steps WHERE rn = 1
  UNION ALL SELECT vehicle_id, rn, event_id, CASE WHEN anew THEN raw WHEN held THEN minutes ELSE smooth END,
    CASE WHEN anew THEN raw WHEN held THEN minutes ELSE smooth END, place, CASE WHEN held AND NOT anew THEN updated ELSE sec END
  FROM (SELECT s.*, w.minutes, w.updated, w.place <> s.place OR s.sec - w.updated > 86400 OR abs(s.raw - w.minutes) > greatest(45::DOUBLE, s.raw * 0.5::DOUBLE) AS anew,
    s.sec - w.updated < 2 AS held, w.minutes * 0.65::DOUBLE + 0.35::DOUBLE * (w.minutes + greatest(-bound, least(bound, s.raw - w.minutes))) AS smooth
    FROM walk w JOIN steps s ON s.vehicle_id = w.vehicle_id AND s.rn = w.rn + 1,
    LATERAL (SELECT greatest(7::DOUBLE, 18 * greatest(0.2::DOUBLE, (s.sec - w.updated) / 60)) AS bound)))""", body="""
SELECT vehicle_id, event_id, round(shown, 6) AS eta_minutes FROM walk"""))
def k10(v):
    """Sequential smoothing per vehicle, which starts anew after a day of silence."""
    raw = v("telemetry").select(
        "vehicle_id", "event_id", F.col("event_timestamp").cast("timestamp").alias("event_timestamp"),
        (F.col("speed_kmh") + F.col("delay_minutes") * 0.35).alias("raw_minutes"), F.col("warehouse_id").alias("destination"),
    )
    stable = run_to_parquet(v, stateful.stabilize_eta(stream_of(v, raw), "0 seconds", SLOT_SECONDS, idle_seconds=86_400))
    return rounded(stable.select("vehicle_id", "event_id", "eta_minutes"), "eta_minutes")


@query("k11_limit_jumps", check_sql("telemetry", recursive=True, extra=f"""{WALK},
walk(vehicle_id, rn, event_id, lat, lon) AS (
  SELECT vehicle_id, rn, event_id, latitude, longitude FROM ordered WHERE rn = 1
  UNION ALL SELECT vehicle_id, rn, event_id, CASE WHEN jump <= cap THEN latitude ELSE lat + (latitude - lat) * (cap / jump) END,
    CASE WHEN jump <= cap THEN longitude ELSE lon + (longitude - lon) * (cap / jump) END
  FROM (SELECT o.*, w.lat, w.lon, {parts.km('w.lat', 'w.lon', 'o.latitude', 'o.longitude')} AS jump,
    greatest(2::DOUBLE, least(8::DOUBLE, o.speed_kmh / 16 + 1.6::DOUBLE)) AS cap
    FROM walk w JOIN ordered o ON o.vehicle_id = w.vehicle_id AND o.rn = w.rn + 1))""", body="""
SELECT vehicle_id, event_id, round(lat, 6) AS latitude, round(lon, 6) AS longitude FROM walk"""))
def k11(v):
    """Sequential position limiter per vehicle."""
    points = v("telemetry").select(
        "vehicle_id", "event_id", F.col("event_timestamp").cast("timestamp").alias("event_timestamp"), "latitude", "longitude", "speed_kmh"
    )
    shown = run_to_parquet(v, stateful.limit_jumps(stream_of(v, points), "0 seconds", SLOT_SECONDS))
    return rounded(shown.drop("event_timestamp"), "latitude", "longitude")


THROTTLED = check_sql("telemetry", recursive=True, extra="""
times AS MATERIALIZED (SELECT DISTINCT route_id, event_timestamp AS t FROM telemetry),
following AS MATERIALIZED (SELECT a.route_id, a.t, min(b.t) AS nxt FROM times a LEFT JOIN times b
  ON b.route_id = a.route_id AND b.t >= a.t + INTERVAL 6 HOUR GROUP BY a.route_id, a.t),
picks(route_id, t) AS (SELECT route_id, min(t) FROM times GROUP BY route_id
  UNION ALL SELECT p.route_id, f.nxt FROM picks p JOIN following f ON f.route_id = p.route_id AND f.t = p.t WHERE f.nxt IS NOT NULL)""", body="""
SELECT {columns} FROM picks{more}""")


@query("k12_throttle_snapshots", THROTTLED.format(columns="route_id, t AS event_timestamp", more=""))
def k12(v):
    rows = v("telemetry").select("route_id", "event_timestamp").distinct()
    return stateful.throttle_snapshots(rows, ["route_id"], "event_timestamp", seconds=6 * 3600)


@query("k12_throttle_stream", THROTTLED.format(
    columns="e.route_id, e.event_timestamp, e.event_id, e.delay_minutes", more=" p JOIN telemetry e ON e.route_id = p.route_id AND e.event_timestamp = p.t"
))
def k12_stream(v):
    """The same choice made while the events stream in, a week's slot at a time."""
    at = F.col("event_timestamp").cast("timestamp").alias("event_timestamp")
    events = v("telemetry").select("route_id", at, "event_id", "delay_minutes")
    kept = run_to_parquet(v, stateful.throttle_stream(stream_of(v, events), ["route_id"], "event_timestamp", 6 * 3600, "0 seconds", SLOT_SECONDS))
    return kept.withColumn("event_timestamp", F.col("event_timestamp").cast("timestamp_ntz"))


# Models ------------------------------------------------------------------------------------------------------------

def events_in_context(v: Views) -> DataFrame:
    events = v("telemetry")
    wide = enrich.enrich_events(events, v("warehouses"), v("vehicles"))
    congestion = enrich.congestion_features(metrics.compact_windows(metrics.delay_windows(events)))
    return enrich.add_context(wide, enrich.weather_features(v("weather")), congestion)


FEATURES_SQL = """
SELECT {key}, vehicle_type, CAST(capacity_kg AS DOUBLE) AS capacity_kg,
  CASE criticality WHEN 'high' THEN 1.0::DOUBLE WHEN 'medium' THEN 0.6::DOUBLE WHEN 'low' THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END AS warehouse_criticality_score,
  CASE status WHEN 'active' THEN 1.0::DOUBLE WHEN 'maintenance' THEN 0.25::DOUBLE ELSE 0.6::DOUBLE END AS vehicle_status_score,
  round(sqrt(pow((t.latitude - w.latitude) * 111.32::DOUBLE, 2) + pow((t.longitude - w.longitude) * 85.39::DOUBLE, 2)), 6) AS distance_to_warehouse_km,
  round(sin(2 * pi() * hour(event_timestamp) / 24), 6) AS hour_sin
FROM {source} t JOIN warehouses w USING (warehouse_id) JOIN vehicles USING (vehicle_id)"""
FEATURES = ["vehicle_type", "capacity_kg", "warehouse_criticality_score", "vehicle_status_score", "distance_to_warehouse_km", "hour_sin"]


@query("l1_ml_features", check_sql("telemetry", "warehouses", "vehicles", body=FEATURES_SQL.format(key="event_id, CAST(delay_minutes AS DOUBLE) AS label", source="telemetry")))
def l1(v):
    rows = learning.ml_features(events_in_context(v)).select("event_id", "label", *FEATURES)
    return rounded(rows, "distance_to_warehouse_km", "hour_sin")


@query("l2_score_frame", check_sql("telemetry", "warehouses", "vehicles", extra="""newest AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY event_timestamp DESC, event_id DESC) AS rn FROM telemetry) WHERE rn = 1)""",
    body=FEATURES_SQL.format(key="vehicle_id", source="newest")))
def l2(v):
    return rounded(learning.score_frame(events_in_context(v)).select("vehicle_id", *FEATURES), "distance_to_warehouse_km", "hour_sin")


@query("l6_train_delay_models", check_sql("telemetry", body="""
SELECT unnest(['baseline_rf', 'tuned_baseline_rf', 'enhanced_rf']) AS candidate, TRUE AS fitted, TRUE AS selected_is_best"""))
def l6(v):
    """Fit, evaluate and select among the three production forests."""
    trained = learning.train_delay_models(learning.ml_features(events_in_context(v)))
    smallest = F.min("rmse").over(Window.partitionBy())
    return learning.metrics_frame(v.spark, trained).select(
        "candidate", F.col("rmse").isNotNull().alias("fitted"), (F.col("selected") == (F.col("rmse") == smallest)).alias("selected_is_best")
    )


@query("l8_score_latest", check_sql("telemetry", extra=LATEST, body="""
SELECT vehicle_id, warehouse_id, last_event_timestamp, TRUE AS level_agrees FROM latest"""))
def l8(v):
    """The newest event of every vehicle with the prediction of the best of the three production forests."""
    context = events_in_context(v)
    trained = learning.train_delay_models(learning.ml_features(context))
    scored = learning.score(trained.models[trained.selected], learning.score_frame(context))
    predicted = F.col("predicted_delay_minutes")
    level = F.when(predicted >= 10, "high").when(predicted >= 5, "medium").otherwise("low")
    return scored.select("vehicle_id", "warehouse_id", "last_event_timestamp", (F.col("risk_level") == level).alias("level_agrees"))


@query("l9_score_heuristic", check_sql("telemetry", extra=LATEST, body="""
SELECT vehicle_id, warehouse_id, last_event_timestamp, predicted_delay_minutes,
  CASE WHEN predicted_delay_minutes >= 10 THEN 'high' WHEN predicted_delay_minutes >= 5 THEN 'medium' ELSE 'low' END AS risk_level
FROM (SELECT *, CASE WHEN speed_kmh < 30 THEN 14.0::DOUBLE WHEN speed_kmh < 50 THEN 8.0::DOUBLE ELSE 3.0::DOUBLE END AS predicted_delay_minutes FROM latest)"""))
def l9(v):
    return learning.score_heuristic(latest.latest_rows(v("telemetry")))


# Drift, schedule, quality ------------------------------------------------------------------------------------------

ADVICE = f"""figures AS (SELECT avg(delay_minutes) FILTER (WHERE status <> 'maintenance') AS delay, max(last_event_timestamp) AS newest
  FROM latest JOIN vehicles USING (vehicle_id)),
cover AS (SELECT count(*) FILTER (WHERE live_sample_count > 0) AS n, count(*) FILTER (WHERE live_sample_count > 0) / count(*) AS ratio FROM live),
facts AS (SELECT delay, weather_factor, ratio, n, date_sub('second', newest, TIMESTAMP '{NOW}') / 3600.0::DOUBLE * 60 AS age,
  date_sub('second', TIMESTAMP '2024-01-20 11:59:00', TIMESTAMP '{NOW}') / 3600.0::DOUBLE AS hours FROM figures, cover, factor),
points AS (SELECT *, CASE WHEN hours >= 168 THEN 26 WHEN hours >= 72 THEN 12 ELSE 0 END
  + CASE WHEN delay >= 14 THEN 24 WHEN delay >= 9 THEN 12 ELSE 0 END + CASE WHEN weather_factor >= 1.2 THEN 8 ELSE 0 END
  + CASE WHEN ratio < 0.32 THEN 15 WHEN ratio < 0.5 THEN 7 ELSE 0 END + CASE WHEN age > 180 THEN 9 ELSE 0 END AS score FROM facts)"""


@query("m1_retrain_advice", check_sql(*LIVE_VIEWS, "weather", "vehicles", extra=f"{parts.LIVE},\n{FACTOR},\n{ADVICE}", body="""
SELECT score >= 55 AS recommended, CAST(score AS INT) AS score, 0.0::DOUBLE AS cooldown_remaining_hours, round(delay, 6) AS avg_delay_minutes,
  round(weather_factor, 6) AS weather_factor, round(ratio, 6) AS live_coverage_ratio, n AS edges_with_live_samples,
  round(age, 6) AS latest_event_age_minutes FROM points"""))
def m1(v):
    fleet = cut_lineage(enrich.attach_status(planned_latest(v), v("vehicles")))
    overview = metrics.overview_latest(fleet)
    live = telemetry.live_summary(telemetry.apply_live_telemetry(v("roads"), fleet), fleet)
    state = v.spark.range(1).select(
        F.expr("TIMESTAMP_NTZ '2024-01-20 11:59:00'").alias("last_success_at"), F.lit(True).alias("last_recommendation")
    )
    advice = drift.retrain_advice(overview, metrics.weather_factor(v("weather")), live, state, now()).drop("reasons")
    return rounded(advice, "avg_delay_minutes", "weather_factor", "live_coverage_ratio", "latest_event_age_minutes")


@query("m2_parse_model_log", check_sql("telemetry", body="""
SELECT speed_kmh AS baseline_rmse, speed_kmh + 1 AS tuned_baseline_rmse, speed_kmh + 2 AS enhanced_rmse, 'baseline_rf' AS selected_name,
  speed_kmh AS selected_rmse FROM telemetry WHERE CAST(substr(event_id, 9) AS BIGINT) % 3 = 0
ORDER BY event_timestamp DESC, event_id DESC LIMIT 1"""))
def m2(v):
    """A log in which every third line reports a training run."""
    speed = F.col("speed_kmh")
    line = F.concat(
        F.lit("INFO: A/B => baseline_rmse="), speed.cast("string"), F.lit(" | tuned_baseline_rmse="), (speed + 1).cast("string"),
        F.lit(" | enhanced_rmse="), (speed + 2).cast("string"), F.lit(" | selected=baseline_rf | selected_rmse="), speed.cast("string"),
    )
    run = F.expr("CAST(substr(event_id, 9) AS BIGINT)") % 3 == 0
    lines = v("telemetry").select(F.struct("event_timestamp", "event_id").alias("line_no"), F.when(run, line).otherwise("INFO: step done").alias("line"))
    return drift.parse_model_log(lines)


@query("m3_next_month_start", check_sql("telemetry", body="""
SELECT event_id, date_trunc('month', event_timestamp) + INTERVAL 1 MONTH AS next_scheduled_at FROM telemetry"""))
def m3(v):
    from haulwise.functions.times import next_month_start

    return v("telemetry").select("event_id", next_month_start("event_timestamp").alias("next_scheduled_at"))


@query("m4_quality_report", check_sql("telemetry_dups", body=f"""
SELECT 'telemetry' AS table_name, 'exists' AS check_name, TRUE AS passed, 1.0::DOUBLE AS measured
UNION ALL SELECT 'telemetry', 'not_empty', count(*) > 0, CAST(count(*) AS DOUBLE) FROM telemetry_dups
UNION ALL SELECT 'telemetry', 'no_null_keys', TRUE, 0.0
UNION ALL SELECT 'telemetry', 'no_duplicate_keys', count(*) = count(DISTINCT event_id), CAST(count(*) - count(DISTINCT event_id) AS DOUBLE) FROM telemetry_dups
UNION ALL SELECT 'telemetry', 'fresh', date_sub('second', max(event_timestamp), TIMESTAMP '{NOW}') <= 900,
  CAST(date_sub('second', max(event_timestamp), TIMESTAMP '{NOW}') AS DOUBLE) FROM telemetry_dups"""))
def m4(v):
    return quality.check_table(v("telemetry_dups"), quality.TableSpec("telemetry", ("event_id",), "event_timestamp"), now())


@query("m7_source_report", check_sql("telemetry", "weather", body=f"""
SELECT 'telemetry' AS source_name, count(*) AS row_count, count(*) FILTER (WHERE date_sub('second', event_timestamp, TIMESTAMP '{NOW}') <= 900) AS fresh_rows,
  count(*) FILTER (WHERE date_sub('second', event_timestamp, TIMESTAMP '{NOW}') > 900) AS stale_rows, max(event_timestamp) AS newest FROM telemetry
UNION ALL SELECT 'weather', count(*), count(*) FILTER (WHERE date_sub('second', weather_timestamp, TIMESTAMP '{NOW}') <= 900),
  count(*) FILTER (WHERE date_sub('second', weather_timestamp, TIMESTAMP '{NOW}') > 900), max(weather_timestamp) FROM weather"""))
def m7(v):
    return quality.source_report(
        {"telemetry": (v("telemetry"), "event_timestamp"), "weather": (v("weather"), "weather_timestamp")}, now()
    )


@query("m8_merge_run_status", check_sql("telemetry", extra=f"""{LATEST},
runs AS (SELECT vehicle_id, delay_minutes % 3 = 0 AS here, speed_kmh >= 50 AND date_sub('second', last_event_timestamp, TIMESTAMP '{NOW}') <= 21600 AS elsewhere,
  last_event_timestamp AS t FROM latest)""", body="""
SELECT vehicle_id AS run_key, CASE WHEN here OR elsewhere THEN 'running' ELSE 'idle' END AS status,
  CASE WHEN NOT here AND elsewhere THEN t END AS started_at,
  CASE WHEN here OR NOT elsewhere THEN t END AS finished_at, CASE WHEN NOT here AND elsewhere THEN 'from outside' ELSE 'own' END AS message,
  CASE WHEN NOT here AND elsewhere THEN 'scheduler' ELSE 'local' END AS source FROM runs"""))
def m8(v):
    rows = latest_of(v)
    none = F.lit(None).cast("timestamp_ntz")
    at = F.col("last_event_timestamp")
    live = rows.select(
        F.col("vehicle_id").alias("run_key"), F.when(F.col("delay_minutes") % 3 == 0, "Running").otherwise("idle").alias("status"),
        none.alias("started_at"), at.alias("finished_at"), F.lit("own").alias("message"), F.lit("local").alias("source"), at.alias("updated_at"),
    )
    external = rows.select(
        F.col("vehicle_id").alias("run_key"), F.when(F.col("speed_kmh") >= 50, " RUNNING").otherwise("gone").alias("status"),
        at.alias("started_at"), none.alias("finished_at"), F.lit("from outside").alias("message"), F.lit("scheduler").alias("source"),
        at.alias("updated_at"),
    )
    return drift.merge_run_status(live, external, now())
