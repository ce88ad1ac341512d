"""Queries on joins, aggregations, windows and sets over events and snapshots (inventory 2D to 2H)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from haulwise.functions.grading import heuristic_delay
from haulwise.functions.times import iso_text
from haulwise.operators import cleaning, enrich, latest, metrics, snapshots
from haulwise.plans.fixtures import check_sql, table, TABLES
from haulwise.plans.registry import NOW, Views, query, rounded

LATEST = """latest AS (
SELECT vehicle_id, warehouse_id, route_id, event_timestamp AS last_event_timestamp, delay_minutes, speed_kmh, latitude, longitude
FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY event_timestamp DESC, event_id DESC) AS rn FROM telemetry)
WHERE rn = 1)"""

WINDOWS = """windows AS (
SELECT time_bucket(INTERVAL 15 MINUTE, event_timestamp) AS window_start,
  time_bucket(INTERVAL 15 MINUTE, event_timestamp) + INTERVAL 15 MINUTE AS window_end, warehouse_id,
  avg(delay_minutes) AS avg_delay_minutes, avg(speed_kmh) AS avg_speed_kmh, max(event_timestamp) AS last_event_timestamp,
  count(*) AS event_count FROM telemetry GROUP BY 1, 2, 3)"""

WEATHER_FEATURES = """weather_features AS (
SELECT warehouse_id, time_bucket(INTERVAL 15 MINUTE, weather_timestamp) AS feature_window_start,
  avg(temperature_c) AS climate_temperature_c, avg(precipitation_mm) AS climate_precipitation_mm, avg(wind_kmh) AS climate_wind_kmh,
  avg(precipitation_mm) * 3.0 + avg(wind_kmh) * 0.15 AS climate_severity_score FROM weather GROUP BY 1, 2)"""

CONGESTION = """congestion AS (
SELECT warehouse_id, window_start AS feature_window_start, avg_delay_minutes AS congestion_avg_delay_minutes,
  avg_speed_kmh AS congestion_avg_speed_kmh, CAST(event_count AS DOUBLE) AS congestion_event_count,
  avg_delay_minutes * 1.5 + CASE WHEN avg_speed_kmh > 0 THEN 100.0 / avg_speed_kmh ELSE 0 END
    + CASE WHEN event_count > 0 THEN 10.0 / sqrt(event_count) ELSE 0 END AS congestion_pressure_score FROM windows)"""

FACTOR = """factor AS (
SELECT CASE WHEN count(*) = 0 THEN 0.0 ELSE least(CAST(0.10 AS DOUBLE) + CAST(0.70 AS DOUBLE) * least(avg(precipitation_mm) / 0.4, 2.0)
  + CAST(0.45 AS DOUBLE) * least(avg(wind_kmh) / 18.0, 2.0)
  + CASE WHEN bool_or(weather_code NOT IN ('0', '1')) THEN 0.25 ELSE 0.0 END, 2.5) END AS weather_factor FROM weather)"""


def latest_of(v: Views):
    return latest.latest_state(v("telemetry"))


# Joins -------------------------------------------------------------------------------------------------------------

@query("d1_enrich_events", check_sql("telemetry", "warehouses", "vehicles", body="""
SELECT t.*, warehouse_name, country, region, criticality, w.latitude AS warehouse_latitude, w.longitude AS warehouse_longitude,
  vehicle_type, capacity_kg, status
FROM telemetry t LEFT JOIN warehouses w USING (warehouse_id) LEFT JOIN vehicles USING (vehicle_id)"""))
def d1(v):
    return enrich.enrich_events(v("telemetry"), v("warehouses"), v("vehicles"))


@query("d4_add_context", check_sql("telemetry", "weather", extra=f"{WINDOWS},\n{WEATHER_FEATURES},\n{CONGESTION}", body="""
SELECT event_id, coalesce(climate_temperature_c, 18.0) AS climate_temperature_c,
  coalesce(climate_precipitation_mm, 0.0) AS climate_precipitation_mm, coalesce(climate_wind_kmh, 0.0) AS climate_wind_kmh,
  round(coalesce(climate_severity_score, 0.0), 6) AS climate_severity_score,
  coalesce(congestion_avg_delay_minutes, 0.0) AS congestion_avg_delay_minutes,
  coalesce(congestion_avg_speed_kmh, 0.0) AS congestion_avg_speed_kmh, coalesce(congestion_event_count, 0.0) AS congestion_event_count,
  round(coalesce(congestion_pressure_score, 0.0), 6) AS congestion_pressure_score
FROM (SELECT *, time_bucket(INTERVAL 15 MINUTE, event_timestamp) AS feature_window_start FROM telemetry)
LEFT JOIN weather_features USING (warehouse_id, feature_window_start) LEFT JOIN congestion USING (warehouse_id, feature_window_start)"""))
def d4(v):
    events = v("telemetry")
    congestion = enrich.congestion_features(metrics.compact_windows(metrics.delay_windows(events)))
    wide = enrich.add_context(events.select("event_id", "warehouse_id", "event_timestamp"), enrich.weather_features(v("weather")), congestion)
    return rounded(wide.drop("warehouse_id", "event_timestamp"), "climate_severity_score", "congestion_pressure_score")


@query("d4_add_context_lagged", check_sql("telemetry", "weather", extra=f"{WINDOWS},\n{CONGESTION}", body="""
SELECT event_id, coalesce(congestion_avg_delay_minutes, 0.0) AS congestion_avg_delay_minutes,
  coalesce(congestion_event_count, 0.0) AS congestion_event_count
FROM (SELECT *, time_bucket(INTERVAL 15 MINUTE, event_timestamp) - INTERVAL 15 MINUTE AS feature_window_start FROM telemetry)
LEFT JOIN congestion USING (warehouse_id, feature_window_start)"""))
def d4_lagged(v):
    events = v("telemetry")
    congestion = enrich.congestion_features(metrics.delay_windows(events))
    wide = enrich.add_context(
        events.select("event_id", "warehouse_id", "event_timestamp"), enrich.weather_features(v("weather")), congestion, lag_windows=1
    )
    return wide.select("event_id", "congestion_avg_delay_minutes", "congestion_event_count")


@query("d8_vertices_with_coords", check_sql("vertices", "warehouses", body="""
SELECT v.*, latitude, longitude FROM vertices v LEFT JOIN warehouses ON id = warehouse_id"""))
def d8(v):
    return enrich.vertices_with_coords(v("vertices"), v("warehouses"))


@query("d9_attach_plans", check_sql("telemetry", "plans", extra=LATEST, body="""
SELECT latest.*, planned_origin, planned_destination, planned_route_origin, planned_route_destination, planned_route_label
FROM latest LEFT JOIN plans USING (vehicle_id)"""))
def d9(v):
    return enrich.attach_plans(latest_of(v), v("plans"))


@query("d11_maintenance_rows", check_sql("telemetry", "vehicles", extra=LATEST, body="""
SELECT vehicle_id, '-' AS warehouse_id, '-' AS route_id, CAST(NULL AS TIMESTAMP) AS last_event_timestamp, CAST(0 AS INT) AS delay_minutes,
  CAST(0 AS DOUBLE) AS speed_kmh, CAST(NULL AS DOUBLE) AS latitude, CAST(NULL AS DOUBLE) AS longitude, 'maintenance' AS vehicle_status
FROM vehicles WHERE status = 'maintenance' AND vehicle_id NOT IN (SELECT vehicle_id FROM latest WHERE speed_kmh >= 40)"""))
def d11(v):
    vehicles = v("vehicles")
    present = enrich.attach_status(latest_of(v).filter("speed_kmh >= 40"), vehicles)
    return enrich.maintenance_rows(present, vehicles)


@query("d15_attach_status", check_sql("telemetry", "vehicles", extra=LATEST, body="""
SELECT vehicle_id, speed_kmh, coalesce(status, 'unknown') AS vehicle_status FROM latest
LEFT JOIN (SELECT * FROM vehicles WHERE vehicle_type = 'truck') USING (vehicle_id)"""))
def d15(v):
    return enrich.attach_status(latest_of(v).select("vehicle_id", "speed_kmh"), v("vehicles").filter("vehicle_type = 'truck'"))


# Aggregations ------------------------------------------------------------------------------------------------------

E1_SQL = """
SELECT time_bucket(INTERVAL 15 MINUTE, event_timestamp) AS window_start,
  time_bucket(INTERVAL 15 MINUTE, event_timestamp) + INTERVAL 15 MINUTE AS window_end,
  warehouse_id, warehouse_name, region, avg(delay_minutes) AS avg_delay_minutes, avg(speed_kmh) AS avg_speed_kmh, count(*) AS event_count
FROM telemetry LEFT JOIN warehouses USING (warehouse_id) GROUP BY ALL"""


@query("e1_delay_metrics", check_sql("telemetry", "warehouses", body=E1_SQL))
def e1(v):
    return delay_by_warehouse(v)


def delay_by_warehouse(v: Views):
    """Clean, deduplicate, enrich and average: the batch path from telemetry to 15-minute metrics.

    Only the columns of the metric are carried through the dedup shuffle.
    """
    needed = v("telemetry").select("event_id", "vehicle_id", "warehouse_id", "delay_minutes", "speed_kmh", "event_timestamp")
    events = metrics.dedup_events(cleaning.clean_events(needed))
    return metrics.delay_metrics(enrich.enrich_warehouses(events, v("warehouses")))


@query("e2_delay_windows", check_sql("telemetry", extra=WINDOWS, body="SELECT * FROM windows"))
def e2(v):
    return metrics.delay_windows(v("telemetry"))


@query("e3_weather_features", check_sql("weather", extra=WEATHER_FEATURES, body="""
SELECT * REPLACE (round(climate_severity_score, 6) AS climate_severity_score) FROM weather_features"""))
def e3(v):
    return rounded(enrich.weather_features(v("weather")), "climate_severity_score")


@query("e4_congestion_features", check_sql("telemetry", extra=f"{WINDOWS},\n{CONGESTION}", body="""
SELECT * REPLACE (round(congestion_pressure_score, 6) AS congestion_pressure_score) FROM congestion"""))
def e4(v):
    return rounded(enrich.congestion_features(metrics.delay_windows(v("telemetry"))), "congestion_pressure_score")


@query("e5_compact_windows", check_sql("telemetry", extra=WINDOWS, body="SELECT * FROM windows"))
def e5(v):
    full = metrics.delay_windows(v("telemetry"))
    partial = full.withColumns({"event_count": F.col("event_count") - 1, "avg_delay_minutes": F.col("avg_delay_minutes") + 1})
    return metrics.compact_windows(partial.unionByName(full))


@query("e6_dedup_events", check_sql("telemetry", body="""
SELECT * REPLACE (CAST(delay_minutes + 1 AS INT) AS delay_minutes) FROM telemetry"""))
def e6(v):
    return metrics.dedup_events(v("telemetry_dups"))


@query("e7_dedup_weather", check_sql("weather", body="""
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY weather_timestamp, temperature_c, precipitation_mm, wind_kmh,
  weather_code ORDER BY weather_event_id) AS rn FROM (SELECT * REPLACE (date_trunc('day', weather_timestamp) AS weather_timestamp)
  FROM weather)) WHERE rn = 1"""))
def e7(v):
    daily = v("weather").withColumn("weather_timestamp", F.date_trunc("day", "weather_timestamp"))
    blurred = daily.withColumn("wind_kmh", F.col("wind_kmh") + 0.01)
    return metrics.dedup_weather(blurred).withColumn("wind_kmh", F.round("wind_kmh", 1))


@query("e11_overview", check_sql("telemetry", body="""
SELECT count(DISTINCT vehicle_id) AS vehicles_active, count(*) AS events_loaded, avg(delay_minutes) AS avg_delay_minutes,
  avg(speed_kmh) AS avg_speed_kmh, max(event_timestamp) AS latest_event_time FROM telemetry"""))
def e11(v):
    return metrics.overview(v("telemetry"))


@query("e12_overview_latest", check_sql("telemetry", "vehicles", extra=LATEST, body="""
SELECT count(*) FILTER (WHERE status <> 'maintenance') AS vehicles_active, count(*) AS events_loaded,
  avg(delay_minutes) FILTER (WHERE status <> 'maintenance') AS avg_delay_minutes,
  avg(speed_kmh) FILTER (WHERE status <> 'maintenance') AS avg_speed_kmh, max(last_event_timestamp) AS latest_event_time
FROM latest JOIN vehicles USING (vehicle_id)"""))
def e12(v):
    return metrics.overview_latest(enrich.attach_status(latest_of(v), v("vehicles")))


@query("e13_weather_factor", check_sql("weather", extra=FACTOR, body="""
SELECT round(weather_factor, 6) AS weather_factor,
  CASE WHEN weather_factor < 0.45 THEN 'low' WHEN weather_factor < 0.95 THEN 'medium' ELSE 'high' END AS weather_impact_level FROM factor"""))
def e13(v):
    return rounded(metrics.weather_factor(v("weather")), "weather_factor")


@query("e18_table_counts", "\nUNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in TABLES))
def e18(v):
    return metrics.table_counts({t: table(v.spark, v.sf_dir, t) for t in TABLES})


@query("e20_distinct_pairs", check_sql("telemetry", body="SELECT DISTINCT vehicle_id, warehouse_id FROM telemetry"))
def e20(v):
    return v("telemetry").select("vehicle_id", "warehouse_id").distinct()


@query("e17_rmse", check_sql("telemetry", body="""
SELECT round(sqrt(avg(pow(delay_minutes - CASE WHEN speed_kmh < 30 THEN 14 WHEN speed_kmh < 50 THEN 8 ELSE 3 END, 2))), 6) AS rmse FROM telemetry"""))
def e17(v):
    scored = v("telemetry").select(F.col("delay_minutes").alias("label"), heuristic_delay("speed_kmh").alias("prediction"))
    return rounded(metrics.rmse(scored), "rmse")


# Windows -----------------------------------------------------------------------------------------------------------

@query("f1_latest_state", check_sql("telemetry", extra=LATEST, body="SELECT * FROM latest"))
def f1(v):
    return latest_of(v)


@query("f4_latest_weather", check_sql("weather", body="""
SELECT * REPLACE (weather_timestamp + INTERVAL 5 MINUTE AS weather_timestamp) FROM weather"""))
def f4(v):
    rows = v("weather")
    later = rows.withColumn("weather_timestamp", F.col("weather_timestamp") + F.expr("INTERVAL 5 MINUTES"))
    return metrics.latest_weather(rows.unionByName(later))


@query("f5_vehicle_history", check_sql("telemetry", body="""
SELECT vehicle_id, event_id, warehouse_id, route_id, delay_minutes, speed_kmh, latitude, longitude, event_timestamp
FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY event_timestamp DESC, event_id DESC) AS rn FROM telemetry)
WHERE rn <= 40"""))
def f5(v):
    return latest.vehicle_history(v("telemetry"), n=40)


@query("f6_downsample_trail", check_sql("telemetry", body="""
SELECT vehicle_id, event_id, position, total FROM (
  SELECT vehicle_id, event_id, row_number() OVER (PARTITION BY vehicle_id ORDER BY event_timestamp, event_id) AS position,
    count(*) OVER (PARTITION BY vehicle_id) AS total FROM telemetry)
WHERE total <= 16 OR (position - 1) % CAST(ceil(total / 16.0) AS BIGINT) = 0 OR position = total"""))
def f6(v):
    points = v("telemetry").select("vehicle_id", "event_id", "event_timestamp")
    return latest.downsample_trail(points).select("vehicle_id", "event_id", "position", "total")


@query("f2_top_edges", check_sql("snapshots", body="""
SELECT snapshot_hour, profile, min_congestion, entity_id AS top_edge_id, impact_score AS top_edge_impact_score,
  effective_avg_delay_minutes AS top_edge_delay_minutes, total_minutes AS top_edge_total_minutes,
  congestion_level AS top_edge_congestion_level, live_sample_count AS top_edge_live_sample_count
FROM (SELECT *, date_trunc('hour', snapshot_time) AS snapshot_hour, row_number() OVER (
  PARTITION BY date_trunc('hour', snapshot_time), profile, min_congestion
  ORDER BY impact_score DESC, rank, entity_id, snapshot_time DESC, total_minutes DESC) AS rn FROM snapshots WHERE entity_type = 'edge')
WHERE rn = 1"""))
def f2(v):
    return snapshots.top_edges(cleaning.normalize_snapshots(v("snapshots")))


@query("f3_top_nodes", check_sql("snapshots", body="""
SELECT snapshot_hour, profile, min_congestion, entity_id AS top_node_id, criticality_score AS top_node_criticality_score,
  effective_avg_delay_minutes AS top_node_avg_incident_delay_minutes, total_minutes AS top_node_avg_profile_minutes
FROM (SELECT *, date_trunc('hour', snapshot_time) AS snapshot_hour, row_number() OVER (
  PARTITION BY date_trunc('hour', snapshot_time), profile, min_congestion
  ORDER BY criticality_score DESC, rank, entity_id, snapshot_time DESC, total_minutes DESC) AS rn FROM snapshots WHERE entity_type = 'node')
WHERE rn = 1"""))
def f3(v):
    return snapshots.top_nodes(cleaning.normalize_snapshots(v("snapshots")))


TOPS = """ranked AS (SELECT *, date_trunc('hour', snapshot_time) AS snapshot_hour, row_number() OVER (
  PARTITION BY entity_type, date_trunc('hour', snapshot_time), profile, min_congestion
  ORDER BY coalesce(impact_score, criticality_score) DESC, rank, entity_id, snapshot_time DESC, total_minutes DESC) AS rn FROM snapshots),
e AS (SELECT * FROM ranked WHERE rn = 1 AND entity_type = 'edge'), n AS (SELECT * FROM ranked WHERE rn = 1 AND entity_type = 'node')"""


@query("d6_hourly_trends", check_sql("snapshots", extra=TOPS, body="""
SELECT snapshot_hour, profile, min_congestion, e.entity_id AS top_edge_id, e.impact_score AS top_edge_impact_score,
  e.effective_avg_delay_minutes AS top_edge_delay_minutes, e.total_minutes AS top_edge_total_minutes,
  e.congestion_level AS top_edge_congestion_level, e.live_sample_count AS top_edge_live_sample_count,
  n.entity_id AS top_node_id, n.criticality_score AS top_node_criticality_score,
  n.effective_avg_delay_minutes AS top_node_avg_incident_delay_minutes, n.total_minutes AS top_node_avg_profile_minutes
FROM e FULL OUTER JOIN n USING (snapshot_hour, profile, min_congestion)
ORDER BY snapshot_hour DESC, profile, min_congestion"""))
def d6(v):
    return snapshots.hourly_trends(cleaning.normalize_snapshots(v("snapshots")))


@query("e14_insights_history", check_sql("snapshots", body="""
SELECT snapshot_time,
  arg_max(entity_id, (impact_score, entity_id)) FILTER (WHERE entity_type = 'edge') AS top_edge_id,
  max(impact_score) FILTER (WHERE entity_type = 'edge') AS top_edge_impact_score,
  arg_max(entity_id, (criticality_score, entity_id)) FILTER (WHERE entity_type = 'node') AS top_node_id,
  max(criticality_score) FILTER (WHERE entity_type = 'node') AS top_node_criticality_score
FROM snapshots WHERE profile = 'balanced' AND min_congestion = 'all' AND rank = 1
GROUP BY snapshot_time ORDER BY snapshot_time DESC LIMIT 48"""))
def e14(v):
    return snapshots.insights_history(v("snapshots"), "balanced", "all", 48).drop("top_edge_level")


@query("h5_snapshots_for", check_sql("snapshots", body="""
SELECT strftime(snapshot_time, '%Y%m%d') AS bucket, * FROM snapshots WHERE snapshot_time >= TIMESTAMP '2024-01-29 00:00:00'
  AND snapshot_time < TIMESTAMP '2024-01-31 00:00:00'"""))
def h5(v):
    rows = cleaning.normalize_snapshots(v("snapshots")).drop("snapshot_hour")
    return snapshots.snapshots_for(rows, datetime.fromisoformat(NOW))


# Sources compared, fleet -----------------------------------------------------------------------------------------

@query("a12_prefer_fresh", check_sql("telemetry", extra=LATEST, body="""
SELECT vehicle_id, last_event_timestamp, 'fallback' AS source_used FROM latest
UNION ALL SELECT vehicle_id, last_event_timestamp + INTERVAL 2 HOUR, 'primary' FROM latest"""))
def a12(v):
    rows = latest_of(v).select("vehicle_id", "last_event_timestamp")
    older = rows.withColumn("last_event_timestamp", F.col("last_event_timestamp") - F.expr("INTERVAL 1 HOUR"))
    newer = rows.withColumn("last_event_timestamp", F.col("last_event_timestamp") + F.expr("INTERVAL 2 HOURS"))
    return latest.prefer_fresh(older, rows, "last_event_timestamp", 20).unionByName(
        latest.prefer_fresh(newer, rows, "last_event_timestamp", 20)
    )


@query("h1_fleet_latest", check_sql("telemetry", "vehicles", extra=LATEST, body="""
SELECT latest.*, status AS vehicle_status FROM latest JOIN vehicles USING (vehicle_id) WHERE speed_kmh >= 40
UNION ALL
SELECT vehicle_id, '-', '-', NULL, 0, 0.0, NULL, NULL, 'maintenance' FROM vehicles
WHERE status = 'maintenance' AND vehicle_id NOT IN (SELECT vehicle_id FROM latest WHERE speed_kmh >= 40)"""))
def h1(v):
    rows = latest_of(v).filter("speed_kmh >= 40")
    old = rows.withColumn("last_event_timestamp", F.col("last_event_timestamp") - F.expr("INTERVAL 1 HOUR"))
    return latest.fleet_latest(old, rows, v("vehicles"))


@query("i38_labels", check_sql("roads", "telemetry", body="""
SELECT concat(src, '->', dst) AS edge_label FROM roads UNION ALL
SELECT concat(strftime(event_timestamp, '%Y%m%d'), ' ', strftime(event_timestamp, '%Y-%m-%dT%H:%M:%SZ')) FROM telemetry"""))
def i38(v):
    from haulwise.functions.times import day_bucket, edge_label

    stamps = v("telemetry").select(F.concat_ws(" ", day_bucket("event_timestamp"), iso_text("event_timestamp")).alias("edge_label"))
    return v("roads").select(edge_label("src", "dst").alias("edge_label")).unionByName(stamps)
