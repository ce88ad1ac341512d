"""Joins that widen events with masters, plans and window features."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from haulwise.functions.grading import congestion_pressure
from haulwise.operators.hotkeys import join_dimension


def enrich_warehouses(events: DataFrame, warehouses: DataFrame) -> DataFrame:
    places = warehouses.withColumnsRenamed({"latitude": "warehouse_latitude", "longitude": "warehouse_longitude"})
    return join_dimension(events, places, "warehouse_id")


def enrich_events(events: DataFrame, warehouses: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Left joins to both masters. Works on a stream too: the masters are the static side."""
    return join_dimension(enrich_warehouses(events, warehouses), vehicles, "vehicle_id")


def vertices_with_coords(vertices: DataFrame, warehouses: DataFrame) -> DataFrame:
    places = warehouses.select(F.col("warehouse_id").alias("id"), "latitude", "longitude")
    return vertices.join(places, "id", "left")


def attach_plans(rows: DataFrame, plans: DataFrame) -> DataFrame:
    return rows.join(plans, "vehicle_id", "left")


def attach_status(rows: DataFrame, vehicles: DataFrame) -> DataFrame:
    status = vehicles.select(
        "vehicle_id", F.coalesce(F.nullif(F.lower(F.trim("status")), F.lit("")), F.lit("unknown")).alias("vehicle_status")
    )
    return rows.join(status, "vehicle_id", "left").fillna("unknown", subset=["vehicle_status"])


def maintenance_rows(present: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Placeholder rows for vehicles in maintenance that sent nothing."""
    missing = vehicles.filter(F.lower(F.trim("status")) == "maintenance").select("vehicle_id").join(
        present.select("vehicle_id").distinct(), "vehicle_id", "left_anti"
    )
    types = {f.name: f.dataType for f in present.schema}
    fixed = {"warehouse_id": "-", "route_id": "-", "delay_minutes": 0, "speed_kmh": 0.0, "vehicle_status": "maintenance"}
    return missing.select(
        *["vehicle_id" if c == "vehicle_id" else F.lit(fixed.get(c)).cast(types[c]).alias(c) for c in present.columns]
    )


def add_maintenance_rows(rows: DataFrame, vehicles: DataFrame) -> DataFrame:
    return rows.unionByName(maintenance_rows(rows, vehicles))


def weather_features(weather: DataFrame) -> DataFrame:
    """15-minute averages per warehouse with their severity."""
    window = F.window("weather_timestamp", "15 minutes")
    return weather.groupBy("warehouse_id", window.alias("w")).agg(
        F.avg("temperature_c").alias("climate_temperature_c"),
        F.avg("precipitation_mm").alias("climate_precipitation_mm"),
        F.avg("wind_kmh").alias("climate_wind_kmh"),
    ).select(
        "warehouse_id", F.col("w.start").alias("feature_window_start"), "climate_temperature_c", "climate_precipitation_mm",
        "climate_wind_kmh",
        (F.col("climate_precipitation_mm") * 3.0 + F.col("climate_wind_kmh") * 0.15).alias("climate_severity_score"),
    )


def congestion_features(windows: DataFrame) -> DataFrame:
    return windows.select(
        "warehouse_id",
        F.col("window_start").alias("feature_window_start"),
        F.col("avg_delay_minutes").alias("congestion_avg_delay_minutes"),
        F.col("avg_speed_kmh").alias("congestion_avg_speed_kmh"),
        F.col("event_count").cast("double").alias("congestion_event_count"),
        congestion_pressure("avg_delay_minutes", "avg_speed_kmh", "event_count").alias("congestion_pressure_score"),
    )


# What an event gets when its window has no weather or congestion row.
CONTEXT_DEFAULTS = {
    "climate_temperature_c": 18.0, "climate_precipitation_mm": 0.0, "climate_wind_kmh": 0.0, "climate_severity_score": 0.0,
    "congestion_avg_delay_minutes": 0.0, "congestion_avg_speed_kmh": 0.0, "congestion_event_count": 0.0,
    "congestion_pressure_score": 0.0,
}


def add_context(events: DataFrame, weather: DataFrame, congestion: DataFrame, lag_windows: int = 0) -> DataFrame:
    """Join both feature tables on (warehouse, 15-minute window); each holds one row per key.

    ``lag_windows=1`` takes the congestion of the window before, so that a label cannot leak into its own features.
    """
    keys = ["warehouse_id", "feature_window_start"]
    shifted = congestion
    if lag_windows:
        step = F.expr(f"INTERVAL {15 * lag_windows} MINUTES")
        shifted = congestion.withColumn("feature_window_start", F.col("feature_window_start") + step)
    return (
        events.withColumn("feature_window_start", F.window("event_timestamp", "15 minutes")["start"])
        .join(weather, keys, "left")
        .join(shifted, keys, "left")
        .fillna(CONTEXT_DEFAULTS)
        .drop("feature_window_start")
    )
