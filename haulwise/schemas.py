"""Declared schemas of files, topics and keyed tables."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(),
    "boolean": T.BooleanType(), "timestamp": T.TimestampType(),
}


def _struct(spec: str) -> T.StructType:
    """Flat schema from "name type, name type, ..."; needs no running session."""
    pairs = (field.split() for field in spec.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


# Raw events are read as text: casting happens in the cleaning step, where a bad value becomes NULL instead of an error.
EVENT_RAW = _struct(
    "event_id string, vehicle_id string, warehouse_id string, route_id string, event_type string, "
    "latitude string, longitude string, speed_kmh string, delay_minutes string, event_time string"
)
EVENT = _struct(
    "event_id string, vehicle_id string, warehouse_id string, route_id string, event_type string, latitude double, "
    "longitude double, speed_kmh double, delay_minutes int, event_timestamp timestamp"
)
WEATHER_RAW = _struct(
    "weather_event_id string, warehouse_id string, temperature_c string, precipitation_mm string, wind_kmh string, "
    "weather_code string, source string, observation_time string"
)
WEATHER = _struct(
    "weather_event_id string, warehouse_id string, temperature_c double, precipitation_mm double, wind_kmh double, "
    "weather_code string, source string, weather_timestamp timestamp"
)
_CURRENT = _struct("time string, temperature_2m double, precipitation double, wind_speed_10m double, weather_code string")
WEATHER_SNAPSHOT = T.StructType([T.StructField("timezone", T.StringType()), T.StructField("current", _CURRENT)])
WAREHOUSE = _struct(
    "warehouse_id string, warehouse_name string, country string, region string, criticality string, "
    "latitude double, longitude double"
)
VEHICLE = _struct("vehicle_id string, vehicle_type string, capacity_kg int, status string")
VERTEX = _struct("id string, name string, type string, criticality string")
EDGE = _struct("src string, dst string, distance_km double, avg_delay_minutes double")
_PLAN = T.StructType(
    [T.StructField(name, T.StringType()) for name in ("origin", "destination", "planned_route_origin", "planned_route_destination")]
    + [T.StructField("planned_route_nodes", T.ArrayType(T.StringType())), T.StructField("planned_route_label", T.StringType())]
)
PLAN_DOCUMENT = T.MapType(T.StringType(), _PLAN)
DELAY_WINDOW = _struct(
    "window_start timestamp, window_end timestamp, warehouse_id string, avg_delay_minutes double, "
    "avg_speed_kmh double, last_event_timestamp timestamp, event_count bigint"
)
LATEST_STATE = _struct(
    "vehicle_id string, warehouse_id string, route_id string, last_event_timestamp timestamp, delay_minutes int, "
    "speed_kmh double, latitude double, longitude double"
)
INSIGHT_SNAPSHOT = _struct(
    "bucket string, entity_type string, profile string, min_congestion string, snapshot_time timestamp, rank int, "
    "entity_id string, impact_score double, criticality_score double, effective_avg_delay_minutes double, "
    "total_minutes double, congestion_level string, live_sample_count int"
)
RETRAIN_STATE = _struct(
    "model_name string, last_success_at timestamp, last_run_at timestamp, last_status string, "
    "last_recommendation boolean, last_score int, last_selected_model string, last_baseline_rmse double, "
    "last_tuned_baseline_rmse double, last_enhanced_rmse double, last_selected_rmse double, updated_at timestamp"
)
