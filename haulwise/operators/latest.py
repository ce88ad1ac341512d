"""Latest state per vehicle, histories, trails and headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from haulwise.functions.geo import bearing_deg, haversine_km
from haulwise.operators.enrich import add_maintenance_rows, attach_status
from haulwise.operators.cleaning import filter_fleet
from haulwise.operators.hotkeys import first_per_key, lag_by_key, rank_by_key

TRAIL_POINTS = 16
MIN_MOVE_KM = 0.02


def latest_rows(events: DataFrame) -> DataFrame:
    return first_per_key(events, ["vehicle_id"], [F.col("event_timestamp").desc(), F.col("event_id").desc()])


def latest_state(events: DataFrame) -> DataFrame:
    needed = events.select(
        "vehicle_id", "warehouse_id", "route_id", "event_timestamp", "event_id", "delay_minutes", "speed_kmh", "latitude", "longitude"
    )
    return latest_rows(needed).select(
        "vehicle_id", "warehouse_id", "route_id", F.col("event_timestamp").alias("last_event_timestamp"), "delay_minutes",
        "speed_kmh", "latitude", "longitude",
    )


def newest_of(df: DataFrame, ts: str) -> Column:
    """Scalar subquery: the newest time of a frame."""
    return df.agg(F.max(ts).alias("newest")).scalar()


def prefer_fresh(primary: DataFrame, fallback: DataFrame, ts: str, margin_seconds: int) -> DataFrame:
    """The primary source, unless it is empty or more than the margin older than the fallback."""
    mine, other = newest_of(primary, ts), newest_of(fallback, ts)
    stale = F.coalesce(F.timestamp_diff("SECOND", mine, other) > margin_seconds, mine.isNull())
    columns = primary.columns
    return (
        primary.filter(~stale).select(*columns, F.lit("primary").alias("source_used"))
        .unionByName(fallback.filter(stale).select(*columns, F.lit("fallback").alias("source_used")))
    )


def fleet_latest(primary: DataFrame, fallback: DataFrame, vehicles: DataFrame, margin_seconds: int = 20) -> DataFrame:
    """Latest fleet rows from the better source, with status and rows for silent vehicles in maintenance."""
    rows = prefer_fresh(filter_fleet(primary, vehicles), filter_fleet(fallback, vehicles), "last_event_timestamp", margin_seconds)
    return add_maintenance_rows(attach_status(rows.drop("source_used"), vehicles), vehicles)


def vehicle_history(events: DataFrame, vehicle: str | None = None, n: int = 120) -> DataFrame:
    """The last ``n`` points of each vehicle (or of one)."""
    rows = events if vehicle is None else events.filter(F.col("vehicle_id") == vehicle)
    rows = rows.select(
        "vehicle_id", "event_id", "warehouse_id", "route_id", "delay_minutes", "speed_kmh", "latitude", "longitude", "event_timestamp"
    )
    return first_per_key(rows, ["vehicle_id"], [F.col("event_timestamp").desc(), F.col("event_id").desc()], n)


def downsample_trail(points: DataFrame, n: int = TRAIL_POINTS) -> DataFrame:
    """Keep short trails whole; of longer ones every ceil(total / n)-th point and the last."""
    ranked = rank_by_key(points, "vehicle_id", "event_timestamp", "event_id")
    step = F.ceil(F.col("total") / n)
    keep = (F.col("total") <= n) | ((F.col("position") - 1) % step == 0) | (F.col("position") == F.col("total"))
    return ranked.filter(keep)


def headings(events: DataFrame) -> DataFrame:
    """Bearing from the previous point of the same vehicle; NULL when it hardly moved."""
    moved = lag_by_key(
        events, "vehicle_id", "event_timestamp", "event_id", {"prev_latitude": "latitude", "prev_longitude": "longitude"}
    )
    km = haversine_km("prev_latitude", "prev_longitude", "latitude", "longitude")
    return moved.withColumn("moved_km", km).withColumn(
        "heading", F.when(F.col("moved_km") >= MIN_MOVE_KM, bearing_deg("prev_latitude", "prev_longitude", "latitude", "longitude"))
    )


def latest_heading(events: DataFrame) -> DataFrame:
    """(vehicle_id, bearing) between the last two points of each vehicle."""
    two = first_per_key(
        events.select("vehicle_id", "event_id", "event_timestamp", "latitude", "longitude"),
        ["vehicle_id"], [F.col("event_timestamp").desc(), F.col("event_id").desc()], 2, rank="_n",
    )
    last, before = [
        {c: F.max(F.when(F.col("_n") == n, F.col(c))) for c in ("latitude", "longitude")} for n in (1, 2)
    ]
    return two.groupBy("vehicle_id").agg(
        bearing_deg(before["latitude"], before["longitude"], last["latitude"], last["longitude"]).alias("bearing")
    )
