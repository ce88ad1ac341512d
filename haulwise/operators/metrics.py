"""Window metrics, dedup and key figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from haulwise.functions.grading import impact_level
from haulwise.operators.hotkeys import first_per_key


def delay_metrics(events: DataFrame, length: str = "15 minutes") -> DataFrame:
    """Average delay and speed per tumbling window and warehouse."""
    return events.groupBy(
        F.window("event_timestamp", length).alias("w"), "warehouse_id", "warehouse_name", "region"
    ).agg(
        F.avg("delay_minutes").alias("avg_delay_minutes"),
        F.avg("speed_kmh").alias("avg_speed_kmh"),
        F.count(F.lit(1)).alias("event_count"),
    ).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "warehouse_id", "warehouse_name", "region",
        "avg_delay_minutes", "avg_speed_kmh", "event_count",
    )


def delay_windows(events: DataFrame, length: str = "15 minutes") -> DataFrame:
    """The streaming shape of the same metric; also valid on a batch."""
    return events.groupBy(F.window("event_timestamp", length).alias("w"), "warehouse_id").agg(
        F.avg("delay_minutes").alias("avg_delay_minutes"),
        F.avg("speed_kmh").alias("avg_speed_kmh"),
        F.max("event_timestamp").alias("last_event_timestamp"),
        F.count(F.lit(1)).alias("event_count"),
    ).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "warehouse_id", "avg_delay_minutes",
        "avg_speed_kmh", "last_event_timestamp", "event_count",
    )


def compact_windows(windows: DataFrame) -> DataFrame:
    """One row per (window, warehouse): the most complete update of each."""
    order = [F.col(c).desc() for c in ("event_count", "last_event_timestamp", "avg_delay_minutes", "avg_speed_kmh")]
    return first_per_key(windows, ["window_start", "warehouse_id"], order)


def dedup_events(events: DataFrame) -> DataFrame:
    """One row per event id: the newest, then the larger payload, so the result does not depend on input order."""
    rest = sorted(c for c in events.columns if c not in ("event_id", "event_timestamp"))
    return first_per_key(events, ["event_id"], [F.col(c).desc_nulls_last() for c in ("event_timestamp", *rest)])


def dedup_weather(weather: DataFrame) -> DataFrame:
    """One row per equal reading (time, rounded values, code)."""
    keyed = weather.withColumns({
        "_t": F.round("temperature_c", 1), "_p": F.round("precipitation_mm", 2), "_w": F.round("wind_kmh", 1),
        "_c": F.coalesce("weather_code", F.lit("unknown")),
    })
    keys = ["weather_timestamp", "_t", "_p", "_w", "_c"]
    return first_per_key(keyed, keys, [F.col("weather_event_id")]).drop("_t", "_p", "_w", "_c")


def latest_weather(weather: DataFrame) -> DataFrame:
    order = [F.col(c).desc_nulls_last() for c in
             ("weather_timestamp", "temperature_c", "precipitation_mm", "wind_kmh", "weather_code", "warehouse_id")]
    return first_per_key(weather, ["weather_event_id"], order)


def overview(events: DataFrame) -> DataFrame:
    """Fleet key figures over an event history."""
    return events.agg(
        F.countDistinct("vehicle_id").alias("vehicles_active"),
        F.count(F.lit(1)).alias("events_loaded"),
        F.coalesce(F.avg(F.coalesce("delay_minutes", F.lit(0))), F.lit(0.0)).alias("avg_delay_minutes"),
        F.coalesce(F.avg(F.coalesce("speed_kmh", F.lit(0.0))), F.lit(0.0)).alias("avg_speed_kmh"),
        F.max("event_timestamp").alias("latest_event_time"),
    )


def overview_latest(latest: DataFrame, ts: str = "last_event_timestamp") -> DataFrame:
    """The same figures over one row per vehicle; vehicles in maintenance count only when nothing else reports."""
    seen = F.col(ts).isNotNull()
    active = seen & (F.lower(F.coalesce("vehicle_status", F.lit(""))) != "maintenance")

    def average(name: str) -> Column:
        value = F.coalesce(F.col(name).cast("double"), F.lit(0.0))
        return F.coalesce(F.avg(F.when(active, value)), F.avg(F.when(seen, value)), F.avg(value), F.lit(0.0))

    n_active, n_seen = F.count_if(active), F.count_if(seen)
    return latest.agg(
        F.when(n_active > 0, n_active).otherwise(n_seen).alias("vehicles_active"),
        n_seen.alias("events_loaded"),
        average("delay_minutes").alias("avg_delay_minutes"),
        average("speed_kmh").alias("avg_speed_kmh"),
        F.max(ts).alias("latest_event_time"),
    )


def current_weather(weather: DataFrame, now: Column, minutes: int, ts: str = "weather_timestamp") -> DataFrame:
    """The readings of the last ``minutes`` up to the newest one that is not after ``now``."""
    known = weather.filter(F.col(ts) <= now)
    newest = known.agg(F.max(ts).alias("newest")).scalar()
    return known.filter(F.timestamp_diff("SECOND", F.col(ts), newest) < 60 * minutes)


def weather_factor(weather: DataFrame) -> DataFrame:
    """One row: the network-wide weather factor (0 without observations) and its level."""
    severe = F.bool_or(~F.coalesce("weather_code", F.lit("0")).isin("0", "1"))
    raw = (
        0.10
        + 0.70 * F.least(F.avg("precipitation_mm") / 0.4, F.lit(2.0))
        + 0.45 * F.least(F.avg("wind_kmh") / 18.0, F.lit(2.0))
        + F.when(severe, 0.25).otherwise(0.0)
    )
    factor = weather.agg(
        F.when(F.count(F.lit(1)) == 0, F.lit(0.0)).otherwise(F.least(raw, F.lit(2.5))).alias("weather_factor")
    )
    return factor.withColumn("weather_impact_level", impact_level("weather_factor"))


def rmse(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return scored.agg(F.sqrt(F.avg(F.pow(F.col(label) - F.col(prediction), F.lit(2.0)))).alias("rmse"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
             for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
