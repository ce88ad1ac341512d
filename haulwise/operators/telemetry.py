"""Live telemetry blended into the road network."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from haulwise.functions.grading import congestion_level

# Most weight live data can get, samples that give it, samples an edge needs to count as live.
BLEND_MAX = 0.65
BLEND_FULL_SAMPLES = 3.0
MIN_SAMPLES = 1


def planned_moves(latest: DataFrame) -> DataFrame:
    """Vehicles under way: both planned ends known and different."""
    return latest.filter(
        (F.col("planned_origin") != "") & (F.col("planned_destination") != "")
        & (F.col("planned_origin") != F.col("planned_destination"))
    )


def live_edge_stats(latest: DataFrame) -> DataFrame:
    return planned_moves(latest).groupBy(
        F.least("planned_origin", "planned_destination").alias("end_a"),
        F.greatest("planned_origin", "planned_destination").alias("end_b"),
    ).agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.avg(F.coalesce(F.col("delay_minutes").cast("double"), F.lit(0.0))).alias("avg_delay"),
        F.avg(F.coalesce(F.col("speed_kmh"), F.lit(0.0))).alias("avg_speed"),
    )


def apply_live_telemetry(edges: DataFrame, latest: DataFrame) -> DataFrame:
    """Blend live delay into the static delay of each edge; roads are two-way, so ends are matched unordered."""
    stats = live_edge_stats(latest).filter(F.col("sample_count") >= MIN_SAMPLES)
    joined = edges.join(
        stats, (F.least("src", "dst") == F.col("end_a")) & (F.greatest("src", "dst") == F.col("end_b")), "left"
    )
    n = F.coalesce(F.col("sample_count"), F.lit(0)).cast("int")
    static = F.coalesce(F.col("avg_delay_minutes"), F.lit(0.0)).cast("double")
    blend = F.least(F.lit(BLEND_MAX), BLEND_MAX * F.least(n / F.lit(BLEND_FULL_SAMPLES), F.lit(1.0)))
    return joined.withColumns({
        "effective_avg_delay_minutes": F.when(n > 0, static * (1 - blend) + F.col("avg_delay") * blend).otherwise(static),
        "live_avg_delay_minutes": F.col("avg_delay"),
        "live_avg_speed_kmh": F.col("avg_speed"),
        "live_sample_count": n,
        "congestion_level": congestion_level("avg_delay", "avg_speed", n),
    }).drop("end_a", "end_b", "sample_count", "avg_delay", "avg_speed")


def live_summary(edges_live: DataFrame, latest: DataFrame) -> DataFrame:
    """One row on how much of the network live data covers."""
    considered = planned_moves(latest).agg(F.count(F.lit(1)).alias("n")).scalar()
    counted = edges_live.agg(
        F.count_if(F.col("live_sample_count") > 0).alias("edges_with_live_samples"), F.count(F.lit(1)).alias("total_edges")
    )
    total = F.col("total_edges")
    return counted.select(
        considered.alias("vehicles_considered"),
        considered.alias("live_samples"),
        "edges_with_live_samples",
        "total_edges",
        F.when(total > 0, F.try_divide(F.col("edges_with_live_samples"), total)).otherwise(0.0).alias("live_coverage_ratio"),
    )
