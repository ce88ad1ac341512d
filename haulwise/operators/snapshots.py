"""Insight snapshots: writing shape, hourly trends and history."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from haulwise.functions.times import day_bucket, edge_label
from haulwise.operators.hotkeys import first_per_key

GROUP = ["snapshot_hour", "profile", "min_congestion"]


def insights_to_snapshots(bottlenecks: DataFrame, nodes: DataFrame, at: Column, profile: str, min_congestion: str) -> DataFrame:
    """Ranked edge and node rows of one snapshot. The inputs are top-n lists, so each rank runs over n rows."""
    edge_order = Window.orderBy(F.desc("impact_score"), F.desc("effective_avg_delay_minutes"), "src", "dst")
    node_order = Window.orderBy(F.desc("criticality_score"), F.desc("avg_incident_delay_minutes"), F.desc("degree"), "id")
    none = F.lit(None).cast("double")
    edges = bottlenecks.select(
        F.lit("edge").alias("entity_type"), F.row_number().over(edge_order).alias("rank"),
        edge_label("src", "dst").alias("entity_id"), "impact_score", none.alias("criticality_score"),
        "effective_avg_delay_minutes", "total_minutes", "congestion_level", F.col("live_sample_count").cast("int").alias("live_sample_count"),
    )
    ranked = nodes.select(
        F.lit("node").alias("entity_type"), F.row_number().over(node_order).alias("rank"), F.col("id").alias("entity_id"),
        none.alias("impact_score"), "criticality_score",
        F.col("avg_incident_delay_minutes").alias("effective_avg_delay_minutes"),
        F.col("avg_profile_minutes").alias("total_minutes"), F.col("criticality").alias("congestion_level"),
        F.lit(0).alias("live_sample_count"),
    )
    return edges.unionByName(ranked).select(
        day_bucket(at).alias("bucket"), F.lit(profile).alias("profile"), F.lit(min_congestion).alias("min_congestion"),
        at.alias("snapshot_time"), "*",
    )


def _top(snapshots: DataFrame, kind: str, score: str) -> DataFrame:
    order = [F.desc(score), F.asc("rank"), F.asc("entity_id"), F.desc("snapshot_time"), F.desc("total_minutes")]
    return first_per_key(snapshots.filter(F.col("entity_type") == kind), GROUP, order)


def top_edges(snapshots: DataFrame) -> DataFrame:
    return _top(snapshots, "edge", "impact_score").select(
        *GROUP, F.col("entity_id").alias("top_edge_id"), F.col("impact_score").alias("top_edge_impact_score"),
        F.col("effective_avg_delay_minutes").alias("top_edge_delay_minutes"),
        F.col("total_minutes").alias("top_edge_total_minutes"), F.col("congestion_level").alias("top_edge_congestion_level"),
        F.col("live_sample_count").alias("top_edge_live_sample_count"),
    )


def top_nodes(snapshots: DataFrame) -> DataFrame:
    return _top(snapshots, "node", "criticality_score").select(
        *GROUP, F.col("entity_id").alias("top_node_id"), F.col("criticality_score").alias("top_node_criticality_score"),
        F.col("effective_avg_delay_minutes").alias("top_node_avg_incident_delay_minutes"),
        F.col("total_minutes").alias("top_node_avg_profile_minutes"),
    )


def hourly_trends(snapshots: DataFrame) -> DataFrame:
    """Best edge and best node of each hour, profile and filter side by side."""
    joined = top_edges(snapshots).join(top_nodes(snapshots), GROUP, "full_outer")
    return joined.orderBy(F.desc("snapshot_hour"), "profile", "min_congestion")


def snapshots_for(snapshots: DataFrame, now: datetime) -> DataFrame:
    """Snapshots of today and yesterday; on a table partitioned by bucket only two folders are read."""
    days = [now.strftime("%Y%m%d"), (now - timedelta(days=1)).strftime("%Y%m%d")]
    return snapshots.filter(F.col("bucket").isin(*days))


def insights_history(snapshots: DataFrame, profile: str, min_congestion: str, n: int = 10) -> DataFrame:
    """The leading edge and node of each snapshot, newest ``n`` snapshots."""
    rows = snapshots.filter(
        (F.col("profile") == profile) & (F.col("min_congestion") == min_congestion) & (F.col("rank") == 1)
        & F.col("snapshot_time").isNotNull()
    )

    def best(kind: str, score: str, columns: dict[str, str]) -> list[Column]:
        order = F.when(F.col("entity_type") == kind, F.struct(score, "entity_id"))
        return [F.max_by(c, order).alias(name) for name, c in columns.items()]

    return rows.groupBy("snapshot_time").agg(
        *best("edge", "impact_score", {
            "top_edge_id": "entity_id", "top_edge_impact_score": "impact_score", "top_edge_level": "congestion_level",
        }),
        *best("node", "criticality_score", {"top_node_id": "entity_id", "top_node_criticality_score": "criticality_score"}),
    ).orderBy(F.desc("snapshot_time")).limit(n)
