"""Bottleneck edges and critical nodes of the network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from haulwise.functions.costs import edge_costs, impact_score, node_criticality
from haulwise.functions.grading import CONGESTION_RANK, criticality_weight, resolve_congestion

TOP_N = 8
# Scores are compared after rounding, so equal scores tie in every engine and fall to the explicit tiebreaks.
SCORE_DECIMALS = 6


def score_edges(
    edges_live: DataFrame, profile: str = "balanced", min_congestion: str = "all", weather_factor: Column | float = 0.0,
    working_day=True, hour=12,
) -> DataFrame:
    costed = edge_costs(
        edges_live.filter((F.col("src") != "") & (F.col("dst") != "")), profile, weather_factor, working_day=working_day, hour=hour
    )
    level = resolve_congestion("congestion_level", "effective_avg_delay_minutes", "total_minutes")
    resolved = costed.withColumn("congestion_level", level)
    if min_congestion.lower() not in ("all", "any"):
        least_rank = CONGESTION_RANK.get(min_congestion.lower(), 0)
        resolved = resolved.filter(F.col("congestion_level").isin(*[k for k, r in CONGESTION_RANK.items() if r >= least_rank]))
    impact = impact_score(
        F.col("total_minutes"), F.col("congestion_level"), F.col("live_sample_count"), F.col("distance_km"), profile
    )
    return resolved.withColumn("impact_score", F.round(impact, SCORE_DECIMALS))


def top_bottlenecks(scored: DataFrame, n: int = TOP_N) -> DataFrame:
    return scored.select(
        "src", "dst", "distance_km", "effective_avg_delay_minutes", "base_minutes", "weather_penalty_minutes", "total_minutes",
        "live_sample_count", "congestion_level", "impact_score",
    ).orderBy(F.desc("impact_score"), F.desc("effective_avg_delay_minutes"), "src", "dst").limit(n)


def node_stats(scored: DataFrame, vertices: DataFrame) -> DataFrame:
    """Figures over the incident edges of every vertex; isolated vertices keep zeros."""
    ends = scored.select(
        F.explode(F.array("src", "dst")).alias("id"), "effective_avg_delay_minutes", "distance_km", "total_minutes",
        "congestion_level", "live_sample_count",
    )
    sums = ends.groupBy("id").agg(
        F.count(F.lit(1)).alias("degree"),
        F.avg("effective_avg_delay_minutes").alias("avg_incident_delay_minutes"),
        F.avg("distance_km").alias("avg_incident_distance_km"),
        F.avg("total_minutes").alias("avg_profile_minutes"),
        F.avg(F.when(F.col("congestion_level") == "high", 1.0).otherwise(0.0)).alias("high_congestion_ratio"),
        F.avg(F.when(F.col("live_sample_count") > 0, 1.0).otherwise(0.0)).alias("live_coverage_ratio"),
    )
    # Known vertices keep their row without edges; ends that are no known vertex keep theirs without a name.
    joined = vertices.select("id", "name", "criticality").join(sums, "id", "full_outer")
    filled = joined.fillna(0, subset=[c for c in sums.columns if c != "id"])
    named = filled.withColumns({
        "name": F.coalesce("name", "id"), "criticality": F.coalesce("criticality", F.lit("unknown")),
    })
    score = node_criticality(
        F.col("degree"), F.col("avg_incident_delay_minutes"), F.col("avg_profile_minutes"), F.col("avg_incident_distance_km"),
        F.col("high_congestion_ratio"), F.col("live_coverage_ratio"), criticality_weight("criticality"),
    )
    return named.withColumn("criticality_score", F.round(score, SCORE_DECIMALS))


def top_nodes_live(stats: DataFrame, n: int = TOP_N) -> DataFrame:
    order = [F.desc("criticality_score"), F.desc(F.round("avg_incident_delay_minutes", SCORE_DECIMALS)), F.desc("degree"), F.asc("id")]
    return stats.select(
        "id", "name", "criticality", "degree", "avg_incident_delay_minutes", "avg_profile_minutes", "high_congestion_ratio",
        "live_coverage_ratio", "criticality_score",
    ).orderBy(*order).limit(n)


def network_insights(
    vertices: DataFrame, edges_live: DataFrame, profile: str = "balanced", min_congestion: str = "all",
    weather_factor: Column | float = 0.0, working_day=True, hour=12, n: int = TOP_N,
) -> dict[str, DataFrame]:
    scored = score_edges(edges_live, profile, min_congestion, weather_factor, working_day, hour)
    return {"bottlenecks": top_bottlenecks(scored, n), "critical_nodes": top_nodes_live(node_stats(scored, vertices), n)}
