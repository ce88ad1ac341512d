"""Edge and route cost model: one coefficient row per routing profile, applied as column arithmetic."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from haulwise.functions.geo import clamp
from haulwise.functions.grading import congestion_rank, congestion_weight


@dataclass(frozen=True)
class Profile:
    """Coefficients of one profile. ``excess`` is (start, exponent, factor) of the penalty on long delays."""

    cruise_kmh: float
    base_delay: float
    base_km: float
    weather: float
    congestion: float
    excess: tuple[float, float, float] | None = None
    telemetry_risk: float = 0.0
    risk_uncertainty: float = 11.5
    risk_excess: tuple[float, float, float] = (7.0, 1.08, 1.0)
    risk_congestion: float = 6.0
    eco_km: float = 0.075
    eco_delay: float = 0.42
    eco_congestion: float = 5.2
    uncertainty_minutes: float = 1.8
    impact: float = 1.0


# The published coefficients of the six profiles.
PROFILES = {
    "balanced": Profile(76.0, 1.0, 0.0, 1.6, 7.0),
    "fastest": Profile(100.0, 0.55, 0.0, 0.8, 4.0, impact=1.08),
    "resilient": Profile(62.0, 1.65, 0.0, 2.6, 14.0, excess=(8.0, 1.2, 0.9), impact=0.94),
    "eco": Profile(74.0, 1.2, 0.018, 1.2, 10.0, excess=(6.0, 1.12, 0.55), impact=0.97),
    "low_risk": Profile(69.0, 1.45, 0.0, 3.05, 17.0, excess=(7.0, 1.18, 1.05), telemetry_risk=3.0, impact=0.9),
    "reliable": Profile(
        71.0, 1.35, 0.0, 2.8, 16.0, risk_uncertainty=14.0, risk_excess=(6.0, 1.15, 1.2), risk_congestion=0.0,
        eco_km=0.085, eco_delay=0.32, eco_congestion=4.2, uncertainty_minutes=2.4, impact=0.88,
    ),
}
THIRDS = (1.0 / 3.0, 1.0 / 3.0, 1.0 / 3.0)
IMPACT_BY_LEVEL = {"high": 1.45, "medium": 1.2, "low": 1.05}


def profile_of(name: str | None) -> Profile:
    return PROFILES.get((name or "").strip().lower(), PROFILES["balanced"])


def normalize_weights(time, risk, eco) -> tuple[Column, Column, Column]:
    """Objective weights clamped to 0..10 (NULL counts as 1) and scaled to sum 1; all zero means equal thirds."""
    raw = [clamp(F.coalesce(w if isinstance(w, Column) else F.lit(w), F.lit(1.0)).cast("double"), 0.0, 10.0)
           for w in (time, risk, eco)]
    total = raw[0] + raw[1] + raw[2]
    return tuple(F.when(total <= 0, F.lit(1.0 / 3.0)).otherwise(F.try_divide(w, total)) for w in raw)


def temporal_factor(level: Column, km: Column, working_day, hour) -> Column:
    """Rush-hour and night factor. ``working_day`` and ``hour`` are values or columns of the routing zone's clock."""
    day = working_day if isinstance(working_day, Column) else F.lit(working_day)
    hour = hour if isinstance(hour, Column) else F.lit(hour)
    rush = day & (hour.between(7, 10) | hour.between(17, 20))
    night = (hour >= 22) | (hour <= 5)
    rank = congestion_rank(level)
    rush_base = F.lit(1.13) + F.when(rank == 3, 0.08).when(rank == 2, 0.05).otherwise(0.0)
    night_base = F.when(rank == 3, 1.0).otherwise(0.94)
    return (
        F.when(rush, F.least(F.lit(1.32), rush_base + F.least(F.lit(0.06), km / 5000)))
        .when(night, F.greatest(F.lit(0.88), night_base - F.least(F.lit(0.03), km / 9000)))
        .otherwise(1.0)
    )


def uncertainty_index(delay: Column, level_weight: Column, samples: Column) -> Column:
    known = clamp(samples.cast("double"), 0.0, 8.0)
    return 1 / (1 + known * 0.7) + F.least(F.lit(1.3), F.greatest(F.lit(0.0), delay - 4) / 14) + (level_weight - 1) * 0.95


def _excess(delay: Column, rule: tuple[float, float, float] | None) -> Column:
    if rule is None:
        return F.lit(0.0)
    start, exponent, factor = rule
    return F.pow(F.greatest(F.lit(0.0), delay - start), F.lit(exponent)) * factor


def edge_costs(
    edges: DataFrame,
    profile: str = "balanced",
    weather_factor: Column | float = 0.0,
    weights: tuple = THIRDS,
    working_day=True,
    hour=12,
) -> DataFrame:
    """Add the cost columns of one profile to an edge table.

    Uses ``effective_avg_delay_minutes``, ``live_sample_count`` and ``congestion_level`` where present, and the static
    delay otherwise. ``weather_factor`` may be a scalar subquery column, so a table-wide factor needs no join.
    """
    p = profile_of(profile)
    have = set(edges.columns)
    static = F.coalesce(F.col("avg_delay_minutes"), F.lit(0.0)).cast("double")
    delay = F.coalesce(F.col("effective_avg_delay_minutes"), static) if "effective_avg_delay_minutes" in have else static
    samples = F.coalesce(F.col("live_sample_count"), F.lit(0)) if "live_sample_count" in have else F.lit(0)
    level = F.coalesce(F.col("congestion_level"), F.lit("unknown")) if "congestion_level" in have else F.lit("unknown")
    weather = weather_factor if isinstance(weather_factor, Column) else F.lit(float(weather_factor))
    weights = tuple(w if isinstance(w, Column) else F.lit(w) for w in weights)

    # Two narrow projections: the shared inputs first, so that codegen evaluates each of them once per row.
    staged = edges.withColumns({
        "_km": F.coalesce(F.col("distance_km"), F.lit(0.0)).cast("double"),
        "_delay": delay.cast("double"),
        "_samples": samples,
        "_cw": congestion_weight(level),
        "_level": level,
        "_weather": weather,
    }).withColumns({
        "uncertainty_index": uncertainty_index(F.col("_delay"), F.col("_cw"), F.col("_samples")),
        "temporal_factor": temporal_factor(F.col("_level"), F.col("_km"), working_day, hour),
    })
    km, d, c = F.col("_km"), F.col("_delay"), F.col("_cw") - 1
    u, t = F.col("uncertainty_index"), F.greatest(F.lit(0.5), F.col("temporal_factor"))
    penalty = d * F.col("_weather") * p.weather * t + c * p.congestion + _excess(d, p.excess)
    if p.telemetry_risk:
        n = F.col("_samples").cast("double")
        penalty = penalty + p.telemetry_risk * F.when(n <= 0, 1.9).otherwise(1 / (1 + F.least(F.lit(6.0), n) * 0.65))
    costed = staged.withColumns({
        "base_minutes": km / p.cruise_kmh * 60 + d * p.base_delay + km * p.base_km,
        "weather_penalty_minutes": penalty,
        "risk_component_minutes": u * p.risk_uncertainty + _excess(d, p.risk_excess) + c * p.risk_congestion,
        "eco_component_minutes": km * p.eco_km + d * p.eco_delay + c * p.eco_congestion,
    })
    total = F.col("base_minutes") + F.col("weather_penalty_minutes") + u * p.uncertainty_minutes
    return (
        costed.withColumn("total_minutes", total)
        .withColumn(
            "routing_weight_minutes",
            F.col("total_minutes") * weights[0]
            + F.col("risk_component_minutes") * weights[1]
            + F.col("eco_component_minutes") * weights[2],
        )
        .drop("_km", "_delay", "_samples", "_cw", "_level", "_weather")
    )


def impact_score(total: Column, level: Column, samples: Column, km: Column, profile: str) -> Column:
    by_level = F.lit(1.0)
    for name, factor in IMPACT_BY_LEVEL.items():
        by_level = F.when(level == name, factor).otherwise(by_level)
    live = 1 + F.least(F.lit(0.35), samples * F.lit(0.07))
    return total * by_level * live * (1 + F.least(F.lit(0.65), km / 750)) * profile_of(profile).impact


def node_criticality(degree, delay, minutes, km, high_ratio, live_ratio, weight) -> Column:
    return (degree * 1.3 + delay * 0.9 + minutes * 0.18 + km / 160 + high_ratio * 5 + live_ratio * 1.8) * weight


def route_weather_factor(factor: Column, avg_delay: Column, avg_km: Column) -> Column:
    growth = 1 + 0.55 * F.least(avg_delay / 20, F.lit(1.0)) + 0.25 * F.least(avg_km / 450, F.lit(1.0))
    return F.least(factor * growth, F.lit(3.2))


def on_time_probability(risk: Column) -> Column:
    return clamp(F.exp(F.greatest(F.lit(0.0), risk) * -0.06), 0.05, 0.99)
