"""SQL building blocks shared by the checks of network, routing and geometry queries.

Formulas are written out here once more, from their definitions, so that a check never reuses the code it checks.
"""

from __future__ import annotations

from haulwise.plans.metric_queries import FACTOR, LATEST

KM_SQL = (
    "(12742.0::DOUBLE * atan2(sqrt({h}), sqrt(1 - ({h}))))"
)


def km(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    h = (
        f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2}))"
        f" * pow(sin(radians({lon2} - {lon1}) / 2), 2))"
    )
    return KM_SQL.format(h=h)


def bearing(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    y = f"sin(radians({lon2} - {lon1})) * cos(radians({lat2}))"
    x = (
        f"cos(radians({lat1})) * sin(radians({lat2})) - sin(radians({lat1})) * cos(radians({lat2}))"
        f" * cos(radians({lon2} - {lon1}))"
    )
    return f"((degrees(atan2({y}, {x})) + 360.0::DOUBLE) % 360.0::DOUBLE)"


def turn(a: str, b: str) -> str:
    return f"(CASE WHEN abs(({a} - {b}) % 360) > 180 THEN 360 - abs(({a} - {b}) % 360) ELSE abs(({a} - {b}) % 360) END)"


def segment_km(lat: str, lon: str, la: str, oa: str, lb: str, ob: str) -> str:
    s = f"(111.32::DOUBLE * cos(radians(({la} + {lb} + {lat}) / 3)))"
    bx, by = f"(({ob} - {oa}) * {s})", f"(({lb} - {la}) * 110.57::DOUBLE)"
    px, py = f"(({lon} - {oa}) * {s})", f"(({lat} - {la}) * 110.57::DOUBLE)"
    t = (
        f"(CASE WHEN {bx} * {bx} + {by} * {by} <= 0 THEN 0.0 ELSE "
        f"greatest(0.0, least(1.0, ({px} * {bx} + {py} * {by}) / ({bx} * {bx} + {by} * {by}))) END)"
    )
    return f"sqrt(pow({px} - {t} * {bx}, 2) + pow({py} - {t} * {by}, 2))"


LIVE = f"""{LATEST},
moves AS (SELECT latest.*, planned_origin, planned_destination FROM latest JOIN plans USING (vehicle_id)
  WHERE planned_origin <> planned_destination),
stats AS (SELECT least(planned_origin, planned_destination) AS end_a, greatest(planned_origin, planned_destination) AS end_b,
  count(*) AS sample_count, avg(delay_minutes) AS avg_delay, avg(speed_kmh) AS avg_speed FROM moves GROUP BY 1, 2),
live AS MATERIALIZED (SELECT src, dst, distance_km, avg_delay_minutes,
  CASE WHEN sample_count > 0 THEN avg_delay_minutes * (1 - blend) + avg_delay * blend ELSE avg_delay_minutes END
    AS effective_avg_delay_minutes,
  avg_delay AS live_avg_delay_minutes, avg_speed AS live_avg_speed_kmh, CAST(coalesce(sample_count, 0) AS INT) AS live_sample_count,
  CASE WHEN coalesce(sample_count, 0) <= 0 THEN 'unknown' WHEN avg_delay >= 14 OR avg_speed <= 38 THEN 'high'
    WHEN avg_delay >= 8 OR avg_speed <= 54 THEN 'medium' ELSE 'low' END AS congestion_level
  FROM (SELECT roads.*, sample_count, avg_delay, avg_speed,
    least(0.65::DOUBLE, 0.65::DOUBLE * least(sample_count / 3.0::DOUBLE, 1.0::DOUBLE)) AS blend
    FROM roads LEFT JOIN stats ON src = end_a AND dst = end_b))"""

# Base minutes and penalty minutes of each profile in terms of km, d (delay), w (weather), t (time of day), c (congestion), n.
PROFILE_SQL = {
    "balanced": ("km / 76 * 60 + d", "1.6::DOUBLE * d * w * t + 7 * c"),
    "fastest": ("km / 100 * 60 + 0.55::DOUBLE * d", "0.8::DOUBLE * d * w * t + 4 * c"),
    "resilient": ("km / 62 * 60 + 1.65::DOUBLE * d", "2.6::DOUBLE * d * w * t + 14 * c + 0.9::DOUBLE * pow(greatest(0, d - 8), 1.2::DOUBLE)"),
    "eco": ("km / 74 * 60 + 1.2::DOUBLE * d + 0.018::DOUBLE * km",
            "1.2::DOUBLE * d * w * t + 10 * c + 0.55::DOUBLE * pow(greatest(0, d - 6), 1.12::DOUBLE)"),
    "low_risk": ("km / 69 * 60 + 1.45::DOUBLE * d",
                 "3.05::DOUBLE * d * w * t + 17 * c + 1.05::DOUBLE * pow(greatest(0, d - 7), 1.18::DOUBLE)"
                 " + 3 * (CASE WHEN n <= 0 THEN 1.9::DOUBLE ELSE 1 / (1 + 0.65::DOUBLE * least(6, n)) END)"),
    "reliable": ("km / 71 * 60 + 1.35::DOUBLE * d", "2.8::DOUBLE * d * w * t + 16 * c"),
}


def costs(profile: str, weights: tuple[str, str, str] = ("1/3.0::DOUBLE",) * 3, source: str = "live") -> str:
    """Common table expressions up to ``costed``: the edges of ``source`` with their costs in a weekday rush hour."""
    base, penalty = PROFILE_SQL[profile]
    if profile == "reliable":
        risk = "14 * u + 1.2::DOUBLE * pow(greatest(0, d - 6), 1.15::DOUBLE)"
        eco, extra = "0.085::DOUBLE * km + 0.32::DOUBLE * d + 4.2::DOUBLE * c", "2.4::DOUBLE"
    else:
        risk = "11.5::DOUBLE * u + pow(greatest(0, d - 7), 1.08::DOUBLE) + 6 * c"
        eco, extra = "0.075::DOUBLE * km + 0.42::DOUBLE * d + 5.2::DOUBLE * c", "1.8::DOUBLE"
    return f"""{FACTOR},
inputs AS (SELECT *, distance_km AS km, effective_avg_delay_minutes AS d, (SELECT weather_factor FROM factor) AS w,
  live_sample_count AS n,
  CASE congestion_level WHEN 'high' THEN 0.6::DOUBLE WHEN 'medium' THEN 0.25::DOUBLE WHEN 'low' THEN 0.0::DOUBLE ELSE 0.1::DOUBLE END AS c,
  least(1.32::DOUBLE, 1.13::DOUBLE + CASE congestion_level WHEN 'high' THEN 0.08::DOUBLE WHEN 'medium' THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END
    + least(0.06::DOUBLE, distance_km / 5000)) AS t FROM {source}),
staged AS (SELECT *, 1 / (1 + 0.7::DOUBLE * least(8, greatest(0, n))) + least(1.3::DOUBLE, greatest(0, d - 4) / 14) + 0.95::DOUBLE * c AS u
  FROM inputs),
costed AS MATERIALIZED (SELECT *, base_minutes + weather_penalty_minutes + {extra} * u AS total_minutes,
  (base_minutes + weather_penalty_minutes + {extra} * u) * ({weights[0]}) + risk_component_minutes * ({weights[1]})
    + eco_component_minutes * ({weights[2]}) AS routing_weight_minutes
  FROM (SELECT *, {base} AS base_minutes, {penalty} AS weather_penalty_minutes, {risk} AS risk_component_minutes,
    {eco} AS eco_component_minutes, u AS uncertainty_index, t AS temporal_factor FROM staged))"""


IMPACT = {"balanced": "1.0", "fastest": "1.08", "resilient": "0.94", "eco": "0.97", "low_risk": "0.9", "reliable": "0.88"}


def scored(profile: str, minimum: int) -> str:
    """``scored``: resolved congestion of at least ``minimum`` and the impact score, from ``costed``."""
    return f"""resolved AS (SELECT * REPLACE (CASE WHEN congestion_level IN ('low', 'medium', 'high') THEN congestion_level
    WHEN d >= 12 OR total_minutes >= 300 THEN 'high' WHEN d >= 7 OR total_minutes >= 180 THEN 'medium' ELSE 'low' END
    AS congestion_level) FROM costed),
scored AS MATERIALIZED (SELECT *, round(total_minutes
  * CASE congestion_level WHEN 'high' THEN 1.45::DOUBLE WHEN 'medium' THEN 1.2::DOUBLE ELSE 1.05::DOUBLE END
  * (1 + least(0.35::DOUBLE, 0.07::DOUBLE * n)) * (1 + least(0.65::DOUBLE, km / 750)) * {IMPACT[profile]}::DOUBLE, 6) AS impact_score
  FROM resolved WHERE CASE congestion_level WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END >= {minimum})"""


NODE_STATS = """ends AS (SELECT src AS id, * FROM scored UNION ALL SELECT dst AS id, * FROM scored),
sums AS (SELECT id, count(*) AS degree, avg(d) AS avg_incident_delay_minutes, avg(km) AS avg_incident_distance_km,
  avg(total_minutes) AS avg_profile_minutes, avg(CASE WHEN congestion_level = 'high' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS high_congestion_ratio,
  avg(CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS live_coverage_ratio FROM ends GROUP BY id),
node_stats AS (SELECT vertices.id, name, criticality, coalesce(degree, 0) AS degree,
  coalesce(avg_incident_delay_minutes, 0) AS avg_incident_delay_minutes, coalesce(avg_profile_minutes, 0) AS avg_profile_minutes,
  coalesce(high_congestion_ratio, 0) AS high_congestion_ratio, coalesce(live_coverage_ratio, 0) AS live_coverage_ratio,
  round(coalesce((1.3::DOUBLE * degree + 0.9::DOUBLE * avg_incident_delay_minutes + 0.18::DOUBLE * avg_profile_minutes
    + avg_incident_distance_km / 160 + 5 * high_congestion_ratio + 1.8::DOUBLE * live_coverage_ratio)
    * CASE criticality WHEN 'high' THEN 1.35::DOUBLE WHEN 'medium' THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END, 0), 6) AS criticality_score
  FROM vertices LEFT JOIN sums USING (id))"""

ARCS = """rounded AS (SELECT src, dst, distance_km, avg_delay_minutes, round(base_minutes, 6) AS base_minutes,
  round(weather_penalty_minutes, 6) AS weather_penalty_minutes, round(risk_component_minutes, 6) AS risk_component_minutes,
  round(eco_component_minutes, 6) AS eco_component_minutes, round(routing_weight_minutes, 6) AS w,
  round(uncertainty_index, 6) AS uncertainty_index FROM costed),
arcs AS MATERIALIZED (SELECT * FROM rounded UNION ALL SELECT dst AS src, src AS dst, * EXCLUDE (src, dst) FROM rounded)"""


def walks(weight: str = "w", k: int = 3) -> str:
    """``walks``: every simple path from a source of ``od_pairs`` that can be among the ``k`` cheapest of one of its pairs.

    The k-th cheapest path of at most six arcs costs at least as much as the k-th cheapest of any length, so paths may have
    any length but not cost more than that. A pair with fewer short paths sets no limit.
    """
    grow = f"""SELECT p.origin, dst, cost + {weight}, list_append(path, dst){{most}} FROM {{name}} p JOIN arcs ON node = src
  WHERE NOT list_contains(path, dst) AND {{limit}}"""
    return f"""short_walks(origin, node, cost, path) AS (
  SELECT DISTINCT source, source, 0.0::DOUBLE, [source] FROM od_pairs
  UNION ALL
  {grow.format(most='', name='short_walks', limit='len(path) <= 6')}),
most AS MATERIALIZED (SELECT origin, max(bound) AS most FROM (
  SELECT source AS origin, target, CASE WHEN count(cost) >= {k} THEN list_sort(list(cost))[{k}] ELSE 'infinity'::DOUBLE END AS bound
  FROM od_pairs LEFT JOIN short_walks ON origin = source AND node = target WHERE source <> target GROUP BY ALL) GROUP BY origin),
walks(origin, node, cost, path, most) AS (
  SELECT origin, origin, 0.0::DOUBLE, [origin], most FROM most
  UNION ALL
  {grow.format(most=', most', name='walks', limit=f'cost + {weight} <= most + 1e-9')})"""


ROUTES = """routes AS (SELECT * FROM (SELECT source, target, cost, path,
    row_number() OVER (PARTITION BY source, target ORDER BY cost, path) AS rank
  FROM od_pairs JOIN walks ON origin = source AND node = target WHERE source <> target) WHERE rank <= 3)"""
