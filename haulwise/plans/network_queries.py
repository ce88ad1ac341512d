"""Queries on live telemetry, insights, graphs, networks and routes (inventory 2D to 2J)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from haulwise.functions import costs as cost_model, geo, grading
from haulwise.operators import enrich, eta, graph, insights, latest, metrics, nearest, network, routing, snapshots, telemetry
from haulwise.plans import check_parts as parts
from haulwise.plans.fixtures import check_sql
from haulwise.plans.metric_queries import FACTOR, LATEST, latest_of
from haulwise.plans.registry import NOW, Views, now, query, rounded
from haulwise.session import cut_lineage

RUSH = {"working_day": True, "hour": 8}
LIVE_VIEWS = ("telemetry", "plans", "roads")
NET_VIEWS = (*LIVE_VIEWS, "weather", "vertices")
COSTS = ["base_minutes", "weather_penalty_minutes", "total_minutes", "uncertainty_index", "risk_component_minutes",
         "eco_component_minutes", "temporal_factor", "routing_weight_minutes"]


def planned_latest(v: Views) -> DataFrame:
    return enrich.attach_plans(latest_of(v), v("plans"))


def live_roads(v: Views) -> DataFrame:
    return telemetry.apply_live_telemetry(v("roads"), planned_latest(v))


def factor_of(v: Views):
    return metrics.weather_factor(v("weather")).select("weather_factor").scalar()


def points_of(v: Views) -> DataFrame:
    return v("warehouses").select(F.col("warehouse_id").alias("id"), "latitude", "longitude")


# Live telemetry ----------------------------------------------------------------------------------------------------

@query("d7_apply_live_telemetry", check_sql(*LIVE_VIEWS, extra=parts.LIVE, body="""
SELECT * REPLACE (round(effective_avg_delay_minutes, 6) AS effective_avg_delay_minutes) FROM live"""))
def d7(v):
    return rounded(live_roads(v), "effective_avg_delay_minutes")


@query("e8_live_edge_stats", check_sql(*LIVE_VIEWS, extra=parts.LIVE, body="SELECT * FROM stats"))
def e8(v):
    return telemetry.live_edge_stats(planned_latest(v))


@query("e9_live_summary", check_sql(*LIVE_VIEWS, extra=parts.LIVE, body="""
SELECT (SELECT count(*) FROM moves) AS vehicles_considered, (SELECT count(*) FROM moves) AS live_samples,
  count(*) FILTER (WHERE live_sample_count > 0) AS edges_with_live_samples, count(*) AS total_edges,
  count(*) FILTER (WHERE live_sample_count > 0) / count(*) AS live_coverage_ratio FROM live"""))
def e9(v):
    fleet = cut_lineage(planned_latest(v))
    return telemetry.live_summary(telemetry.apply_live_telemetry(v("roads"), fleet), fleet)


# Cost model and insights -------------------------------------------------------------------------------------------

def _cost_query(profile: str) -> None:
    body = "SELECT src, dst, " + ", ".join(f"round({c}, 6) AS {c}" for c in COSTS) + " FROM costed"

    @query(f"i23_edge_costs_{profile}", check_sql(*NET_VIEWS, extra=f"{parts.LIVE},\n{parts.costs(profile)}", body=body))
    def run(v):
        costed = cost_model.edge_costs(live_roads(v), profile, factor_of(v), **RUSH)
        return rounded(costed.select("src", "dst", *COSTS), *COSTS)


for _name in cost_model.PROFILES:
    _cost_query(_name)


@query("n9_edge_cost_table", check_sql(*NET_VIEWS, extra=f"{parts.LIVE},\n{parts.costs('eco')}", body="""
SELECT src, dst, round(total_minutes, 6) AS total_minutes FROM costed
UNION ALL SELECT dst, src, round(total_minutes, 6) FROM costed"""))
def n9(v):
    costed = cost_model.edge_costs(live_roads(v), "eco", factor_of(v), **RUSH).select("src", "dst", "total_minutes")
    return rounded(graph.both_directions(costed), "total_minutes")


def _insight_sql(profile: str, minimum: int) -> str:
    return f"{parts.LIVE},\n{parts.costs(profile)},\n{parts.scored(profile, minimum)},\n{parts.NODE_STATS}"


@query("i25_score_edges", check_sql(*NET_VIEWS, extra=_insight_sql("resilient", 2), body="""
SELECT src, dst, congestion_level, round(impact_score, 6) AS impact_score FROM scored"""))
def i25(v):
    scored = insights.score_edges(live_roads(v), "resilient", "medium", factor_of(v), **RUSH)
    return rounded(scored.select("src", "dst", "congestion_level", "impact_score"), "impact_score", digits=6)


@query("e10_node_stats", check_sql(*NET_VIEWS, extra=_insight_sql("balanced", 3), body="""
SELECT id, name, criticality, degree, round(avg_incident_delay_minutes, 6) AS avg_incident_delay_minutes,
  round(avg_profile_minutes, 6) AS avg_profile_minutes, round(high_congestion_ratio, 6) AS high_congestion_ratio,
  round(live_coverage_ratio, 6) AS live_coverage_ratio, round(criticality_score, 6) AS criticality_score FROM node_stats"""))
def e10(v):
    scored = insights.score_edges(live_roads(v), "balanced", "high", factor_of(v), **RUSH)
    stats = insights.node_stats(scored, v("vertices")).drop("avg_incident_distance_km")
    stats = rounded(stats, "avg_incident_delay_minutes", "avg_profile_minutes", "high_congestion_ratio", "live_coverage_ratio")
    return rounded(stats, "criticality_score", digits=6)


@query("g3_top_bottlenecks", check_sql(*NET_VIEWS, extra=_insight_sql("fastest", 0), body="""
SELECT src, dst, congestion_level, live_sample_count, round(total_minutes, 6) AS total_minutes, round(impact_score, 6) AS impact_score
FROM scored ORDER BY scored.impact_score DESC, effective_avg_delay_minutes DESC, src, dst LIMIT 8"""))
def g3(v):
    top = insights.network_insights(v("vertices"), live_roads(v), "fastest", "all", factor_of(v), **RUSH)["bottlenecks"]
    top = top.select("src", "dst", "congestion_level", "live_sample_count", "total_minutes", "impact_score")
    return rounded(rounded(top, "total_minutes"), "impact_score", digits=6)


@query("g4_top_critical_nodes", check_sql(*NET_VIEWS, extra=_insight_sql("reliable", 2), body="""
SELECT id, degree, round(avg_incident_delay_minutes, 6) AS avg_incident_delay_minutes, round(criticality_score, 6) AS criticality_score
FROM node_stats ORDER BY node_stats.criticality_score DESC, round(node_stats.avg_incident_delay_minutes, 6) DESC, degree DESC, id LIMIT 8"""))
def g4(v):
    top = insights.network_insights(v("vertices"), live_roads(v), "reliable", "medium", factor_of(v), **RUSH)["critical_nodes"]
    top = top.select("id", "degree", "avg_incident_delay_minutes", "criticality_score")
    return rounded(rounded(top, "avg_incident_delay_minutes"), "criticality_score", digits=6)


@query("b8_insight_snapshots", check_sql(*NET_VIEWS, extra=_insight_sql("balanced", 0), body=f"""
SELECT '20240130' AS bucket, 'balanced' AS profile, 'all' AS min_congestion, TIMESTAMP '{NOW}' AS snapshot_time, 'edge' AS entity_type,
  rank, concat(src, '->', dst) AS entity_id, round(impact_score, 6) AS impact_score, CAST(NULL AS DOUBLE) AS criticality_score,
  round(d, 6) AS effective_avg_delay_minutes, round(total_minutes, 6) AS total_minutes, congestion_level, live_sample_count
FROM (SELECT *, row_number() OVER (ORDER BY impact_score DESC, d DESC, src, dst) AS rank FROM scored) WHERE rank <= 8
UNION ALL
SELECT '20240130', 'balanced', 'all', TIMESTAMP '{NOW}', 'node', rank, id, NULL, round(criticality_score, 6),
  round(avg_incident_delay_minutes, 6), round(avg_profile_minutes, 6), criticality, 0
FROM (SELECT *, row_number() OVER (ORDER BY criticality_score DESC, round(avg_incident_delay_minutes, 6) DESC, degree DESC, id) AS rank
  FROM node_stats) WHERE rank <= 8"""))
def b8(v):
    both = insights.network_insights(v("vertices"), live_roads(v), "balanced", "all", factor_of(v), **RUSH)
    rows = snapshots.insights_to_snapshots(both["bottlenecks"], both["critical_nodes"], now(), "balanced", "all")
    rows = rounded(rows, "effective_avg_delay_minutes", "total_minutes")
    return rounded(rows, "impact_score", "criticality_score", digits=6)


# Column functions --------------------------------------------------------------------------------------------------

PAIRS = """pairs AS (SELECT event_id, t.latitude AS lat, t.longitude AS lon, w.latitude AS wlat, w.longitude AS wlon, speed_kmh,
  delay_minutes, event_timestamp, criticality FROM telemetry t JOIN warehouses w USING (warehouse_id))"""
P4 = ("lat", "lon", "wlat", "wlon")


def position_pairs(v: Views) -> DataFrame:
    wide = enrich.enrich_events(v("telemetry"), v("warehouses"), v("vehicles"))
    return wide.select(
        "event_id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), F.col("warehouse_latitude").alias("wlat"),
        F.col("warehouse_longitude").alias("wlon"), "speed_kmh", "delay_minutes", "event_timestamp", "criticality", "status",
    )


@query("i1_geometry", check_sql("telemetry", "warehouses", extra=PAIRS, body=f"""
SELECT event_id, round({parts.km(*P4)}, 6) AS km, round({parts.bearing(*P4)}, 6) AS bearing,
  ['N', 'NE', 'E', 'SE', 'S', 'SO', 'O', 'NO'][CAST(floor({parts.bearing(*P4)} / 45 + 0.5) AS BIGINT) % 8 + 1] AS compass,
  round({parts.turn(parts.bearing(*P4), "speed_kmh")}, 6) AS turn,
  round({parts.segment_km("lat", "lon", "wlat", "wlon", "40.0", "-3.0")}, 6) AS segment_km,
  round(sqrt(pow((lat - wlat) * 111.32::DOUBLE, 2) + pow((lon - wlon) * 85.39::DOUBLE, 2)), 6) AS planar_km,
  round(lat + (wlat - lat) * 0.25::DOUBLE, 6) AS quarter_lat FROM pairs"""))
def i1(v):
    df = position_pairs(v)
    bearing = geo.bearing_deg(*P4)
    out = df.select(
        "event_id", geo.haversine_km(*P4).alias("km"), bearing.alias("bearing"), geo.compass(bearing).alias("compass"),
        geo.angle_diff(bearing, "speed_kmh").alias("turn"),
        geo.point_segment_km("lat", "lon", "wlat", "wlon", F.lit(40.0), F.lit(-3.0)).alias("segment_km"),
        geo.planar_km(*P4).alias("planar_km"), geo.interpolate("lat", "wlat", F.lit(0.25)).alias("quarter_lat"),
    )
    return rounded(out, "km", "bearing", "turn", "segment_km", "planar_km", "quarter_lat")


@query("i8_grades", check_sql("telemetry", "warehouses", "vehicles", body="""
SELECT event_id, CASE criticality WHEN 'high' THEN 1.0::DOUBLE WHEN 'medium' THEN 0.6::DOUBLE WHEN 'low' THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END AS criticality_score,
  CASE criticality WHEN 'high' THEN 1.35::DOUBLE WHEN 'medium' THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END AS criticality_weight,
  CASE status WHEN 'active' THEN 1.0::DOUBLE WHEN 'maintenance' THEN 0.25::DOUBLE ELSE 0.6::DOUBLE END AS status_score,
  CASE WHEN delay_minutes >= 10 THEN 'high' WHEN delay_minutes >= 5 THEN 'medium' ELSE 'low' END AS risk_level,
  CASE WHEN speed_kmh < 30 THEN 14.0::DOUBLE WHEN speed_kmh < 50 THEN 8.0::DOUBLE ELSE 3.0::DOUBLE END AS heuristic_delay,
  CASE WHEN delay_minutes >= 14 OR speed_kmh <= 38 THEN 'high' WHEN delay_minutes >= 8 OR speed_kmh <= 54 THEN 'medium' ELSE 'low' END AS congestion_level,
  CASE WHEN delay_minutes >= 12 OR speed_kmh * 4 >= 300 THEN 'high' WHEN delay_minutes >= 7 OR speed_kmh * 4 >= 180 THEN 'medium' ELSE 'low' END AS resolved,
  CASE criticality WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS congestion_rank,
  CASE criticality WHEN 'high' THEN 1.6::DOUBLE WHEN 'medium' THEN 1.25::DOUBLE ELSE 1.0::DOUBLE END AS congestion_weight,
  CASE WHEN speed_kmh / 100 < 0.45 THEN 'low' WHEN speed_kmh / 100 < 0.95 THEN 'medium' ELSE 'high' END AS impact_level,
  CASE WHEN speed_kmh * 10 < 160 THEN 4 WHEN speed_kmh * 10 < 260 THEN 5 WHEN speed_kmh * 10 < 360 THEN 6 WHEN speed_kmh * 10 < 480 THEN 7
    WHEN speed_kmh * 10 < 620 THEN 8 WHEN speed_kmh * 10 < 760 THEN 9 ELSE 10 END AS distance_delay,
  CASE WHEN speed_kmh * 5 > 300 THEN 'stale' WHEN speed_kmh * 5 > 120 THEN 'warn' ELSE 'fresh' END AS freshness,
  CASE WHEN delay_minutes >= 15 THEN 'bad' ELSE 'ok' END AS severity
FROM telemetry JOIN warehouses USING (warehouse_id) JOIN vehicles USING (vehicle_id)"""))
def i8(v):
    speed = F.col("speed_kmh")
    return position_pairs(v).select(
        "event_id", grading.criticality_score("criticality").alias("criticality_score"),
        grading.criticality_weight("criticality").alias("criticality_weight"), grading.status_score("status").alias("status_score"),
        grading.risk_level("delay_minutes").alias("risk_level"), grading.heuristic_delay("speed_kmh").alias("heuristic_delay"),
        grading.congestion_level("delay_minutes", "speed_kmh", F.lit(1)).alias("congestion_level"),
        grading.resolve_congestion(F.lit("unknown"), "delay_minutes", speed * 4).alias("resolved"),
        grading.congestion_rank("criticality").alias("congestion_rank"), grading.congestion_weight("criticality").alias("congestion_weight"),
        grading.impact_level(speed / 100).alias("impact_level"), grading.delay_for_distance(speed * 10).alias("distance_delay"),
        grading.freshness_class(speed * 5).alias("freshness"), grading.delay_severity("delay_minutes").alias("severity"),
    )


@query("i11_time_features", check_sql("telemetry", body="""
SELECT event_id, round(sin(2 * pi() * hour(event_timestamp) / 24), 6) AS hour_sin,
  round(cos(2 * pi() * hour(event_timestamp) / 24), 6) AS hour_cos,
  CASE WHEN dayofweek(event_timestamp) IN (0, 6) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_weekend FROM telemetry"""))
def i11(v):
    from haulwise.operators.learning import time_features

    return rounded(time_features(v("telemetry")).select("event_id", "hour_sin", "hour_cos", "is_weekend"), "hour_sin", "hour_cos")


@query("i21_temporal_factor", check_sql("telemetry", "warehouses", body="""
SELECT event_id, round(CASE
  WHEN dayofweek(ts) BETWEEN 1 AND 5 AND (hour(ts) BETWEEN 7 AND 10 OR hour(ts) BETWEEN 17 AND 20) THEN
    least(1.32::DOUBLE, 1.13::DOUBLE + CASE criticality WHEN 'high' THEN 0.08::DOUBLE WHEN 'medium' THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END + least(0.06::DOUBLE, km / 5000))
  WHEN hour(ts) >= 22 OR hour(ts) <= 5 THEN
    greatest(0.88::DOUBLE, CASE criticality WHEN 'high' THEN 1.0::DOUBLE ELSE 0.94::DOUBLE END - least(0.03::DOUBLE, km / 9000))
  ELSE 1.0::DOUBLE END, 6) AS temporal_factor
FROM (SELECT event_id, event_timestamp + INTERVAL 1 HOUR AS ts, speed_kmh * 3 AS km, criticality FROM telemetry JOIN warehouses USING (warehouse_id))"""))
def i21(v):
    local = F.convert_timezone(F.lit("UTC"), F.lit("Europe/Madrid"), F.col("event_timestamp"))
    factor = cost_model.temporal_factor(F.col("criticality"), F.col("speed_kmh") * 3, F.weekday(local) < 5, F.hour(local))
    return rounded(position_pairs(v).select("event_id", factor.alias("temporal_factor")), "temporal_factor")


@query("i22_uncertainty_index", check_sql("telemetry", body="""
SELECT event_id, round(1 / (1 + 0.7::DOUBLE * least(8, n)) + least(1.3::DOUBLE, greatest(0, delay_minutes - 4) / 14) + 0.95::DOUBLE * 0.25::DOUBLE, 6) AS uncertainty
FROM (SELECT *, CAST(speed_kmh AS INT) % 12 AS n FROM telemetry)"""))
def i22(v):
    u = cost_model.uncertainty_index(F.col("delay_minutes"), F.lit(1.25), F.col("speed_kmh").cast("int") % 12)
    return rounded(v("telemetry").select("event_id", u.alias("uncertainty")), "uncertainty")


@query("i24_normalize_weights", check_sql("telemetry", extra="""
w AS (SELECT event_id, CASE WHEN delay_minutes = 0 THEN 0.0::DOUBLE ELSE least(10.0::DOUBLE, speed_kmh / 5) END AS a,
  CASE WHEN delay_minutes = 0 THEN 0.0::DOUBLE ELSE least(10.0::DOUBLE, CAST(delay_minutes AS DOUBLE)) END AS b,
  CASE WHEN delay_minutes = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS c FROM telemetry)""", body="""
SELECT event_id, round(CASE WHEN a + b + c <= 0 THEN 1 / 3.0::DOUBLE ELSE a / (a + b + c) END, 6) AS w_time,
  round(CASE WHEN a + b + c <= 0 THEN 1 / 3.0::DOUBLE ELSE b / (a + b + c) END, 6) AS w_risk,
  round(CASE WHEN a + b + c <= 0 THEN 1 / 3.0::DOUBLE ELSE c / (a + b + c) END, 6) AS w_eco FROM w"""))
def i24(v):
    zero = F.col("delay_minutes") == 0
    t, r, e = cost_model.normalize_weights(
        F.when(zero, 0.0).otherwise(F.col("speed_kmh") / 5), F.when(zero, 0.0).otherwise(F.col("delay_minutes").cast("double")),
        F.when(zero, F.lit(0.0)),
    )
    return rounded(v("telemetry").select("event_id", t.alias("w_time"), r.alias("w_risk"), e.alias("w_eco")), "w_time", "w_risk", "w_eco")


# Positions ---------------------------------------------------------------------------------------------------------

HEADINGS = f"""moved AS (SELECT vehicle_id, event_id, event_timestamp, latitude, longitude,
  lag(latitude) OVER w AS plat, lag(longitude) OVER w AS plon FROM telemetry
  WINDOW w AS (PARTITION BY vehicle_id ORDER BY event_timestamp, event_id)),
heads AS (SELECT *, {parts.km('plat', 'plon', 'latitude', 'longitude')} AS moved_km,
  {parts.bearing('plat', 'plon', 'latitude', 'longitude')} AS b FROM moved)"""


@query("f7_headings", check_sql("telemetry", extra=HEADINGS, body="""
SELECT event_id, round(moved_km, 6) AS moved_km, CASE WHEN moved_km >= 0.02 THEN round(b, 6) END AS heading FROM heads"""))
def f7(v):
    return rounded(latest.headings(v("telemetry")).select("event_id", "moved_km", "heading"), "moved_km", "heading")


FLEET = f"""{LATEST},
{HEADINGS},
fleet AS (SELECT latest.*, b AS bearing, planned_origin, planned_destination FROM latest
  JOIN (SELECT vehicle_id, arg_max(b, (event_timestamp, event_id)) AS b FROM heads GROUP BY vehicle_id) USING (vehicle_id)
  LEFT JOIN plans USING (vehicle_id)),
nearest AS (SELECT vehicle_id, warehouse_id AS nearest_id, d AS nearest_km FROM (
  SELECT vehicle_id, w.warehouse_id, {parts.km('f.latitude', 'f.longitude', 'w.latitude', 'w.longitude')} AS d,
    row_number() OVER (PARTITION BY vehicle_id ORDER BY {parts.km('f.latitude', 'f.longitude', 'w.latitude', 'w.longitude')}, w.warehouse_id) AS rn
  FROM fleet f, warehouses w) WHERE rn = 1),
turns AS (SELECT *, CASE WHEN bearing IS NULL OR turn <= 115 THEN 0 ELSE 1 END AS class,
    round(CASE WHEN bearing IS NULL THEN 0.4::DOUBLE * km ELSE 1.6::DOUBLE * turn + 0.4::DOUBLE * km END, 9) AS score
  FROM (SELECT f.vehicle_id, f.bearing, w.warehouse_id AS id, {parts.km('f.latitude', 'f.longitude', 'w.latitude', 'w.longitude')} AS km,
    {parts.turn('bearing', parts.bearing('f.latitude', 'f.longitude', 'w.latitude', 'w.longitude'))} AS turn
    FROM fleet f JOIN nearest USING (vehicle_id), warehouses w WHERE w.warehouse_id <> nearest_id)),
ahead AS (SELECT vehicle_id, id AS next_id, km AS next_km FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id
  ORDER BY class, score, id) AS rn FROM turns) WHERE rn = 1),
routes AS (SELECT vehicle_id, coalesce(planned_origin, nearest_id) AS from_id,
  CASE WHEN planned_origin IS NOT NULL THEN planned_destination ELSE next_id END AS to_id
  FROM fleet JOIN nearest USING (vehicle_id) JOIN ahead USING (vehicle_id))"""
FLEET_VIEWS = ("telemetry", "plans", "warehouses", "plan_stops")


def fleet(v: Views) -> DataFrame:
    """Latest rows with their plan and the bearing of the last move."""
    return planned_latest(v).join(latest.latest_heading(v("telemetry")), "vehicle_id")


@query("d13_nearest_node", check_sql(*FLEET_VIEWS, extra=FLEET, body="""
SELECT vehicle_id, nearest_id, round(nearest_km, 6) AS nearest_km FROM nearest"""))
def d13(v):
    return rounded(nearest.nearest_node(latest_of(v), points_of(v)), "nearest_km")


@query("d13_nearest_node_all_events", check_sql("telemetry", "warehouses", body=f"""
SELECT event_id, nearest_id, round(nearest_km, 6) AS nearest_km FROM (
  SELECT event_id, w.warehouse_id AS nearest_id, {parts.km('t.latitude', 't.longitude', 'w.latitude', 'w.longitude')} AS nearest_km,
    row_number() OVER (PARTITION BY event_id ORDER BY {parts.km('t.latitude', 't.longitude', 'w.latitude', 'w.longitude')}, w.warehouse_id) AS rn
  FROM telemetry t, warehouses w) WHERE rn = 1"""))
def d13_all(v):
    events = v("telemetry").select(F.col("event_id").alias("vehicle_id"), "latitude", "longitude")
    return rounded(nearest.nearest_node(events, points_of(v)), "nearest_km").withColumnRenamed("vehicle_id", "event_id")


def placed_fleet(v: Views) -> DataFrame:
    """The fleet with every vehicle set to its nearest node."""
    rows = cut_lineage(fleet(v))
    return cut_lineage(
        rows.join(nearest.nearest_node(rows, points_of(v)), "vehicle_id").withColumn("warehouse_id", F.col("nearest_id"))
    )


@query("i32_next_node", check_sql(*FLEET_VIEWS, extra=FLEET, body="SELECT vehicle_id, next_id, round(next_km, 6) AS next_km FROM ahead"))
def i32(v):
    return rounded(nearest.next_node(placed_fleet(v), points_of(v)), "next_km")


@query("i33_infer_route", check_sql(*FLEET_VIEWS, extra=FLEET, body="""
SELECT vehicle_id, from_id, to_id, concat(from_id, ' -> ', to_id) AS label FROM routes"""))
def i33(v):
    return eta.infer_route(fleet(v), points_of(v))


@query("i34_raw_eta", check_sql(*FLEET_VIEWS, extra=FLEET, body="""
SELECT vehicle_id, round(CASE WHEN speed_kmh > 0 THEN next_km / speed_kmh * 60 + delay_minutes * 0.35::DOUBLE END, 6) AS eta_minutes
FROM fleet JOIN ahead USING (vehicle_id)"""))
def i34(v):
    placed = placed_fleet(v)
    timed = placed.join(nearest.next_node(placed, points_of(v)), "vehicle_id")
    minutes = eta.raw_eta(F.col("next_km"), F.col("speed_kmh"), F.col("delay_minutes"))
    return rounded(timed.select("vehicle_id", minutes.alias("eta_minutes")), "eta_minutes")


STOPS = f"""stops AS (SELECT vehicle_id, stop, node_id, latitude AS slat, longitude AS slon FROM plan_stops JOIN warehouses ON node_id = warehouse_id),
at_stops AS (SELECT l.vehicle_id, speed_kmh, delay_minutes, stop, node_id, slat, slon, planned_destination,
  {parts.km('l.latitude', 'l.longitude', 'slat', 'slon')} AS km FROM latest l JOIN stops USING (vehicle_id) JOIN plans USING (vehicle_id)),
starts AS (SELECT vehicle_id, CASE WHEN vehicle_no % 2 = 0 THEN next_stop ELSE near_stop + CASE WHEN near_km <= 1.2 AND near_stop < 3 THEN 1 ELSE 0 END END AS start_stop
  FROM (SELECT vehicle_id, CAST(substr(vehicle_id, 7) AS BIGINT) AS vehicle_no, min(stop) FILTER (WHERE node_id = planned_destination) AS next_stop,
    arg_min(stop, (km, stop)) AS near_stop, min(km) AS near_km FROM at_stops GROUP BY vehicle_id)),
remaining AS (SELECT * FROM at_stops JOIN starts USING (vehicle_id) WHERE stop >= start_stop)"""


def stops_of(v: Views) -> DataFrame:
    places = points_of(v).withColumnRenamed("id", "node_id")
    return v("plan_stops").join(places, "node_id")


def heading_for(v: Views) -> DataFrame:
    """Every other vehicle knows its next node; the others have to be placed on their route."""
    even = F.expr("CAST(substr(vehicle_id, 7) AS BIGINT) % 2 = 0")
    return planned_latest(v).withColumn("next_id", F.when(even, F.col("planned_destination")))


@query("i35_remaining_stops", check_sql(*FLEET_VIEWS, extra=f"{LATEST},\n{STOPS}", body="SELECT vehicle_id, stop, node_id FROM remaining"))
def i35(v):
    return eta.remaining_stops(heading_for(v), stops_of(v)).select("vehicle_id", "stop", "node_id")


@query("f11_route_etas", check_sql(*FLEET_VIEWS, extra=f"{LATEST},\n{STOPS}", body=f"""
SELECT vehicle_id, stop, node_id, round(sum(coalesce({parts.km('plat', 'plon', 'slat', 'slon')} / speed_kmh * 60,
  km / speed_kmh * 60 + delay_minutes * 0.35::DOUBLE)) OVER (PARTITION BY vehicle_id ORDER BY stop), 6) AS eta_minutes
FROM (SELECT *, lag(slat) OVER (PARTITION BY vehicle_id ORDER BY stop) AS plat, lag(slon) OVER (PARTITION BY vehicle_id ORDER BY stop) AS plon
  FROM remaining WHERE speed_kmh > 0)"""))
def f11(v):
    return rounded(eta.route_etas(heading_for(v), stops_of(v)), "eta_minutes")


@query("d14_distance_to_route", check_sql(*FLEET_VIEWS, extra=f"{LATEST},\n{STOPS}", body=f"""
SELECT vehicle_id, round(min({parts.segment_km('l.latitude', 'l.longitude', 'a.slat', 'a.slon', 'b.slat', 'b.slon')}), 6) AS route_km
FROM latest l JOIN stops a USING (vehicle_id) JOIN stops b USING (vehicle_id) WHERE b.stop = a.stop + 1 GROUP BY vehicle_id"""))
def d14(v):
    return rounded(eta.distance_to_route(latest_of(v), eta.segments_of(stops_of(v))), "route_km")


def corridor_input(v: Views) -> DataFrame:
    rows = cut_lineage(fleet(v))
    rows = cut_lineage(rows.join(nearest.nearest_node(rows, points_of(v)), "vehicle_id"))
    return rows.join(eta.infer_route(rows, points_of(v)).drop("label"), "vehicle_id")


CORRIDOR = f"""ends AS (SELECT s.latitude AS slat, s.longitude AS slon, t.latitude AS tlat, t.longitude AS tlon
  FROM warehouses s, warehouses t WHERE s.warehouse_id = 'W1' AND t.warehouse_id = 'W5'),
tagged AS (SELECT fleet.*, from_id, to_id, nearest_id, {parts.segment_km('latitude', 'longitude', 'slat', 'slon', 'tlat', 'tlon')} AS corridor_km,
  CASE WHEN nearest_id = 'W1' THEN 'W5' WHEN nearest_id = 'W5' THEN 'W1' WHEN bearing IS NULL THEN
    CASE WHEN {parts.km('latitude', 'longitude', 'slat', 'slon')} <= {parts.km('latitude', 'longitude', 'tlat', 'tlon')} THEN 'W5' ELSE 'W1' END
    WHEN {parts.turn('bearing', parts.bearing('latitude', 'longitude', 'slat', 'slon'))}
      <= {parts.turn('bearing', parts.bearing('latitude', 'longitude', 'tlat', 'tlon'))} THEN 'W1' ELSE 'W5' END AS next_id
  FROM fleet JOIN routes USING (vehicle_id) JOIN nearest USING (vehicle_id), ends)"""


@query("c20_corridor_filter", check_sql(*FLEET_VIEWS, extra=f"{FLEET},\n{CORRIDOR}", body="""
SELECT 'both' AS ends_given, vehicle_id FROM tagged WHERE corridor_km <= 400 AND from_id IN ('W1', 'W5') AND to_id = 'W5'
UNION ALL SELECT 'source', vehicle_id FROM tagged WHERE from_id = 'W1'
UNION ALL SELECT 'target', vehicle_id FROM tagged WHERE to_id = 'W5'"""))
def c20(v):
    rows, nodes = corridor_input(v), points_of(v)
    both = eta.corridor_filter(rows, nodes, "W1", "W5", max_km=400)
    tag = lambda df, name: df.select(F.lit(name).alias("ends_given"), "vehicle_id")
    return tag(both, "both").unionByName(tag(eta.corridor_filter(rows, nodes, source="W1"), "source")).unionByName(
        tag(eta.corridor_filter(rows, nodes, target="W5"), "target")
    )


@query("i40_corridor_next", check_sql(*FLEET_VIEWS, extra=f"{FLEET},\n{CORRIDOR}", body="SELECT vehicle_id, next_id FROM tagged"))
def i40(v):
    nodes = points_of(v)
    end = lambda node: nodes.filter(F.col("id") == node).agg(F.first(F.struct("id", "latitude", "longitude"))).scalar()
    rows = fleet(v).join(nearest.nearest_node(latest_of(v), nodes), "vehicle_id").withColumns({"_s": end("W1"), "_t": end("W5")})
    return eta.corridor_next(rows, F.col("_s"), F.col("_t")).select("vehicle_id", F.col("corridor_next_id").alias("next_id"))


@query("i36_route_weather", check_sql("weather", extra=FACTOR, body="""
SELECT weather_event_id, round(precipitation_mm * greatest(0.7::DOUBLE, least(3.2::DOUBLE, r * (1 + 12 / 55.0::DOUBLE))), 6) AS precipitation_mm,
  round(wind_kmh * greatest(0.75::DOUBLE, least(2.4::DOUBLE, 0.92::DOUBLE + (r - 1) * 0.65::DOUBLE)), 6) AS wind_kmh
FROM weather, (SELECT greatest(0.6::DOUBLE, least(3.0::DOUBLE, 3.0::DOUBLE / weather_factor)) AS r FROM factor)"""))
def i36(v):
    rows = v("weather").select("weather_event_id", "precipitation_mm", "wind_kmh")
    return rounded(eta.route_weather(rows, factor_of(v), F.lit(3.0), F.lit(12.0)), "precipitation_mm", "wind_kmh")


# Networks ----------------------------------------------------------------------------------------------------------

KNN = f"""near AS (SELECT src, dst, km AS distance_km, rn AS position FROM (
  SELECT a.warehouse_id AS src, b.warehouse_id AS dst, round({parts.km('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')}, 1) AS km,
    row_number() OVER (PARTITION BY a.warehouse_id ORDER BY round({parts.km('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')}, 1), b.warehouse_id) AS rn
  FROM warehouses a JOIN warehouses b ON a.warehouse_id <> b.warehouse_id) WHERE rn <= 4)"""

RULES = """numbered AS (SELECT s_suppkey AS i, (SELECT count(*) FROM supplier) AS n FROM supplier),
forbidden AS (SELECT src, dst FROM near JOIN warehouses ON src = warehouse_id WHERE position = 2 AND criticality = 'low'),
required AS (SELECT concat('W', CAST(i AS STRING)) AS src, concat('W', CAST((i + 10) % n AS STRING)) AS dst FROM numbered
  JOIN warehouses ON warehouse_id = concat('W', CAST(i AS STRING)) WHERE criticality = 'high'),
chain AS (SELECT country AS chain_id, row_number() OVER (PARTITION BY country ORDER BY warehouse_id) AS place, warehouse_id AS id FROM warehouses),
shortcuts AS (SELECT src, dst FROM near JOIN chain a ON a.id = src JOIN chain b ON b.id = dst AND a.chain_id = b.chain_id WHERE abs(a.place - b.place) <> 1),
pairs AS (
  SELECT least(src, dst) AS src, greatest(src, dst) AS dst FROM near
  EXCEPT SELECT least(src, dst), greatest(src, dst) FROM forbidden
  EXCEPT SELECT least(src, dst), greatest(src, dst) FROM shortcuts),
ruled AS (SELECT * FROM pairs UNION SELECT least(src, dst), greatest(src, dst) FROM required
  UNION SELECT least(a.id, b.id), greatest(a.id, b.id) FROM chain a JOIN chain b ON a.chain_id = b.chain_id AND b.place = a.place + 1)"""


def rules_of(v: Views, neighbours: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """No road to the second neighbour of a low-criticality warehouse; one from each high-criticality warehouse to the
    tenth after it; the warehouses of a country form a chain."""
    places = v("warehouses").select(F.col("warehouse_id").alias("src"), "criticality")
    forbidden = neighbours.join(places.filter("criticality = 'low'"), "src").filter("position = 2").select("src", "dst")
    n = v("supplier").agg(F.count(F.lit(1))).scalar()
    number = F.expr("CAST(substr(src, 2) AS BIGINT)")
    required = places.filter("criticality = 'high'").select("src", F.concat(F.lit("W"), ((number + 10) % n).cast("string")).alias("dst"))
    chain = v("warehouses").select(F.col("country").alias("chain_id"), F.col("warehouse_id").alias("position"), F.col("warehouse_id").alias("id"))
    return forbidden, required, chain


@query("f8_knn_neighbours", check_sql("warehouses", extra=KNN, body="SELECT * FROM near"))
def f8(v):
    return network.knn_neighbours(points_of(v), 4)


@query("h3_undirected", check_sql("warehouses", extra=KNN, body="SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM near"))
def h3(v):
    return network.undirected(network.knn_neighbours(points_of(v), 4))


@query("h4_network_rules", check_sql("warehouses", extra=f"{KNN},\n{RULES}", body="SELECT * FROM ruled"))
def h4(v):
    near = network.knn_neighbours(points_of(v), 4)
    return network.apply_network_rules(network.undirected(near), points_of(v), *rules_of(v, near))


# With these rules the network of the checked tables is connected from k = 4 on.
@query("j10_build_network", check_sql("warehouses", extra=f"{KNN},\n{RULES},\n" + f"""
measured AS (SELECT src, dst, round({parts.km('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')}, 1) AS distance_km
  FROM ruled JOIN warehouses a ON a.warehouse_id = src JOIN warehouses b ON b.warehouse_id = dst)""", body="""
SELECT *, CASE WHEN distance_km < 160 THEN 4.0::DOUBLE WHEN distance_km < 260 THEN 5.0::DOUBLE WHEN distance_km < 360 THEN 6.0::DOUBLE WHEN distance_km < 480 THEN 7.0::DOUBLE
  WHEN distance_km < 620 THEN 8.0::DOUBLE WHEN distance_km < 760 THEN 9.0::DOUBLE ELSE 10.0::DOUBLE END AS avg_delay_minutes FROM measured"""))
def j10(v):
    near = network.knn_neighbours(points_of(v), 4)
    return network.build_network(points_of(v), *rules_of(v, near), k=4)


@query("h2_both_directions", check_sql("roads", body="""
SELECT * FROM roads UNION ALL SELECT dst AS src, src AS dst, distance_km, avg_delay_minutes FROM roads"""))
def h2(v):
    return graph.both_directions(v("roads"))


@query("h2_missing_reverse", check_sql("raw_roads", body="""
SELECT * FROM raw_roads UNION ALL SELECT dst, src, distance_km, avg_delay_minutes FROM raw_roads r
WHERE NOT EXISTS (SELECT 1 FROM raw_roads o WHERE o.src = r.dst AND o.dst = r.src)"""))
def h2_missing(v):
    return graph.with_missing_reverse(v("raw_roads"))


@query("e15_degree_summary", check_sql("roads", body="""
SELECT count(*) AS nodes, min(d) AS degree_min, max(d) AS degree_max, CAST(sum(d) / 2 AS BIGINT) AS edges FROM (
  SELECT id, count(*) AS d FROM (SELECT src AS id FROM roads UNION ALL SELECT dst FROM roads) GROUP BY id)"""))
def e15(v):
    return graph.degree_summary(v("roads"))


# Graph analytics ---------------------------------------------------------------------------------------------------

def _components(links: str = "supply_links") -> str:
    return f"""two_way AS MATERIALIZED (SELECT src, dst FROM {links} UNION SELECT dst, src FROM {links}),
reach(root, id) AS (SELECT id, id FROM supply_nodes UNION SELECT root, dst FROM reach JOIN two_way ON src = id),
components AS (SELECT id, min(root) AS component FROM reach GROUP BY id)"""


def _rank_rounds(links: str = "supply_links") -> str:
    steps = [f"arcs AS MATERIALIZED (SELECT src, dst, count(*) OVER (PARTITION BY src) AS out_degree FROM {links})",
             "rank0 AS (SELECT id, 1.0::DOUBLE AS r FROM supply_nodes)"]
    for i in range(1, 11):
        steps.append(
            f"rank{i} AS MATERIALIZED (SELECT id, 0.15::DOUBLE + 0.85::DOUBLE * coalesce(got, 0) AS r FROM supply_nodes LEFT JOIN "
            f"(SELECT dst AS id, sum(r / out_degree) AS got FROM arcs JOIN rank{i - 1} ON src = id GROUP BY dst) USING (id))"
        )
    steps.append("ranks AS (SELECT id, r / (SELECT avg(r) FROM rank10) AS pagerank FROM rank10)")
    return ",\n".join(steps)


@query("j1_connected_components", check_sql("supply_nodes", "supply_links", extra=_components(), recursive=True, body="SELECT * FROM components"))
def j1(v):
    return graph.connected_components(v("supply_nodes"), v("supply_links"))


@query("j2_pagerank", check_sql("supply_nodes", "supply_links", extra=_rank_rounds(), body="SELECT id, round(pagerank, 7) AS pagerank FROM ranks"))
def j2(v):
    return rounded(graph.pagerank(v("supply_nodes"), v("supply_links")), "pagerank", digits=7)


@query("j3_graph_metrics", check_sql("supply_nodes", "supply_links", extra=f"{_components()},\n{_rank_rounds()}", recursive=True, body="""
SELECT id, criticality, component AS community_id, round(pagerank, 7) AS pagerank
FROM supply_nodes JOIN components USING (id) JOIN ranks USING (id) ORDER BY round(pagerank, 9) DESC, id"""))
def j3(v):
    return rounded(graph.graph_metrics(v("supply_nodes"), v("supply_links")), "pagerank", digits=7)


@query("j4_hop_distances_directed", check_sql("raw_roads", "vertices", recursive=True, extra="""
steps(id, target, hops) AS (SELECT id, id, 0 FROM vertices WHERE criticality = 'high'
  UNION SELECT src, target, hops + 1 FROM steps JOIN raw_roads ON dst = id WHERE hops < 25)""", body="""
SELECT id AS source_id, target AS target_id, min(hops) AS hop_distance FROM steps GROUP BY id, target"""))
def j4(v):
    return graph.hop_distances(v("raw_roads"), graph.landmarks(v("vertices")))


@query("j4_hop_distances_two_way", check_sql("supply_nodes", "supply_links", recursive=True, extra="""
two_way AS MATERIALIZED (SELECT src, dst FROM supply_links UNION SELECT dst, src FROM supply_links),
steps(id, target, hops) AS (SELECT id, id, 0 FROM supply_nodes WHERE criticality = 'high'
  UNION SELECT dst, target, hops + 1 FROM steps JOIN two_way ON src = id WHERE hops < 12)""", body="""
SELECT id AS source_id, target AS target_id, min(hops) AS hop_distance FROM steps GROUP BY id, target"""))
def j4_two_way(v):
    return graph.hop_distances(v("supply_links"), graph.landmarks(v("supply_nodes")), directed=False)


@query("j1_components_all_links", check_sql("supply_nodes", "all_links", extra=_components("all_links"), recursive=True, body="SELECT * FROM components"))
def j1_all(v):
    return graph.connected_components(v("supply_nodes"), v("all_links"))


@query("j3_graph_metrics_all_links", check_sql("supply_nodes", "all_links", extra=f"{_components('all_links')},\n{_rank_rounds('all_links')}", recursive=True, body="""
SELECT id, criticality, component AS community_id, round(pagerank, 7) AS pagerank
FROM supply_nodes JOIN components USING (id) JOIN ranks USING (id)"""))
def j3_all(v):
    return rounded(graph.graph_metrics(v("supply_nodes"), v("all_links")), "pagerank", digits=7)


@query("j4_hop_distances_all_links", check_sql("supply_nodes", "all_links", recursive=True, extra="""
two_way AS MATERIALIZED (SELECT src, dst FROM all_links UNION SELECT dst, src FROM all_links),
steps(id, target, hops) AS (SELECT id, id, 0 FROM supply_nodes WHERE criticality = 'high'
  UNION SELECT dst, target, hops + 1 FROM steps JOIN two_way ON src = id WHERE hops < 6)""", body="""
SELECT id AS source_id, target AS target_id, min(hops) AS hop_distance FROM steps GROUP BY id, target"""))
def j4_all(v):
    return graph.hop_distances(v("all_links"), graph.landmarks(v("supply_nodes")), directed=False)


@query("j11_is_connected", check_sql("roads", "vertices", recursive=True, extra="""
arcs AS (SELECT src, dst FROM roads UNION SELECT dst, src FROM roads),
reach(id) AS (SELECT min(id) FROM vertices UNION SELECT dst FROM reach JOIN arcs ON src = id)""", body="""
SELECT (SELECT count(*) FROM reach) = (SELECT count(*) FROM vertices) AS connected"""))
def j11(v):
    components = graph.connected_components(v("vertices"), v("roads"))
    return components.agg((F.countDistinct("component") <= 1).alias("connected"))


@query("g6_landmarks", check_sql("vertices", body="""
SELECT id FROM vertices WHERE criticality = 'high' UNION ALL SELECT min(id) FROM vertices WHERE criticality <> 'high'"""))
def g6(v):
    nodes = v("vertices")
    return graph.landmarks(nodes).unionByName(graph.landmarks(nodes.filter("criticality <> 'high'")))


# Routing -----------------------------------------------------------------------------------------------------------

ROUTE_VIEWS = (*NET_VIEWS, "od_pairs")
ROUTING = f"{parts.LIVE},\n{parts.costs('balanced')},\n{parts.ARCS},\n{parts.walks()},\n{parts.ROUTES}"


def arcs_of(v: Views, profile: str = "balanced", **options) -> DataFrame:
    return routing.weighted_edges(live_roads(v), profile, factor_of(v), **RUSH, **options)


@query("j5_weighted_edges", check_sql(*NET_VIEWS, extra=f"{parts.LIVE},\n{parts.costs('low_risk', ('0.5', '0.3', '0.2'))},\n{parts.ARCS}", body="""
SELECT src, dst, round(w, 6) AS routing_weight_minutes FROM arcs WHERE src NOT IN ('W3', 'W5') AND dst NOT IN ('W3', 'W5')"""))
def j5(v):
    arcs = arcs_of(v, "low_risk", weights=(0.5, 0.3, 0.2), avoid=["W3", "W5"])
    return rounded(arcs.select("src", "dst", "routing_weight_minutes"), "routing_weight_minutes", digits=6)


@query("j6_best_route", check_sql(*ROUTE_VIEWS, extra=ROUTING, recursive=True, body="""
SELECT source, target, round(cost, 6) AS cost, array_to_string(path, ' -> ') AS path FROM routes WHERE rank = 1
UNION ALL SELECT source, target, 0.0, source FROM od_pairs WHERE source = target"""))
def j6(v):
    best = routing.best_route(arcs_of(v), v("od_pairs"))
    return rounded(best, "cost", digits=6).withColumn("path", F.array_join("path", " -> "))


@query("j7_k_routes", check_sql(*ROUTE_VIEWS, extra=ROUTING, recursive=True, body="""
SELECT source, target, rank, round(cost, 6) AS cost, array_to_string(path, ' -> ') AS path FROM routes"""))
def j7(v):
    routes = routing.k_routes(arcs_of(v), v("od_pairs"), 3)
    return rounded(routes, "cost", digits=6).withColumn("path", F.array_join("path", " -> "))


SUMMARY = """legs AS (SELECT source, target, rank, path[i] AS src, path[i + 1] AS dst FROM (
  SELECT *, unnest(range(1, len(path))) AS i FROM routes)),
totals AS (SELECT source, target, rank, count(*) AS hops, sum(distance_km) AS total_distance_km, sum(avg_delay_minutes) AS expected_delay_minutes,
  sum(base_minutes) AS base_travel_minutes, sum(weather_penalty_minutes) AS edge_penalty, sum(risk_component_minutes) AS risk_score_minutes,
  sum(eco_component_minutes) AS eco_score_minutes, sum(w) AS routing_weight_minutes, avg(uncertainty_index) AS uncertainty_score
  FROM legs JOIN arcs USING (src, dst) GROUP BY ALL),
timed AS (SELECT *, edge_penalty * least(f * (1 + 0.55::DOUBLE * least(expected_delay_minutes / hops / 20, 1)
    + 0.25::DOUBLE * least(total_distance_km / hops / 450, 1)), 3.2::DOUBLE) / f AS weather_penalty_minutes,
  greatest(0.05::DOUBLE, least(0.99::DOUBLE, exp(-0.06::DOUBLE * risk_score_minutes))) AS on_time_probability
  FROM totals, (SELECT weather_factor AS f FROM factor)),
summed AS (SELECT *, base_travel_minutes + weather_penalty_minutes AS eta,
  list_sort([{'s': round(weather_penalty_minutes * 2 / 3.0::DOUBLE, 6), 'o': 0, 't': 'weather impact: ' || round(weather_penalty_minutes, 1)},
    {'s': round(risk_score_minutes * 0.5, 6), 'o': -1, 't': 'operational risk: ' || round(risk_score_minutes, 1)},
    {'s': round(eco_score_minutes * 0.5, 6), 'o': -2, 't': 'eco cost: ' || round(eco_score_minutes, 1)},
    {'s': round(uncertainty_score * 0.5, 6), 'o': -3, 't': 'network uncertainty: ' || round(uncertainty_score, 2)}], 'DESC') AS factors FROM timed)"""


@query("j8_route_summary", check_sql(*ROUTE_VIEWS, extra=f"{ROUTING},\n{SUMMARY}", recursive=True, body="""
SELECT source, target, rank, array_to_string(path, ' -> ') AS path, total_distance_km, expected_delay_minutes,
  round(base_travel_minutes, 6) AS base_travel_minutes, round(weather_penalty_minutes, 6) AS weather_penalty_minutes,
  round(eta, 6) AS estimated_travel_minutes, round(risk_score_minutes, 6) AS risk_score_minutes, round(eco_score_minutes, 6) AS eco_score_minutes,
  round(uncertainty_score, 9) AS uncertainty_score, round(on_time_probability, 6) AS on_time_probability,
  round(eta - first_value(eta) OVER w, 6) AS delta_vs_best_minutes,
  round(routing_weight_minutes - first_value(routing_weight_minutes) OVER w, 6) AS delta_vs_best_weight,
  concat(factors[1].t, ' | ', factors[2].t, ' | ', factors[3].t) AS explain
FROM summed JOIN routes USING (source, target, rank) WINDOW w AS (PARTITION BY source, target ORDER BY rank)"""))
def j8(v):
    arcs = cut_lineage(arcs_of(v))
    summary = routing.route_summary(routing.k_routes(arcs, v("od_pairs"), 3), arcs, factor_of(v))
    figures = ["base_travel_minutes", "weather_penalty_minutes", "estimated_travel_minutes", "risk_score_minutes", "eco_score_minutes",
               "on_time_probability", "delta_vs_best_minutes", "delta_vs_best_weight"]
    kept = ["source", "target", "rank", "path", "total_distance_km", "expected_delay_minutes", "uncertainty_score", "explain"]
    return rounded(rounded(summary.select(*kept, *figures), *figures), "uncertainty_score", digits=9)


@query("j9_trivial_routes", check_sql("od_pairs", "weather", extra=FACTOR, body="""
SELECT source, target, 1 AS rank, source AS path, 0.0::DOUBLE AS total_minutes, round(weather_factor, 6) AS weather_factor,
  1.0::DOUBLE AS on_time_probability FROM od_pairs, factor WHERE source = target"""))
def j9(v):
    like = v.spark.createDataFrame(
        [], "source string, target string, rank int, path string, total_minutes double, weather_factor double, on_time_probability double"
    )
    return rounded(routing.trivial_routes(v("od_pairs"), like, factor_of(v)), "weather_factor")


@query("e16_route_totals", check_sql(*ROUTE_VIEWS, extra=f"{ROUTING},\n{SUMMARY}", recursive=True, body="""
SELECT source, target, rank, hops, total_distance_km, expected_delay_minutes, round(base_travel_minutes, 6) AS base_travel_minutes,
  round(routing_weight_minutes, 6) AS routing_weight_minutes FROM totals WHERE rank = 1"""))
def e16(v):
    arcs = cut_lineage(arcs_of(v))
    best = routing.best_route(arcs, v("od_pairs").filter("source <> target")).withColumn("rank", F.lit(1))
    totals = routing.route_totals(routing.route_edges(best, arcs)).select(
        "source", "target", "rank", "hops", "total_distance_km", "expected_delay_minutes", "base_travel_minutes", "routing_weight_minutes"
    )
    return rounded(totals, "base_travel_minutes", "routing_weight_minutes", digits=6)


CATALOG_SQL = f"""one_way AS (SELECT src, dst, distance_km, distance_km + 9 * avg_delay_minutes AS w FROM roads),
arcs AS MATERIALIZED (SELECT * FROM one_way UNION ALL SELECT dst, src, distance_km, w FROM one_way),
{parts.walks(k=1)},
best AS (SELECT source, target, path FROM (SELECT source, target, path, row_number() OVER (PARTITION BY source, target ORDER BY cost, path) AS rn
  FROM od_pairs JOIN walks ON origin = source AND node = target WHERE source <> target) WHERE rn = 1),
once AS (SELECT source, target, path FROM (SELECT *, row_number() OVER (PARTITION BY least(path, list_reverse(path)) ORDER BY source, target) AS rn FROM best) WHERE rn = 1),
degree AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM roads UNION ALL SELECT dst FROM roads) GROUP BY id),
legs AS (SELECT source, target, sum(distance_km) AS km, count(*) AS hops FROM (SELECT *, unnest(range(1, len(path))) AS i FROM once)
  JOIN arcs ON src = path[i] AND dst = path[i + 1] GROUP BY ALL),
stops AS (SELECT source, target, avg(degree) AS centrality FROM (SELECT *, unnest(path) AS id FROM once) JOIN degree USING (id) GROUP BY ALL),
cand AS (SELECT o.*, greatest(40.0, km) AS total_km, hops, round(1.8::DOUBLE * (a.degree + b.degree) + 1.2::DOUBLE * centrality + 0.9::DOUBLE * hops + greatest(40.0, km) / 240, 6) AS score
  FROM once o JOIN legs USING (source, target) JOIN stops USING (source, target) JOIN degree a ON a.id = o.source JOIN degree b ON b.id = o.target),
ordered AS (SELECT *, row_number() OVER (PARTITION BY hops >= 2 ORDER BY score DESC, hops DESC, total_km, path) AS rn FROM cand),
picked AS (SELECT *, CASE WHEN hops >= 2 AND rn <= 13 THEN 0 WHEN hops = 1 THEN 1 ELSE 2 END AS grp FROM ordered),
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY grp, score DESC, hops DESC, total_km, path) AS place FROM picked) WHERE place <= 20)"""


@query("j12_route_catalog", check_sql("roads", "od_pairs", extra=CATALOG_SQL, recursive=True, body="""
SELECT concat('R', lpad(CAST(place AS STRING), 2, '0')) AS route_id, array_to_string(path, ' -> ') AS path, hops, total_km,
  round(score, 6) AS score, round(greatest(60, least(82, 61 + least(16, total_km / hops / 25))), 1) AS cruise_speed_kmh,
  CAST(1 AS INT) AS dwell_min, CASE WHEN len(path) >= 4 THEN 3 ELSE 2 END AS dwell_max,
  round(greatest(0.15, score) / sum(greatest(0.15, score)) OVER (), 6) AS weight FROM chosen"""))
def j12(v):
    return rounded(rounded(routing.route_catalog(v("roads"), v("od_pairs")), "weight"), "score", digits=6)
