"""Queries that answer the dashboard's composite questions (inventory 2N)."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from haulwise.operators.cleaning import normalize_snapshots
from haulwise.plans import check_parts as parts
from haulwise.plans.fixtures import check_sql
from haulwise.plans.metric_queries import FACTOR, latest_of
from haulwise.plans.network_queries import FLEET, FLEET_VIEWS, LIVE_VIEWS, NET_VIEWS, ROUTE_VIEWS, ROUTING, SUMMARY
from haulwise.plans.registry import NOW, Views, query, rounded
from haulwise.plans.service import Service


def check(*names: str, **parts_of: object) -> str:
    """A check whose weather factor counts the newest half hour only, as the service does."""
    newest = "weather_timestamp > (SELECT max(weather_timestamp) FROM weather) - INTERVAL 30 MINUTE"
    return check_sql(*names, **parts_of).replace("END AS weather_factor FROM weather)", f"END AS weather_factor FROM weather WHERE {newest})")


STATE_SQL = """model AS (SELECT 'delay' AS model_name, TIMESTAMP '2024-01-20 11:59:00' AS last_success_at, TIMESTAMP '2024-01-21 08:00:00' AS last_run_at,
  'done' AS last_status, TRUE AS last_recommendation, 40 AS last_score, 'tuned_baseline_rf' AS last_selected_model,
  max(speed_kmh) AS last_baseline_rmse, avg(speed_kmh) AS last_tuned_baseline_rmse, max(speed_kmh) + 1 AS last_enhanced_rmse,
  avg(speed_kmh) AS last_selected_rmse FROM telemetry)"""


def model_state(v: Views):
    """The stored state of a model whose errors are taken from the events."""
    top, mean = F.max("speed_kmh"), F.avg("speed_kmh")
    return v("telemetry").agg(
        F.lit("delay").alias("model_name"), F.expr("TIMESTAMP_NTZ '2024-01-20 11:59:00'").alias("last_success_at"),
        F.expr("TIMESTAMP_NTZ '2024-01-21 08:00:00'").alias("last_run_at"), F.lit("done").alias("last_status"),
        F.lit(True).alias("last_recommendation"), F.lit(40).alias("last_score"), F.lit("tuned_baseline_rf").alias("last_selected_model"),
        top.alias("last_baseline_rmse"), mean.alias("last_tuned_baseline_rmse"), (top + 1).alias("last_enhanced_rmse"), mean.alias("last_selected_rmse"),
    )


def runs(v: Views, status: str, message: str, source: str):
    """One run report, stamped with the newest event."""
    newest, none = F.max("event_timestamp"), F.lit(None).cast("timestamp_ntz")
    return v("telemetry").agg(
        F.lit("delay").alias("run_key"), F.lit(status).alias("status"), newest.alias("started_at"), none.alias("finished_at"),
        F.lit(message).alias("message"), F.lit(source).alias("source"), newest.alias("updated_at"),
    )


def service(v: Views, mode: str = "peak", **more) -> Service:
    """All inputs from the driver tables; a Tuesday in the rush hour."""
    return Service(
        telemetry=v("telemetry"), weather=v("weather"), warehouses=v("warehouses"), vehicles=v("vehicles"), vertices=v("vertices"),
        edges=v("roads"), plans=v("plans"), now=datetime.fromisoformat(NOW).replace(tzinfo=timezone.utc), mode=mode,
        snapshots=normalize_snapshots(v("snapshots")), retrain_state=model_state(v), **more,
    )


HISTORY = """(SELECT count(DISTINCT vehicle_id) FROM telemetry) AS vehicles_active, (SELECT count(*) FROM telemetry) AS events_loaded,
  (SELECT round(avg(delay_minutes), 6) FROM telemetry) AS avg_delay_minutes, (SELECT max(event_timestamp) FROM telemetry) AS latest_event_time,
  'events' AS fleet_source"""
STORED = """(SELECT count(*) FROM latest JOIN vehicles USING (vehicle_id) WHERE status <> 'maintenance') AS vehicles_active,
  (SELECT count(*) FROM latest) AS events_loaded,
  (SELECT round(avg(delay_minutes), 6) FROM latest JOIN vehicles USING (vehicle_id) WHERE status <> 'maintenance') AS avg_delay_minutes,
  (SELECT max(last_event_timestamp) FROM latest) AS latest_event_time, 'stored' AS fleet_source"""


def overview_check(figures: str) -> str:
    return check(*NET_VIEWS, "vehicles", extra=f"{parts.LIVE},\n{FACTOR}", body=f"""
SELECT {figures}, round((SELECT weather_factor FROM factor), 6) AS weather_factor, (SELECT count(*) FROM moves) AS vehicles_considered,
  (SELECT count(*) FILTER (WHERE live_sample_count > 0) FROM live) AS edges_with_live_samples""")


def overview_of(found: Service):
    row = found.overview().select(
        "vehicles_active", "events_loaded", "avg_delay_minutes", "latest_event_time", "fleet_source", "weather_factor", "vehicles_considered",
        "edges_with_live_samples",
    )
    return rounded(row, "avg_delay_minutes", "weather_factor")


@query("n1_overview", overview_check(STORED))
def n1(v):
    """The serving copy is up to date and answers."""
    return overview_of(service(v, stored_latest=latest_of(v)))


@query("n1_overview_history", overview_check(HISTORY))
def n1_history(v):
    """The serving copy is a day behind: the event history answers."""
    behind = latest_of(v).withColumn("last_event_timestamp", F.expr("last_event_timestamp - INTERVAL 1 DAY"))
    return overview_of(service(v, stored_latest=behind))


@query("n2_latest_vehicles", check_sql(*LIVE_VIEWS, "vehicles", extra=parts.LATEST, body="""
SELECT vehicle_id, warehouse_id, last_event_timestamp, status AS vehicle_status, planned_route_label
FROM latest JOIN vehicles USING (vehicle_id) LEFT JOIN plans USING (vehicle_id) ORDER BY last_event_timestamp DESC, vehicle_id LIMIT 100"""))
def n2(v):
    return service(v).latest_vehicles(100).select("vehicle_id", "warehouse_id", "last_event_timestamp", "vehicle_status", "planned_route_label")


@query("n3_vehicle_history", check_sql("telemetry", "plans", body="""
SELECT vehicle_id, event_id, event_timestamp, planned_route_label FROM (
  SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY event_timestamp DESC, event_id DESC) AS rn FROM telemetry)
LEFT JOIN plans USING (vehicle_id) WHERE rn <= 80"""))
def n3(v):
    return service(v).vehicle_history(points=80).select("vehicle_id", "event_id", "event_timestamp", "planned_route_label")


@query("n4_latest_weather", check_sql("weather", body="""
SELECT weather_event_id, weather_timestamp FROM weather ORDER BY weather_timestamp DESC, weather_event_id LIMIT 20"""))
def n4(v):
    return service(v).latest_weather(20).select("weather_event_id", "weather_timestamp")


@query("n4_latest_weather_landed", check_sql("weather", body="""
SELECT concat('b_', weather_event_id) AS weather_event_id, weather_timestamp FROM weather ORDER BY weather_timestamp DESC, weather_event_id LIMIT 20"""))
def n4_landed(v):
    """The first source is an hour behind: the second, with its own ids, answers."""
    weather = v("weather")
    behind = weather.withColumn("weather_timestamp", F.expr("weather_timestamp - INTERVAL 1 HOUR"))
    landed = weather.withColumn("weather_event_id", F.concat(F.lit("b_"), "weather_event_id"))
    found = service(v)
    found.weather, found.landed_weather = behind, landed
    return found.latest_weather(20).select("weather_event_id", "weather_timestamp")


_NETWORK = f"{parts.LIVE},\n{parts.costs('eco')},\n{parts.scored('eco', 0)},\n{parts.NODE_STATS}"


@query("n5_network_snapshot", check(*NET_VIEWS, extra=_NETWORK, body="""
SELECT 'edge' AS entity_type, concat(src, '->', dst) AS entity_id, rank FROM (
  SELECT *, row_number() OVER (ORDER BY impact_score DESC, d DESC, src, dst) AS rank FROM scored) WHERE rank <= 8
UNION ALL SELECT 'node', id, rank FROM (SELECT *, row_number() OVER (
  ORDER BY criticality_score DESC, round(avg_incident_delay_minutes, 6) DESC, degree DESC, id) AS rank FROM node_stats) WHERE rank <= 8"""))
def n5(v):
    return service(v).network("eco")["snapshot"].select("entity_type", "entity_id", "rank")


@query("n6_insights_history", check_sql("snapshots", body="""
SELECT snapshot_time, max(impact_score) FILTER (WHERE entity_type = 'edge') AS top_edge_impact_score,
  max(criticality_score) FILTER (WHERE entity_type = 'node') AS top_node_criticality_score
FROM snapshots WHERE profile = 'eco' AND min_congestion = 'medium' AND rank = 1 AND snapshot_time >= TIMESTAMP '2024-01-29 00:00:00'
GROUP BY snapshot_time ORDER BY snapshot_time DESC LIMIT 10"""))
def n6(v):
    return service(v).insights_history("eco", "medium", 10).select("snapshot_time", "top_edge_impact_score", "top_node_criticality_score")


@query("n7_best_routes", check(*ROUTE_VIEWS, extra=f"{ROUTING},\n{SUMMARY}", recursive=True, body="""
SELECT source, target, rank, array_to_string(path, ' -> ') AS path, round(eta, 6) AS estimated_travel_minutes,
  round(on_time_probability, 6) AS on_time_probability FROM summed JOIN routes USING (source, target, rank)
UNION ALL SELECT source, target, 1, source, 0.0, 1.0 FROM od_pairs WHERE source = target"""))
def n7(v):
    routes = service(v).best_routes(v("od_pairs")).select("source", "target", "rank", "path", "estimated_travel_minutes", "on_time_probability")
    return rounded(routes, "estimated_travel_minutes", "on_time_probability")


@query("n8_retrain_status", check(*LIVE_VIEWS, "weather", "vehicles", extra=f"{parts.LIVE},\n{FACTOR},\n{STATE_SQL}", body=f"""
SELECT score >= 55 AS recommended, CAST(score AS INT) AS score, round(delay, 6) AS avg_delay_minutes, round(f, 6) AS weather_factor,
  round(ratio, 6) AS live_coverage_ratio, model_name, last_success_at AS last_retrain_at, last_run_at,
  TIMESTAMP '2024-02-01 00:00:00' AS next_scheduled_at, last_selected_model AS selected_model, round(last_baseline_rmse, 6) AS baseline_rmse,
  round(last_selected_rmse, 6) AS selected_rmse, round(100 * (last_baseline_rmse - last_selected_rmse) / last_baseline_rmse, 6) AS gain_percent,
  'running' AS status, newest AS started_at, 'nightly' AS message, 'scheduler' AS source
FROM (SELECT *, 26 + CASE WHEN delay >= 14 THEN 24 WHEN delay >= 9 THEN 12 ELSE 0 END + CASE WHEN f >= 1.2 THEN 8 ELSE 0 END
  + CASE WHEN ratio < 0.32 THEN 15 WHEN ratio < 0.5 THEN 7 ELSE 0 END + CASE WHEN date_sub('second', newest, TIMESTAMP '{NOW}') > 10800 THEN 9 ELSE 0 END AS score
FROM (SELECT (SELECT avg(delay_minutes) FROM latest JOIN vehicles USING (vehicle_id) WHERE status <> 'maintenance') AS delay,
  (SELECT weather_factor FROM factor) AS f, (SELECT count(*) FILTER (WHERE live_sample_count > 0) / count(*) FROM live) AS ratio,
  (SELECT max(last_event_timestamp) FROM latest) AS newest)), model"""))
def n8(v):
    """An idle process here, a run reported by the scheduler."""
    found = service(v, live_runs=runs(v, "idle", "own", "local"), outside_runs=runs(v, "running", "nightly", "scheduler"))
    row = found.retrain_status().drop(
        "reasons", "cooldown_remaining_hours", "edges_with_live_samples", "latest_event_age_minutes", "last_success_at", "tuned_baseline_rmse",
        "enhanced_rmse", "run_key", "finished_at",
    )
    return rounded(row, "avg_delay_minutes", "weather_factor", "live_coverage_ratio", "baseline_rmse", "selected_rmse", "gain_percent")


@query("n10_visible_fleet", check_sql(*FLEET_VIEWS, extra=FLEET, body="SELECT vehicle_id, from_id, to_id FROM routes WHERE from_id = 'W1'"))
def n10(v):
    return service(v).visible_fleet(source="W1").select("vehicle_id", "from_id", "to_id")
