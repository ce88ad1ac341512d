"""Business views over the driver tables.

One SQL text per view, written in the subset that Spark SQL and DuckDB share, so a query and its check start from the
same rows. ``$k`` stands for the only piece that differs: reading the field ``k`` of the JSON column ``props``.
Whole-number delays, speeds and weather values keep averages exact in both engines. About a third of all events belong
to warehouse W0, so every keyed operator meets a hot key.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

VIEWS = {
    "warehouses": """
SELECT concat('W', CAST(s_suppkey AS STRING)) AS warehouse_id, s_name AS warehouse_name, n_name AS country,
  r_name AS region,
  CASE WHEN s_suppkey % 5 = 0 THEN 'high' WHEN s_suppkey % 5 < 3 THEN 'medium' ELSE 'low' END AS criticality,
  CAST(36 + ((s_suppkey * 37) % 101) * 0.07 + ((s_suppkey * s_suppkey) % 13) * 0.017 AS DOUBLE) AS latitude,
  CAST(-9 + ((s_suppkey * 53) % 103) * 0.12 + ((s_suppkey * s_suppkey) % 11) * 0.013 AS DOUBLE) AS longitude
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "vertices": """
SELECT warehouse_id AS id, warehouse_name AS name, 'warehouse' AS type, criticality FROM {warehouses}""",
    "vehicles": """
SELECT DISTINCT concat('TRUCK-', CAST(user_id AS STRING)) AS vehicle_id,
  CASE WHEN user_id % 3 = 0 THEN 'van' ELSE 'truck' END AS vehicle_type,
  CAST(4000 + (user_id % 20) * 1000 AS INT) AS capacity_kg,
  CASE WHEN user_id % 25 = 3 THEN 'maintenance' ELSE 'active' END AS status
FROM {events}""",
    "telemetry": """
SELECT concat('gps_evt_', CAST(event_id AS STRING)) AS event_id,
  concat('TRUCK-', CAST(user_id AS STRING)) AS vehicle_id,
  concat('W', CAST(CASE WHEN event_id % 3 = 0 THEN 0 ELSE (user_id + event_id) % (SELECT count(*) FROM {supplier}) END
    AS STRING)) AS warehouse_id,
  concat('R', CAST(user_id % 20 AS STRING)) AS route_id,
  event_type,
  CAST(36 + ((user_id * 7 + event_id) % 76) * 0.1 AS DOUBLE) AS latitude,
  CAST(-9 + ((user_id * 11 + event_id) % 133) * 0.1 AS DOUBLE) AS longitude,
  CAST(floor(value / 5) AS INT) AS delay_minutes,
  CAST($k AS DOUBLE) AS speed_kmh,
  ts AS event_timestamp
FROM {events}""",
    "telemetry_dups": """
SELECT * FROM {telemetry}
UNION ALL
SELECT event_id, vehicle_id, warehouse_id, route_id, event_type, latitude, longitude,
  CAST(delay_minutes + 1 AS INT) AS delay_minutes, speed_kmh, event_timestamp FROM {telemetry}""",
    "weather": """
SELECT concat('w_', CAST(event_id AS STRING)) AS weather_event_id,
  concat('W', CAST(CASE WHEN event_id % 3 = 0 THEN 0 ELSE (user_id + event_id) % (SELECT count(*) FROM {supplier}) END
    AS STRING)) AS warehouse_id,
  CAST(floor(value / 10) AS DOUBLE) AS temperature_c,
  CAST(event_id % 4 AS DOUBLE) AS precipitation_mm,
  CAST($k AS DOUBLE) AS wind_kmh,
  CAST(event_id % 3 AS STRING) AS weather_code,
  'station' AS source,
  ts AS weather_timestamp
FROM {events} WHERE event_type = 'view'""",
    "raw_roads": """
SELECT concat('W', CAST(i AS STRING)) AS src, concat('W', CAST(j AS STRING)) AS dst,
  CAST(20 + ((i + j) * 37 + i * j) % 700 AS DOUBLE) AS distance_km,
  CAST((i * j + i + j) % 16 AS DOUBLE) AS avg_delay_minutes
FROM (
  SELECT s_suppkey AS i, (s_suppkey + 1) % (SELECT count(*) FROM {supplier}) AS j FROM {supplier}
  UNION ALL
  SELECT s_suppkey AS i, (s_suppkey * 3 + 7) % (SELECT count(*) FROM {supplier}) AS j FROM {supplier}
) AS pairs""",
    "roads": """
SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst,
  greatest(distance_km, CAST(30 AS DOUBLE)) AS distance_km,
  greatest(avg_delay_minutes, CAST(1 AS DOUBLE)) AS avg_delay_minutes
FROM {raw_roads} WHERE src <> dst""",
    # Vans run without a plan.
    "plan_rows": """
SELECT vehicle_id, o, d, (d * 3 + 7) % n AS e, n, user_id
FROM (
  SELECT vehicle_id, user_id, n, user_id % n AS o, ((user_id % n) * 3 + 7) % n AS d
  FROM (SELECT vehicle_id, CAST(substr(vehicle_id, 7) AS BIGINT) AS user_id, (SELECT count(*) FROM {supplier}) AS n
    FROM {vehicles} WHERE vehicle_type = 'truck') AS v
) AS p""",
    "plans": """
SELECT vehicle_id, concat('W', CAST(o AS STRING)) AS planned_origin, concat('W', CAST(d AS STRING)) AS planned_destination,
  concat('W', CAST(o AS STRING)) AS planned_route_origin, concat('W', CAST(e AS STRING)) AS planned_route_destination,
  concat('W', CAST(o AS STRING), ' -> W', CAST(d AS STRING), ' -> W', CAST(e AS STRING)) AS planned_route_label
FROM {plan_rows}""",
    "plan_stops": """
SELECT vehicle_id, 1 AS stop, concat('W', CAST(o AS STRING)) AS node_id FROM {plan_rows}
UNION ALL SELECT vehicle_id, 2, concat('W', CAST(d AS STRING)) FROM {plan_rows}
UNION ALL SELECT vehicle_id, 3, concat('W', CAST(e AS STRING)) FROM {plan_rows}""",
    "od_pairs": """
SELECT DISTINCT concat('W', CAST(o AS STRING)) AS source,
  concat('W', CAST(CASE WHEN user_id % 10 = 0 THEN o ELSE e END AS STRING)) AS target FROM {plan_rows}""",
    "snapshots": """
SELECT CASE WHEN event_id % 2 = 0 THEN 'edge' ELSE 'node' END AS entity_type,
  CASE user_id % 6 WHEN 0 THEN 'balanced' WHEN 1 THEN 'fastest' WHEN 2 THEN 'resilient' WHEN 3 THEN 'eco'
    WHEN 4 THEN 'low_risk' ELSE 'reliable' END AS profile,
  CASE event_id % 3 WHEN 0 THEN 'all' WHEN 1 THEN 'medium' ELSE 'high' END AS min_congestion,
  date_trunc('hour', ts) AS snapshot_time,
  CAST(1 + (event_id + user_id) % 8 AS INT) AS rank,
  CASE WHEN event_id % 2 = 0 THEN concat('W', CAST(user_id AS STRING), '->W', CAST(event_id % 97 AS STRING))
    ELSE concat('W', CAST(user_id AS STRING)) END AS entity_id,
  CASE WHEN event_id % 2 = 0 THEN CAST(floor(value) AS DOUBLE) END AS impact_score,
  CASE WHEN event_id % 2 = 1 THEN CAST(floor(value / 2) AS DOUBLE) END AS criticality_score,
  CAST(floor(value / 5) AS DOUBLE) AS effective_avg_delay_minutes,
  CAST($k AS DOUBLE) AS total_minutes,
  CASE event_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'unknown' END AS congestion_level,
  CAST(event_id % 5 AS INT) AS live_sample_count
FROM {events}""",
    "supply_nodes": """
SELECT concat('C', CAST(c_custkey AS STRING)) AS id, 'low' AS criticality FROM {customer}
UNION ALL
SELECT concat('S', CAST(s_suppkey AS STRING)) AS id,
  CASE WHEN s_suppkey % 5 = 0 THEN 'high' ELSE 'medium' END AS criticality FROM {supplier}""",
    "supply_links": """
SELECT DISTINCT concat('C', CAST(o_custkey AS STRING)) AS src, concat('S', CAST(l_suppkey AS STRING)) AS dst
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
JOIN {customer} ON o_custkey = c_custkey JOIN {supplier} ON l_suppkey = s_suppkey
WHERE c_nationkey = s_nationkey""",
    # Every customer with every supplier it has bought from; supply_links keeps those of one nation, which fall apart by nation.
    "all_links": """
SELECT DISTINCT concat('C', CAST(o_custkey AS STRING)) AS src, concat('S', CAST(l_suppkey AS STRING)) AS dst
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
}

_FIELD = re.compile(r"\{(\w+)\}")
SPARK_JSON_FIELD = "get_json_object(props, '$.k')"
DUCKDB_JSON_FIELD = "json_extract_string(props, '$.k')"


def _needs(name: str) -> list[str]:
    return list(dict.fromkeys(_FIELD.findall(VIEWS[name])))


@lru_cache(maxsize=None)
def _order(names: tuple[str, ...]) -> tuple[str, ...]:
    """The views ``names`` depend on, each after what it reads."""
    done: list[str] = []

    def visit(name: str) -> None:
        if name in VIEWS and name not in done:
            for dep in _needs(name):
                visit(dep)
            done.append(name)

    for name in names:
        visit(name)
    return tuple(done)


def check_sql(*names: str, extra: str = "", body: str, recursive: bool = False) -> str:
    """DuckDB text: the views as common table expressions, further expressions in ``extra``, then ``body``."""
    ctes = []
    for name in _order(tuple(names)):
        text = _FIELD.sub(lambda m: m.group(1), VIEWS[name]).replace("$k", DUCKDB_JSON_FIELD)
        ctes.append(f"{name} AS ({text})")
    if extra:
        ctes.append(extra)
    head = ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) if ctes else ""
    return f"{head}\n{body}"


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table. Its schema is read from the file once; later reads skip that job."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Spark frame of a view or a driver table."""
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    text = VIEWS[name].replace("$k", SPARK_JSON_FIELD)
    return spark.sql(text, **{dep: view(spark, sf_dir, dep) for dep in _needs(name)})
