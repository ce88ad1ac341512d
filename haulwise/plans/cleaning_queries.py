"""Queries on parsing, cleaning, routing and normalising (inventory 2C)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from haulwise import schemas
from haulwise.functions.times import parse_timestamp
from haulwise.operators import cleaning, enrich
from haulwise.plans.fixtures import check_sql
from haulwise.plans.registry import NOW, Views, now, query


def raw_lines(v: Views, where: str = "TRUE") -> DataFrame:
    """Telemetry as JSON text with the faults real feeds have: other time formats, text in numbers, missing ids, cut lines.
    ``where`` chooses what lands, by the number ``n`` of an event."""
    n = F.expr("CAST(substr(event_id, 9) AS BIGINT)")
    ts = F.col("event_timestamp")
    fields = F.struct(
        "event_id",
        F.when(n % 47 != 0, F.col("vehicle_id")).alias("vehicle_id"),
        "warehouse_id", "route_id", "event_type",
        F.col("latitude").cast("string").alias("latitude"), F.col("longitude").cast("string").alias("longitude"),
        F.when(n % 41 == 0, "fast").otherwise(F.col("speed_kmh").cast("int").cast("string")).alias("speed_kmh"),
        F.when(n % 5 != 0, F.col("delay_minutes")).alias("delay_minutes"),
        F.when(n % 40 == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("event_time"),
    )
    landing = v("telemetry").withColumn("n", n).filter(where)
    return landing.select(F.when(n % 43 == 0, '{"event_id": "cut').otherwise(F.to_json(fields)).alias("value"))


RAW = """raw AS (
SELECT n % 43 = 0 AS cut, event_id, CASE WHEN n % 47 <> 0 THEN vehicle_id END AS vehicle_id, warehouse_id, route_id, event_type,
  CASE WHEN n % 41 = 0 THEN 'fast' ELSE CAST(CAST(speed_kmh AS INT) AS STRING) END AS speed_text,
  CASE WHEN n % 41 = 0 THEN 0.0 ELSE speed_kmh END AS speed_kmh,
  CASE WHEN n % 5 <> 0 THEN delay_minutes END AS delay_minutes,
  date_trunc('second', event_timestamp) AS event_timestamp, n,
  CASE WHEN n % 40 = 0 THEN strftime(event_timestamp, '%Y-%m-%d %H:%M:%S')
    ELSE strftime(event_timestamp, '%Y-%m-%dT%H:%M:%SZ') END AS event_time
FROM (SELECT *, CAST(substr(event_id, 9) AS BIGINT) AS n FROM telemetry))"""


@query("c1_parse_events", check_sql("telemetry", extra=RAW, body="""
SELECT CASE WHEN NOT cut THEN event_id END AS event_id, CASE WHEN NOT cut THEN vehicle_id END AS vehicle_id,
  CASE WHEN NOT cut THEN speed_text END AS speed_kmh, CASE WHEN NOT cut THEN CAST(delay_minutes AS STRING) END AS delay_minutes,
  CASE WHEN NOT cut THEN event_time END AS event_time FROM raw"""))
def c1(v):
    return cleaning.parse_events(raw_lines(v)).select("event_id", "vehicle_id", "speed_kmh", "delay_minutes", "event_time")


def weather_lines(v: Views) -> DataFrame:
    """Weather as JSON text; every other row has its numbers quoted."""
    n = F.expr("CAST(substr(weather_event_id, 3) AS BIGINT)")
    names = ("temperature_c", "precipitation_mm", "wind_kmh")
    rest = ["weather_event_id", "warehouse_id", "weather_code", "source",
            F.date_format("weather_timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("observation_time")]
    plain = F.to_json(F.struct(*names, *rest))
    quoted = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in names], *rest))
    return v("weather").select(F.when(n % 2 == 0, plain).otherwise(quoted).alias("value"))


@query("c2_parse_weather", check_sql("weather", body="""
SELECT weather_event_id, warehouse_id, CAST(temperature_c AS STRING) AS temperature_c,
  CAST(precipitation_mm AS STRING) AS precipitation_mm, CAST(wind_kmh AS STRING) AS wind_kmh, weather_code, source,
  strftime(weather_timestamp, '%Y-%m-%dT%H:%M:%SZ') AS observation_time FROM weather"""))
def c2(v):
    return cleaning.parse_weather(weather_lines(v))


@query("c3_parse_timestamp", check_sql("telemetry", extra=RAW, body="SELECT event_id, event_timestamp FROM raw WHERE NOT cut"))
def c3(v):
    parsed = cleaning.parse_events(raw_lines(v)).filter("event_id IS NOT NULL")
    return parsed.select("event_id", parse_timestamp("event_time").cast("timestamp_ntz").alias("event_timestamp"))


@query("c4_clean_events", check_sql("telemetry", extra=RAW, body="""
SELECT event_id, vehicle_id, warehouse_id, speed_kmh, coalesce(delay_minutes, 0) AS delay_minutes, event_timestamp
FROM raw WHERE NOT cut AND vehicle_id IS NOT NULL"""))
def c4(v):
    return cleaning.clean_events(cleaning.parse_events(raw_lines(v))).select(
        "event_id", "vehicle_id", "warehouse_id", "speed_kmh", "delay_minutes", F.col("event_timestamp").cast("timestamp_ntz").alias("event_timestamp")
    )


@query("c5_clean_weather", check_sql("weather", body="""
SELECT weather_event_id, warehouse_id, temperature_c, precipitation_mm, wind_kmh, weather_code, source,
  date_trunc('second', weather_timestamp) AS weather_timestamp FROM weather"""))
def c5(v):
    return cleaning.clean_weather(cleaning.parse_weather(weather_lines(v))).withColumn(
        "weather_timestamp", F.col("weather_timestamp").cast("timestamp_ntz")
    )


@query("c6_normalize_weather_export", check_sql("weather", body="""
SELECT weather_event_id, CASE WHEN n % 7 = 0 THEN 'UNK' ELSE warehouse_id END AS warehouse_id,
  CASE WHEN n % 11 = 0 THEN 0.0 ELSE temperature_c END AS temperature_c, precipitation_mm, wind_kmh,
  CASE WHEN n % 5 = 0 THEN 'unknown' ELSE weather_code END AS weather_code,
  CASE WHEN n % 3 = 0 THEN 'cassandra' ELSE source END AS source,
  date_trunc('second', weather_timestamp) AS weather_timestamp
FROM (SELECT *, CAST(substr(weather_event_id, 3) AS BIGINT) AS n FROM weather)
WHERE n % 13 <> 0 AND n % 17 <> 0"""))
def c6(v):
    n = F.expr("CAST(substr(weather_event_id, 3) AS BIGINT)")
    export = v("weather").select(
        F.when(n % 13 == 0, " other ").otherwise(" ALL ").alias("bucket"),
        F.concat(F.lit(" "), "weather_event_id").alias("weather_event_id"),
        F.when(n % 7 == 0, "  ").otherwise(F.col("warehouse_id")).alias("warehouse_id"),
        F.when(n % 11 == 0, "n/a").otherwise(F.col("temperature_c").cast("string")).alias("temperature_c"),
        F.col("precipitation_mm").cast("string").alias("precipitation_mm"),
        F.concat(F.col("wind_kmh").cast("string"), F.lit(" ")).alias("wind_kmh"),
        F.when(n % 5 == 0, F.lit(None)).otherwise(F.col("weather_code")).alias("weather_code"),
        F.when(n % 3 == 0, "").otherwise(F.col("source")).alias("source"),
        F.when(n % 17 == 0, "yesterday").otherwise(F.date_format("weather_timestamp", "yyyy-MM-dd HH:mm:ss")).alias("weather_timestamp"),
    )
    return cleaning.normalize_weather_export(export).withColumn(
        "weather_timestamp", F.col("weather_timestamp").cast("timestamp_ntz")
    )


@query("c7_normalize_snapshots", check_sql("snapshots", body="""
SELECT strftime(snapshot_time, '%Y%m%d') AS bucket, *, date_trunc('hour', snapshot_time) AS snapshot_hour FROM snapshots"""))
def c7(v):
    return cleaning.normalize_snapshots(v("snapshots"))


@query("c8_route_events", check_sql("telemetry", extra=RAW, body="""
SELECT 'raw' AS route, event_id FROM raw WHERE NOT cut
UNION ALL SELECT 'filtered', event_id FROM raw WHERE NOT cut AND delay_minutes >= 5
UNION ALL SELECT 'rejected', NULL FROM raw WHERE cut"""))
def c8(v):
    routes = cleaning.route_events(cleaning.parse_events(raw_lines(v)))
    parts = [df.select(F.lit(name).alias("route"), "event_id") for name, df in routes.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("c10_weather_to_json", check_sql("weather", body="""
SELECT warehouse_id, CAST(temperature_c AS STRING) AS temperature_c, weather_code, 'station-feed' AS source,
  strftime(weather_timestamp, '%Y-%m-%dT%H:%M:%SZ') AS observation_time, CAST(36 AS INT) AS id_length FROM weather"""))
def c10(v):
    text = cleaning.weather_to_json(v("weather").drop("weather_event_id"), "station-feed", F.col("weather_timestamp"))
    return cleaning.parse_weather(text).select(
        "warehouse_id", "temperature_c", "weather_code", "source", "observation_time",
        F.length("weather_event_id").alias("id_length"),
    )


@query("c12_normalize_warehouse_id", check_sql("telemetry", "vertices", extra="""
aliases AS (SELECT concat('WH', CAST(row_number() OVER (ORDER BY id) AS STRING)) AS alias, id FROM vertices),
coded AS (SELECT event_id, CASE WHEN CAST(substr(event_id, 9) AS BIGINT) % 2 = 0 THEN replace(warehouse_id, 'W', 'WH')
  ELSE warehouse_id END AS warehouse_id FROM telemetry)""", body="""
SELECT event_id, coalesce(id, warehouse_id) AS warehouse_id FROM coded LEFT JOIN aliases ON warehouse_id = alias"""))
def c12(v):
    n = F.expr("CAST(substr(event_id, 9) AS BIGINT)")
    coded = v("telemetry").select(
        "event_id",
        F.when(n % 2 == 0, F.replace("warehouse_id", F.lit("W"), F.lit("WH"))).otherwise(F.col("warehouse_id")).alias("warehouse_id"),
    )
    return cleaning.normalize_warehouse_id(coded, v("vertices")).select("event_id", "warehouse_id")


@query("c13_fresh_only", check_sql("telemetry", body=f"""
SELECT event_id, vehicle_id, event_timestamp FROM telemetry
WHERE date_sub('second', event_timestamp, TIMESTAMP '{NOW}') <= 86400"""))
def c13(v):
    return cleaning.fresh_only(v("telemetry"), now(), max_age=86400).select("event_id", "vehicle_id", "event_timestamp")


@query("c13_freshness_counts", check_sql("telemetry", body=f"""
SELECT count(*) FILTER (WHERE date_sub('second', event_timestamp, TIMESTAMP '{NOW}') <= 86400) AS fresh_rows,
  count(*) FILTER (WHERE date_sub('second', event_timestamp, TIMESTAMP '{NOW}') > 86400) AS stale_rows,
  max(event_timestamp) AS freshest_event_time FROM telemetry"""))
def c13_counts(v):
    return cleaning.freshness_counts(v("telemetry"), now(), max_age=86400)


@query("c14_filter_fleet", check_sql("telemetry", "vehicles", body="""
SELECT event_id, vehicle_id FROM telemetry WHERE vehicle_id IN (SELECT vehicle_id FROM vehicles WHERE vehicle_type = 'truck')"""))
def c14(v):
    return cleaning.filter_fleet(v("telemetry"), v("vehicles").filter("vehicle_type = 'truck'")).select("event_id", "vehicle_id")


@query("c16_require_features", check_sql("telemetry", "vehicles", body="""
SELECT event_id, CASE WHEN user_no % 4 = 0 THEN 'UNKNOWN' ELSE route_id END AS route_id, CAST(capacity_kg AS DOUBLE) AS capacity_kg
FROM (SELECT *, CAST(substr(vehicle_id, 7) AS BIGINT) AS user_no FROM telemetry) JOIN
  (SELECT vehicle_id, capacity_kg FROM vehicles WHERE vehicle_type = 'truck') USING (vehicle_id)"""))
def c16(v):
    no = F.expr("CAST(substr(vehicle_id, 7) AS BIGINT)")
    events = v("telemetry").withColumn("route_id", F.when(no % 4 != 0, F.col("route_id")))
    wide = enrich.enrich_events(events, v("warehouses"), v("vehicles").filter("vehicle_type = 'truck'"))
    return cleaning.require_features(wide).select("event_id", "route_id", "capacity_kg")


# January is one hour ahead of UTC in Madrid; the checked tables hold January only.
@query("c17_local_time_view", check_sql("weather", body="""
SELECT weather_event_id, weather_timestamp, weather_timestamp + INTERVAL 1 HOUR AS weather_timestamp_local FROM weather"""))
def c17(v):
    return cleaning.local_time_view(v("weather").select("weather_event_id", "weather_timestamp"), ["weather_timestamp"])


@query("c18_clean_edges", check_sql("raw_roads", "vertices", body="""
SELECT upper(trim(src)) AS src, upper(trim(dst)) AS dst, greatest(30.0, distance_km) AS distance_km,
  greatest(1.0, avg_delay_minutes) AS avg_delay_minutes
FROM raw_roads WHERE src <> dst AND src IN (SELECT id FROM vertices WHERE criticality <> 'low')
  AND dst IN (SELECT id FROM vertices WHERE criticality <> 'low')"""))
def c18(v):
    messy = v("raw_roads").select(
        F.concat(F.lit(" "), F.lower("src")).alias("src"), F.concat("dst", F.lit("  ")).alias("dst"), "distance_km", "avg_delay_minutes"
    )
    return cleaning.clean_edges(messy, v("vertices").filter("criticality <> 'low'"))


@query("c19_clean_nodes", check_sql("warehouses", body="""
SELECT warehouse_id, latitude, longitude FROM warehouses WHERE CAST(substr(warehouse_id, 2) AS BIGINT) % 9 <> 0"""))
def c19(v):
    n = F.expr("CAST(substr(warehouse_id, 2) AS BIGINT)")
    messy = v("warehouses").select(
        F.concat(F.lit(" "), F.lower("warehouse_id")).alias("warehouse_id"),
        F.when(n % 9 == 0, "north").otherwise(F.col("latitude").cast("string")).alias("latitude"),
        F.col("longitude").cast("string").alias("longitude"),
    )
    return cleaning.clean_nodes(messy)


@query("c21_preview", check_sql("telemetry", body="""
SELECT event_id, vehicle_id, delay_minutes, event_timestamp FROM telemetry ORDER BY delay_minutes DESC, event_id LIMIT 20"""))
def c21(v):
    return cleaning.preview(v("telemetry").select("event_id", "vehicle_id", "delay_minutes", "event_timestamp"), "delay_minutes", 20, "event_id")


@query("g5_newest", check_sql("telemetry", body="""
SELECT event_id, vehicle_id, event_timestamp FROM telemetry ORDER BY event_timestamp DESC, event_id LIMIT 200"""))
def g5(v):
    return cleaning.newest(v("telemetry").select("event_id", "vehicle_id", "event_timestamp"), "event_timestamp", 200, "event_id")


@query("g8_sort_by", check_sql("vehicles", body="SELECT * FROM vehicles ORDER BY capacity_kg DESC"))
def g8(v):
    return cleaning.sort_by(v("vehicles"), "capacity_kg", descending=True)
