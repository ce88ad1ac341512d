"""Parsing, cleaning, routing and normalising of events, weather, snapshots, nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from haulwise import schemas
from haulwise.functions.times import age_seconds, day_bucket, parse_timestamp
from haulwise.operators.hotkeys import global_index, join_dimension

DELAY_ROUTING_MINUTES = 5
FRESH_SECONDS = 900


def _parsed(text: Column, schema: T.StructType) -> Column:
    """The fields of a JSON text as columns, each text parsed once.

    The generator keeps later filters above the parsing; as a plain projection they would be pushed below it and parse
    every text again for each condition.
    """
    return F.inline(F.array(F.from_json(text, schema)))


def parse_events(df: DataFrame, value: str = "value", keep_raw: bool = False) -> DataFrame:
    """One JSON text per row to event columns; text that is not a JSON object gives all-NULL columns."""
    text = F.col(value).cast("string")
    return df.select(*([text.alias("raw_value")] if keep_raw else []), _parsed(text, schemas.EVENT_RAW))


def parse_weather(df: DataFrame, value: str = "value") -> DataFrame:
    """Eight weather fields as text, so that a number and a quoted number arrive alike."""
    return df.select(_parsed(F.col(value).cast("string"), schemas.WEATHER_RAW))


def _typed(df: DataFrame, kinds: dict[str, str]) -> dict[str, Column]:
    return {c: F.col(c).try_cast(kind) for c, kind in kinds.items() if c in df.columns}


def clean_events(df: DataFrame) -> DataFrame:
    if "event_timestamp" not in df.columns:
        df = df.withColumn("event_timestamp", parse_timestamp("event_time"))
    kinds = {"latitude": "double", "longitude": "double", "speed_kmh": "double", "delay_minutes": "int"}
    return (
        df.withColumns(_typed(df, kinds))
        .fillna({"delay_minutes": 0, "speed_kmh": 0.0})
        .filter(F.col("event_timestamp").isNotNull() & F.col("vehicle_id").isNotNull() & F.col("warehouse_id").isNotNull())
    )


def clean_weather(df: DataFrame) -> DataFrame:
    if "weather_timestamp" not in df.columns:
        df = df.withColumn("weather_timestamp", parse_timestamp("observation_time"))
    numbers = ("temperature_c", "precipitation_mm", "wind_kmh")
    return (
        df.withColumns(_typed(df, dict.fromkeys(numbers, "double")))
        .fillna(0.0, subset=list(numbers))
        .filter(
            F.col("weather_timestamp").isNotNull() & F.col("weather_event_id").isNotNull() & F.col("warehouse_id").isNotNull()
        )
        .select(
            "weather_event_id", "warehouse_id", "temperature_c", "precipitation_mm", "wind_kmh", "weather_code", "source",
            "weather_timestamp",
        )
    )


def normalize_weather_export(df: DataFrame, bucket: str = "all") -> DataFrame:
    """Clean an all-text export of the keyed weather table: blanks become defaults, rows without id or time go."""

    def text(name: str, default: str) -> Column:
        return F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit(default))

    def number(name: str) -> Column:
        return F.coalesce(F.nullif(F.trim(name), F.lit("")).try_cast("double"), F.lit(0.0))

    out = df.filter(F.lower(F.trim("bucket")) == bucket).select(
        F.trim("weather_event_id").alias("weather_event_id"),
        text("warehouse_id", "UNK").alias("warehouse_id"),
        number("temperature_c").alias("temperature_c"),
        number("precipitation_mm").alias("precipitation_mm"),
        number("wind_kmh").alias("wind_kmh"),
        text("weather_code", "unknown").alias("weather_code"),
        text("source", "cassandra").alias("source"),
        parse_timestamp(F.trim("weather_timestamp")).alias("weather_timestamp"),
    )
    return out.filter((F.col("weather_event_id") != "") & F.col("weather_timestamp").isNotNull())


def normalize_snapshots(df: DataFrame) -> DataFrame:
    columns = [f.name for f in schemas.INSIGHT_SNAPSHOT if f.name != "bucket"]
    return (
        df.filter(F.col("snapshot_time").isNotNull())
        .select(day_bucket("snapshot_time").alias("bucket"), *columns)
        .withColumn("snapshot_hour", F.date_trunc("hour", "snapshot_time"))
    )


def route_events(parsed: DataFrame, threshold: int = DELAY_ROUTING_MINUTES) -> dict[str, DataFrame]:
    """Split parsed events: every readable one is ``raw``, long delays are also ``filtered``, the rest is ``rejected``."""
    readable = F.coalesce(*[F.col(f.name) for f in schemas.EVENT_RAW]).isNotNull()
    delay = F.col("delay_minutes").try_cast("int")
    return {
        "raw": parsed.filter(readable),
        "filtered": parsed.filter(readable & (delay >= threshold)),
        "rejected": parsed.filter(~readable),
    }


def weather_to_json(df: DataFrame, source: str, observed: Column) -> DataFrame:
    """Stamp records with an id, a source and the observation time and serialise them for the topic."""
    stamped = df.withColumns({
        "weather_event_id": F.uuid(),
        "source": F.lit(source),
        "observation_time": F.date_format(observed, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
    })
    return stamped.select(F.to_json(F.struct(*[F.col(f.name) for f in schemas.WEATHER_RAW])).alias("value"))


def warehouse_aliases(vertices: DataFrame) -> DataFrame:
    """(alias, warehouse_id): WH1 is the first vertex id, WH2 the second, and so on."""
    indexed = global_index(vertices.select("id").filter(F.col("id").isNotNull()), [F.col("id")], "n")
    return indexed.select(F.concat(F.lit("WH"), F.col("n").cast("string")).alias("alias"), F.col("id").alias("canonical_id"))


def normalize_warehouse_id(df: DataFrame, vertices: DataFrame, column: str = "warehouse_id") -> DataFrame:
    aliases = warehouse_aliases(vertices).withColumnRenamed("alias", column)
    return (
        join_dimension(df, aliases, column)
        .withColumn(column, F.coalesce("canonical_id", column))
        .drop("canonical_id")
    )


def fresh_only(df: DataFrame, now: Column, ts: str = "event_timestamp", max_age: int = FRESH_SECONDS) -> DataFrame:
    return df.filter(age_seconds(now, ts) <= max_age)


def freshness_counts(df: DataFrame, now: Column, ts: str = "event_timestamp", max_age: int = FRESH_SECONDS) -> DataFrame:
    fresh = F.coalesce(age_seconds(now, ts) <= max_age, F.lit(False))
    return df.agg(
        F.count_if(fresh).alias("fresh_rows"), F.count_if(~fresh).alias("stale_rows"), F.max(ts).alias("freshest_event_time")
    )


def filter_fleet(df: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Keep rows of known vehicles; an empty fleet list keeps everything."""
    allowed = vehicles.select(F.trim("vehicle_id").alias("vehicle_id")).filter("vehicle_id <> ''").distinct()
    if allowed.isEmpty():
        return df
    return join_dimension(df, allowed, "vehicle_id", "left_semi")


def require_features(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["delay_minutes", "speed_kmh", "warehouse_id", "vehicle_id", "vehicle_type"]).withColumns({
        "route_id": F.coalesce("route_id", F.lit("UNKNOWN")),
        "capacity_kg": F.coalesce("capacity_kg", F.lit(0)).cast("double"),
    })


def local_time_view(df: DataFrame, columns: list[str], zone: str = "Europe/Madrid") -> DataFrame:
    """Add ``<name>_local`` renderings of UTC timestamps as wall-clock time."""
    return df.withColumns({
        f"{c}_local": F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col(c).cast("timestamp_ntz")) for c in columns
    })


def clean_edges(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Upper-case trimmed ends, no self loops, no unknown nodes, distance at least 30 km, delay at least 1 minute."""
    known = vertices.select(F.upper(F.trim("id")).alias("node")).distinct()
    out = edges.select(
        F.upper(F.trim("src")).alias("src"),
        F.upper(F.trim("dst")).alias("dst"),
        F.greatest(F.lit(30.0), F.col("distance_km").try_cast("double")).alias("distance_km"),
        F.greatest(F.lit(1.0), F.col("avg_delay_minutes").try_cast("double")).alias("avg_delay_minutes"),
    ).filter((F.col("src") != F.col("dst")) & (F.col("src") != "") & (F.col("dst") != ""))
    for end in ("src", "dst"):
        out = join_dimension(out, known.withColumnRenamed("node", end), end, "left_semi")
    return out.select("src", "dst", "distance_km", "avg_delay_minutes")


def clean_nodes(nodes: DataFrame) -> DataFrame:
    out = nodes.withColumns({
        "warehouse_id": F.upper(F.trim("warehouse_id")),
        "latitude": F.col("latitude").try_cast("double"),
        "longitude": F.col("longitude").try_cast("double"),
    })
    return out.filter((F.col("warehouse_id") != "") & F.col("latitude").isNotNull() & F.col("longitude").isNotNull())


def preview(df: DataFrame, order: str, n: int, *tiebreak: str) -> DataFrame:
    return df.orderBy(F.col(order).desc(), *tiebreak).limit(n)


def newest(df: DataFrame, ts: str, n: int, *tiebreak: str) -> DataFrame:
    return df.orderBy(F.col(ts).desc_nulls_last(), *tiebreak).limit(n)


def sort_by(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    return df.orderBy(F.col(column).desc() if descending else F.col(column).asc())
