"""File sources: JSON lines, CSV masters, nested snapshots, plan documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from haulwise import schemas
from haulwise.operators.cleaning import clean_events, warehouse_aliases
from haulwise.operators.hotkeys import global_index
from haulwise.session import cut_lineage


def read_events_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Events with the declared schema; an unreadable line becomes a NULL row, which cleaning drops."""
    return spark.read.schema(schemas.EVENT_RAW).option("mode", "PERMISSIVE").json(path)


def read_master_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def read_edges_csv(spark: SparkSession, path: str, infer: bool = False) -> DataFrame:
    reader = spark.read.option("header", True)
    return (reader.option("inferSchema", True) if infer else reader.schema(schemas.EDGE)).csv(path)


def read_ordered_edges(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_edges`` wrote, each row with the number of its part; rows of lower parts come first."""
    part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int")
    return read_edges_csv(spark, path).withColumn("part", part)


def csv_view(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A CSV export as an all-text temporary view."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    df.createOrReplaceTempView(name)
    return df


def newest_files(spark: SparkSession, path: str, n: int) -> list[str]:
    """Paths of the ``n`` newest files, from file metadata alone."""
    listing = spark.read.format("binaryFile").load(path).select("path", "modificationTime")
    return [row["path"] for row in listing.orderBy(F.desc("modificationTime"), F.desc("path")).limit(n).collect()]


def read_recent_files(spark: SparkSession, path: str, max_files: int, max_rows: int) -> DataFrame:
    """The latest ``max_rows`` events of the newest files in event-time order; bad lines are skipped."""
    paths = newest_files(spark, path, max_files)
    if not paths:
        return spark.createDataFrame([], schemas.EVENT_RAW).withColumn("event_timestamp", F.lit(None).cast("timestamp"))
    rows = spark.read.schema(schemas.EVENT_RAW).option("mode", "DROPMALFORMED").json(paths)
    newest = clean_events(rows).orderBy(F.desc("event_timestamp"), F.desc("event_id")).limit(max_rows)
    return newest.orderBy("event_timestamp", "event_id")


def read_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Whole-file JSON documents, each with its file and the file's time; an unreadable one is a row with its text in ``_corrupt``.

    A file may hold one document, which can span lines, or an array of them.
    """
    wide = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    raw = spark.read.schema(wide).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return raw.select("*", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_modification_time").alias("file_time"))


def read_weather_snapshots(spark: SparkSession, path: str, source: str = "snapshot") -> DataFrame:
    """Nested weather documents, flattened; unreadable documents and those without a time are dropped."""
    return flatten_weather_snapshots(read_documents(spark, path, schemas.WEATHER_SNAPSHOT).filter("_corrupt IS NULL"), source)


def flatten_weather_snapshots(raw: DataFrame, source: str = "snapshot") -> DataFrame:
    zero = F.lit(0.0)
    return raw.select(
        F.lit(source).alias("source"),
        F.try_to_timestamp(F.col("current.time")).alias("observed_at"),
        F.coalesce("current.temperature_2m", zero).alias("temperature_c"),
        F.coalesce("current.precipitation", zero).alias("precipitation_mm"),
        F.coalesce("current.wind_speed_10m", zero).alias("wind_kmh"),
        F.coalesce("current.weather_code", F.lit("unknown")).alias("weather_code"),
        "timezone",
    ).filter("observed_at IS NOT NULL")


def explode_plans(documents: DataFrame, vertices: DataFrame | None = None, value: str = "value") -> DataFrame:
    """One row per vehicle of JSON plan documents (a map from vehicle to plan).

    Node names are translated from WHn aliases when vertices are given; missing route ends, node list and label are
    filled from what is there.
    """
    rows = documents.select(F.explode(F.from_json(F.col(value), schemas.PLAN_DOCUMENT)).alias("vehicle_id", "p"))
    nodes = F.filter(F.coalesce("p.planned_route_nodes", F.array().cast("array<string>")), lambda n: F.trim(n) != "")
    flat = rows.select(
        "vehicle_id", F.col("p.origin").alias("planned_origin"), F.col("p.destination").alias("planned_destination"),
        F.col("p.planned_route_origin").alias("planned_route_origin"),
        F.col("p.planned_route_destination").alias("planned_route_destination"),
        nodes.alias("planned_route_nodes"), F.nullif(F.trim("p.planned_route_label"), F.lit("")).alias("planned_route_label"),
    ).filter("vehicle_id <> '' AND planned_origin <> '' AND planned_destination <> ''")
    if vertices is not None:
        flat = _translate(flat, warehouse_aliases(vertices))
    start, end = F.col("planned_route_origin"), F.col("planned_route_destination")
    listed = F.when(F.size("planned_route_nodes") > 0, F.col("planned_route_nodes")).when(
        start.isNotNull() & end.isNotNull(), F.array(start, end)
    ).otherwise(F.col("planned_route_nodes"))
    filled = flat.withColumn("planned_route_nodes", listed)
    route = F.col("planned_route_nodes")
    arrow = F.lit(" -> ")
    return filled.withColumns({
        "planned_route_origin": F.coalesce(start, F.try_element_at(route, F.lit(1)), "planned_origin"),
        "planned_route_destination": F.coalesce(end, F.try_element_at(route, F.lit(-1)), "planned_destination"),
        "planned_route_label": F.coalesce(
            "planned_route_label",
            F.when(F.size(route) > 0, F.array_join(route, " -> ")).otherwise(F.concat("planned_origin", arrow, "planned_destination")),
        ),
    })


def _translate(plans: DataFrame, aliases: DataFrame) -> DataFrame:
    """Replace aliases in the four end columns and, stop by stop, in the node list (a few stops per plan)."""
    numbered = cut_lineage(plans.withColumn("_row", F.monotonically_increasing_id()))
    out = numbered
    for c in ("planned_origin", "planned_destination", "planned_route_origin", "planned_route_destination"):
        table = aliases.select(F.col("alias").alias(c), F.col("canonical_id").alias("_id"))
        out = out.join(table, c, "left").withColumn(c, F.coalesce("_id", c)).drop("_id")
    stops = numbered.select("_row", F.posexplode("planned_route_nodes").alias("pos", "alias")).join(aliases, "alias", "left")
    lists = stops.groupBy("_row").agg(
        F.sort_array(F.collect_list(F.struct("pos", F.coalesce("canonical_id", "alias").alias("node")))).alias("_stops")
    )
    return out.join(lists, "_row", "left").withColumn(
        "planned_route_nodes", F.coalesce(F.transform("_stops", lambda s: s["node"]), "planned_route_nodes")
    ).select(*plans.columns)


def weather_event_id(snapshots: DataFrame) -> DataFrame:
    """Deterministic id of a flattened snapshot: time without punctuation, source, place in newest-first order.

    Readings of one time and source are ordered by all their columns, so only exact copies of a row can change places.
    """
    first = ["source", "temperature_c", "precipitation_mm", "wind_kmh"]
    rest = sorted(set(snapshots.columns) - {"observed_at", *first})
    indexed = global_index(snapshots, [F.desc("observed_at"), *[F.asc(c) for c in [*first, *rest]]], "_n")
    stamp = F.regexp_replace(F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "[-:.]", "")
    label = F.concat(
        F.lit("snap_"), stamp, F.lit("_"), F.regexp_replace("source", " ", "_"), F.lit("_"), (F.col("_n") - 1).cast("string")
    )
    return indexed.withColumn("weather_event_id", label).drop("_n")
