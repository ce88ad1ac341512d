"""Streaming queries: windows, latest state, weather, routing and the raw archive."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from haulwise.operators.cleaning import clean_events, clean_weather, parse_events, parse_weather, route_events
from haulwise.operators.enrich import enrich_events
from haulwise.operators.latest import latest_state
from haulwise.operators.metrics import delay_windows
from haulwise.sinks import keyed
from haulwise.sinks.tables import append_or_fallback, without_stored
from haulwise.sources.streams import StreamSource, read_event_stream

WATERMARK = "20 minutes"


@dataclass(frozen=True)
class FlowConfig:
    """Folders and tables of the flows. ``once`` processes what is there and stops; otherwise the queries keep running.

    ``state_partitions`` sets how many state stores a new stream gets (a checkpoint keeps its number for good); None takes
    the session's shuffle partitions.
    """

    events: StreamSource
    weather: StreamSource
    root: str
    events_table: str = "enriched_events_streaming"
    weather_table: str = "weather_observations_streaming"
    once: bool = False
    trigger_seconds: int = 15
    state_partitions: int | None = None

    def checkpoint(self, name: str) -> str:
        return f"{self.root}/checkpoints/{name}"

    def store(self, name: str) -> str:
        return f"{self.root}/{name}"


def stream_dedup(df: DataFrame, key: str, ts: str, delay: str = WATERMARK) -> DataFrame:
    """One row per key; the state of a key is dropped once the watermark has passed it."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def clean_event_stream(raw: DataFrame, delay: str = WATERMARK) -> DataFrame:
    return stream_dedup(clean_events(parse_events(raw)), "event_id", "event_timestamp", delay)


def clean_weather_stream(raw: DataFrame) -> DataFrame:
    return stream_dedup(clean_weather(parse_weather(raw)), "weather_event_id", "weather_timestamp")


@contextmanager
def state_partitions(spark: SparkSession, n: int | None) -> Iterator[None]:
    """Streams started inside get ``n`` shuffle partitions; a running stream keeps its own copy of the settings."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    if n:
        spark.conf.set("spark.sql.shuffle.partitions", n)
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def _start(df: DataFrame, cfg: FlowConfig, name: str, mode: str, write) -> StreamingQuery:
    writer = df.writeStream.outputMode(mode).queryName(name).option("checkpointLocation", cfg.checkpoint(name)).foreachBatch(write)
    writer = writer.trigger(availableNow=True) if cfg.once else writer.trigger(processingTime=f"{cfg.trigger_seconds} seconds")
    with state_partitions(df.sparkSession, cfg.state_partitions):
        return writer.start()


def _append_once(table: str, fallback: str, key: str, ts: str) -> Callable[[DataFrame, int], None]:
    """An append that a restart cannot double. Only the first batch after a start can be a replay of one that was already
    written, so only that one is compared with the table; what it diverted before is replaced."""
    started = False

    def append(batch: DataFrame, batch_id: int) -> None:
        nonlocal started
        rows = batch if started else without_stored(batch, table, key, ts).select(*batch.columns)
        append_or_fallback(rows, table, fallback, batch_id)
        started = True

    return append


def run_window_stream(spark: SparkSession, cfg: FlowConfig) -> StreamingQuery:
    """15-minute windows in update mode; each update replaces the row of its window."""
    windows = delay_windows(clean_event_stream(read_event_stream(spark, cfg.events)))
    return _start(windows, cfg, "delay_windows", "update", lambda b, _: keyed.upsert_windows(b, cfg.store("delay_windows")))


def run_state_stream(spark: SparkSession, cfg: FlowConfig, warehouses: DataFrame, vehicles: DataFrame) -> StreamingQuery:
    """Enriched events to their table, and the newest of each vehicle to the latest-state store."""
    enriched = enrich_events(clean_event_stream(read_event_stream(spark, cfg.events)), warehouses, vehicles)
    append = _append_once(cfg.events_table, cfg.store("fallback/events"), "event_id", "event_timestamp")

    def fan_out(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            append(batch, batch_id)
            keyed.upsert_latest(latest_state(batch), cfg.store("latest_state"))
        finally:
            batch.unpersist()

    return _start(enriched, cfg, "latest_state", "append", fan_out)


def run_weather_stream(spark: SparkSession, cfg: FlowConfig) -> StreamingQuery:
    append = _append_once(cfg.weather_table, cfg.store("fallback/weather"), "weather_event_id", "weather_timestamp")

    def fan_out(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            append(batch, batch_id)
            keyed.upsert_weather(batch, cfg.store("weather_recent"))
        finally:
            batch.unpersist()

    return _start(clean_weather_stream(read_event_stream(spark, cfg.weather)), cfg, "weather", "append", fan_out)


def run_router(spark: SparkSession, cfg: FlowConfig) -> StreamingQuery:
    """Raw, filtered and rejected copies of the incoming lines. A replayed batch overwrites its own folder."""
    parsed = parse_events(read_event_stream(spark, cfg.events), keep_raw=True)

    def fan_out(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for route, rows in route_events(batch).items():
                rows.select("raw_value").write.mode("overwrite").parquet(cfg.store(f"routed/{route}/batch={batch_id}"))
        finally:
            batch.unpersist()

    return _start(parsed, cfg, "router", "append", fan_out)


def start_all(spark: SparkSession, cfg: FlowConfig, warehouses: DataFrame, vehicles: DataFrame) -> list[StreamingQuery]:
    """The three main flows, one checkpoint each; returns when they are done (once) or when any of them ends."""
    queries = [run_window_stream(spark, cfg), run_state_stream(spark, cfg, warehouses, vehicles), run_weather_stream(spark, cfg)]
    if cfg.once:
        for query in queries:
            query.awaitTermination()
    else:
        spark.streams.awaitAnyTermination()
    return queries
