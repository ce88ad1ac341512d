"""The three run modes: batch over landed files, streaming, and the insight sync."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from haulwise import schemas
from haulwise.operators import cleaning, enrich, graph, latest, learning, metrics, snapshots
from haulwise.sinks import keyed, tables
from haulwise.sources import files
from haulwise.sources.tables import first_existing, read_keyed_table

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class BatchConfig:
    """Folders and names of a batch run. ``masters`` holds warehouses.csv and vehicles.csv, ``graph`` vertices.csv and
    edges.csv; ``root`` receives the curated files, the latest-state store and the model."""

    events: str
    masters: str
    graph: str
    root: str
    database: str = "logistics"
    candidates: tuple[learning.Candidate, ...] = learning.CANDIDATES

    def table(self, name: str) -> str:
        return f"{self.database}.{name}"


def run_batch(spark: SparkSession, cfg: BatchConfig) -> None:
    """Landed events to curated tables, 15-minute metrics, graph tables, latest state and delay-risk scores."""
    tables.ensure_schema(spark, cfg.database)
    tables.publish_masters(spark, cfg.masters, cfg.database)
    warehouses, vehicles = spark.table(cfg.table("master_warehouses")), spark.table(cfg.table("master_vehicles"))

    events = metrics.dedup_events(cleaning.clean_events(files.read_events_jsonl(spark, cfg.events)))
    tables.write_parquet(enrich.enrich_events(events, warehouses, vehicles), f"{cfg.root}/enriched_events")
    # Everything below reads the written rows, not the chain that made them.
    enriched = spark.read.parquet(f"{cfg.root}/enriched_events")
    tables.save_table(enriched, cfg.table("enriched_events"))
    tables.save_table(metrics.delay_metrics(enriched), cfg.table("delay_metrics_batch"))

    vertices = files.read_master_csv(spark, f"{cfg.graph}/vertices.csv", schemas.VERTEX)
    edges = files.read_edges_csv(spark, f"{cfg.graph}/edges.csv")
    tables.save_table(graph.graph_metrics(vertices, edges), cfg.table("route_graph_metrics"))
    hops = graph.hop_distances(edges, graph.landmarks(vertices))
    tables.save_table(
        hops.withColumnsRenamed({"source_id": "source_warehouse_id", "target_id": "target_warehouse_id"}), cfg.table("route_shortest_paths")
    )
    keyed.upsert_latest(latest.latest_state(enriched), f"{cfg.root}/latest_state")
    train_and_score(spark, cfg, enriched)


def context_of(spark: SparkSession, cfg: BatchConfig, enriched: DataFrame) -> DataFrame:
    """Enriched events with the weather and congestion of their window, from whichever tables exist."""
    weather = first_existing(spark, [cfg.table(tables.WEATHER_TABLE)], schemas.WEATHER)
    windows = first_existing(spark, [cfg.table(tables.DELAY_TABLE)], schemas.DELAY_WINDOW)
    if windows.isEmpty():
        windows = metrics.delay_windows(enriched)
    congestion = enrich.congestion_features(metrics.compact_windows(windows))
    return enrich.add_context(enriched, enrich.weather_features(weather), congestion)


def train_and_score(spark: SparkSession, cfg: BatchConfig, enriched: DataFrame) -> str:
    """Train, keep the best model, score the latest state. A failure here is logged and leaves the batch standing."""
    try:
        context = context_of(spark, cfg, enriched)
        frame = learning.score_frame(context)
        trained = learning.train_delay_models(learning.ml_features(context), cfg.candidates)
        if trained is None:
            log.warning("too few rows to train: heuristic scores")
            scores, name = learning.score_heuristic(frame), "heuristic"
        else:
            name = trained.selected
            model = trained.models[name]
            model.write().overwrite().save(f"{cfg.root}/models/delay_risk")
            tables.save_table(learning.metrics_frame(spark, trained), cfg.table("ml_model_metrics"))
            scores = learning.score(model, frame)
        tables.save_table(scores, cfg.table("ml_delay_risk_scores"))
        return name
    except Exception as error:  # the curated tables must not be lost to a modelling problem
        log.warning("delay-risk model failed: %s", error)
        return "failed"


def run_insights_sync(spark: SparkSession, source: str, database: str, keyspace: str | None = None) -> bool:
    """Insight snapshots from the serving store to reporting tables; False when there is nothing to sync."""
    try:
        raw = read_keyed_table(spark, source, keyspace)
        if raw.isEmpty():
            log.warning("no insight snapshots to sync")
            return False
        tables.save_table(cleaning.normalize_snapshots(raw), f"{database}.network_insights_snapshots")
        stored = spark.table(f"{database}.network_insights_snapshots")
        tables.save_table(snapshots.hourly_trends(stored), f"{database}.network_insights_hourly_trends")
        return True
    except Exception as error:
        log.warning("insight sync failed: %s", error)
        return False
