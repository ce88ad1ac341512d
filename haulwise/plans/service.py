"""What a dashboard asks: each method is one lazy query over the same inputs."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from haulwise.functions.costs import THIRDS, edge_costs
from haulwise.functions.times import local_clock
from haulwise.operators import cleaning, drift, enrich, eta, graph, insights, latest, metrics, nearest, routing, snapshots, telemetry
from haulwise.session import cut_lineage


@dataclass
class Service:
    """Inputs of the query surface. ``now`` is explicit, so every answer can be repeated.

    ``telemetry`` holds cleaned events, ``stored_latest`` the serving copy of the latest state (None: derive it),
    ``weather`` cleaned observations, ``landed_weather`` the same from a second source (used where the first is older by more
    than ``weather_margin_seconds``). The weather factor counts the readings of the last ``weather_minutes``. ``snapshots`` stored insight rows, ``retrain_state`` the model's stored state (one row), ``live_runs`` and
    ``outside_runs`` what this process and others report about its runs.
    """

    telemetry: DataFrame
    weather: DataFrame
    warehouses: DataFrame
    vehicles: DataFrame
    vertices: DataFrame
    edges: DataFrame
    plans: DataFrame
    now: datetime
    stored_latest: DataFrame | None = None
    snapshots: DataFrame | None = None
    retrain_state: DataFrame | None = None
    landed_weather: DataFrame | None = None
    live_runs: DataFrame | None = None
    outside_runs: DataFrame | None = None
    weather_minutes: int = 30
    weather_margin_seconds: int = 120
    mode: str = "auto"
    zone: str = "Europe/Madrid"
    clock: tuple[bool, int] = field(init=False)
    fleet: DataFrame | None = field(init=False, default=None)
    derived: DataFrame | None = field(init=False, default=None)

    def __post_init__(self) -> None:
        self.clock = local_clock(self.now, self.mode, self.zone)

    def _now(self) -> Column:
        return F.lit(self.now.replace(tzinfo=None)).cast("timestamp_ntz")

    def _weather(self) -> DataFrame:
        """The observations of the better source."""
        if self.landed_weather is None:
            return self.weather
        return latest.prefer_fresh(self.weather, self.landed_weather, "weather_timestamp", self.weather_margin_seconds).drop("source_used")

    def _weather_factor(self) -> DataFrame:
        return metrics.weather_factor(metrics.current_weather(self._weather(), self._now(), self.weather_minutes))

    def _factor(self) -> Column:
        return self._weather_factor().select("weather_factor").scalar()

    def _fleet(self) -> DataFrame:
        """One row per vehicle, derived once per service: the event history is read a single time."""
        if self.fleet is None:
            derived = self.derived = cut_lineage(latest.latest_state(self.telemetry))
            stored = derived if self.stored_latest is None else self.stored_latest
            rows = latest.fleet_latest(stored, derived, self.vehicles)
            self.fleet = cut_lineage(cleaning.normalize_warehouse_id(rows, self.vertices))
        return self.fleet

    def _fleet_source(self) -> DataFrame:
        """One row: which source the fleet rows come from, decided by the same rule and margin."""
        newest = lambda rows: rows.agg(F.max("last_event_timestamp").alias("last_event_timestamp"))
        stored = newest(cleaning.filter_fleet(self.stored_latest, self.vehicles)).filter("last_event_timestamp IS NOT NULL")
        self._fleet()
        derived = newest(cleaning.filter_fleet(self.derived, self.vehicles))
        return latest.prefer_fresh(stored, derived, "last_event_timestamp", 20).select("source_used")

    def _planned_fleet(self) -> DataFrame:
        return enrich.attach_plans(self._fleet(), self.plans)

    def _live_edges(self) -> DataFrame:
        return telemetry.apply_live_telemetry(self.edges, self._planned_fleet())

    def overview(self) -> DataFrame:
        """Fleet figures, weather factor and live coverage in one row.

        The figures come from the stored latest state where that is the fresher source, else from the event history. ``fleet_source``
        says which.
        """
        live = telemetry.live_summary(self._live_edges(), self._planned_fleet())
        weather = self._weather_factor()
        known = metrics.overview(self.telemetry).withColumn("fleet_source", F.lit("events"))
        if self.stored_latest is not None:
            source = self._fleet_source().select("source_used").scalar()
            stored = metrics.overview_latest(self._fleet()).withColumn("fleet_source", F.lit("stored"))
            known = stored.filter(source == "primary").unionByName(known.filter(F.coalesce(source != "primary", F.lit(True))))
        return known.withColumns({"_w": weather.select(F.struct("*")).scalar(), "_l": live.select(F.struct("*")).scalar()}).select(
            "vehicles_active", "events_loaded", "avg_delay_minutes", "avg_speed_kmh", "latest_event_time", "fleet_source", "_w.*", "_l.*"
        )

    def latest_vehicles(self, limit: int = 200) -> DataFrame:
        return cleaning.newest(self._planned_fleet(), "last_event_timestamp", limit, "vehicle_id")

    def vehicle_history(self, vehicle: str | None = None, points: int = 120) -> DataFrame:
        rows = cleaning.normalize_warehouse_id(latest.vehicle_history(self.telemetry, vehicle, points), self.vertices)
        return enrich.attach_plans(rows, self.plans).orderBy(
            "vehicle_id", "event_timestamp", "event_id"
        )

    def latest_weather(self, limit: int = 20) -> DataFrame:
        return cleaning.newest(metrics.dedup_weather(self._weather()), "weather_timestamp", limit, "weather_event_id")

    def network(self, profile: str = "balanced", min_congestion: str = "all") -> dict[str, DataFrame]:
        """Vertices with positions, live edges, rankings and the snapshot rows to store."""
        edges = cut_lineage(self._live_edges())
        day, hour = self.clock
        found = insights.network_insights(self.vertices, edges, profile, min_congestion, self._factor(), day, hour)
        return {
            "vertices": enrich.vertices_with_coords(self.vertices, self.warehouses),
            "edges": edges,
            **found,
            "snapshot": snapshots.insights_to_snapshots(
                found["bottlenecks"], found["critical_nodes"], self._now(), profile, min_congestion
            ),
        }

    def insights_history(self, profile: str = "balanced", min_congestion: str = "all", count: int = 10) -> DataFrame:
        return snapshots.insights_history(snapshots.snapshots_for(self.snapshots, self.now), profile, min_congestion, count)

    def best_routes(
        self, od: DataFrame, profile: str = "balanced", weights: tuple = THIRDS, alternatives: int = 3, avoid: list[str] | None = None,
        max_hops: int | None = None,
    ) -> DataFrame:
        """Ranked candidates of every (source, target) pair, zero-cost rows for pairs with equal ends.

        Nodes of ``avoid`` are not passed through; a pair that starts or ends at one keeps its routes.
        """
        day, hour = self.clock
        factor = self._factor()
        arcs = cut_lineage(routing.weighted_edges(self._live_edges(), profile, factor, weights, day, hour))
        found = routing.route_summary(routing.k_routes(arcs, od, alternatives, max_hops, avoid=avoid), arcs, factor, weights, profile)
        return found.unionByName(routing.trivial_routes(od, found, factor))

    def retrain_status(self) -> DataFrame:
        """Advice, schedule, last selected model with its errors, and the run's state in one row."""
        overview = metrics.overview_latest(self._fleet())
        live = telemetry.live_summary(self._live_edges(), self._planned_fleet())
        advice = drift.retrain_advice(overview, self._weather_factor(), live, self.retrain_state, self._now())
        parts = {"_schedule": drift.schedule_info(self.retrain_state, self._now()), "_model": drift.model_info(self.retrain_state)}
        if self.live_runs is not None:
            outside = self.live_runs.limit(0) if self.outside_runs is None else self.outside_runs
            parts["_run"] = drift.merge_run_status(self.live_runs, outside, self._now())
        row = advice.withColumns({name: df.agg(F.first(F.struct("*")).alias("row")).scalar() for name, df in parts.items()})
        # Names that the schedule states already are not repeated.
        return row.select(*advice.columns, "_schedule.*", *[f"_model.{c}" for c in drift.MODEL_FIGURES], *(["_run.*"] if "_run" in parts else []))

    def edge_cost_table(self, profile: str = "balanced") -> DataFrame:
        day, hour = self.clock
        return graph.both_directions(edge_costs(self._live_edges(), profile, self._factor(), working_day=day, hour=hour))

    def visible_fleet(self, source: str | None = None, target: str | None = None) -> DataFrame:
        """Vehicles of a corridor, with their inferred route."""
        nodes = enrich.vertices_with_coords(self.vertices, self.warehouses).filter("latitude IS NOT NULL")
        rows = cut_lineage(self._planned_fleet().join(latest.latest_heading(self.telemetry), "vehicle_id", "left"))
        placed = rows.filter("latitude IS NOT NULL AND longitude IS NOT NULL")
        near = cut_lineage(placed.join(nearest.nearest_node(placed, nodes), "vehicle_id", "left"))
        routes = eta.infer_route(near, nodes)
        tagged = rows.join(near.select("vehicle_id", "nearest_id", "nearest_km"), "vehicle_id", "left").join(routes, "vehicle_id", "left")
        return eta.corridor_filter(tagged, nodes, source, target)
