"""Arrival times, route inference and corridor membership of vehicles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from haulwise.functions.geo import angle_diff, bearing_deg, clamp, haversine_km, point_segment_km
from haulwise.operators.hotkeys import join_dimension
from haulwise.operators.nearest import nearest_node, next_node
from haulwise.session import cut_lineage

DELAY_SHARE = 0.35
ARRIVED_KM = 1.2
CORRIDOR_KM = 40.0


def raw_eta(km: Column, speed: Column, delay: Column) -> Column:
    """Minutes to cover ``km`` plus a share of the present delay; NULL for a standing vehicle."""
    return F.when(speed > 0, F.try_divide(km, speed) * 60 + F.coalesce(delay, F.lit(0)) * DELAY_SHARE)


def infer_route(vehicles: DataFrame, nodes: DataFrame) -> DataFrame:
    """(vehicle_id, from_id, to_id, label): the plan where both ends are known nodes, else nearest node to likely next.

    The label of a vehicle without any known end is its ``route_id`` where it has one, else "-". A ``nearest_id`` already on the vehicles is used, otherwise it is searched for the vehicles without a plan.
    """
    # The plans and the searches read these rows more than once.
    vehicles = cut_lineage(vehicles)
    known = nodes.select("id")
    planned = vehicles.select("vehicle_id", "planned_origin", "planned_destination")
    for end in ("planned_origin", "planned_destination"):
        planned = join_dimension(planned, known.withColumnRenamed("id", end), end, "left_semi")
    nothing = F.lit(None).cast("string").alias("route_id")
    planned = planned.select(
        "vehicle_id", F.col("planned_origin").alias("from_id"), F.col("planned_destination").alias("to_id"), nothing
    )
    open_rows = cut_lineage(vehicles.join(planned.select("vehicle_id"), "vehicle_id", "left_anti"))
    if "nearest_id" not in vehicles.columns:
        open_rows = open_rows.join(nearest_node(open_rows, nodes).select("vehicle_id", "nearest_id"), "vehicle_id", "left")
    placed = cut_lineage(open_rows.withColumn("warehouse_id", F.coalesce("nearest_id", "warehouse_id")))
    ahead = next_node(placed, nodes).select("vehicle_id", "next_id")
    guessed = placed.join(ahead, "vehicle_id", "left").select(
        "vehicle_id", F.col("nearest_id").alias("from_id"), F.col("next_id").alias("to_id"),
        "route_id" if "route_id" in placed.columns else nothing,
    )
    both = planned.unionByName(guessed)
    unknown = F.lit("?")
    named = F.concat(F.coalesce("from_id", unknown), F.lit(" -> "), F.coalesce("to_id", unknown))
    return both.withColumn(
        "label", F.when(F.col("from_id").isNull() & F.col("to_id").isNull(), F.coalesce("route_id", F.lit("-"))).otherwise(named)
    ).drop("route_id")


def remaining_stops(vehicles: DataFrame, stops: DataFrame) -> DataFrame:
    """Stops still ahead of each vehicle, in order.

    ``vehicles`` carry ``next_id`` (may be NULL), ``stops`` are (vehicle_id, stop, node_id, latitude, longitude). The list
    starts at the next node if it is on the route; otherwise at the nearest stop, or after it when that is reached.
    """
    at = vehicles.select(
        "vehicle_id", F.col("latitude").alias("v_lat"), F.col("longitude").alias("v_lon"), "speed_kmh", "delay_minutes", "next_id"
    )
    rows = stops.join(at, "vehicle_id").withColumn("km", haversine_km("v_lat", "v_lon", "latitude", "longitude"))
    starts = rows.groupBy("vehicle_id").agg(
        F.min(F.when(F.col("node_id") == F.col("next_id"), F.col("stop"))).alias("next_stop"),
        F.min(F.struct("km", "stop")).alias("near"),
        F.max("stop").alias("last_stop"),
    )
    skip = (F.col("near.km") <= ARRIVED_KM) & (F.col("near.stop") < F.col("last_stop"))
    starts = starts.select(
        "vehicle_id", F.coalesce("next_stop", F.col("near.stop") + F.when(skip, 1).otherwise(0)).alias("start_stop"), "last_stop"
    )
    return rows.join(starts, "vehicle_id").filter(F.col("stop") >= F.col("start_stop"))


def route_etas(vehicles: DataFrame, stops: DataFrame) -> DataFrame:
    """Minutes to each remaining stop: the vehicle's own estimate to the first, plus driving time from stop to stop.

    A window runs over the stops of one vehicle's plan, a list of a few nodes.
    """
    order = Window.partitionBy("vehicle_id").orderBy("stop")
    ahead = remaining_stops(vehicles, stops).filter(F.col("speed_kmh") > 0)
    leg = haversine_km(F.lag("latitude").over(order), F.lag("longitude").over(order), "latitude", "longitude")
    minutes = F.coalesce(F.col("leg_km") / F.col("speed_kmh") * 60, raw_eta(F.col("km"), F.col("speed_kmh"), F.col("delay_minutes")))
    return ahead.withColumn("leg_km", leg).withColumn("leg_minutes", minutes).select(
        "vehicle_id", "stop", "node_id",
        F.sum("leg_minutes").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("eta_minutes"),
    )


def distance_to_route(vehicles: DataFrame, segments: DataFrame, key: str = "vehicle_id") -> DataFrame:
    """(vehicle_id, route_km): least distance to the segments of the route a vehicle is matched to by ``key``."""
    km = point_segment_km("latitude", "longitude", "lat_a", "lon_a", "lat_b", "lon_b")
    return join_dimension(vehicles.select("vehicle_id", *([key] if key != "vehicle_id" else []), "latitude", "longitude"), segments, key, "inner").groupBy(
        "vehicle_id"
    ).agg(F.min(km).alias("route_km"))


def segments_of(stops: DataFrame) -> DataFrame:
    """(vehicle_id, lat_a, lon_a, lat_b, lon_b) between consecutive stops, by an equi join on the stop number."""
    a = stops.select("vehicle_id", F.col("stop"), F.col("latitude").alias("lat_a"), F.col("longitude").alias("lon_a"))
    b = stops.select("vehicle_id", (F.col("stop") - 1).alias("stop"), F.col("latitude").alias("lat_b"), F.col("longitude").alias("lon_b"))
    return a.join(b, ["vehicle_id", "stop"]).drop("stop")


def corridor_next(vehicles: DataFrame, source: Column, target: Column) -> DataFrame:
    """Add ``corridor_next_id``: the far end when the nearest node is one end, else the end with the smaller turn."""

    def km(end: Column) -> Column:
        return haversine_km("latitude", "longitude", end["latitude"], end["longitude"])

    def turn(end: Column) -> Column:
        return angle_diff(F.col("bearing"), bearing_deg("latitude", "longitude", end["latitude"], end["longitude"]))

    # Without a bearing the farther end is taken: the vehicle is thought to have left the nearer one.
    by_distance = F.when(km(source) <= km(target), target["id"]).otherwise(source["id"])
    by_turn = F.when(turn(source) <= turn(target), source["id"]).otherwise(target["id"])
    return vehicles.withColumn(
        "corridor_next_id",
        F.when(F.col("nearest_id") == source["id"], target["id"])
        .when(F.col("nearest_id") == target["id"], source["id"])
        .when(F.col("bearing").isNull(), by_distance)
        .otherwise(by_turn),
    )


def corridor_filter(
    vehicles: DataFrame, nodes: DataFrame, source: str | None = None, target: str | None = None, max_km: float = CORRIDOR_KM
) -> DataFrame:
    """Vehicles on a corridor. ``vehicles`` carry position, ``bearing``, ``nearest_id`` and their route
    (``from_id``, ``to_id``). One end given: vehicles of routes from or to it. Both: on the way along the segment."""
    if not source and not target:
        return vehicles
    start = F.coalesce("from_id", "warehouse_id", F.lit(""))
    if not (source and target):
        return vehicles.filter(start == source) if source else vehicles.filter(F.col("to_id") == target)

    def end(node: str) -> Column:
        return nodes.filter(F.col("id") == node).agg(F.first(F.struct("id", "latitude", "longitude")).alias("n")).scalar()

    tagged = vehicles.withColumns({"_s": end(source), "_t": end(target)})
    s, t = F.col("_s"), F.col("_t")
    km = point_segment_km("latitude", "longitude", s["latitude"], s["longitude"], t["latitude"], t["longitude"])
    inside = corridor_next(tagged, s, t).withColumn("corridor_km", km).filter(
        (F.col("corridor_km") <= max_km) & start.isin(source, target) & F.col("corridor_next_id").isin(source, target)
        & (F.col("to_id") == target)
    )
    return inside.drop("_s", "_t")


def route_weather(weather: DataFrame, weather_factor: Column, route_factor: Column, avg_delay: Column) -> DataFrame:
    """Scale observations to what a route meets: rain with the factor ratio and delay, wind with the ratio alone."""
    ratio = clamp(F.try_divide(route_factor, weather_factor), 0.6, 3.0)
    known = (weather_factor > 0) & (route_factor > 0)
    rain = clamp(ratio * clamp(1 + avg_delay / 55, 1.0, 1.5), 0.7, 3.2)
    wind = clamp(0.92 + (ratio - 1) * 0.65, 0.75, 2.4)
    return weather.withColumns({
        "precipitation_mm": F.when(known, F.col("precipitation_mm") * rain).otherwise(F.col("precipitation_mm")),
        "wind_kmh": F.when(known, F.col("wind_kmh") * wind).otherwise(F.col("wind_kmh")),
    })
