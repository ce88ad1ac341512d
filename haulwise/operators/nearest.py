"""Exact nearest-neighbour search on a longitude/latitude grid, as equi joins on cell numbers.

A round joins every open query to the points in its own and the eight adjoining cells. Any point within one cell width
is then known, which gives a radius inside which nothing can be missing: a query whose k-th answer lies inside it is
final. The k-th answer of any other is a bound on its score, hence on the distance of better ones: it goes on towards the finest
cells that cover this distance, by at most two levels a round, since each round may lower the bound. Queries without k answers take
larger steps.
The coarsest cell is the whole globe, so every query ends.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from haulwise.functions.geo import EARTH_RADIUS_KM, angle_diff, bearing_deg, haversine_km
from haulwise.operators.hotkeys import first_per_key, join_dimension
from haulwise.session import cut_and_measure, cut_lineage

log = logging.getLogger(__name__)

FINEST_LEVEL = 18
LEVEL_STEP, BOUNDED_STEP = 3, 2
CODE_BASE = 1 << 20
GLOBE_SALTS = 16
TURN_LIMIT_DEG = 115
TURN_COST, KM_COST = 1.6, 0.4
# More than any score: nodes beyond the turn limit come after all others.
BACKWARD = 1e5
# Levels between two steps down the pyramid of cells.
CELL_STEP = 2
# Room for rounding: in the angle of a cell's radius, in degrees of a turn, in an offer.
RADIUS_SLACK, TURN_SLACK, OFFER_SLACK = 1e-9, 1e-6, 1e-4


def _cell(lat: Column, lon: Column, cells: Column) -> tuple[Column, Column]:
    """Row and column of the cell when the globe's circumference is cut into ``cells`` cells."""
    return F.floor((lat + 90) / 360 * cells), F.pmod(F.floor((lon + 180) / 360 * cells), cells)


def _code(row: Column, column: Column) -> Column:
    return row * CODE_BASE + column


def _cells(level: Column) -> Column:
    return F.pow(F.lit(2.0), level).cast("bigint")


def _salts(level: Column) -> Column:
    return F.when(level == 0, GLOBE_SALTS).otherwise(1)


def _adjoining(lat: Column, lon: Column, cells: Column) -> Column:
    row, column = _cell(lat, lon, cells)
    codes = [_code(row + i, F.pmod(column + j, cells)) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    return F.array_distinct(F.array(*codes))


def _safe_radius_km(lat: Column, level: Column) -> Column:
    """Every point nearer than this is in the adjoining cells."""
    width = F.radians(F.lit(360.0) / _cells(level))
    return EARTH_RADIUS_KM * F.asin(F.sin(width) * F.cos(F.radians(lat)))


def start_level(points: DataFrame, per_cell: int) -> int:
    """Coarsest level whose cells hold about ``per_cell`` points and whose fullest cell stays moderate."""
    levels = points.select("lat", "lon", F.explode(F.sequence(F.lit(2), F.lit(FINEST_LEVEL))).alias("level"))
    row, column = _cell(F.col("lat"), F.col("lon"), F.pow(F.lit(2.0), F.col("level")).cast("bigint"))
    counts = levels.groupBy("level", _code(row, column).alias("cell")).count()
    summary = counts.groupBy("level").agg(F.max("count").alias("most"), F.avg("count").alias("mean")).collect()
    fit = [r["level"] for r in summary if r["mean"] <= per_cell and r["most"] <= 32 * per_cell]
    return min(fit) if fit else FINEST_LEVEL


def grid_search(
    queries: DataFrame, points: DataFrame, keys: list[str], k: int, score: Callable[[DataFrame], DataFrame],
    km_cost: float, slack: float, level: int, extra: list[str] | None = None,
) -> DataFrame:
    """The ``k`` lowest (``_class``, ``_score``, point id) per query.

    ``queries`` hold ``keys`` and (lat, lon), ``points`` hold (point_id, plat, plon). ``score`` adds ``_class`` and
    ``_score`` to joined rows with their ``km``; a score is at least ``km_cost * km``.
    """
    per_query = Window.partitionBy(*keys)
    order = [F.asc("_class"), F.asc("_score"), F.asc("point_id")]
    lat, lon, at, bound = F.col("lat"), F.col("lon"), F.col("_level"), F.col("_bound")
    reach = lambda level: _safe_radius_km(lat, level) * km_cost - slack
    covering = F.array_max(F.filter(F.sequence(F.lit(0), at - 1), lambda finer: reach(finer) >= F.col("_worst")))
    measures = {"n": F.count(F.lit(1)), "levels": F.bit_or(_cells(at))}
    asked_first = queries.withColumns({"_level": F.lit(level), "_bound": F.lit(None).cast("double")})
    pending, figures = cut_and_measure(asked_first, **measures)
    found = []
    while True:
        levels = [i for i in range(FINEST_LEVEL + 1) if (figures["levels"] or 0) >> i & 1]
        row, column = _cell(F.col("plat"), F.col("plon"), _cells(at))
        placed = points.withColumn("_level", F.explode(F.array(*[F.lit(i) for i in levels or [0]]))).withColumns({
            "_cell": _code(row, column), "_salt": F.pmod(F.xxhash64("point_id"), _salts(at)).cast("int"),
        })
        asked = pending.withColumn("_cell", F.explode(_adjoining(lat, lon, _cells(at)))).withColumn(
            "_salt", F.explode(F.sequence(F.lit(0), _salts(at) - 1))
        )
        met = Observation()
        joined = asked.join(placed, ["_level", "_cell", "_salt"]).observe(met, F.count(F.lit(1)).alias("n"))
        near = joined.withColumn("km", haversine_km("lat", "lon", "plat", "plon")).filter(
            bound.isNull() | (F.col("km") * km_cost - slack <= bound)
        )
        best = first_per_key(score(near), keys, order, k, rank="position").withColumn(
            "_worst", F.when((F.count(F.lit(1)).over(per_query) == k) & (F.max("_class").over(per_query) == 0), F.max("_score").over(per_query))
        )
        answers = best.select(
            *keys, *(extra or []), "point_id", "km", "_score", "position", "_worst",
            F.coalesce((at == 0) | (F.col("_worst") <= reach(at)), F.lit(False)).alias("_final"),
            # Without k answers a step is taken; at the globe the sequence would run backwards.
            F.when(at == 0, 0).when(F.col("_worst").isNull(), F.greatest(F.lit(0), at - LEVEL_STEP)).otherwise(
                F.greatest(F.coalesce(covering, F.lit(0)), at - BOUNDED_STEP)
            ).alias("_next"),
        )
        written, _ = cut_and_measure(answers)
        log.info("nearest: %d queries at levels %s met %d points", figures["n"], levels, met.get["n"])
        found.append(written.filter("_final").drop("_final", "_worst", "_next"))
        if not any(levels):
            break
        told = written.filter("position = 1").select(*[F.col(c).alias(f"_k_{c}") for c in keys], "_final", "_next", "_worst")
        same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys])
        rest = pending.join(told, same, "left").filter(~F.coalesce("_final", at == 0))
        pending, figures = cut_and_measure(
            rest.withColumns({"_level": F.coalesce("_next", F.greatest(F.lit(0), at - LEVEL_STEP)), "_bound": F.col("_worst")}).select(*pending.columns),
            **measures,
        )
        if not figures["n"]:
            break
    return reduce(DataFrame.unionByName, found)


def knn_join(
    queries: DataFrame, points: DataFrame, k: int, exclude_self: bool = False, decimals: int | None = None
) -> DataFrame:
    """The ``k`` nearest points of every query by (distance, point id): (query_id, point_id, distance_km, position).

    ``queries`` are (query_id, latitude, longitude), ``points`` (point_id, latitude, longitude). Equal positions are
    searched once, and of points on one spot only as many as can ever be answers take part. With ``decimals`` distances
    are compared after rounding.
    """
    need = k + 1 if exclude_self else k
    spots = points.select("point_id", F.col("latitude").alias("plat"), F.col("longitude").alias("plon"))
    spots = cut_lineage(first_per_key(spots, ["plat", "plon"], [F.asc("point_id")], need))
    places = queries.select(F.col("latitude").alias("lat"), F.col("longitude").alias("lon")).distinct()

    def score(df: DataFrame) -> DataFrame:
        km = F.round("km", decimals) if decimals is not None else F.col("km")
        return df.withColumns({"_class": F.lit(0), "_score": km})

    slack = 0.0 if decimals is None else 10.0 ** -decimals
    level = start_level(spots.select(F.col("plat").alias("lat"), F.col("plon").alias("lon")), 2 * need)
    hits = grid_search(places, spots, ["lat", "lon"], need, score, 1.0, slack, level)
    back = queries.join(hits, (F.col("latitude") == F.col("lat")) & (F.col("longitude") == F.col("lon")))
    if exclude_self:
        back = back.filter(F.col("point_id") != F.col("query_id"))
    ranked = first_per_key(
        back.select("query_id", "point_id", F.col("_score").alias("distance_km")), ["query_id"],
        [F.asc("distance_km"), F.asc("point_id")], k, rank="position",
    )
    return ranked


def nearest_node(vehicles: DataFrame, nodes: DataFrame) -> DataFrame:
    """(vehicle_id, nearest_id, nearest_km)."""
    hits = knn_join(
        vehicles.select(F.col("vehicle_id").alias("query_id"), "latitude", "longitude"),
        nodes.select(F.col("id").alias("point_id"), "latitude", "longitude"), 1,
    )
    return hits.select(
        F.col("query_id").alias("vehicle_id"), F.col("point_id").alias("nearest_id"), F.col("distance_km").alias("nearest_km")
    )


def _total(score: Column, backward: Column) -> Column:
    """One number in the order of (class, score)."""
    return score + F.when(backward, BACKWARD).otherwise(0.0)


def _facing(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """Add ``km`` to a place and ``turn`` towards it. Both come out of a generator: filters on what follows from them would
    otherwise be pushed below and write out the formulas once more at each use."""
    aim = F.struct(haversine_km("lat", "lon", lat, lon).alias("km"), bearing_deg("lat", "lon", lat, lon).alias("_towards"))
    turn = F.coalesce(angle_diff(F.col("_bearing"), F.col("_towards")), F.lit(0.0))
    return df.select("*", F.inline(F.array(aim))).withColumn("turn", turn).drop("_towards")


def _offer(point: str) -> Column:
    """The order number of a node for a vehicle that faces it; NULL for the vehicle's own node."""
    total = _total(F.round(F.col("turn") * TURN_COST + F.col("km") * KM_COST, 9), F.col("turn") > TURN_LIMIT_DEG)
    return F.when(F.coalesce(F.col(point) != F.col("_here"), F.lit(True)), total)


def cell_pyramid(spots: DataFrame, levels: list[int]) -> DataFrame:
    """(level, parent, cell, clat, clon, radius, low, high): the filled cells of each level under their cell one level up.

    ``radius`` is the angle at the centre of the cell's points that covers them all; ``low`` and ``high`` are the points with the
    smallest and the largest id.
    """
    above = [None, *levels[:-1]]
    pairs = F.array(*[F.struct(F.lit(at).alias("level"), F.lit(up).cast("int").alias("up")) for at, up in zip(levels, above)])
    placed = spots.withColumn("_at", F.explode(pairs)).select("point_id", "plat", "plon", "_at.level", "_at.up")
    own = _code(*_cell(F.col("plat"), F.col("plon"), _cells(F.col("level"))))
    parent = F.coalesce(_code(*_cell(F.col("plat"), F.col("plon"), _cells(F.col("up")))), F.lit(0).cast("bigint"))
    point = F.struct("point_id", "plat", "plon")
    boxes = placed.groupBy("level", parent.alias("parent"), own.alias("cell")).agg(
        F.min("plat").alias("south"), F.max("plat").alias("north"), F.min("plon").alias("west"), F.max("plon").alias("east"),
        F.min(point).alias("low"), F.max(point).alias("high"),
    )
    centred = boxes.withColumns({"clat": (F.col("south") + F.col("north")) / 2, "clon": (F.col("west") + F.col("east")) / 2})
    # Up to a quarter turn to either side the farthest point of a box is a corner.
    corner = F.greatest(*[haversine_km("clat", "clon", lat, "east") for lat in ("south", "north")]) / EARTH_RADIUS_KM
    radius = F.when(F.col("east") - F.col("west") <= 180, F.least(corner + RADIUS_SLACK, F.lit(math.pi))).otherwise(math.pi)
    return centred.select("level", "parent", "cell", "clat", "clon", radius.alias("radius"), "low", "high")


def _with_least_offer(met: DataFrame) -> DataFrame:
    """Add ``_least``: what a point in a cell can offer at best, as near as the cell's circle and as straight ahead as its rim."""
    away, radius = F.col("_away"), F.col("radius")
    apart = (away > radius) & (away + radius < math.pi)
    half = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(radius) / F.sin(away))))
    straightest = F.when(~apart, 0.0).otherwise(F.greatest(F.lit(0.0), F.col("turn") - half - TURN_SLACK))
    seen = _facing(met, "clat", "clon").withColumn("_away", F.col("km") / EARTH_RADIUS_KM).withColumns({
        "turn": straightest, "km": F.greatest(F.lit(0.0), away - radius) * EARTH_RADIUS_KM,
    })
    least = _total(F.col("turn") * TURN_COST + F.col("km") * KM_COST, F.col("turn") > TURN_LIMIT_DEG) - OFFER_SLACK
    return seen.withColumn("_least", least).drop("km", "turn", "_away")


def next_node(vehicles: DataFrame, nodes: DataFrame) -> DataFrame:
    """Likely next stop: (vehicle_id, next_id, next_km).

    Vehicles carry their position, the node they are at (``warehouse_id``, never an answer) and a ``bearing``. Without a
    bearing the nearest node wins; with one, nodes within a 115 degree turn come first and the lowest
    1.6 * turn + 0.4 * km wins.

    The search descends a pyramid of cells. A node of every cell is offered; a cell stays open for a vehicle while the nearest
    and straightest point of its circle could be as good as the best offer so far. So a vehicle with nothing ahead of it opens a
    few large cells instead of meeting all nodes within the reach of a wide turn.
    """
    asked = vehicles.select(
        "vehicle_id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), F.col("warehouse_id").alias("_here"),
        F.col("bearing").alias("_bearing"),
    ).filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    spots = nodes.select(F.col("id").alias("point_id"), F.col("latitude").alias("plat"), F.col("longitude").alias("plon"))
    # On one spot only the first id can win, or the second where the first is the vehicle's own node.
    spots = cut_lineage(first_per_key(spots.dropna(subset=["plat", "plon"]), ["plat", "plon"], [F.asc("point_id")], 2))

    leaf = start_level(spots.select(F.col("plat").alias("lat"), F.col("plon").alias("lon")), 8)
    levels = list(range(leaf, 0, -CELL_STEP))[::-1]
    pyramid = cut_lineage(cell_pyramid(spots, levels).repartition("level"))
    # Every level is a table of its own, measured alone: a coarse cell is open for whole fleets and must not become a shuffle key.
    layers = {level: cut_lineage(pyramid.filter(F.col("level") == level).drop("level")) for level in levels}
    tasks = spots.sparkSession.sparkContext.defaultParallelism
    per_vehicle = Window.partitionBy("vehicle_id")
    kept = ["vehicle_id", "lat", "lon", "_here", "_bearing", "_best"]
    open_cells = asked.repartition(tasks).withColumns({"_best": F.lit(math.inf), "_open": F.lit(0).cast("bigint")})

    for level in levels:
        counted = Observation()
        met = join_dimension(open_cells, layers[level].withColumnRenamed("parent", "_open"), "_open", "inner").observe(counted, F.count(F.lit(1)).alias("n"))
        bounded = _with_least_offer(met).filter(F.col("_least") <= F.col("_best"))
        shown = bounded.withColumn("_shown", F.when(F.col("low.point_id") == F.col("_here"), F.col("high")).otherwise(F.col("low")))
        shown = shown.select(*kept, "_least", F.col("cell").alias("_open"), "_shown.*")
        offered = _facing(shown, "plat", "plon").withColumn("_best", F.least("_best", _offer("point_id")))
        seen = offered.select(*kept, "_least", "_open")
        # Most cells fall at the best offer of their own row and never reach the window.
        best = seen.filter(F.col("_least") <= F.col("_best")).withColumn("_best", F.min("_best").over(per_vehicle))
        open_cells, figures = cut_and_measure(best.filter(F.col("_least") <= F.col("_best")).drop("_least").repartition(tasks), n=F.count(F.lit(1)))
        log.info("next node: at level %d %d cells stay open of %d met", level, figures["n"], counted.get["n"])

    placed = spots.withColumn("_cell", _code(*_cell(F.col("plat"), F.col("plon"), _cells(F.lit(leaf)))))
    met = Observation()
    joined = open_cells.join(placed, F.col("_open") == F.col("_cell")).observe(met, F.count(F.lit(1)).alias("n"))
    offered = _facing(joined, "plat", "plon").withColumn("_total", _offer("point_id"))
    first = F.min(F.struct("_total", "point_id", "km")).alias("first")
    found = cut_lineage(offered.filter("_total IS NOT NULL AND _total <= _best + 1e-6").groupBy("vehicle_id").agg(first))
    log.info("next node: %d levels down to %d, then %d points met", len(levels), leaf, met.get["n"])
    return found.select("vehicle_id", F.col("first.point_id").alias("next_id"), F.col("first.km").alias("next_km"))
