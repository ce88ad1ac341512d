"""Cheapest and k cheapest simple routes for a table of origin/target pairs."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from haulwise.functions.costs import THIRDS, edge_costs, on_time_probability, route_weather_factor
from haulwise.functions.grading import impact_level
from haulwise.operators.graph import both_directions, degrees
from haulwise.operators.hotkeys import first_per_key
from haulwise.session import cut_and_measure, cut_lineage

ROUTES = 3
# Hops that balls grow between two estimates of how far they have to reach.
HOPS_PER_ESTIMATE = 3
# Hops that partial routes take in one job.
HOPS_PER_JOB = 3
# What sums of rounded weights may differ by.
SLACK = 1e-9
# Share of a catalogue that goes to routes of several hops first.
LONG_ROUTES = 0.65
# Weights are rounded before they are added up, so that equal routes cost the same wherever they are summed.
WEIGHT_DECIMALS = 6
COST_COLUMNS = (
    "base_minutes", "weather_penalty_minutes", "total_minutes", "risk_component_minutes", "eco_component_minutes",
    "routing_weight_minutes", "uncertainty_index",
)


def weighted_edges(
    edges: DataFrame, profile: str = "balanced", weather_factor: Column | float = 0.0, weights: tuple = THIRDS,
    working_day=True, hour=12, avoid: list[str] | None = None,
) -> DataFrame:
    """Arcs in both directions with their costs; blank ends and avoided nodes are gone. A reverse arc costs the same."""
    usable = edges.filter((F.col("src") != "") & (F.col("dst") != ""))
    if avoid:
        usable = usable.filter(~F.col("src").isin(*avoid) & ~F.col("dst").isin(*avoid))
    costed = edge_costs(usable, profile, weather_factor, weights, working_day, hour)
    rounded = costed.withColumns({c: F.round(c, WEIGHT_DECIMALS) for c in COST_COLUMNS})
    arcs = both_directions(rounded)
    cheapest = F.min_by(F.struct(*[c for c in arcs.columns if c not in ("src", "dst")]), F.col("routing_weight_minutes"))
    return arcs.groupBy("src", "dst").agg(cheapest.alias("a")).select("src", "dst", "a.*")


def _passable(avoid: list[str] | None, *ends: str) -> Column:
    """Whether a route may run through ``node``: avoided nodes are left out, except as one of the named ends."""
    if not avoid:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [F.col("node") == F.col(end) for end in ends], ~F.col("node").isin(*avoid))


def _moved(df: DataFrame) -> DataFrame:
    """A side of a join in a loop. It is never broadcast: each round would collect it on the driver once more."""
    return df.hint("merge")


def _starts(origins: DataFrame) -> DataFrame:
    """Labels of searches (way, origin) before their first hop."""
    return origins.distinct().select(
        "way", "origin", F.col("origin").alias("node"), F.lit(0.0).alias("cost"), F.array("origin").alias("path"),
        F.lit(True).alias("fresh"),
    )


def _relaxed(best: DataFrame, arcs: DataFrame, avoid: list[str] | None, reach: DataFrame | None = None) -> tuple[DataFrame, int]:
    """Labels after one more hop of those that improved last, and how many improved now. Ties go to the first path in node order.

    ``reach`` (way, origin, most) drops labels that cost more than ``most``; NULL drops none.
    """
    grown = best.filter(F.col("fresh") & _passable(avoid, "origin")).join(
        _moved(arcs.withColumnRenamed("way", "_way")), (F.col("way") == F.col("_way")) & (F.col("node") == F.col("arc_from"))
    ).filter(~F.array_contains("path", F.col("arc_to"))).select(
        "way", "origin", F.col("arc_to").alias("node"), (F.col("cost") + F.col("weight")).alias("cost"),
        F.concat("path", F.array("arc_to")).alias("path"), F.lit(True).alias("fresh"),
    )
    merged = best.withColumn("fresh", F.lit(False)).unionByName(grown)
    if reach is not None:
        merged = merged.join(_moved(reach), ["way", "origin"]).filter(F.col("most").isNull() | (F.col("cost") <= F.col("most") + SLACK)).drop("most")
    label = F.min(F.struct("cost", "path", "fresh")).alias("l")
    round_best = merged.groupBy("way", "origin", "node").agg(label).select("way", "origin", "node", "l.cost", "l.path", "l.fresh")
    best, figures = cut_and_measure(round_best, improved=F.count_if("fresh"))
    return best, figures["improved"]


def _arcs_of(arcs: DataFrame, way: str, weight: str, reverse: bool = False) -> DataFrame:
    a, b = ("dst", "src") if reverse else ("src", "dst")
    return arcs.select(F.lit(way).alias("way"), F.col(a).alias("arc_from"), F.col(b).alias("arc_to"), F.col(weight).alias("weight"))


def cheapest_paths(
    arcs: DataFrame, origins: DataFrame, max_hops: int | None = None, weight: str = "routing_weight_minutes", avoid: list[str] | None = None
) -> DataFrame:
    """(origin, node, cost, path): cheapest path from each origin to each node it reaches, of any length unless ``max_hops``
    limits it, with no node of ``avoid`` between its ends."""
    steps = cut_lineage(_arcs_of(arcs, "ahead", weight))
    best = _starts(origins.select(F.lit("ahead").alias("way"), F.col("id").alias("origin")))
    for _ in itertools.count() if max_hops is None else range(max_hops):
        best, improved = _relaxed(best, steps, avoid)
        if not improved:
            break
    return best.drop("fresh", "way")


def best_route(
    arcs: DataFrame, od: DataFrame, max_hops: int | None = None, weight: str = "routing_weight_minutes", avoid: list[str] | None = None
) -> DataFrame:
    """(source, target, cost, path) of the cheapest route of each pair; pairs out of reach have no row."""
    here = od.filter(F.col("source") == F.col("target")).select("source", "target").distinct()
    staying = here.select("source", "target", F.lit(0.0).alias("cost"), F.array("source").alias("path"))
    return k_routes(arcs, od, 1, max_hops, weight, avoid).drop("rank").unionByName(staying)


def _reach(bounds: DataFrame, way: str, end: str) -> DataFrame:
    """(way, origin, most): half the largest bound of the pairs of an end; NULL if one of them has no bound."""
    most = F.when(F.count_if(F.col("bound").isNull()) == 0, F.max("bound") / 2).alias("most")
    return bounds.groupBy(F.lit(way).alias("way"), F.col(end).alias("origin")).agg(most)


def _rest(paths: DataFrame) -> DataFrame:
    """(target, node, rest, tail): the cheapest way from a node to a target."""
    return paths.filter("way = 'back'").select(
        F.col("origin").alias("target"), "node", F.col("cost").alias("rest"), F.reverse("path").alias("tail")
    )


def _bounds(
    pairs: DataFrame, arcs: DataFrame, paths: DataFrame, k: int, max_hops: int | None, avoid: list[str] | None
) -> DataFrame:
    """(source, target, bound): the cost of the k-th cheapest known route of each pair, or the bound it has if lower; NULL where fewer are known."""
    ahead, rest = paths.filter("way = 'ahead'").drop("way"), _rest(paths)
    # Routes that follow a cheapest path, take one arc and follow a cheapest path again.
    first_half = pairs.drop("bound").join(_moved(ahead.withColumnRenamed("origin", "source")), "source").filter(_passable(avoid, "source"))
    first_half = first_half.join(_moved(arcs), F.col("node") == F.col("src"))
    joined = first_half.select("source", "target", "cost", "path", F.col("dst").alias("node"), "w").filter(_passable(avoid, "target"))
    joined = joined.join(_moved(rest), ["target", "node"])
    full = F.concat("path", "tail")
    known = joined.select("source", "target", full.alias("path"), (F.col("cost") + F.col("w") + F.col("rest")).alias("cost")).filter(
        F.size(F.array_distinct("path")) == F.size("path")
    )
    if max_hops is not None:
        known = known.filter(F.size("path") <= max_hops + 1)
    # A route shows up once per arc of it. The copies are merged before the shuffle; only the k cheapest per task move on.
    order = [F.asc("cost"), F.asc("path")]
    trimmed = known.groupBy("source", "target", "path").agg(F.min("cost").alias("cost"))
    ranked = first_per_key(trimmed, ["source", "target"], order, k, rank="n")
    bounds = ranked.groupBy("source", "target").agg(F.when(F.count(F.lit(1)) == k, F.max("cost")).alias("_new"))
    return cut_lineage(pairs.join(_moved(bounds), ["source", "target"], "left").withColumn("bound", F.least("bound", "_new")).drop("_new"))


def _balls(
    pairs: DataFrame, arcs: DataFrame, k: int, max_hops: int | None, avoid: list[str] | None
) -> tuple[DataFrame, DataFrame]:
    """Cheapest paths around both ends of all pairs, and an upper bound of the cost of each pair's ``k`` cheapest routes.

    A route within the bound has an arc whose start costs at most half of it from the source, and whose end costs at most half
    of it to the target. So the balls reach half of the bound, which is estimated again as they grow; what lies beyond is
    dropped. A pair with fewer than ``k`` known routes has no bound, and its ends search on.
    """
    steps = cut_lineage(_arcs_of(arcs, "ahead", "w").unionByName(_arcs_of(arcs, "back", "w", reverse=True)))
    best = _starts(pairs.select(F.lit("ahead").alias("way"), F.col("source").alias("origin")).unionByName(
        pairs.select(F.lit("back").alias("way"), F.col("target").alias("origin"))
    ))
    bounds, reach, hops = pairs.withColumn("bound", F.lit(None).cast("double")), None, 0
    while True:
        for _ in range(HOPS_PER_ESTIMATE if max_hops is None else min(HOPS_PER_ESTIMATE, max_hops - hops)):
            best, improved = _relaxed(best, steps, avoid, reach)
            hops += 1
            if not improved:
                break
        # A bound stays one when what it rests on has been dropped.
        bounds = _bounds(bounds, arcs, best.drop("fresh"), k, max_hops, avoid)
        if not improved or hops == max_hops:
            return best.drop("fresh"), bounds
        reach = cut_lineage(_reach(bounds, "ahead", "source").unionByName(_reach(bounds, "back", "target")))


def _rests(bounds: DataFrame, arcs: DataFrame, paths: DataFrame) -> DataFrame:
    """(source, target, node, rest): what is left to pay from a node to the target, for all nodes that routes within the bound can
    pass. Inside the target's ball it is known; from its rim it is carried on through the source's ball, pair by pair."""
    within = F.col("bound").isNull() | (F.col("ahead") + F.col("rest") <= F.col("bound") + SLACK)
    ahead = paths.filter("way = 'ahead'").select(F.col("origin").alias("source"), "node", F.col("cost").alias("ahead"))
    near = bounds.join(ahead, "source").filter(F.col("bound").isNull() | (F.col("ahead") <= F.col("bound") + SLACK))
    near = cut_lineage(near)
    known = bounds.join(_rest(paths).drop("tail"), "target").join(near.drop("bound"), ["source", "target", "node"], "left")
    # A node outside the source's ball costs more than half of the bound from there.
    known = known.filter(F.coalesce(within, F.col("rest") <= F.col("bound") / 2 + SLACK)).select(
        "source", "target", "node", "rest", F.lit(True).alias("fresh"), F.lit(True).alias("settled")
    )
    rests = cut_lineage(known)

    def hop(labels: DataFrame) -> DataFrame:
        return labels.join(_moved(arcs), F.col("node") == F.col("dst")).select(
            "source", "target", F.col("src").alias("node"), (F.col("w") + F.col("rest")).alias("rest"), F.lit(True).alias("fresh"), F.lit(False).alias("settled")
        ).join(_moved(near), ["source", "target", "node"]).filter(within).drop("ahead", "bound")

    while True:
        grown = hop(rests.filter("fresh"))
        merged = rests.withColumn("fresh", F.lit(False)).unionByName(grown).unionByName(hop(grown))
        # What the target's ball holds is final.
        least = F.min(F.struct(~F.col("settled"), "rest", "fresh", "settled")).alias("l")
        rests, figures = cut_and_measure(
            merged.groupBy("source", "target", "node").agg(least).select("source", "target", "node", "l.rest", "l.fresh", "l.settled"),
            improved=F.count_if("fresh"),
        )
        if not figures["improved"]:
            return rests.select("source", "target", "node", "rest")


def k_routes(
    arcs: DataFrame, od: DataFrame, k: int = ROUTES, max_hops: int | None = None, weight: str = "routing_weight_minutes",
    avoid: list[str] | None = None,
) -> DataFrame:
    """(source, target, rank, cost, path): the ``k`` cheapest simple routes of each pair, none lost.

    Routes may have any number of hops unless ``max_hops`` limits it; a node of ``avoid`` is an end of a route or not on it.

    1. Balls around all ends grow until they meet half-way; routes through an arc between them bound the answers of a pair.
    2. From the rim of the target's ball the exact rest is carried back to the source, over nodes that the bound allows.
    3. Partial paths grow from the source and stay only while their cost plus the exact rest is within the bound.
    """
    if k < 1:
        raise ValueError("k counts from 1")
    pairs = cut_lineage(od.select("source", "target").filter(F.col("source") != F.col("target")).distinct())
    arcs = cut_lineage(arcs.select("src", "dst", F.col(weight).alias("w")))
    paths, bounds = _balls(pairs, arcs, k, max_hops, avoid)
    rests = _rests(bounds, arcs, paths)

    forward = arcs.select(F.col("src").alias("arc_from"), F.col("dst").alias("arc_to"), "w")
    frontier = bounds.select(
        "source", "target", "bound", F.col("source").alias("node"), F.lit(0.0).alias("cost"), F.array("source").alias("path")
    )
    complete, hops = None, 0
    while True:
        left = HOPS_PER_JOB if max_hops is None else min(HOPS_PER_JOB, max_hops - hops)
        for _ in range(left):
            frontier = _one_hop(frontier, forward, rests, avoid)
        hops += left
        if k == 1:
            # Equal routes are many where weights repeat; the first path in node order is enough.
            first = F.min(F.struct("cost", "path")).alias("l")
            frontier = frontier.groupBy("source", "target", "bound", "node").agg(first).select("source", "target", "bound", "node", "l.cost", "l.path")
        frontier, figures = cut_and_measure(frontier, moving=F.count_if(F.col("node") != F.col("target")))
        arrived = frontier.filter(F.col("node") == F.col("target")).select("source", "target", "cost", "path")
        complete = arrived if complete is None else complete.unionByName(arrived)
        frontier = frontier.filter(F.col("node") != F.col("target"))
        if not figures["moving"] or hops == max_hops:
            return first_per_key(complete, ["source", "target"], [F.asc("cost"), F.asc("path")], k, rank="rank")


def _one_hop(frontier: DataFrame, forward: DataFrame, rests: DataFrame, avoid: list[str] | None) -> DataFrame:
    """Partial routes one hop on; those that have arrived stay as they are."""
    arrived = F.col("node") == F.col("target")
    on = frontier.withColumn("_from", F.when(~arrived, F.col("node"))).join(_moved(forward), F.col("_from") == F.col("arc_from"), "left")
    moved = on.filter(arrived | (F.col("arc_to").isNotNull() & ~F.array_contains("path", F.col("arc_to")))).select(
        "source", "target", "bound", F.coalesce("arc_to", "node").alias("node"),
        F.when(arrived, F.col("cost")).otherwise(F.col("cost") + F.col("w")).alias("cost"),
        F.when(arrived, F.col("path")).otherwise(F.concat("path", F.array("arc_to"))).alias("path"),
    ).filter(_passable(avoid, "target"))
    return moved.join(_moved(rests), ["source", "target", "node"]).filter(
        F.col("bound").isNull() | (F.col("cost") + F.col("rest") <= F.col("bound") + SLACK)
    ).drop("rest")


def route_edges(routes: DataFrame, arcs: DataFrame) -> DataFrame:
    """One row per arc of each route."""
    legs = routes.select("source", "target", "rank", "path", F.posexplode("path").alias("leg", "src")).withColumn(
        "dst", F.try_element_at("path", F.col("leg") + 2)
    ).filter(F.col("dst").isNotNull()).drop("path")
    return legs.join(arcs, ["src", "dst"])


def route_totals(legs: DataFrame) -> DataFrame:
    """Sums over the arcs of each route."""
    total = {
        "total_distance_km": "distance_km", "expected_delay_minutes": "avg_delay_minutes", "base_travel_minutes": "base_minutes",
        "edge_penalty_minutes": "weather_penalty_minutes", "risk_score_minutes": "risk_component_minutes",
        "eco_score_minutes": "eco_component_minutes", "routing_weight_minutes": "routing_weight_minutes",
    }
    return legs.groupBy("source", "target", "rank").agg(
        *[F.round(F.sum(c), WEIGHT_DECIMALS).alias(name) for name, c in total.items()],
        F.avg("uncertainty_index").alias("uncertainty_score"),
        F.count(F.lit(1)).alias("hops"),
    )


def explain_route(routes: DataFrame, weights: tuple = THIRDS) -> DataFrame:
    """Add ``explain``: the three strongest cost factors of a route, strongest first."""
    time, risk, eco = [w if isinstance(w, Column) else F.lit(float(w)) for w in weights]
    half = F.lit(0.5)
    factors = [
        ("weather_penalty_minutes", F.greatest(F.lit(0.4), time + risk), "weather impact", 1),
        ("risk_score_minutes", F.greatest(half, risk), "operational risk", 1),
        ("eco_score_minutes", F.greatest(half, eco), "eco cost", 1),
        ("uncertainty_score", F.greatest(half, risk), "network uncertainty", 2),
    ]
    entries = [
        F.struct(
            F.round(F.col(c) * w, WEIGHT_DECIMALS).alias("strength"), F.lit(-i).alias("order"),
            F.concat(F.lit(f"{label}: "), F.round(c, digits).cast("string")).alias("text"),
        )
        for i, (c, w, label, digits) in enumerate(factors)
    ]
    top = F.slice(F.sort_array(F.array(*entries), asc=False), 1, 3)
    return routes.withColumn("explain", F.array_join(F.transform(top, lambda e: e["text"]), " | "))


def route_summary(
    routes: DataFrame, arcs: DataFrame, weather_factor: Column | float, weights: tuple = THIRDS, profile: str = "balanced"
) -> DataFrame:
    """Totals, arrival time, reliability, explanation and the gap to the best route of each pair."""
    weather = weather_factor if isinstance(weather_factor, Column) else F.lit(float(weather_factor))
    totals = route_totals(route_edges(routes, arcs)).withColumn("weather_factor", weather)
    scaled = totals.withColumn(
        "route_weather_factor",
        route_weather_factor(
            F.col("weather_factor"), F.col("expected_delay_minutes") / F.col("hops"), F.col("total_distance_km") / F.col("hops")
        ),
    )
    ratio = F.when(F.col("weather_factor") > 0, F.try_divide(F.col("route_weather_factor"), F.col("weather_factor"))).otherwise(1.0)
    timed = scaled.withColumn("weather_penalty_minutes", F.col("edge_penalty_minutes") * ratio).withColumns({
        "estimated_travel_minutes": F.col("base_travel_minutes") + F.col("weather_penalty_minutes"),
        "on_time_probability": on_time_probability(F.col("risk_score_minutes")),
        "weather_impact_level": impact_level("weather_factor"),
        "route_weather_impact_level": impact_level("route_weather_factor"),
        "profile": F.lit(profile),
    })
    paths = routes.select("source", "target", "rank", F.array_join("path", " -> ").alias("path"))
    return rank_candidates(explain_route(timed, weights).join(paths, ["source", "target", "rank"])).drop("edge_penalty_minutes")


def rank_candidates(routes: DataFrame) -> DataFrame:
    """Gap of each candidate to the first of its pair, in minutes and in weight. A pair has k candidates."""
    w = Window.partitionBy("source", "target").orderBy("rank")
    return routes.withColumns({
        "delta_vs_best_minutes": F.col("estimated_travel_minutes") - F.first("estimated_travel_minutes").over(w),
        "delta_vs_best_weight": F.col("routing_weight_minutes") - F.first("routing_weight_minutes").over(w),
    })


def trivial_routes(od: DataFrame, like: DataFrame, weather_factor: Column | float) -> DataFrame:
    """Zero-cost rows for pairs whose ends coincide, in the shape of a route summary."""
    weather = weather_factor if isinstance(weather_factor, Column) else F.lit(float(weather_factor))
    same = od.filter(F.col("source") == F.col("target")).select("source", "target").distinct().withColumn("_w", weather)
    special = {
        "source": F.col("source"), "target": F.col("target"), "rank": F.lit(1), "path": F.col("source"),
        "weather_factor": F.col("_w"), "route_weather_factor": F.col("_w"), "weather_impact_level": impact_level("_w"),
        "route_weather_impact_level": impact_level("_w"), "on_time_probability": F.lit(1.0),
        "explain": F.lit("origin and target coincide"), "profile": F.lit("balanced"),
    }
    types = {f.name: f.dataType for f in like.schema}
    return same.select(*[special.get(c, F.lit(0)).cast(types[c]).alias(c) for c in like.columns])


def route_catalog(
    edges: DataFrame, od: DataFrame, n: int = 20, max_hops: int | None = None, long_share: float = LONG_ROUTES
) -> DataFrame:
    """The ``n`` most useful routes among the pairs of a demand table (all, if fewer).

    Cheapest path by km + 9 * delay, one per pair of ends whichever way it is asked for; ranked by demand, centrality,
    hops and length. The best ``long_share`` * ``n`` routes of several hops come first, then direct ones, then the others. Each
    carries its cruising speed, its least and longest stop in minutes, and its share of the traffic.
    """
    arcs = both_directions(edges.select("src", "dst", "distance_km", "avg_delay_minutes")).dropDuplicates(["src", "dst"])
    arcs = cut_lineage(arcs.withColumn("weight", F.col("distance_km") + F.col("avg_delay_minutes") * 9))
    found = best_route(arcs, od.filter(F.col("source") != F.col("target")), max_hops, "weight")
    reverse = F.reverse("path")
    signed = found.withColumn("signature", F.when(reverse < F.col("path"), reverse).otherwise(F.col("path")))
    routes = cut_lineage(first_per_key(signed, ["signature"], [F.asc("source"), F.asc("target")]).drop("signature"))

    degree = degrees(edges)
    stops = routes.select("source", "target", "path", F.posexplode("path").alias("pos", "id"))
    central = stops.join(degree, "id").groupBy("source", "target").agg(
        F.avg("degree").alias("centrality"),
        F.sum(F.when((F.col("pos") == 0) | (F.col("pos") == F.size("path") - 1), F.col("degree")).otherwise(0)).alias("endpoint_demand"),
    )
    numbered = routes.withColumn("rank", F.lit(1))
    km = route_edges(numbered, arcs).groupBy("source", "target").agg(
        F.greatest(F.lit(40.0), F.sum("distance_km")).alias("total_km"), F.count(F.lit(1)).alias("hops")
    )
    scored = routes.join(central, ["source", "target"]).join(km, ["source", "target"]).withColumn(
        "score",
        F.round(
            F.col("endpoint_demand") * 1.8 + F.col("centrality") * 1.2 + F.col("hops") * 0.9 + F.col("total_km") / 240,
            WEIGHT_DECIMALS,
        ),
    )
    order = [F.desc("score"), F.desc("hops"), F.asc("total_km"), F.asc("path")]
    group = F.when((F.col("hops") >= 2) & (F.col("_place") <= int(n * long_share)), 0).when(F.col("hops") == 1, 1).otherwise(2)
    # Only n rows of each kind can be among the first n, and each task ships no more than those.
    kinds = first_per_key(scored.withColumn("_long", F.col("hops") >= 2), ["_long"], order, n, rank="_place")
    chosen = kinds.withColumn("_group", group).orderBy("_group", *order).limit(n)
    place = F.row_number().over(Window.orderBy("_group", *order))
    weight = F.greatest(F.lit(0.15), F.col("score"))
    cruise = F.least(F.lit(82.0), F.greatest(F.lit(60.0), 61 + F.least(F.lit(16.0), F.col("total_km") / F.col("hops") / 25)))
    return chosen.select(
        F.concat(F.lit("R"), F.lpad(place.cast("string"), 2, "0")).alias("route_id"), F.array_join("path", " -> ").alias("path"), "hops", "total_km", "score",
        F.round(cruise, 1).alias("cruise_speed_kmh"), F.lit(1).alias("dwell_min"), F.when(F.size("path") >= 4, 3).otherwise(2).alias("dwell_max"),
        (weight / F.sum(weight).over(Window.partitionBy())).alias("weight"),
    )
