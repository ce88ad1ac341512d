"""Hand-computed values on the 15-node network, and graph properties."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from haulwise.operators import graph, network, routing
from haulwise.session import cut_in_buckets
from tests.conftest import rows

# Positions of the fifteen warehouses and the network they must give.
NODES = [
    ("MAD", 40.4168, -3.7038), ("BCN", 41.3874, 2.1686), ("VAL", 39.4699, -0.3763), ("SEV", 37.3891, -5.9845),
    ("LIS", 38.7223, -9.1393), ("OPO", 41.1579, -8.6291), ("ZAR", 41.6488, -0.8891), ("BIO", 43.2630, -2.9350),
    ("ACO", 43.3623, -8.4115), ("ALM", 36.8340, -2.4637), ("VLL", 41.6523, -4.7245), ("MAL", 36.7213, -4.4214),
    ("MUR", 37.9922, -1.1307), ("GIJ", 43.5322, -5.6611), ("CAC", 39.4765, -6.3722),
]
HIGH = ("MAD", "BCN", "LIS")
EDGES = [
    ("MAL", "SEV", 157.3, 4.0),
    ("MAD", "VLL", 161.9, 5.0),
    ("ALM", "MUR", 174.5, 5.0),
    ("ALM", "MAL", 174.8, 5.0),
    ("MUR", "VAL", 176.9, 5.0),
    ("BIO", "GIJ", 222.3, 5.0),
    ("GIJ", "VLL", 222.6, 5.0),
    ("ACO", "GIJ", 222.8, 5.0),
    ("BIO", "VLL", 231.6, 5.0),
    ("CAC", "SEV", 234.6, 5.0),
    ("BIO", "ZAR", 245.7, 5.0),
    ("ACO", "OPO", 245.8, 5.0),
    ("VAL", "ZAR", 246.1, 5.0),
    ("CAC", "MAD", 250.3, 5.0),
    ("CAC", "LIS", 253.1, 5.0),
    ("BCN", "ZAR", 256.2, 5.0),
    ("CAC", "OPO", 267.5, 6.0),
    ("MAD", "ZAR", 272.9, 6.0),
    ("LIS", "OPO", 274.3, 6.0),
    ("CAC", "VLL", 279.1, 6.0),
    ("MAD", "VAL", 302.6, 6.0),
    ("BCN", "VAL", 303.1, 6.0),
    ("LIS", "SEV", 313.5, 6.0),
    ("BIO", "MAD", 322.8, 6.0),
    ("OPO", "VLL", 330.2, 6.0),
    ("MAD", "MUR", 349.0, 6.0),
    ("ACO", "VLL", 357.0, 6.0),
    ("GIJ", "OPO", 359.4, 6.0),
    ("MAD", "SEV", 390.2, 7.0),
    ("MAD", "MAL", 415.6, 7.0),
    ("BCN", "BIO", 468.4, 7.0),
    ("LIS", "MAL", 470.8, 7.0),
]
# The rules of that network.
FORBIDDEN = [("BCN", "MUR"), ("ACO", "BIO"), ("VAL", "ALM")]
REQUIRED = [("BCN", "VAL"), ("VAL", "MUR"), ("ACO", "GIJ"), ("GIJ", "BIO"), ("MAD", "SEV"), ("MAD", "MAL")]
CHAIN = ["CAC", "SEV", "MAL", "ALM", "MUR"]
PAGERANK = dict(VLL=2.2892, ZAR=2.0594, SEV=1.6529, VAL=1.4079, OPO=1.1988, MAL=0.961, MUR=0.7985, GIJ=0.7626, MAD=0.707, BIO=0.6289,
                LIS=0.5734, ACO=0.4901, ALM=0.4901, BCN=0.4901, CAC=0.4901)


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame(NODES, "id string, latitude double, longitude double")


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "src string, dst string, distance_km double, avg_delay_minutes double")


def test_network_from_positions_and_rules(spark, nodes):
    pairs = "src string, dst string"
    chain = spark.createDataFrame([("south", i, n) for i, n in enumerate(CHAIN)], "chain_id string, position int, id string")
    built = network.build_network(nodes, spark.createDataFrame(FORBIDDEN, pairs), spark.createDataFrame(REQUIRED, pairs), chain, k=4)
    assert rows(built) == sorted(EDGES, key=repr)


def test_network_grows_k_until_connected(spark):
    line = [(f"N{i}", 40.0 + (0.01 * i if i < 3 else 5 + 0.01 * i), -3.0) for i in range(6)]
    none = spark.createDataFrame([], "src string, dst string")
    chain = spark.createDataFrame([], "chain_id string, position int, id string")
    nodes = spark.createDataFrame(line, "id string, latitude double, longitude double")
    one = network.build_network(nodes, none, none, chain, k=1)
    assert graph.is_connected(nodes, one)
    assert one.count() == len(set(rows(one, "src", "dst")))


def test_hops_directed(edges, spark):
    targets = spark.createDataFrame([(h,) for h in HIGH], "id string")
    found = rows(graph.hop_distances(edges, targets), "source_id", "target_id", "hop_distance")
    assert found == sorted([("MAD", "MAD", 0), ("CAC", "MAD", 1), ("BIO", "MAD", 1), ("BCN", "MAD", 2), ("BCN", "BCN", 0),
                            ("LIS", "LIS", 0), ("CAC", "LIS", 1)], key=repr)
    maps = {r["source_id"]: r["distances"] for r in graph.hop_maps(graph.hop_distances(edges, targets)).collect()}
    assert maps["CAC"] == {"MAD": 1, "LIS": 1}


def test_pagerank_and_components(nodes, edges):
    ranks = {r["id"]: round(r["pagerank"], 4) for r in graph.pagerank(nodes, edges).collect()}
    assert ranks == PAGERANK
    assert {c for _, c in rows(graph.connected_components(nodes, edges))} == {"ACO"}


def test_components_of_random_graphs(spark):
    rng = random.Random(5)
    for size, links in ((30, 12), (60, 45), (40, 0)):
        pairs = [(f"v{rng.randrange(size)}", f"v{rng.randrange(size)}") for _ in range(links)]
        parent = {f"v{i}": f"v{i}" for i in range(size)}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
        vertices = spark.createDataFrame([(v,) for v in parent], "id string")
        found = dict(rows(graph.connected_components(vertices, spark.createDataFrame(pairs, "src string, dst string"))))
        assert found == {v: root(v) for v in parent}


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)]
    hub = [("hub", f"h{i:04d}") for i in range(800)]
    names = sorted({x for pair in chain + hub for x in pair})
    found = dict(rows(graph.connected_components(
        spark.createDataFrame([(n,) for n in names], "id string"), spark.createDataFrame(chain + hub, "src string, dst string")
    )))
    assert {found[n] for n in names if n.startswith("c")} == {"c000"}
    assert {found[n] for n in names if not n.startswith("c")} == {"h0000"}


def brute_routes(weights, source, target, k, max_hops, avoid=()):
    found = []

    def walk(path, cost):
        if path[-1] == target:
            found.append((round(cost, 6), path))
            return
        if max_hops is not None and len(path) > max_hops:
            return
        if len(path) > 1 and path[-1] in avoid:
            return
        for (a, b), w in weights.items():
            if a == path[-1] and b not in path:
                walk(path + [b], cost + w)

    walk([source], 0.0)
    return sorted(found)[:k]


@pytest.mark.parametrize("seed,max_hops,avoid", [(1, None, []), (2, 4, []), (3, 3, []), (4, None, ["n1", "n5"])])
def test_k_routes_equal_brute_force(spark, seed, max_hops, avoid):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(9)]
    weights = {}
    for a in names:
        for b in rng.sample(names, 3):
            if a != b:
                weights[a, b] = weights[b, a] = float(rng.randrange(1, 9))  # small whole weights: many ties
    arcs = spark.createDataFrame([(a, b, w) for (a, b), w in weights.items()], "src string, dst string, w double")
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(12)]
    od = spark.createDataFrame(pairs, "source string, target string")
    got = {}
    for r in routing.k_routes(arcs, od, 4, max_hops, "w", avoid).collect():
        got.setdefault((r["source"], r["target"]), []).append((r["rank"], round(r["cost"], 6), list(r["path"])))
    best = {(r["source"], r["target"]): list(r["path"]) for r in routing.best_route(arcs, od, max_hops, "w", avoid).collect()}
    for source, target in set(pairs):
        if source == target:
            continue
        expected = brute_routes(weights, source, target, 4, max_hops, avoid)
        assert [(c, p) for _, c, p in sorted(got.get((source, target), []))] == expected
        if expected:
            assert best[source, target] == expected[0][1]


def test_routes_of_many_hops(spark):
    """A ladder of 13 rungs: its ends are 12 hops apart and more, and a separate pair stays out of reach."""
    weights = {}
    for i in range(12):
        for side in "ab":
            weights[f"{side}{i:02d}", f"{side}{i + 1:02d}"] = 1.0 if side == "a" else 1.25
    weights |= {(f"a{i:02d}", f"b{i:02d}"): 2.0 for i in range(13)} | {("x", "y"): 1.0}
    weights |= {(b, a): w for (a, b), w in weights.items()}
    arcs = spark.createDataFrame([(a, b, w) for (a, b), w in weights.items()], "src string, dst string, w double")
    pairs = [("a00", "a12"), ("a00", "b12"), ("b03", "b11"), ("a00", "a01"), ("a00", "x"), ("x", "y")]
    od = spark.createDataFrame(pairs, "source string, target string")
    found = {(r["source"], r["target"], r["rank"]): (r["cost"], len(r["path"])) for r in routing.k_routes(arcs, od, 2, weight="w").collect()}
    assert found["a00", "a12", 1] == (12.0, 13) and found["a00", "b12", 1] == (14.0, 14) and found["b03", "b11", 1] == (10.0, 9)
    assert {key[:2] for key in found} == {*pairs} - {("a00", "x")}
    assert ("a00", "a12", 2) in found and routing.k_routes(arcs, od, 9, weight="w").groupBy("source", "target").count().agg(F.max("count")).first()[0] == 9
    with pytest.raises(ValueError):
        routing.k_routes(arcs, od, 0)


def test_costs_are_positive_and_symmetric(edges):
    from haulwise.functions.costs import PROFILES

    for profile in PROFILES:
        arcs = routing.weighted_edges(edges, profile, 1.3)
        assert arcs.filter("routing_weight_minutes <= 0").isEmpty()
        swapped = arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "routing_weight_minutes")
        assert arcs.select("src", "dst", "routing_weight_minutes").exceptAll(swapped).isEmpty()


def test_avoided_nodes_are_gone(edges):
    arcs = routing.weighted_edges(edges, avoid=["MAD", "VLL"])
    assert arcs.filter("src IN ('MAD', 'VLL') OR dst IN ('MAD', 'VLL')").isEmpty()


def random_graph(spark, seed, vertices, arcs):
    rng = random.Random(seed)
    # A third of all arcs leave one vertex.
    pairs = [(0 if rng.random() < 1 / 3 else rng.randrange(vertices), rng.randrange(vertices)) for _ in range(arcs)]
    return pairs, spark.createDataFrame(pairs, "src long, dst long"), spark.range(vertices)


@pytest.mark.parametrize("arcs_per_part", [3, 1_000_000])
def test_pagerank_of_a_hub_equals_a_loop(spark, arcs_per_part):
    pairs, edges, nodes = random_graph(spark, 5, 40, 200)
    ranks = dict.fromkeys(range(40), 1.0)
    for _ in range(10):
        got = dict.fromkeys(ranks, 0.0)
        for src, dst in pairs:
            got[dst] += ranks[src] / sum(1 for s, _ in pairs if s == src)
        ranks = {v: 0.15 + 0.85 * g for v, g in got.items()}
    mean = sum(ranks.values()) / 40
    found = {r["id"]: r["pagerank"] for r in graph.pagerank(nodes, edges, arcs_per_part=arcs_per_part).collect()}
    assert found == pytest.approx({v: r / mean for v, r in ranks.items()}, rel=1e-9)


def test_a_rank_round_does_not_move_the_arcs(spark):
    _, edges, nodes = random_graph(spark, 6, 40, 200)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        arcs, leaving, buckets = graph._store_arcs(edges)
        base = cut_in_buckets(nodes.join(leaving.withColumnRenamed("src", "id"), "id", "left"), buckets, "id")
        text = graph._rank_round(arcs, base, base.withColumn("rank", F.lit(1.0)), 0.15)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # One exchange for the shares, one for the partial sums; both scans keep their buckets.
    assert text.count("Exchange hashpartitioning") == 2 and text.count("Bucketed: true") >= 2


@pytest.mark.parametrize("arcs_per_part,directed", [(3, True), (1_000_000, False)])
def test_hops_to_more_targets_than_bits_equal_a_search(spark, arcs_per_part, directed):
    pairs, edges, _ = random_graph(spark, 7, 150, 220)
    targets = spark.range(0, 150, 2)
    ways = set(pairs) | (set() if directed else {(b, a) for a, b in pairs})
    before = {v: {a for a, b in ways if b == v} for v in range(150)}
    expected = set()
    for target in range(0, 150, 2):
        level, seen, hops = {target}, set(), 0
        while level:
            expected |= {(v, target, hops) for v in level}
            seen |= level
            level, hops = {a for v in level for a in before[v]} - seen, hops + 1
    found = rows(graph.hop_distances(edges, targets, directed, arcs_per_part=arcs_per_part))
    assert found == sorted(expected, key=repr)
    reached, names = graph.hop_bitmaps(edges, targets, directed)
    assert names.count() == 2 and reached.count() == reached.select("id", "hops", "block").distinct().count()
    assert rows(graph.hop_distances(edges, targets, directed, max_hops=1)) == sorted([e for e in expected if e[2] <= 1], key=repr)
    assert graph.hop_distances(edges, targets.filter("id < 0"), directed).isEmpty()


@pytest.mark.parametrize("directed,words", [(True, 1), (False, 3)])
def test_hops_dealt_by_targets_equal_a_search_and_move_nothing(spark, monkeypatch, directed, words):
    """A ring with chords whose targets fill a block for every core: the rounds neither shuffle nor lose a pair."""
    n = 64 * spark.sparkContext.defaultParallelism + 40
    monkeypatch.setattr(graph, "_words", lambda *_: words)
    pairs = [(i, (i + 1) % n) for i in range(n)] + [(i, (i * 3 + 7) % n) for i in range(n)] + [(0, 1), (5, 5)]
    ways = set(pairs) | (set() if directed else {(b, a) for a, b in pairs})
    before = {v: [] for v in range(n)}
    for a, b in ways:
        before[b].append(a)
    expected = [0, 0]
    for target in range(n):
        level, seen, hops = {target}, set(), 0
        while level:
            expected = [expected[0] + len(level), expected[1] + hops * sum((v + 1) * (target + 3) for v in level)]
            seen |= level
            level, hops = {a for v in level for a in before[v]} - seen, hops + 1
    plans, round_of = [], graph._span_round

    def watched(*given):
        found = round_of(*given)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    monkeypatch.setattr(graph, "_span_round", watched)
    distances = graph.hop_distances(spark.createDataFrame(pairs, "src long, dst long"), spark.range(n), directed)
    found = distances.selectExpr("count(*)", "sum(hop_distance * (source_id + 1) * (target_id + 3))", "count(DISTINCT source_id, target_id)").first()
    assert list(found[:2]) == expected and found[2] == expected[0]
    assert len(plans) > 3 and not any("Exchange" in plan for plan in plans)


def test_catalogue_carries_speed_stops_and_share(spark):
    edges = spark.createDataFrame(EDGES, "src string, dst string, distance_km double, avg_delay_minutes double")
    od = spark.createDataFrame([("MAL", "SEV"), ("LIS", "BCN"), ("MUR", "ACO")], "source string, target string")
    found = routing.route_catalog(edges, od).collect()
    assert len(found) == 3 and round(sum(r["weight"] for r in found), 9) == 1
    for r in found:
        assert r["cruise_speed_kmh"] == round(max(60, min(82, 61 + min(16, r["total_km"] / r["hops"] / 25))), 1)
        assert (r["dwell_min"], r["dwell_max"]) == (1, 3 if r["hops"] >= 3 else 2)
        assert round(r["weight"], 9) == round(max(0.15, r["score"]) / sum(max(0.15, x["score"]) for x in found), 9)


@pytest.mark.parametrize("analysis", [
    lambda nodes, edges: graph.hop_distances(edges, nodes.limit(3), directed=False), lambda nodes, edges: graph.graph_metrics(nodes, edges),
], ids=["hops", "metrics"])
def test_edges_are_derived_once(spark, analysis):
    derived = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            derived.add(len(batch))
            yield batch

    given = spark.createDataFrame([e[:2] for e in EDGES], "src string, dst string")
    nodes = spark.createDataFrame([(n[0],) for n in NODES], "id string")
    assert analysis(nodes, given.mapInPandas(counted, given.schema)).count()
    assert derived.value == len(EDGES)


def test_route_rounds_collect_nothing_on_the_driver(spark, monkeypatch):
    """Sides of joins that every round repeats are moved between tasks, never broadcast through the driver."""
    plans, write = [], routing.cut_and_measure

    def watched(df, **figures):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, **figures)

    monkeypatch.setattr(routing, "cut_and_measure", watched)
    arcs = spark.createDataFrame([(a, b, 1.0 + i) for i, (a, b) in enumerate([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")])], "src string, dst string, w double")
    od = spark.createDataFrame([("a", "d")], "source string, target string")
    found = routing.k_routes(arcs, od, 2, weight="w")
    assert [(r["cost"], r["path"]) for r in found.orderBy("rank").collect()] == [(7.0, ["a", "b", "c", "d"]), (7.0, ["a", "c", "d"])]
    assert plans and not [plan for plan in plans if "BroadcastHashJoin" in plan]


def test_hops_over_many_links_are_not_copied_for_each_span(spark, monkeypatch):
    """Links of few vertices with many: only what the few vertices have is moved, and no link is copied for blocks of targets."""
    few, many = 64 * spark.sparkContext.defaultParallelism + 8, 700
    monkeypatch.setattr(graph, "_bitmaps_by_span", None)
    pairs = sorted({(f"C{c}", f"S{(c * 37 + j * j * 11) % few}") for c in range(many) for j in range(14)})
    beside = {}
    for a, b in pairs:
        beside.setdefault(a, set()).add(b)
        beside.setdefault(b, set()).add(a)
    targets = [f"S{i}" for i in range(few)]
    expected = [0, 0]
    for target in targets:
        level, seen, hops = {target}, set(), 0
        while level:
            expected = [expected[0] + len(level), expected[1] + hops * len(level)]
            seen |= level
            level, hops = {a for v in level for a in beside.get(v, ())} - seen, hops + 1
    plans, round_of = [], graph._home_round

    def watched(*given):
        found = round_of(*given)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    monkeypatch.setattr(graph, "_home_round", watched)
    distances = graph.hop_distances(
        spark.createDataFrame(pairs, "src string, dst string"), spark.createDataFrame([(t,) for t in targets], "id string"), directed=False
    )
    assert list(distances.selectExpr("count(*)", "sum(hop_distance)").first()) == expected
    # One exchange to the homes of the many, one from them; links and known bits keep their buckets.
    assert plans and all(plan.count("Exchange") == 2 for plan in plans)


def test_two_way_hops_with_hubs_at_both_ends(spark, monkeypatch):
    """Links between vertices that all have too many for one bucket lie at the other end; none is lost, and known bits are never dealt anew."""
    pairs = [(a, 100 + b) for a in range(6) for b in range(40) if (a * b) % 3 != 1] + [(7, 8), (8, 9), (100, 7)]
    plans, round_of = [], graph._home_round

    def watched(*given):
        found = round_of(*given)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    monkeypatch.setattr(graph, "_home_round", watched)
    beside = {}
    for a, b in pairs:
        beside.setdefault(a, set()).add(b)
        beside.setdefault(b, set()).add(a)
    expected = set()
    for target in (0, 5, 9, 120):
        level, seen, hops = {target}, set(), 0
        while level:
            expected |= {(v, target, hops) for v in level}
            seen |= level
            level, hops = {a for v in level for a in beside[v]} - seen, hops + 1
    targets = spark.createDataFrame([(0,), (5,), (9,), (120,)], "id long")
    edges = spark.createDataFrame(pairs + pairs[:5], "src long, dst long")
    assert rows(graph.hop_distances(edges, targets, directed=False, arcs_per_part=3)) == sorted(expected, key=repr)
    assert len(plans) > 3 and all(plan.count("Exchange") == 2 for plan in plans)
