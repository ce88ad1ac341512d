"""Grid search against brute force."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from haulwise.functions.geo import haversine_km
from haulwise.operators.eta import infer_route
from haulwise.operators.nearest import knn_join, next_node
from haulwise.streaming.stateful import great_circle_km
from tests.conftest import rows

POINT = "point_id string, latitude double, longitude double"
QUERY = "query_id string, latitude double, longitude double"


def layouts():
    rng = random.Random(3)
    spread = [(rng.uniform(-80, 80), rng.uniform(-180, 180)) for _ in range(60)]
    cluster = [(40 + rng.gauss(0, 0.001), -3 + rng.gauss(0, 0.001)) for _ in range(80)] + spread[:8]
    copies = [(40.0, -3.0)] * 30 + [(40.0, -3.001)] * 5 + spread[:5]
    edge = [(rng.uniform(-3, 3), rng.choice((179.9, -179.9, 179.5, -179.2))) for _ in range(30)]
    poles = [(rng.choice((89.9, 89.0, -89.5)), rng.uniform(-180, 180)) for _ in range(30)]
    return {"spread": spread, "cluster": cluster, "copies": copies, "antimeridian": edge, "poles": poles, "few": spread[:2]}


@pytest.mark.parametrize("layout", list(layouts()))
def test_knn_equals_brute_force(spark, layout):
    points = [(f"p{i:03d}", *xy) for i, xy in enumerate(layouts()[layout])]
    got = {}
    frame = spark.createDataFrame(points, POINT)
    for r in knn_join(frame.withColumnRenamed("point_id", "query_id"), frame, 3, exclude_self=True, decimals=1).collect():
        got.setdefault(r["query_id"], []).append((r["distance_km"], r["point_id"]))
    for q, lat, lon in points:
        near = sorted((round(great_circle_km(lat, lon, a, b), 1), p) for p, a, b in points if p != q)[:3]
        assert sorted(got.get(q, [])) == near


def test_next_node_equals_brute_force(spark):
    rng = random.Random(9)
    nodes = [(f"n{i:02d}", 36 + rng.random() * 7, -9 + rng.random() * 11) for i in range(40)]
    trucks = [
        (f"t{i:03d}", 36 + rng.random() * 7, -9 + rng.random() * 11, rng.choice(nodes)[0] if i % 3 else None,
         None if i % 4 == 0 else rng.random() * 360)
        for i in range(60)
    ]

    def bearing(a, b, c, d):
        y = math.sin(math.radians(d - b)) * math.cos(math.radians(c))
        x = math.cos(math.radians(a)) * math.sin(math.radians(c)) - math.sin(math.radians(a)) * math.cos(math.radians(c)) * math.cos(
            math.radians(d - b))
        return (math.degrees(math.atan2(y, x)) + 360) % 360

    expected = []
    for vid, lat, lon, here, heading in trucks:
        options = []
        for nid, a, b in nodes:
            if nid == here:
                continue
            km = great_circle_km(lat, lon, a, b)
            turn = 0 if heading is None else abs(heading - bearing(lat, lon, a, b))
            turn = 360 - turn if turn > 180 else turn
            options.append((turn > 115, 0.4 * km + 1.6 * turn, nid))
        expected.append((vid, min(options)[2]))
    frame = spark.createDataFrame(trucks, "vehicle_id string, latitude double, longitude double, warehouse_id string, bearing double")
    found = next_node(frame, spark.createDataFrame(nodes, "id string, latitude double, longitude double"))
    assert rows(found, "vehicle_id", "next_id") == sorted(expected)


def test_candidates_ahead_hardly_grow_with_the_nodes(spark, caplog):
    rng = random.Random(31)
    place = lambda: (36 + rng.random() * 7, -9 + rng.random() * 11)
    trucks = spark.createDataFrame([(f"t{i}", *place(), None, rng.random() * 360) for i in range(40)],
                                   "vehicle_id string, latitude double, longitude double, warehouse_id string, bearing double")
    met = []
    for n in (1_000, 32_000):
        nodes = spark.createDataFrame([(f"n{i}", *place()) for i in range(n)], "id string, latitude double, longitude double")
        caplog.clear()
        with caplog.at_level("INFO", "haulwise.operators.nearest"):
            assert next_node(trucks, nodes).count() == 40
        met.append(sum(r.args[2] for r in caplog.records if r.name == "haulwise.operators.nearest"))
    assert met[1] < 8 * met[0] and met[1] < 40 * 32_000 / 10


def test_haversine_is_symmetric_and_zero_at_home(spark):
    df = spark.createDataFrame([(40.4, -3.7, 41.4, 2.2), (10.0, 170.0, -10.0, -170.0)], "a double, b double, c double, d double")
    assert df.filter(F.abs(haversine_km("a", "b", "c", "d") - haversine_km("c", "d", "a", "b")) > 1e-9).isEmpty()
    assert df.filter(haversine_km("a", "b", "a", "b") > 0).isEmpty()


def test_infer_route_computes_its_vehicles_once(spark):
    """The plans, the rows without one and both searches share one computation of the input."""
    made = spark.sparkContext.accumulator(0)

    def count(parts):
        for part in parts:
            made.add(len(part))
            yield part

    schema = "vehicle_id string, latitude double, longitude double, bearing double, warehouse_id string, planned_origin string, planned_destination string"
    plans = [("p0", "p1"), (None, None), ("p0", "gone")]
    fleet = [(f"v{i}", 40 + i * 0.01, -3.0, 90.0, "p0", *plans[i % 3]) for i in range(30)]
    vehicles = spark.createDataFrame(fleet, schema).mapInPandas(count, schema)
    nodes = spark.createDataFrame([(f"p{i}", 40 + i * 0.05, -3 + i * 0.1) for i in range(4)], "id string, latitude double, longitude double")
    routes = infer_route(vehicles, nodes).collect()
    assert {r["vehicle_id"] for r in routes} == {v[0] for v in fleet}
    assert made.value == len(fleet)
