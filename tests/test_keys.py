"""Hot-key helpers equal the plain window functions they replace; keyed tables merge in any order."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from itertools import permutations

import pytest
from pyspark.sql import Window, functions as F

from haulwise.operators.hotkeys import global_index, join_dimension, lag_by_key, rank_by_key
from haulwise.operators.metrics import dedup_events
from haulwise.sinks import keyed
from tests.conftest import rows

START = datetime(2024, 1, 1)


def events(spark, n=400):
    """Half of all rows belong to one vehicle; many share a time."""
    rng = random.Random(1)
    data = [
        (f"e{i:04d}", "hot" if rng.random() < 0.5 else f"v{rng.randrange(6)}", START + timedelta(minutes=10 * rng.randrange(200)), float(i))
        for i in range(n)
    ]
    return spark.createDataFrame(data, "event_id string, vehicle_id string, event_timestamp timestamp, value double")


def test_lag_by_key(spark):
    df = events(spark)
    plain = df.withColumn("before", F.lag("value").over(Window.partitionBy("vehicle_id").orderBy("event_timestamp", "event_id")))
    for unit in ("hour", "day"):
        assert rows(lag_by_key(df, "vehicle_id", "event_timestamp", "event_id", {"before": "value"}, unit), "event_id", "before") == rows(
            plain, "event_id", "before")


def test_rank_by_key(spark):
    df = events(spark)
    w = Window.partitionBy("vehicle_id")
    plain = df.withColumns({
        "position": F.row_number().over(w.orderBy("event_timestamp", "event_id")), "total": F.count(F.lit(1)).over(w),
    })
    assert rows(rank_by_key(df, "vehicle_id", "event_timestamp", "event_id"), "event_id", "position", "total") == rows(
        plain, "event_id", "position", "total")


def test_global_index(spark):
    got = rows(global_index(events(spark), [F.desc("value")], "n"), "n", "value")
    assert got == sorted(((i + 1, float(399 - i)) for i in range(400)), key=repr)


def test_join_dimension_is_the_same_on_both_paths(spark):
    df = events(spark)
    dim = spark.createDataFrame([("hot", 1), ("v1", 2)], "vehicle_id string, grade int")
    assert rows(join_dimension(df, dim, "vehicle_id")) == rows(join_dimension(df, dim, "vehicle_id", max_rows=0))


def test_dedup_is_idempotent_and_order_free(spark):
    df = events(spark).withColumn("delay_minutes", F.lit(1))
    twice = df.unionByName(df.withColumn("delay_minutes", F.lit(2)))
    once = dedup_events(twice)
    assert rows(once) == rows(dedup_events(once)) == rows(dedup_events(twice.orderBy(F.rand(3))))
    assert {r["delay_minutes"] for r in once.collect()} == {2}


STATE = "vehicle_id string, warehouse_id string, route_id string, last_event_timestamp timestamp, delay_minutes int, speed_kmh double, latitude double, longitude double"


def state(spark, *triples):
    return spark.createDataFrame([(v, w, "R1", START + timedelta(minutes=m), 1, 50.0, 40.0, -3.0) for v, w, m in triples], STATE)


def test_upsert_in_any_order(spark, folder):
    batches = [[("a", "W1", 5), ("b", "W1", 1)], [("a", "W2", 9)], [("a", "W3", 7), ("c", "W3", 2)]]
    expected = [("a", "W2"), ("b", "W1"), ("c", "W3")]
    for i, order in enumerate(permutations(batches)):
        path = f"{folder}/t{i}"
        for batch in (*order, order[0]):  # the first one is replayed
            keyed.upsert_latest(state(spark, *batch), path)
        assert rows(keyed.read(spark, path), "vehicle_id", "warehouse_id") == expected


@pytest.mark.parametrize("broken_step", ["_commit", "compact"])
def test_interrupted_upsert_leaves_the_table_whole(spark, folder, monkeypatch, broken_step):
    path = f"{folder}/table"
    keyed.upsert_latest(state(spark, ("a", "W1", 1), ("b", "W1", 1)), path)
    with monkeypatch.context() as broken:
        broken.setattr(keyed, broken_step, lambda *args: (_ for _ in ()).throw(RuntimeError("executor lost")))
        with pytest.raises(RuntimeError):
            keyed.upsert_latest(state(spark, ("a", "W2", 2)), path)
    seen = rows(keyed.read(spark, path), "vehicle_id", "warehouse_id")
    assert seen == [("a", "W2" if broken_step == "compact" else "W1"), ("b", "W1")]
    for _ in range(2):  # the batch is replayed
        keyed.upsert_latest(state(spark, ("a", "W2", 2)), path)
    keyed.upsert_latest(state(spark, ("b", "W3", 3)), path)
    assert rows(keyed.read(spark, path), "vehicle_id", "warehouse_id") == [("a", "W2"), ("b", "W3")]


def test_a_batch_writes_its_own_rows_while_history_grows(spark, folder, monkeypatch):
    monkeypatch.setattr(keyed, "SMALLEST_CLASS", 4)
    path, written, write_run = f"{folder}/table", [], keyed._write_run

    def counted(rows, *rest):
        written.append(write_run(rows, *rest))
        return written[-1]

    monkeypatch.setattr(keyed, "_write_run", counted)
    expected, held = {}, 0
    for n in range(24):
        keyed.upsert_latest(state(spark, *[(f"v{n}-{i}", "W1", n) for i in range(3)], ("hot", f"W{n}", n)), path)
        expected |= {f"v{n}-{i}": "W1" for i in range(3)} | {"hot": f"W{n}"}
        own, merges = written[0], written[1:]
        assert own["rows"] == 4
        held += sum(run["rows"] for run in merges)
        written.clear()
    current = keyed.manifest(spark, path)
    # A row is rewritten at most once per size class (4, 16, 64), and few runs are open.
    assert held <= 2 * 24 * 4 and len(current["runs"]) <= 3 * (keyed.RUNS_PER_CLASS - 1)
    kept = {run["name"] for run in current["runs"] + keyed.manifest(spark, path, 1)["runs"]}
    assert set(keyed._names(spark, f"{path}/runs")) == kept
    assert rows(keyed.read(spark, path), "vehicle_id", "warehouse_id") == sorted(expected.items())
    plan = keyed.read(spark, path).filter("vehicle_id = 'v3-1'")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(vehicle_id), EqualTo(vehicle_id,v3-1)]" in plan


def test_null_keys_and_another_order(spark, folder):
    path = f"{folder}/table"
    keyed.upsert_latest(state(spark, (None, "W1", 1), (None, "W2", 5), ("a", "W1", 1)), path)
    keyed.upsert_latest(state(spark, (None, "W3", 3)), path)
    assert rows(keyed.read(spark, path), "vehicle_id", "warehouse_id") == sorted([(None, "W2"), ("a", "W1")], key=repr)
    with pytest.raises(ValueError):
        keyed.upsert(state(spark, ("a", "W1", 1)), path, ["vehicle_id"], ["speed_kmh"])


def test_empty_batch_changes_nothing(spark, folder):
    path = f"{folder}/table"
    keyed.upsert_latest(state(spark, ("a", "W1", 1)), path)
    keyed.upsert_latest(state(spark, ("z", "W1", 1)).filter("false"), path)
    assert rows(keyed.read(spark, path), "vehicle_id") == [("a",)]
