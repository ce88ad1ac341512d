"""Keyed upsert on plain Parquet as sorted runs, for stores without a table format.

An upsert writes the rows of its own batch, one per key and sorted by key, as a new run and adds it to the manifest, the list
of the runs that make up the table. A reader merges the runs: of each key the first row in the store's order stays. When a size
class has ``RUNS_PER_CLASS`` runs, they are merged into one of the next class, so a row is rewritten once per class, and
a table of n rows has a number of runs that grows with log n.

A run counts from the moment its manifest is renamed into place; what an interrupted upsert or merge has left is in no manifest
and is deleted by a later one. The merge takes the maximum by an order, so batches may come in any order and be repeated.
One writer at a time; readers need no lock, since the runs of the manifest before the current one are kept.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StructType

from haulwise.operators.hotkeys import first_per_key
from haulwise.sinks.tables import path_exists, remove_path

RUNS_PER_CLASS = 4
# Rows of the smallest class; each further one holds RUNS_PER_CLASS times as many.
SMALLEST_CLASS = 1000


def _order(names: list[str]) -> list[Column]:
    return [F.col(name).desc_nulls_last() for name in names]


def _files(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    target, files = _files(spark, path)
    return sorted(status.getPath().getName() for status in files.listStatus(target)) if files.exists(target) else []


def manifest(spark: SparkSession, path: str, back: int = 0) -> dict | None:
    """The current manifest of a store, or one of those before it; None where there is none."""
    names = [name for name in _names(spark, f"{path}/manifests") if name.endswith(".json")]
    if len(names) <= back:
        return None
    target, files = _files(spark, f"{path}/manifests/{names[-1 - back]}")
    stream = files.open(target)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _commit(spark: SparkSession, path: str, state: dict) -> None:
    """Make ``state`` the current manifest. Only the two newest are kept."""
    state["version"] += 1
    folder = f"{path}/manifests"
    written, files = _files(spark, f"{folder}/.{uuid.uuid4().hex}")
    stream = files.create(written, True)
    try:
        stream.write(bytearray(json.dumps(state).encode()))
    finally:
        stream.close()
    final, _ = _files(spark, f"{folder}/{state['version']:012d}.json")
    if files.exists(final) or not files.rename(written, final):
        raise RuntimeError(f"another writer has changed {path}")
    for name in [name for name in _names(spark, folder) if name.endswith(".json")][:-2]:
        remove_path(spark, f"{folder}/{name}")


def _write_run(rows: DataFrame, path: str, keys: list[str]) -> dict:
    """One sorted run; its row groups then hold narrow key ranges."""
    run, observation = uuid.uuid4().hex, Observation()
    rows.repartitionByRange(*keys).sortWithinPartitions(*keys).observe(observation, F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/runs/{run}")
    return {"name": run, "rows": observation.get["n"]}


def _size_class(run: dict) -> int:
    n, size = 0, SMALLEST_CLASS
    while run["rows"] > size:
        n, size = n + 1, size * RUNS_PER_CLASS
    return n


def _runs(spark: SparkSession, path: str, state: dict, runs: list[dict]) -> DataFrame:
    schema = StructType.fromJson(state["schema"])
    if not runs:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/runs/{run['name']}" for run in runs])


def upsert(batch: DataFrame, path: str, keys: list[str], order: list[str]) -> None:
    """Merge ``batch`` into the store at ``path``: of each key the row with the highest values of the ``order`` columns stays, NULL
    lowest. Keys may be NULL. An empty batch changes nothing."""
    spark, path = batch.sparkSession, path.rstrip("/")
    state = manifest(spark, path) or {"version": 0, "keys": keys, "order": order, "schema": json.loads(batch.schema.json()), "runs": []}
    if (state["keys"], state["order"]) != (keys, order):
        raise ValueError(f"{path} is kept by {state['keys']} in the order of {state['order']}")
    columns = StructType.fromJson(state["schema"]).fieldNames()
    run = _write_run(first_per_key(batch.select(*columns), keys, _order(order)), path, keys)
    if run["rows"]:
        state["runs"].append(run)
        _commit(spark, path, state)
        compact(spark, path)


def compact(spark: SparkSession, path: str) -> None:
    """Merge the runs of every size class that is full, smallest first, and delete what no manifest names."""
    state = manifest(spark, path)
    while True:
        by_class: dict[int, list[dict]] = {}
        for run in state["runs"]:
            by_class.setdefault(_size_class(run), []).append(run)
        full = [runs for _, runs in sorted(by_class.items()) if len(runs) >= RUNS_PER_CLASS]
        if not full:
            break
        merged = first_per_key(_runs(spark, path, state, full[0]), state["keys"], _order(state["order"]))
        run = _write_run(merged, path, state["keys"])
        state["runs"] = [other for other in state["runs"] if other not in full[0]] + [run]
        _commit(spark, path, state)
    named = {run["name"] for run in state["runs"] + (manifest(spark, path, 1) or state)["runs"]}
    for name in _names(spark, f"{path}/runs"):
        if name not in named:
            remove_path(spark, f"{path}/runs/{name}")


def is_store(spark: SparkSession, path: str) -> bool:
    return path_exists(spark, f"{path.rstrip('/')}/manifests")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a store, one per key. A filter on key columns reaches the runs' row groups."""
    path = path.rstrip("/")
    state = manifest(spark, path)
    if state is None:
        raise FileNotFoundError(f"no keyed store at {path}")
    return first_per_key(_runs(spark, path, state, state["runs"]), state["keys"], _order(state["order"]))


def upsert_latest(batch: DataFrame, path: str) -> None:
    """Latest state per vehicle; the newer event wins however late its batch comes."""
    rest = ["warehouse_id", "route_id", "delay_minutes", "speed_kmh", "latitude", "longitude"]
    upsert(batch, path, ["vehicle_id"], ["last_event_timestamp", *rest])


def upsert_weather(batch: DataFrame, path: str) -> None:
    rest = sorted(c for c in batch.columns if c not in ("weather_event_id", "weather_timestamp"))
    upsert(batch, path, ["weather_event_id"], ["weather_timestamp", *rest])


def upsert_windows(batch: DataFrame, path: str) -> None:
    """Window metrics by (window, warehouse); the more complete update wins."""
    upsert(batch, path, ["window_start", "warehouse_id"], ["event_count", "last_event_timestamp", "avg_delay_minutes", "avg_speed_kmh"])
