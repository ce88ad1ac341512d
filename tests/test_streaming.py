"""Streams replayed file by file: duplicates, disorder, lateness, faults, restart; stateful operators against loops."""

from __future__ import annotations

import json
import os
import random
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from haulwise import schemas
from haulwise.operators import cleaning, latest, metrics
from haulwise.sinks import keyed
from haulwise.sources.streams import StreamSource, read_event_stream
from haulwise.streaming import flows, stateful
from haulwise.streaming.progress import FlowLog
from tests.conftest import rows

START = datetime(2024, 1, 1, 8, 0)


def line(event, vehicle, minute, delay=3, warehouse="W1", **extra):
    stamp = (START + timedelta(minutes=minute)).strftime("%Y-%m-%dT%H:%M:%SZ")
    return json.dumps({"event_id": event, "vehicle_id": vehicle, "warehouse_id": warehouse, "route_id": "R1", "event_type": "ping",
                       "latitude": 40.0, "longitude": -3.0, "speed_kmh": 50, "delay_minutes": delay, "event_time": stamp, **extra})


FILES = [
    [line("e1", "a", 0), line("e2", "b", 2), line("e1", "a", 0)],  # duplicate inside a file
    [line("e2", "b", 2), line("e3", "a", 14, delay="7"), "{broken", line("e4", None, 3)],  # across files, text number, faults
    [line("e5", "b", 9), line("e6", "a", 40, warehouse="W2")],  # out of order, and the watermark moves to minute 20
    [],
    [line("e7", "a", 1, delay=90), line("e8", "c", 41)],  # e7 is later than the watermark allows
    [line("e9", "b", 30)],
]


def put(folder, i, lines):
    path = f"{folder}/in/{i}.json"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as handle:
        handle.write("\n".join(lines))
    stamp = time.time() - 100 + i
    os.utime(path, (stamp, stamp))


def config(folder, tag):
    return flows.FlowConfig(
        events=StreamSource(path=f"{folder}/in", max_files_per_trigger=1), weather=StreamSource(path=f"{folder}/weather"), root=f"{folder}/out",
        once=True, events_table=f"events_{tag}", weather_table=f"weather_{tag}",
    )


def test_windows_drop_late_rows_and_keep_one_row_per_window(spark, folder):
    for i, lines in enumerate(FILES):
        put(folder, i, lines)
    cfg = config(folder, "w")
    flows.run_window_stream(spark, cfg).awaitTermination()
    found = keyed.read(spark, cfg.store("delay_windows"))
    table = {(r["window_start"].strftime("%H:%M"), r["warehouse_id"]): (r["event_count"], r["avg_delay_minutes"]) for r in found.collect()}
    assert table == {("08:00", "W1"): (4, 4.0), ("08:30", "W2"): (1, 3.0), ("08:30", "W1"): (2, 3.0)}


def test_restart_between_files_equals_one_run_and_the_batch(spark, folder):
    cfg = config(folder, "r")
    on_time = [lines for i, lines in enumerate(FILES) if i != 4]
    for i, lines in enumerate(on_time):
        put(folder, i, lines)
        flows.run_window_stream(spark, cfg).awaitTermination()
    streamed = rows(keyed.read(spark, cfg.store("delay_windows")))
    raw = spark.createDataFrame([(text,) for lines in on_time for text in lines], "value string")
    batch = metrics.delay_windows(metrics.dedup_events(cleaning.clean_events(cleaning.parse_events(raw))))
    assert streamed == rows(batch, *keyed.read(spark, cfg.store("delay_windows")).columns)


def test_state_stream_never_goes_back(spark, folder):
    cfg = config(folder, "s")
    warehouses = spark.createDataFrame([("W1", "One", "ES", "R", "high", 40.0, -3.0)], schemas.WAREHOUSE)
    vehicles = spark.createDataFrame([("a", "van", 10, "active")], schemas.VEHICLE)
    for i, lines in enumerate([[line("e1", "a", 10, warehouse="W9")], [line("e2", "a", 4)], [line("e3", "b", 5)]]):
        put(folder, i, lines)
        flows.run_state_stream(spark, cfg, warehouses, vehicles).awaitTermination()
    assert rows(keyed.read(spark, cfg.store("latest_state")), "vehicle_id", "warehouse_id") == [("a", "W9"), ("b", "W1")]
    stored = spark.table(cfg.events_table)
    assert stored.count() == 3
    assert rows(stored, "event_id", "warehouse_name") == [("e1", None), ("e2", "One"), ("e3", "One")]


def test_replayed_batch_is_not_appended_twice(spark, folder):
    put(folder, 0, FILES[0])
    cfg = config(folder, "replay")
    warehouses, vehicles = spark.createDataFrame([], schemas.WAREHOUSE), spark.createDataFrame([], schemas.VEHICLE)
    flows.run_state_stream(spark, cfg, warehouses, vehicles).awaitTermination()
    for name in os.listdir(f"{cfg.checkpoint('latest_state')}/commits"):  # as if the driver died right before the commit
        os.remove(f"{cfg.checkpoint('latest_state')}/commits/{name}")
    put(folder, 1, [line("e9", "c", 3)])
    flows.run_state_stream(spark, cfg, warehouses, vehicles).awaitTermination()
    assert rows(spark.table(cfg.events_table), "event_id") == [("e1",), ("e2",), ("e9",)]


def test_router_and_weather(spark, folder):
    put(folder, 0, [line("e1", "a", 0, delay=4), line("e2", "a", 1, delay=5), "{broken"])
    cfg = config(folder, "x")
    flows.run_router(spark, cfg).awaitTermination()
    counts = {r: spark.read.parquet(cfg.store(f"routed/{r}")).count() for r in ("raw", "filtered", "rejected")}
    assert counts == {"raw": 2, "filtered": 1, "rejected": 1}
    os.makedirs(f"{folder}/weather")
    weather = {"warehouse_id": "W1", "weather_code": "1", "source": "s", "observation_time": "2024-01-01T08:00:00Z"}
    with open(f"{folder}/weather/0.json", "w", encoding="utf-8") as handle:
        handle.write(json.dumps({**weather, "weather_event_id": "num", "temperature_c": 21.7, "precipitation_mm": 0.3, "wind_kmh": 14.2}) + "\n")
        handle.write(json.dumps({**weather, "weather_event_id": "str", "temperature_c": "22.9", "precipitation_mm": "0.1", "wind_kmh": "11.8"}))
    flows.run_weather_stream(spark, cfg).awaitTermination()
    assert rows(keyed.read(spark, cfg.store("weather_recent")), "weather_event_id", "temperature_c", "precipitation_mm", "wind_kmh") == [
        ("num", 21.7, 0.3, 14.2), ("str", 22.9, 0.1, 11.8)]


def test_start_all(spark, folder):
    put(folder, 0, FILES[0])
    os.makedirs(f"{folder}/weather")
    put(f"{folder}/weather", 0, [])
    cfg = config(folder, "all")
    warehouses, vehicles = spark.createDataFrame([], schemas.WAREHOUSE), spark.createDataFrame([], schemas.VEHICLE)
    assert len(flows.start_all(spark, cfg, warehouses, vehicles)) == 3
    assert keyed.read(spark, cfg.store("latest_state")).count() == 2


def test_a_batch_commits_the_state_it_changed(spark, folder):
    """No batch uploads a snapshot of the whole state, and a restart goes on from what was committed."""
    cfg = config(folder, "changes")
    for i in range(2):
        put(folder, i, [line(f"e{n}", "a", n % 10) for n in range(300 * i + 300)])
        flows.run_window_stream(spark, cfg).awaitTermination()
    committed = [name for _, _, names in os.walk(f"{cfg.checkpoint('delay_windows')}/state") for name in names]
    assert any(name.endswith(".changelog") for name in committed) and not any(name.endswith(".zip") for name in committed)
    assert rows(keyed.read(spark, cfg.store("delay_windows")), "event_count") == [(600,)]


def run_files(spark, folder, operator, columns, data, batches):
    """Feed ``data`` in several files and collect the emitted rows."""
    step = -(-len(data) // batches)
    for i in range(batches):
        spark.createDataFrame(data[i * step:(i + 1) * step], columns).coalesce(1).write.mode("append").parquet(f"{folder}/src")
    stream = spark.readStream.schema(spark.read.parquet(f"{folder}/src").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/src")
    query = operator(stream).writeStream.format("parquet").option("path", f"{folder}/dst").option(
        "checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/dst")


def test_eta_stabiliser_equals_a_loop(spark, folder):
    rng = random.Random(4)
    data = [(f"v{i % 3}", f"e{i:03d}", START + timedelta(seconds=7 * i + (i % 2)), rng.choice((20.0, 30.0, 25.0, 200.0)) + rng.random(),
             rng.choice("AAAB")) for i in range(120)]
    emitted = run_files(spark, folder, lambda stream: stateful.stabilize_eta(stream, "0 seconds"),
                        "vehicle_id string, event_id string, event_timestamp timestamp, raw_minutes double, destination string", data, 4)
    expected, last = [], {}
    for vehicle, event, at, raw, where in data:
        seconds = at.timestamp()
        minutes = raw
        if vehicle in last:
            before, old, then = last[vehicle]
            if old == where and abs(raw - before) <= max(45, 0.5 * raw):
                if seconds - then < 2:
                    expected.append((event, round(before, 6)))
                    continue
                step = max(7, 18 * max(0.2, (seconds - then) / 60))
                minutes = 0.65 * before + 0.35 * (before + max(-step, min(step, raw - before)))
        last[vehicle] = (minutes, where, seconds)
        expected.append((event, round(minutes, 6)))
    assert rows(emitted, "event_id", "eta_minutes") == sorted(expected)


def test_jump_limiter_caps_every_step(spark, folder):
    rng = random.Random(8)
    data = [(f"v{i % 3}", f"e{i:03d}", START + timedelta(seconds=5 * i), 40 + rng.random() * 0.3, -3 + rng.random() * 0.3, rng.choice((0.0, 60.0, 300.0)))
            for i in range(90)]
    emitted = {r["event_id"]: (r["latitude"], r["longitude"]) for r in run_files(
        spark, folder, lambda stream: stateful.limit_jumps(stream, "0 seconds", slot_seconds=60),
        "vehicle_id string, event_id string, event_timestamp timestamp, latitude double, longitude double, speed_kmh double", data, 3).collect()}
    shown = {}
    for vehicle, event, _, lat, lon, speed in data:
        if vehicle in shown:
            a, b = shown[vehicle]
            km, cap = stateful.great_circle_km(a, b, lat, lon), min(8, max(2, speed / 16 + 1.6))
            if km > cap:
                lat, lon = a + (lat - a) * cap / km, b + (lon - b) * cap / km
        shown[vehicle] = (lat, lon)
        assert abs(emitted[event][0] - lat) < 1e-9 and abs(emitted[event][1] - lon) < 1e-9


STABLE = "vehicle_id string, event_id string, event_timestamp timestamp, raw_minutes double, destination string"


def test_order_of_arrival_changes_nothing(spark, folder):
    rng = random.Random(12)
    data = [("v", f"e{i:03d}", START + timedelta(seconds=40 * i), 20 + 5 * rng.random(), "A") for i in range(90)]
    mixed = [row for at in range(0, 90, 12) for row in rng.sample(data[at:at + 12], len(data[at:at + 12]))]  # eight minutes of disorder
    kept = run_files(spark, f"{folder}/a", lambda s: stateful.stabilize_eta(s, "0 seconds", 60), STABLE, data, 1)
    late = run_files(spark, f"{folder}/b", lambda s: stateful.stabilize_eta(s, "20 minutes", 60), STABLE, mixed, 30)
    edge = data[-1][2] - timedelta(minutes=20)
    found = rows(late, "event_id", "eta_minutes")
    assert found == rows(kept.filter(F.col("event_timestamp") <= F.lit(edge)), "event_id", "eta_minutes") and len(found) == 60


def test_silent_vehicles_start_anew_in_one_batch_or_many(spark, folder):
    minutes = (0, 1, 2, 40, 41, 120, 121)
    data = [("v", f"e{i}", START + timedelta(minutes=m), 20.0 + i, "A") for i, m in enumerate(minutes)] + [
        ("w", f"f{i}", START + timedelta(minutes=m), 30.0, None) for i, m in enumerate(range(0, 130, 10))]
    data.sort(key=lambda row: row[2])
    found = [rows(run_files(spark, f"{folder}/{n}", lambda s: stateful.stabilize_eta(s, "0 seconds", 60, idle_seconds=1800), STABLE, data, n),
                  "event_id", "eta_minutes") for n in (1, 7)]
    assert found[0] == found[1] and len(found[0]) == len(data)
    assert {("e0", 20.0), ("e3", 23.0), ("e5", 25.0)} <= set(found[0]) and ("e1", 21.0) not in found[0]


def test_memory_stays_while_an_earlier_row_waits(spark, folder):
    """The watermark passes the end of the silence while a row from before it waits in a slot that is not yet due."""
    hour = START.replace(minute=0, second=0)
    at = lambda minutes: hour + timedelta(minutes=minutes)
    data = [("v", "e0", at(-5), 20.0, "A"), ("w", "f0", at(16), 30.0, "A"), ("v", "e1", at(20), 21.0, "A"), ("v", "e2", at(50), 22.0, "A"),
            ("w", "f1", at(100), 30.0, "A"), ("w", "f2", at(100), 30.0, "A")]
    found = rows(run_files(spark, folder, lambda s: stateful.stabilize_eta(s, "20 minutes", 3600, idle_seconds=1800), STABLE, data, 3),
                 "event_id", "eta_minutes")
    assert [row for row in found if row[0] in ("e0", "e1", "e2")] == [("e0", 20.0), ("e1", 20.35), ("e2", 20.9275)]


def test_rows_without_time_or_values_pass_and_change_nothing(spark, folder):
    data = [("v", "e0", START, 20.0, "A"), ("v", "e1", None, 99.0, "A"), ("v", "e2", START + timedelta(minutes=1), None, "A"),
            ("v", "e3", START + timedelta(minutes=2), 22.0, "A"), (None, "e4", START + timedelta(minutes=2), 5.0, None)]
    found = rows(run_files(spark, folder, lambda s: stateful.stabilize_eta(s, "0 seconds"), STABLE, data, 1), "event_id", "eta_minutes")
    assert found == [("e0", 20.0), ("e1", None), ("e2", None), ("e3", 20.7), ("e4", 5.0)]


def test_stream_throttle_equals_the_batch_with_all_rows_of_a_time(spark, folder):
    rng = random.Random(21)
    data, at = [], START
    for i in range(200):
        data.append((rng.choice(("eco", None)), "all", i, at))
        at += timedelta(seconds=rng.choice((0, 0, 7, 30, 61, 4000)))
    columns = "profile string, min_congestion string, n int, snapshot_time timestamp"
    keys = ["profile", "min_congestion"]
    streamed = run_files(spark, folder, lambda s: stateful.throttle_stream(s, keys, "snapshot_time", 60, "0 seconds"), columns, data, 5)
    kept, last = [], {}
    for profile, least, i, at in data:
        if profile not in last or at == last[profile] or (at - last[profile]).total_seconds() >= 60:
            last[profile] = at
            kept.append(i)
    assert sorted(r["n"] for r in streamed.collect()) == kept
    assert streamed.columns == ["profile", "min_congestion", "n", "snapshot_time"]


def test_throttle_equals_a_loop(spark):
    rng = random.Random(6)
    data = []
    for key, gaps in (("dense", (1, 5)), ("sparse", (3000, 90000)), ("mixed", (10, 4000)), ("exact", (60, 61))):
        at = datetime(2024, 1, 1, 23, 50) - timedelta(seconds=rng.randrange(300))
        for _ in range(150):
            data.append((key, at))
            at += timedelta(seconds=rng.randrange(*gaps))
    kept, last = [], {}
    for key, at in data:
        if key not in last or (at - last[key]).total_seconds() >= 60:
            last[key] = at
            kept.append((key, at))
    df = spark.createDataFrame(data, "profile string, snapshot_time timestamp")
    for chunk in ("hour", "day", "minute"):
        assert rows(stateful.throttle_snapshots(df.distinct(), ["profile"], "snapshot_time", 60, chunk)) == sorted(set(kept), key=repr)


def test_kafka_source_is_only_a_matter_of_settings(spark):
    try:
        read_event_stream(spark, StreamSource(brokers="broker:9092", topic="events"))
    except Exception as error:  # the connector is not on this class path
        assert "kafka" in str(error).lower()


def test_latest_state_of_stream_equals_batch(spark, folder):
    put(folder, 0, [text for lines in FILES for text in lines])
    raw = spark.read.text(f"{folder}/in")
    state = latest.latest_state(metrics.dedup_events(cleaning.clean_events(cleaning.parse_events(raw))))
    assert rows(state, "vehicle_id", "warehouse_id") == [("a", "W2"), ("b", "W1"), ("c", "W1")]


def test_missing_values_leave_the_state_alone():
    from haulwise.streaming.stateful import limited, next_eta

    before = (20.0, "B", 0.0)
    assert next_eta(before, None, "B", 60.0) == (None, False) and next_eta(before, float("nan"), "B", 60.0) == (None, False)
    assert next_eta(None, None, "B", 60.0) == (None, False)
    assert limited((40.0, -3.0), 40.001, -3.0, float("nan")) == (40.001, -3.0)


def test_flow_log_counts_late_rows_and_forgets_the_oldest(spark, folder):
    for i, lines in enumerate(FILES):
        put(folder, i, lines)
    with FlowLog(spark, keep=100) as log, FlowLog(spark, keep=1) as short:
        query = flows.run_window_stream(spark, config(folder, "log"))
        query.awaitTermination()
        log.wait_for(query)
        short.wait_for(query)
    seen = log.batches().filter("flow = 'delay_windows'")
    # e7 comes behind the watermark that e6 has set.
    assert seen.agg(F.sum("late_rows"), F.sum("rows_read")).first() == (1, sum(map(len, FILES)))
    assert short.batches().count() == 1
    assert seen.orderBy(F.desc("batch_id")).first()["watermark"].startswith("2024-01-01T08:21")
