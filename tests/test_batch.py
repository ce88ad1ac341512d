"""File sources, sinks and the run modes on a small landed data set."""

from __future__ import annotations

import json
import os
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from haulwise import schemas
from haulwise.operators import drift, learning, quality
from haulwise.plans.batch import BatchConfig, run_batch, run_insights_sync, train_and_score
from haulwise.sinks import tables
from haulwise.sources import files
from haulwise.sources.tables import first_existing, read_keyed_table
from tests.conftest import rows

SMALL = (learning.Candidate("baseline_rf", 3, 3), learning.Candidate("tuned_baseline_rf", 4, 4), learning.Candidate("enhanced_rf", 3, 4, True))


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as handle:
        handle.write(text)
    return path


def landed(folder, n=60):
    start = datetime(2024, 1, 1, 6)
    lines = [json.dumps({
        "event_id": f"e{i}", "vehicle_id": f"T{i % 4}", "warehouse_id": "ABC"[i % 3], "route_id": "R1", "event_type": "gps", "latitude": 40.0 + i % 3,
        "longitude": -3.0, "speed_kmh": 30 + i, "delay_minutes": i % 20, "event_time": (start + timedelta(minutes=i)).strftime("%Y-%m-%dT%H:%M:%SZ"),
    }) for i in range(n)]
    write(f"{folder}/events/1.jsonl", "\n".join(lines + lines[:5] + ["{bad"]))
    write(f"{folder}/masters/warehouses.csv", "warehouse_id,warehouse_name,country,region,criticality,latitude,longitude\n"
          "A,Alpha,ES,South,high,40.0,-3.0\nB,Beta,ES,South,medium,41.0,-3.0\nC,Gamma,PT,West,low,42.0,-3.0\n")
    write(f"{folder}/masters/vehicles.csv", "vehicle_id,vehicle_type,capacity_kg,status\n" + "".join(f"T{i},van,{1000 * i},active\n" for i in range(4)))
    write(f"{folder}/graph/vertices.csv", "id,name,type,criticality\nA,Alpha,warehouse,high\nB,Beta,warehouse,medium\nC,Gamma,warehouse,low\n")
    write(f"{folder}/graph/edges.csv", "src,dst,distance_km,avg_delay_minutes\nA,B,100,4\nB,C,200,5\n")


def test_run_batch(spark, folder):
    landed(folder)
    cfg = BatchConfig(f"{folder}/events", f"{folder}/masters", f"{folder}/graph", f"{folder}/out", "batch_db", SMALL)
    run_batch(spark, cfg)
    run_batch(spark, cfg)  # a repeat replaces, it does not add
    assert spark.table("batch_db.enriched_events").count() == 60
    assert spark.table("batch_db.delay_metrics_batch").agg(F.sum("event_count")).first()[0] == 60
    assert rows(spark.table("batch_db.route_shortest_paths")) == [("A", "A", 0)]
    assert {r["community_id"] for r in spark.table("batch_db.route_graph_metrics").collect()} == {"A"}
    assert spark.table("batch_db.ml_delay_risk_scores").count() == 4
    chosen = spark.table("batch_db.ml_model_metrics")
    best = chosen.orderBy("rmse").first()
    assert best["selected"] and chosen.filter("selected").count() == 1
    logged = drift.parse_model_log(drift.model_log_line(chosen).withColumn("line_no", F.lit(1))).first()
    assert logged["selected_name"] == best["candidate"]
    report = quality.quality_report(
        spark, [quality.TableSpec("batch_db.enriched_events", ("event_id",), "event_timestamp"), quality.TableSpec("batch_db.missing")],
        F.expr("TIMESTAMP '2024-01-01 07:00:00'"),
    )
    failed = {(r["table_name"], r["check_name"]) for r in report.filter("NOT passed").collect()}
    assert failed == {("batch_db.missing", "exists")}
    assert quality.smoke_query(spark, "batch_db.missing", "batch_db.enriched_events", "event_timestamp").count() == 1
    assert not quality.repair_if_empty(spark, "batch_db.enriched_events", lambda: None)


def test_model_trouble_does_not_fail_the_batch(spark, folder):
    tables.ensure_schema(spark, "trouble_db")
    cfg = BatchConfig("", "", "", folder, "trouble_db", SMALL)
    assert train_and_score(spark, cfg, spark.range(3)) == "failed"


def test_few_rows_are_scored_by_speed(spark, folder):
    landed(folder, 2)
    cfg = BatchConfig(f"{folder}/events", f"{folder}/masters", f"{folder}/graph", f"{folder}/out", "few_db", SMALL)
    run_batch(spark, cfg)
    assert {r["predicted_delay_minutes"] for r in spark.table("few_db.ml_delay_risk_scores").collect()} == {8.0}


def test_insights_sync(spark, folder):
    at = datetime(2024, 1, 1, 10, 5)
    data = [("20240101", kind, "balanced", "all", at, rank, f"{kind}{rank}", 9.0 - rank, 9.0 - rank, 1.0, 2.0, "low", 1)
            for kind in ("edge", "node") for rank in (1, 2)]
    tables.ensure_schema(spark, "sync_db")
    empty = spark.createDataFrame([], schemas.INSIGHT_SNAPSHOT)
    empty.write.parquet(f"{folder}/none")
    assert not run_insights_sync(spark, f"{folder}/none", "sync_db")
    tables.write_snapshots(spark.createDataFrame(data, schemas.INSIGHT_SNAPSHOT), f"{folder}/snapshots")
    assert run_insights_sync(spark, f"{folder}/snapshots", "sync_db")
    assert rows(spark.table("sync_db.network_insights_hourly_trends"), "top_edge_id", "top_node_id") == [("edge1", "node1")]


def test_recent_files(spark, folder):
    for i in range(3):
        line = json.dumps({"event_id": f"e{i}", "vehicle_id": "v", "warehouse_id": "w", "event_time": f"2024-01-01T0{i}:00:00Z"})
        path = write(f"{folder}/in/{i}.jsonl", line + "\n{bad\n")
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    assert [r["event_id"] for r in files.read_recent_files(spark, f"{folder}/in", 2, 10).collect()] == ["e1", "e2"]
    assert [r["event_id"] for r in files.read_recent_files(spark, f"{folder}/in", 3, 1).collect()] == ["e2"]


def test_csv_and_nested_sources(spark, folder):
    path = write(f"{folder}/export.csv", "a,b\n1,x\n")
    files.csv_view(spark, path, "export_view")
    assert dict(spark.table("export_view").dtypes) == {"a": "string", "b": "string"}
    write(f"{folder}/w/1.json", json.dumps({"timezone": "UTC", "current": {
        "time": "2024-01-01T10:00", "temperature_2m": 5.5, "precipitation": 0.1, "wind_speed_10m": 9.0, "weather_code": 3}}, indent=1))
    write(f"{folder}/w/2.json", "{bad")
    assert rows(files.read_weather_snapshots(spark, f"{folder}/w"), "temperature_c", "weather_code") == [(5.5, "3")]


def test_plan_documents_with_aliases(spark):
    vertices = spark.createDataFrame([("AAA",), ("BBB",), ("CCC",)], "id string")
    doc = {"t1": {"origin": "WH1", "destination": "WH2", "planned_route_nodes": ["WH1", " ", "WH2", "CCC"]}, "t2": {"origin": "WH3"},
           "t3": {"origin": "X", "destination": "Y", "planned_route_label": " "}}
    found = files.explode_plans(spark.createDataFrame([(json.dumps(doc),)] * 2, "value string"), vertices)
    assert rows(found, "vehicle_id", "planned_origin", "planned_route_destination", "planned_route_label") == [
        ("t1", "AAA", "CCC", "AAA -> BBB -> CCC")] * 2 + [("t3", "X", "Y", "X -> Y")] * 2


def test_table_sinks(spark, folder):
    df = spark.createDataFrame([(1, "a")], "n int, s string")
    assert tables.append_or_fallback(df.filter("false"), "sink_t", f"{folder}/fb") == "empty"
    assert tables.append_or_fallback(df, "sink_t", f"{folder}/fb") == "table"
    assert tables.append_or_fallback(df.select("s", "n"), "sink_t", f"{folder}/fb") == "table"
    assert tables.append_or_fallback(df.drop("s"), "sink_t", f"{folder}/fb") == "fallback"
    assert spark.table("sink_t").count() == 2 and spark.read.parquet(f"{folder}/fb").count() == 1
    assert first_existing(spark, ["nothing_here", "sink_t"], df.schema).count() == 2
    assert first_existing(spark, ["nothing_here"], df.schema).isEmpty()
    assert read_keyed_table(spark, "sink_t").count() == 2
    tables.reset_stream_state(spark, ["sink_t"], [f"{folder}/fb"])
    assert not spark.catalog.tableExists("sink_t") and not os.path.exists(f"{folder}/fb")


def test_diverted_batches_are_replayed_read_and_restored(spark, folder):
    table, fallback = "diverted_t", f"{folder}/fb"
    rows_of = lambda *ids: spark.createDataFrame([(i, f"s{i}") for i in ids], "id long, s string")
    assert tables.append_or_fallback(rows_of(1, 2), table, fallback, 0) == "table"
    for _ in range(2):  # the second is a replay
        assert tables.append_or_fallback(rows_of(3, 4).withColumnRenamed("s", "t"), table, fallback, 1) == "fallback"
    assert tables.append_or_fallback(rows_of(5).withColumnRenamed("s", "t"), table, fallback, 2) == "fallback"
    assert tables.append_or_fallback(rows_of(5), table, fallback, 2) == "table"  # now it fits: its folder goes
    seen = tables.read_appended(spark, table, fallback)
    assert rows(seen, "id", "s", "t") == rows(spark.createDataFrame(
        [(1, "s1", None), (2, "s2", None), (3, None, "s3"), (4, None, "s4"), (5, "s5", None)], "id long, s string, t string"), "id", "s", "t")
    spark.createDataFrame([(4, "s4")], "id long, s string").write.insertInto(table)  # as an interrupted restore leaves it
    assert tables.restore_diverted(spark, table, fallback, "id") == 1
    assert rows(spark.table(table), "id") == [(1,), (2,), (3,), (4,), (5,)]
    assert tables.restore_diverted(spark, table, fallback, "id") == 0 and tables.read_appended(spark, table, fallback).count() == 5
    tables.reset_stream_state(spark, [table], [])



def test_weather_reload_and_local_views(spark, folder):
    tables.ensure_schema(spark, "views_db")
    tables.ensure_schema(spark, "views_db")
    export = spark.createDataFrame(
        [("all", "w1", "", "1.5", "x", "2", " ", None, "2024-07-01 10:00:00"), ("all", "w1", "A", "9", "0", "2", "1", "s", "2024-07-01 12:00:00"),
         ("old", "w2", "A", "1", "0", "2", "1", "s", "2024-07-01 10:00:00"), ("all", " ", "A", "1", "0", "2", "1", "s", "2024-07-01 10:00:00")],
        "bucket string, weather_event_id string, warehouse_id string, temperature_c string, precipitation_mm string, wind_kmh string, "
        "weather_code string, source string, weather_timestamp string",
    )
    target = f"views_db.{tables.WEATHER_TABLE}"
    for _ in range(2):
        tables.reload_weather(export, target)
    view = spark.table(f"views_db.v_{tables.WEATHER_TABLE}_local")
    row = view.first()
    assert view.count() == 1 and row["weather_event_id"] == "w1" and row["temperature_c"] == 9.0
    assert row["weather_timestamp_local"] - row["weather_timestamp_utc"] == timedelta(hours=2)


@pytest.mark.parametrize("hours,previous,score,recommended", [(10, False, 15 + 24 + 9, False), (80, True, 12 + 24 + 15 + 9, True), (80, False, 60, False), (None, None, 64, False)])
def test_retrain_advice(spark, hours, previous, score, recommended):
    overview = spark.createDataFrame([(20.0, datetime(2024, 1, 1))], "avg_delay_minutes double, latest_event_time timestamp")
    weather = spark.createDataFrame([(0.5,)], "weather_factor double")
    live = spark.createDataFrame([(0.1, 4)], "live_coverage_ratio double, edges_with_live_samples int")
    now = datetime(2024, 1, 2)
    data = [] if hours is None else [(now - timedelta(hours=hours), previous)]
    state = spark.createDataFrame(data, "last_success_at timestamp, last_recommendation boolean")
    row = drift.retrain_advice(overview, weather, live, state, F.lit(now)).first()
    assert (row["score"], row["recommended"]) == (score, recommended)
    assert len(row["reasons"].split(" | ")) <= 5
    if hours == 10:
        assert row["cooldown_remaining_hours"] == 38 and row["reasons"].startswith("cooling down")


def test_schedule(spark):
    state = spark.createDataFrame([("m", None, datetime(2024, 12, 3))], "model_name string, last_success_at timestamp, last_run_at timestamp")
    row = drift.schedule_info(state, F.lit(datetime(2024, 12, 31, 23))).first()
    assert row["next_scheduled_at"] == datetime(2025, 1, 1) and row["last_retrain_at"] == datetime(2024, 12, 3)


def test_local_clock():
    from haulwise.functions.times import local_clock

    friday = datetime(2024, 7, 5, 22, 30, tzinfo=timezone.utc)
    assert local_clock(friday) == (False, 0) and local_clock(friday, "peak") == (False, 8)
    assert local_clock(friday, zone="UTC") == (True, 22)


def test_named_categories_are_hashed(spark):
    data = [(f"e{i}", datetime(2024, 1, 1), f"W{i % 3}", "van", "R1", f"T{i}", *[float(i % 7)] * 16, float(i % 5)) for i in range(60)]
    names = (["event_id", "event_timestamp"] + learning.BASE_CATEGORIES + learning.CONTEXT_CATEGORIES + learning.BASE_NUMBERS
             + learning.CONTEXT_NUMBERS + ["label"])
    features = spark.createDataFrame(data, names)
    model = learning.pipeline_for(SMALL[2], {"vehicle_id"}).fit(features)
    assert model.transform(features).filter("prediction IS NULL").isEmpty()


def test_model_log_takes_the_newest_whole_line(spark):
    lines = [
        (1, "INFO: Model => baseline_rmse=6.1 | tuned_baseline_rmse=6.2 | enhanced_rmse=6 | selected=enhanced_rf | selected_rmse=6.05"),
        (2, "12:00 baseline_rmse=7.1|tuned_baseline_rmse=7.25 |enhanced_rmse= 7 | selected=tuned_rf | selected_rmse=7.0 done"),
        (3, "baseline_rmse=1 | tuned_baseline_rmse=2 | enhanced_rmse=3 | selected=x"), (4, "baseline_rmse=a | tuned"), (5, None), (6, ""),
    ]
    frame = spark.createDataFrame(lines, "line_no int, line string")
    assert tuple(drift.parse_model_log(frame).first()) == (7.1, 7.25, 7.0, "tuned_rf", 7.0)
    assert drift.parse_model_log(frame.filter("line_no > 2")).count() == 0


def test_documents_keep_their_file_and_unreadable_ones_show(spark, folder):

    texts = {
        "one.json": '{"timezone": "UTC",\n "current": {"time": "2024-01-01T08:00", "temperature_2m": 4.5}}',
        "two.json": '[{"current": {"time": "2024-01-01T09:00", "weather_code": "3"}},\n {"current": {"time": null}}]',
        "bad.json": '{"timezone": ', "none.json": "",
    }
    os.makedirs(f"{folder}/docs")
    for name, text in texts.items():
        with open(f"{folder}/docs/{name}", "w", encoding="utf-8") as handle:
            handle.write(text)
    found = files.read_documents(spark, f"{folder}/docs", schemas.WEATHER_SNAPSHOT).collect()
    seen = sorted((r["source_file"].rsplit("/", 1)[1], r["_corrupt"] is None) for r in found)
    assert seen == [("bad.json", False), ("one.json", True), ("two.json", True), ("two.json", True)]
    assert all(r["file_time"] is not None for r in found)
    flat = rows(files.read_weather_snapshots(spark, f"{folder}/docs"), "temperature_c", "weather_code")
    assert flat == [(0.0, "3"), (4.5, "unknown")]


def test_edges_come_back_in_order_from_many_files(spark, folder):

    edges = [(f"a{i}", f"b{i % 7}", float((i * 37) % 50), 1.0) for i in range(300)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tables.write_edges(spark.createDataFrame(edges, "src string, dst string, distance_km double, avg_delay_minutes double"), f"{folder}/e")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    parts = [p for p in sorted(os.listdir(f"{folder}/e")) if p.startswith("part-")]
    assert len(parts) > 1
    lines = [line for part in parts for line in open(f"{folder}/e/{part}", encoding="utf-8").read().splitlines()[1:]]
    expected = [f"{s},{d},{km},{delay}" for km, s, d, delay in sorted((km, s, d, delay) for s, d, km, delay in edges)]
    assert lines == expected
    assert sorted({r["part"] for r in files.read_ordered_edges(spark, f"{folder}/e").collect()}) == [int(p[5:10]) for p in parts]


def test_status_of_a_model_without_any_record(spark):

    state = spark.createDataFrame([("m", "tuned_baseline_rf", 8.0, None, None, 6.0), ("n", None, None, None, None, None)],
                                  "model_name string, last_selected_model string, last_baseline_rmse double, last_tuned_baseline_rmse double, "
                                  "last_enhanced_rmse double, last_selected_rmse double")
    assert rows(drift.model_info(state), "model_name", "selected_model", "gain_percent") == [("m", "tuned_baseline_rf", 25.0), ("n", None, None)]


def test_forests_are_fitted_on_all_cores(spark, monkeypatch):
    """Rows that arrive in one partition do not stay there."""
    met = []

    class Fitted(Exception):
        pass

    class Recorder:
        def fit(self, train):
            met.append((train.rdd.getNumPartitions(), sorted(r["event_id"] for r in train.collect())))
            raise Fitted

    monkeypatch.setattr(learning, "pipeline_for", lambda *_: Recorder())
    features = spark.range(400).select(F.col("id").cast("string").alias("event_id"), F.lit(1.0).alias("label")).coalesce(1)
    with pytest.raises(Fitted):
        learning.train_delay_models(features)
    assert met == [(spark.sparkContext.defaultParallelism, sorted(r["event_id"] for r in learning.split(features)[0].collect()))]


def test_trees_are_fitted_in_groups_and_averaged(spark, folder):
    """Few rows are not dealt over all cores for one tree after the other: groups of trees share the cores, and all trees count alike."""
    rows_ = spark.range(200).select(
        F.concat(F.lit("W"), F.col("id") % 4).alias("warehouse_id"), F.lit("van").alias("vehicle_type"),
        (F.col("id") % 50).cast("double").alias("speed_kmh"), (F.col("id") % 4 * 3).cast("double").alias("label"),
    )
    groups = min(spark.sparkContext.defaultParallelism, learning.MAX_GROUPS, 7)
    model = learning.pipeline_for(learning.Candidate("c", 7, 3)).fit(rows_)
    *forests, _ = model.stages[-1].stages
    assert len(forests) == groups and sum(f.getNumTrees for f in forests) == 7
    model.write().overwrite().save(f"{folder}/model")
    for scored in (model.transform(rows_), PipelineModel.load(f"{folder}/model").transform(rows_)):
        for r in scored.limit(20).collect():
            mean = sum(f.getNumTrees * r[f"prediction_{i}"] for i, f in enumerate(forests)) / 7
            assert abs(r["prediction"] - mean) < 1e-9
