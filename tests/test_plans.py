"""The plans that matter at scale keep their shape."""

from __future__ import annotations

from pyspark.sql import functions as F

from haulwise.operators import cleaning, enrich, latest, metrics
from haulwise.plans.registry import Views
from tests.conftest import SMALLEST


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_per_key_is_trimmed_before_the_shuffle(spark):
    v = Views(spark, SMALLEST)
    for df in (latest.latest_state(v("telemetry")), metrics.dedup_events(v("telemetry")), latest.vehicle_history(v("telemetry"), n=40)):
        text = plan(df)
        # Read from the bottom: the partial limit comes below the exchange, the final one above it.
        assert text.count("WindowGroupLimit") == 2
        assert text.rindex("WindowGroupLimit") > text.index("Exchange hashpartitioning") > text.index("WindowGroupLimit")


def test_small_masters_do_not_shuffle_the_events(spark):
    v = Views(spark, SMALLEST)
    text = plan(enrich.enrich_events(v("telemetry"), v("warehouses"), v("vehicles")))
    assert text.count("BroadcastHashJoin") >= 2 and "SortMergeJoin [warehouse_id" not in text


def test_window_metrics_aggregate_before_the_shuffle(spark):
    text = plan(metrics.delay_windows(Views(spark, SMALLEST)("telemetry")))
    assert "partial_avg" in text and text.count("Exchange hashpartitioning") == 1


def test_scan_reads_only_what_is_used(spark):
    df = spark.read.parquet(f"{SMALLEST}/events.parquet").select(F.col("user_id").cast("string").alias("vehicle_id"), "ts", "event_type")
    text = plan(df.filter("event_type = 'view'").groupBy("vehicle_id").agg(F.max("ts")))
    assert "EqualTo(event_type,view)" in text and "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string>" in text


def test_json_is_parsed_once_per_row(spark):
    lines = spark.createDataFrame([('{"event_id": "e"}',)], "value string")
    assert plan(cleaning.clean_events(cleaning.parse_events(lines))).count("from_json(") == 1
