"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR: folder of the driver tables, BENCH_CPUS: local cores, BENCH_QUERIES: comma-separated names (default: the
headline list, "all" for every registered query). Every query runs to completion with all columns of all rows.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from haulwise.plans import catalog
from haulwise.session import build_session

HEADLINE = (
    "e1_delay_metrics", "e6_dedup_events", "f1_latest_state", "f6_downsample_trail", "f7_headings", "d4_add_context", "d6_hourly_trends",
    "c4_clean_events", "d7_apply_live_telemetry", "e10_node_stats", "d13_nearest_node_all_events", "j1_connected_components", "j2_pagerank",
    "j6_best_route", "j7_k_routes", "k3_window_stream", "l1_ml_features",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "")
    work = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = build_session(
        "haulwise-bench", f"local[{cpus}]",
        {
            "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g",
            "spark.sql.warehouse.dir": f"{work}/warehouse", "spark.checkpoint.dir": f"{work}/checkpoints",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    names = list(queries) if wanted == "all" else [n for n in wanted.split(",") if n] or list(HEADLINE)
    queries["e1_delay_metrics"](spark, folder).write.format("noop").mode("overwrite").save()  # start-up is not measured
    seconds = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
