"""What the flows of a session have done: figures of every micro-batch, late rows included."""

from __future__ import annotations

import threading
from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

SCHEMA = "flow string, batch_id long, rows_read long, late_rows long, state_rows long, watermark string"
KEPT_BATCHES = 10_000


class FlowLog(StreamingQueryListener):
    """Keeps the figures of the newest ``keep`` micro-batches of all named streams of a session.

    ``late_rows`` counts what stateful operators dropped behind the watermark. Events arrive on a thread of their own, after
    the batch they tell of; ``wait_for`` returns when a finished query's last one is in. Use as a context manager.
    """

    def __init__(self, spark: SparkSession, keep: int = KEPT_BATCHES) -> None:
        self._spark = spark
        self._rows: deque[tuple] = deque(maxlen=keep)
        self._ended: dict[str, threading.Event] = {}
        self._lock = threading.Lock()

    def __enter__(self) -> FlowLog:
        self._spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self._spark.streams.removeListener(self)

    def _end_of(self, run_id: str) -> threading.Event:
        with self._lock:
            return self._ended.setdefault(run_id, threading.Event())

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        states = progress.stateOperators
        row = (
            progress.name, progress.batchId, progress.numInputRows, sum(s.numRowsDroppedByWatermark for s in states),
            sum(s.numRowsTotal for s in states), progress.eventTime.get("watermark"),
        )
        with self._lock:
            self._rows.append(row)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._end_of(str(event.runId)).set()

    def wait_for(self, query: StreamingQuery, seconds: float = 60) -> None:
        if not self._end_of(str(query.runId)).wait(seconds):
            raise TimeoutError(f"no end of {query.name} within {seconds} s")

    def batches(self) -> DataFrame:
        """One row per micro-batch, at most ``keep``."""
        with self._lock:
            return self._spark.createDataFrame(list(self._rows), SCHEMA)
