"""Per-key sequential operators: arrival-time stabiliser, jump limiter, snapshot throttle.

The streaming forms hold rows back in the state store (RocksDB) until the watermark has passed them and then work them off in
event order, so the order in which files or batches arrive does not change a result. Event time stands in for the wall clock.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# The functions below travel to the Python workers by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of the stabiliser.
RESYNC_MINUTES, RESYNC_SHARE = 45.0, 0.5
HOLD_SECONDS = 2.0
MIN_ELAPSED_MINUTES, STEP_PER_MINUTE, MIN_STEP = 0.2, 18.0, 7.0
SMOOTHING = 0.35
# Fixed values of the jump limiter: cap in km by speed, and its bounds.
CAP_SPEED, CAP_BASE, CAP_LOW, CAP_HIGH = 16.0, 1.6, 2.0, 8.0


def next_eta(previous: tuple[float, str, float] | None, raw: float | None, destination: str, at: float) -> tuple[float | None, bool]:
    """Stable minutes after one raw estimate, and whether the state moves on. ``previous`` is (minutes, destination, time).

    Without an estimate, as for a standing vehicle, there is no stable one either and the state stays as it is.
    """
    if raw is None or math.isnan(raw):
        return None, False
    if previous is None:
        return raw, True
    minutes, where, updated = previous
    if where != destination or abs(raw - minutes) > max(RESYNC_MINUTES, raw * RESYNC_SHARE):
        return raw, True
    if at - updated < HOLD_SECONDS:
        return minutes, False
    step = max(MIN_STEP, STEP_PER_MINUTE * max(MIN_ELAPSED_MINUTES, (at - updated) / 60.0))
    bounded = minutes + max(-step, min(step, raw - minutes))
    return minutes * (1 - SMOOTHING) + bounded * SMOOTHING, True


# Rows of one frame that leaves a worker; a frame may exceed it by one slot.
FRAME_ROWS = 10_000


def _sorted_rows(lists: dict[str, list], tie: str) -> dict[str, list]:
    """The rows of a slot in order of (time, tie), rows without a tie last."""
    times, ties = lists["at"], lists[tie]
    order = sorted(range(len(times)), key=lambda i: (times[i], ties[i] is None, ties[i] or ""))
    return {name: [values[i] for i in order] for name, values in lists.items()}


class InTimeOrder(StatefulProcessor):
    """Calls ``fold(rows, memory) -> (output, memory)`` with the rows of a key in order of (time, tie), both as lists by column name.

    Rows wait in slots of ``slot_ms`` of event time. A slot is due when the watermark reaches its newest row; ``fold`` then gets
    it alone, so a worker holds one slot of one key and a frame of output, however long the key's history or its micro-batch is.
    The agenda of a key lists its waiting slots and the one timer it has: at its earliest due slot, which hands over all that are due.
    ``memory`` is a tuple whose last value is a time in seconds; with ``idle_seconds`` it is deleted once that time is so far behind
    the watermark that ``fold`` would not use it any more, and no row waits. Rows without a time are handed over at once, without memory.
    """

    def __init__(
        self, columns: dict[str, str], tie: str, memory: str, fold: Callable, output: str, slot_ms: int, idle_seconds: float | None
    ) -> None:
        self.columns, self.tie, self.memory_type, self.fold = {"at": "bigint", **columns}, tie, memory, fold
        # Times stay whole numbers where some are missing.
        self.types = {"at": "Int64", **{c.split()[0]: "Float64" for c in output.split(", ") if c.endswith(" double")}}
        self.slot_ms, self.idle_seconds = slot_ms, idle_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        arrays = ", ".join(f"{name} array<{kind}>" for name, kind in self.columns.items())
        self.waiting = handle.getMapState("waiting", "slot bigint", arrays)
        self.agenda = handle.getValueState("agenda", "slots array<bigint>, dues array<bigint>, timer bigint")
        self.memory = handle.getValueState("memory", self.memory_type)

    def _frame(self, key: tuple, out: dict[str, list]) -> pd.DataFrame:
        filled = {name: pd.array(values, dtype=self.types[name]) if name in self.types else values for name, values in out.items()}
        return pd.DataFrame({"key": [key[0]] * len(out["at"]), **filled})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        agenda = self.agenda.get()
        dues, timer = (dict(zip(agenda[0], agenda[1])), agenda[2]) if agenda else ({}, None)
        for part in rows:
            lists = {name: part[name].tolist() for name in self.columns}
            slots: dict[int | None, list[int]] = {}
            for i, at in enumerate(lists["at"]):
                slots.setdefault(None if at is None or at != at else int(at) // 1000 // self.slot_ms, []).append(i)
            for slot, which in slots.items():
                chosen = {name: [values[i] for i in which] for name, values in lists.items()}
                if slot is None:
                    yield self._frame(key, self.fold({**chosen, "at": [None] * len(which)}, None)[0])
                    continue
                chosen["at"] = [int(at) for at in chosen["at"]]
                due = max(chosen["at"]) // 1000
                if slot in dues:
                    due, held = max(due, dues[slot]), self.waiting.getValue((slot,))
                    chosen = {name: [*old, *new] for old, (name, new) in zip(held, chosen.items())}
                self.waiting.updateValue((slot,), tuple(chosen.values()))
                dues[slot] = due
        self._note(dues, timer, None)

    def _note(self, dues: dict[int, int], timer: int | None, idle: int | None) -> None:
        """Write the agenda and move the key's timer to its earliest due slot, else to the time its memory is deleted."""
        if not dues and idle is None:
            self.agenda.clear()
            return
        wanted = min(dues.values()) if dues else idle
        if wanted != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(wanted)
        self.agenda.update((list(dues), list(dues.values()), wanted))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        agenda = self.agenda.get()
        if agenda is None or agenda[2] != expiredTimerInfo.getExpiryTimeInMs():
            return
        passed = timerValues.getCurrentWatermarkInMs()
        dues, memory, frame = dict(zip(agenda[0], agenda[1])), self.memory.get(), None
        ripe, waiting = sorted(slot for slot, due in dues.items() if due <= passed), len(dues)
        for slot in ripe:
            lists = dict(zip(self.columns, self.waiting.getValue((slot,))))
            del dues[slot]
            # One call drops all slots where none is left; calls to the state store are most of a worker's time.
            if not dues:
                self.waiting.clear()
            elif len(ripe) < waiting:
                self.waiting.removeKey((slot,))
            out, memory = self.fold(_sorted_rows(lists, self.tie), memory)
            frame = out if frame is None else {name: frame[name] + out[name] for name in out}
            if len(frame["at"]) >= FRAME_ROWS:
                yield self._frame(key, frame)
                frame = None
        idle = None
        if memory is not None and self.idle_seconds is not None:
            idle = math.ceil((memory[-1] + self.idle_seconds) * 1000)
        if not dues and idle is not None and idle <= passed:
            # Nothing waits and every later row is too far away.
            self.memory.clear()
            idle = None
        elif ripe and memory is not None:
            self.memory.update(memory)
        # Spark itself deletes the timer that has just expired.
        self._note(dues, None, idle)
        if frame is not None and frame["at"]:
            yield self._frame(key, frame)

    def close(self) -> None:
        pass


def _in_time_order(
    stream: DataFrame, key: str, ts: str, columns: dict[str, str], tie: str, memory: str, fold: Callable, output: str, delay: str,
    slot_seconds: int, idle_seconds: float | None,
) -> DataFrame:
    """``InTimeOrder`` over a stream; times travel as microseconds, whatever the session's time zone."""
    processor = InTimeOrder(columns, tie, memory, fold, output, slot_seconds * 1000, idle_seconds)
    return (
        stream.withWatermark(ts, delay)
        .select(F.col(key).alias("key"), ts, F.unix_micros(ts).alias("at"), *columns)
        .groupBy("key").transformWithStateInPandas(processor, f"key string, at bigint, {output}", "append", "eventTime")
        .withColumns({"at": F.timestamp_micros("at")}).withColumnsRenamed({"key": key, "at": ts})
    )


def _seconds(rows: dict[str, list]) -> list[float | None]:
    return [None if at is None else at / 1e6 for at in rows["at"]]


def _known(memory: tuple | None, at: float, idle_seconds: float | None) -> tuple | None:
    """What is remembered, unless the key has been silent for too long."""
    return None if memory is None or (idle_seconds is not None and at - memory[-1] > idle_seconds) else memory


def stabilize_eta(stream: DataFrame, delay: str = "20 minutes", slot_seconds: int = 3600, idle_seconds: float | None = None) -> DataFrame:
    """Smooth raw arrival minutes per vehicle. Needs vehicle_id, event_id, event_timestamp, raw_minutes, destination.

    A row comes out when the watermark (``delay`` behind the newest event) has passed it; later ones than that are dropped by the
    watermark. A vehicle that moved its estimate last more than ``idle_seconds`` ago starts anew (None: never). Without an estimate
    or a time a row has no stable one and changes nothing; a missing destination is one of its own.
    """

    def fold(rows: dict[str, list], memory: tuple | None) -> tuple[dict[str, list], tuple | None]:
        out = []
        for raw, where, at in zip(rows["raw_minutes"], rows["destination"], _seconds(rows)):
            if at is None:
                out.append(None)
                continue
            stable, moved = next_eta(_known(memory, at, idle_seconds), raw, where, at)
            if moved:
                memory = (float(stable), where, float(at))
            out.append(stable)
        return {"at": rows["at"], "event_id": rows["event_id"], "eta_minutes": out}, memory

    return _in_time_order(
        stream, "vehicle_id", "event_timestamp", {"event_id": "string", "raw_minutes": "double", "destination": "string"}, "event_id",
        "minutes double, destination string, updated_at double", fold, "event_id string, eta_minutes double", delay, slot_seconds, idle_seconds,
    ).select("vehicle_id", "event_id", "event_timestamp", "eta_minutes")


def great_circle_km(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    p1, p2 = math.radians(lat1), math.radians(lat2)
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def _missing(value: float | None) -> bool:
    return value is None or math.isnan(value)


def limited(previous: tuple[float, float] | None, lat: float, lon: float, speed: float) -> tuple[float, float]:
    """The next shown position: towards the new one, but no farther than the cap for its speed."""
    if previous is None:
        return lat, lon
    jump = great_circle_km(*previous, lat, lon)
    cap = max(CAP_LOW, min(CAP_HIGH, (0.0 if _missing(speed) else speed) / CAP_SPEED + CAP_BASE))
    if jump <= cap:
        return lat, lon
    share = cap / jump
    return previous[0] + (lat - previous[0]) * share, previous[1] + (lon - previous[1]) * share


def limit_jumps(stream: DataFrame, delay: str = "20 minutes", slot_seconds: int = 3600, idle_seconds: float | None = None) -> DataFrame:
    """Cap how far a vehicle may move from one row to the next. Needs vehicle_id, event_id, event_timestamp, latitude, longitude, speed_kmh.

    Rows come out as in ``stabilize_eta``. A row without a position or a time is passed through as it is; the next position is
    measured from the last known one, or taken as it is after ``idle_seconds`` without any.
    """

    def fold(rows: dict[str, list], memory: tuple | None) -> tuple[dict[str, list], tuple | None]:
        out = []
        for lat, lon, speed, at in zip(rows["latitude"], rows["longitude"], rows["speed_kmh"], _seconds(rows)):
            if _missing(lat) or _missing(lon) or at is None:
                out.append((lat, lon))
                continue
            known = _known(memory, at, idle_seconds)
            shown = limited(None if known is None else known[:2], lat, lon, speed)
            memory = (float(shown[0]), float(shown[1]), float(at))
            out.append(shown)
        places = {name: [None if _missing(p[i]) else p[i] for p in out] for i, name in enumerate(("latitude", "longitude"))}
        return {"at": rows["at"], "event_id": rows["event_id"], **places}, memory

    return _in_time_order(
        stream, "vehicle_id", "event_timestamp", {"event_id": "string", "latitude": "double", "longitude": "double", "speed_kmh": "double"},
        "event_id", "latitude double, longitude double, updated_at double", fold, "event_id string, latitude double, longitude double", delay,
        slot_seconds, idle_seconds,
    ).select("vehicle_id", "event_id", "event_timestamp", "latitude", "longitude")


def throttle_stream(
    stream: DataFrame, keys: list[str], ts: str, seconds: int = 60, delay: str = "20 minutes", slot_seconds: int = 3600
) -> DataFrame:
    """``throttle_snapshots`` over a stream: all rows of a kept time, with all their columns, once the watermark has passed it.

    Rows of one time arrive together with their slot, so all of them are kept or none. Rows without a time are dropped.
    """
    interval = float(seconds)
    kept_type = T.StructType([f for f in stream.schema if f.name != ts])

    def fold(rows: dict[str, list], memory: tuple | None) -> tuple[dict[str, list], tuple | None]:
        last, kept = -math.inf if memory is None else memory[0], []
        for i, at in enumerate(_seconds(rows)):
            if at == last or at >= last + interval:
                kept.append(i)
                last = float(at)
        return {name: [rows[name][i] for i in kept] for name in ("at", "row")}, None if last == -math.inf else (last,)

    packed = stream.filter(F.col(ts).isNotNull()).select(
        ts, F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("_key"), F.to_json(F.struct(*kept_type.names)).alias("row")
    )
    kept = _in_time_order(
        packed, "_key", ts, {"row": "string"}, "row", "last double", fold, "row string", delay, slot_seconds, interval
    )
    return kept.select(F.from_json("row", kept_type).alias("row"), ts).select(
        *[ts if name == ts else F.col(f"row.`{name}`") for name in stream.columns]
    )


def _first_after(times: np.ndarray, interval: float) -> np.ndarray:
    """For each sorted time the index of the first time at least one interval later."""
    return np.searchsorted(times, times + interval, side="left")


def _entries(pdf: pd.DataFrame, interval: float) -> pd.DataFrame:
    """What one chunk does to a chain of picks: for every time a chain may enter with, the last pick inside the chunk."""
    times = np.sort(pdf["at"].to_numpy())
    following = _first_after(times, interval)
    last = times.copy()
    for i in range(len(times) - 1, -1, -1):
        if following[i] < len(times):
            last[i] = last[following[i]]
    # A pick of an earlier chunk delays the entry by less than an interval: the first time after that is the last choice.
    may_enter = np.arange(len(times)) <= following[0]
    return pd.DataFrame({
        "group": pdf["group"].iloc[0], "chunk": pdf["chunk"].iloc[0], "entry": times[may_enter], "last": last[may_enter],
    })


def _chain(pdf: pd.DataFrame, interval: float) -> pd.DataFrame:
    """Walk the chunks of one group in order: the time each chunk is entered with."""
    out, last = [], -math.inf
    for chunk, rows in pdf.sort_values(["chunk", "entry"]).groupby("chunk", sort=True):
        fit = rows[rows["entry"] >= last + interval]
        if len(fit):
            out.append((pdf["group"].iloc[0], chunk, fit["entry"].iloc[0]))
            last = fit["last"].iloc[0]
    return pd.DataFrame(out, columns=["group", "chunk", "entry"])


def _picks(pdf: pd.DataFrame, interval: float) -> pd.DataFrame:
    times = np.sort(pdf["at"].to_numpy())
    times = times[times >= pdf["entry"].iloc[0]]
    following, picked, i = _first_after(times, interval), [], 0
    while i < len(times):
        picked.append(times[i])
        i = following[i]
    return pd.DataFrame({"group": pdf["group"].iloc[0], "at": picked})


def throttle_snapshots(df: DataFrame, keys: list[str], ts: str, seconds: int = 60, chunk: str = "day") -> DataFrame:
    """At most one snapshot time per key and interval: a time is kept when the last kept one is an interval older.

    The chain of kept times runs through all of a key's history, yet no task sees more than one chunk of it: each chunk is
    first reduced to its effect on a chain entering it, a short pass per key links the chunks, and then all chunks pick
    their times in parallel.
    """
    interval = float(seconds)
    times = df.select(*keys, ts).distinct().withColumns({
        "group": F.to_json(F.struct(*keys)),
        "chunk": F.unix_micros(F.date_trunc(chunk, F.col(ts)).cast("timestamp")),
        "at": F.unix_micros(F.col(ts).cast("timestamp")) / 1e6,
    })
    slim = times.select("group", "chunk", "at")
    spec = {"group": "string", "chunk": "bigint"}
    ddl = lambda extra: ", ".join(f"{k} {v}" for k, v in {**spec, **extra}.items())
    effects = slim.groupBy("group", "chunk").applyInPandas(lambda p: _entries(p, interval), ddl({"entry": "double", "last": "double"}))
    entered = effects.groupBy("group").applyInPandas(lambda p: _chain(p, interval), ddl({"entry": "double"}))
    picks = slim.join(entered, ["group", "chunk"]).groupBy("group", "chunk").applyInPandas(
        lambda p: _picks(p, interval), "group string, at double"
    )
    kept = times.join(picks, ["group", "at"], "left_semi").select(*keys, ts)
    return df.join(kept, [*keys, ts], "left_semi")
