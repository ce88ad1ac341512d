"""Timestamp parsing, labels and calendar helpers."""

from __future__ import annotations

from datetime import datetime, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, functions as F

ISO_WITH_ZONE = "yyyy-MM-dd'T'HH:mm:ssX"
# The simulated local clock of each what-if mode.
MODE_CLOCK = {"peak": (8, 30), "offpeak": (11, 30), "night": (1, 30)}


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def parse_timestamp(text) -> Column:
    """ISO with zone first, then Spark's default formats; NULL when neither fits."""
    text = _col(text)
    return F.coalesce(F.try_to_timestamp(text, F.lit(ISO_WITH_ZONE)), F.try_to_timestamp(text))


def day_bucket(ts) -> Column:
    return F.date_format(_col(ts), "yyyyMMdd")


def edge_label(src, dst) -> Column:
    return F.concat(_col(src), F.lit("->"), _col(dst))


def iso_text(ts) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def age_seconds(now, ts) -> Column:
    return F.timestamp_diff("SECOND", _col(ts), _col(now))


def next_month_start(ts) -> Column:
    return F.add_months(F.trunc(_col(ts), "month"), 1).cast("timestamp_ntz")


def local_clock(now: datetime, mode: str = "auto", zone: str = "Europe/Madrid") -> tuple[bool, int]:
    """(is a working day, hour) at ``now`` in the routing zone; what-if modes replace the time of day."""
    if now.tzinfo is None:
        now = now.replace(tzinfo=timezone.utc)
    local = now.astimezone(ZoneInfo(zone))
    hour = MODE_CLOCK[mode][0] if mode in MODE_CLOCK else local.hour
    return local.weekday() < 5, hour
