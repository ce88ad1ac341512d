"""Scores, levels and classes derived from single columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _lookup(value: Column, pairs: dict[str, float | int], default: float | int) -> Column:
    chain = reduce(lambda acc, kv: acc.when(value == kv[0], F.lit(kv[1])), pairs.items(), F)
    return chain.otherwise(F.lit(default))


def _norm(value: Column | str) -> Column:
    return F.lower(F.trim(_col(value)))


# Fixed values of the scoring tables.
CRITICALITY_SCORE = {"high": 1.0, "medium": 0.6, "low": 0.3}
CRITICALITY_WEIGHT = {"high": 1.35, "medium": 1.1}
STATUS_SCORE = {"active": 1.0, "maintenance": 0.25}
CONGESTION_RANK = {"high": 3, "medium": 2, "low": 1}
CONGESTION_WEIGHT = {"high": 1.6, "medium": 1.25, "low": 1.0}
DISTANCE_DELAY_STEPS = ((160, 4), (260, 5), (360, 6), (480, 7), (620, 8), (760, 9))
DISTANCE_DELAY_LAST = 10


def criticality_score(criticality) -> Column:
    return _lookup(_col(criticality), CRITICALITY_SCORE, 0.5)


def criticality_weight(criticality) -> Column:
    return _lookup(_norm(criticality), CRITICALITY_WEIGHT, 1.0)


def status_score(status) -> Column:
    return _lookup(_col(status), STATUS_SCORE, 0.6)


def climate_severity(rain, wind) -> Column:
    return _col(rain) * 3.0 + _col(wind) * 0.15


def congestion_pressure(delay, speed, events) -> Column:
    delay, speed, events = map(_col, (delay, speed, events))
    return (
        delay * 1.5
        + F.when(speed > 0, F.try_divide(F.lit(100.0), speed)).otherwise(0.0)
        + F.when(events > 0, F.try_divide(F.lit(10.0), F.sqrt(events))).otherwise(0.0)
    )


def risk_level(minutes) -> Column:
    minutes = _col(minutes)
    return F.when(minutes >= 10, "high").when(minutes >= 5, "medium").otherwise("low")


def heuristic_delay(speed) -> Column:
    speed = _col(speed)
    return F.when(speed.isNull(), 8.0).when(speed < 30, 14.0).when(speed < 50, 8.0).otherwise(3.0)


def congestion_level(delay, speed, samples) -> Column:
    delay, speed, samples = map(_col, (delay, speed, samples))
    return (
        F.when(F.coalesce(samples, F.lit(0)) <= 0, "unknown")
        .when((delay >= 14) | (speed <= 38), "high")
        .when((delay >= 8) | (speed <= 54), "medium")
        .otherwise("low")
    )


def resolve_congestion(level, delay, minutes) -> Column:
    """Keep a live level; otherwise estimate it from the delay and the travel minutes of the edge."""
    level, delay, minutes = _norm(level), _col(delay), _col(minutes)
    return (
        F.when(level.isin("low", "medium", "high"), level)
        .when((delay >= 12) | (minutes >= 300), "high")
        .when((delay >= 7) | (minutes >= 180), "medium")
        .otherwise("low")
    )


def congestion_rank(level) -> Column:
    return _lookup(F.lower(_col(level)), CONGESTION_RANK, 0)


def congestion_weight(level) -> Column:
    return _lookup(_norm(level), CONGESTION_WEIGHT, 1.1)


def impact_level(factor) -> Column:
    factor = _col(factor)
    return F.when(factor < 0.45, "low").when(factor < 0.95, "medium").otherwise("high")


def delay_for_distance(km) -> Column:
    km = _col(km)
    chain = reduce(lambda acc, step: acc.when(km < step[0], F.lit(step[1])), DISTANCE_DELAY_STEPS, F)
    return chain.otherwise(F.lit(DISTANCE_DELAY_LAST))


def freshness_class(age_seconds) -> Column:
    age = _col(age_seconds)
    return F.when(age.isNull(), "unknown").when(age > 300, "stale").when(age > 120, "warn").otherwise("fresh")


def delay_severity(delay) -> Column:
    return F.when(_col(delay) >= 15, "bad").otherwise("ok")
