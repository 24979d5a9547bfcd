"""Predicates and small formulas over transaction columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerscope import constants as C


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def near_threshold_band(amount: Column) -> Column:
    """Amount inside one of the bands just under a reporting limit."""
    return _any([(amount >= low) & (amount < high) for low, high in C.THRESHOLD_BANDS])


def near_threshold_pct(amount: Column, pct: float = 0.05) -> Column:
    """Amount at most ``pct`` below a reporting limit."""
    return _any([(amount >= t * (1 - pct)) & (amount < t) for t in C.REPORTING_THRESHOLDS])


def is_night(ts: Column, start: int = 23, end: int = 5) -> Column:
    hour = F.hour(ts)
    return (hour >= start) | (hour < end)


def is_festival(ts: Column) -> Column:
    """October, or the first half of November."""
    month = F.month(ts)
    return (month == 10) | ((month == 11) & (F.dayofmonth(ts) <= 15))


def occupation_in(occupation: Column, names: list[str]) -> Column:
    """Case-insensitive membership; unknown occupation is never a member."""
    return F.coalesce(F.lower(occupation).isin(names), F.lit(False))


def vpa_age_days(ts: Column, created: Column) -> Column:
    """Whole days between payment and handle creation, never negative, null if unknown."""
    seconds = (
        F.unix_micros(ts.cast("timestamp")) - F.unix_micros(created.cast("timestamp"))
    ) / 1_000_000.0
    # greatest() skips nulls, so an unknown age needs its own branch.
    return F.when(seconds.isNotNull(), F.greatest(F.floor(seconds / 86_400), F.lit(0))).cast("long")


def micro_test_payment(amount: Column, vpa_age: Column) -> Column:
    return F.when((amount < 2) & (vpa_age < 7), 1.0).otherwise(0.0)


def staleness_hours(as_of: Column, last_updated: Column) -> Column:
    return (
        F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(last_updated.cast("timestamp"))
    ) / 3_600_000_000.0


def score_to_action(
    score: Column,
    log: float = C.THRESHOLD_LOG,
    review: float = C.THRESHOLD_REVIEW,
    high_risk: float = C.THRESHOLD_HIGH_RISK,
) -> Column:
    return (
        F.when(score >= high_risk, "HIGH_RISK")
        .when(score >= review, "REVIEW")
        .when(score >= log, "LOG")
        .otherwise("PASS")
    )


def jitter(score: Column, key: Column, seed: int = 42, width: float = C.JITTER_RANGE) -> Column:
    """Shift of at most ``width`` drawn from the key, so a rerun gives the same score."""
    draw = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_001)) / 1_000_000.0
    return clamp(score + (draw * 2 - 1) * width, 0.0, 1.0)


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi))))


def normalize(x: Column, lo: float, hi: float) -> Column:
    """Linear map of [lo, hi] onto [0, 1], clamped; 0 for an empty interval."""
    if hi <= lo:
        return F.lit(0.0)
    return clamp((x - lo) / float(hi - lo))


def signal_confidence(p: Column) -> Column:
    return F.abs(p - 0.5) * 2.0


def large_value(amount: Column, action: Column) -> Column:
    return (action == "HIGH_RISK") & (amount >= C.LARGE_VALUE)


def leading_digit(x: Column) -> Column:
    """First non-zero digit of the decimal form; null for zero."""
    # A decimal cast keeps large doubles out of exponent notation.
    digit = F.regexp_extract(F.abs(x).cast("decimal(38,10)").cast("string"), "[1-9]", 0)
    return F.when(digit != "", digit.cast("int"))
