"""Completeness and threshold filters (FLT-*)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.time import HOUR, col
from .ordered import salted_join
from .sessions import PID, keep_keys


def having_count(df: DataFrame, n: int, by: Sequence[str] = (PID,)) -> DataFrame:
    """Rows of groups with at least ``n`` rows (FLT-1)."""
    enough = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= n)
    return keep_keys(df, enough, list(by))


def complete_periods(
    df: DataFrame, value: str, share: float, by: Sequence[str], length: int | None = None
) -> DataFrame:
    """Periods whose non-null share reaches ``share`` and whose length fits (FLT-2)."""
    n, ok = F.count(F.lit(1)), F.count(value)
    out = df.groupBy(*by).agg(n.alias("n"), ok.alias("valid"))
    out = out.filter(F.col("valid") / F.col("n") >= share)
    return out.filter(F.col("n") == length) if length is not None else out


def min_days(df: DataFrame, n: int, pid=PID, day="day") -> DataFrame:
    """Participants with at least ``n`` qualifying days (FLT-3)."""
    days = df.select(pid, day).distinct().groupBy(pid).agg(F.count(F.lit(1)).alias("days"))
    return days.filter(F.col("days") >= n)


def load_periods(
    periods: DataFrame, points: DataFrame, logic: str | None = None, low_hours: float | None = None,
    high_hours: float | None = None, valid_rate: float | None = None, value="value", pid=PID, ts="ts", bucket_seconds=6 * 3600,
) -> DataFrame:
    """Points of the periods that pass duration, validity and work rules (FLT-4).

    ``logic`` is ``work``, ``off_work`` or None; the valid rate is the share of
    non-negative readings in the period.
    """
    from .intervals import points_in_intervals

    hours = (F.col("end_us") - F.col("start_us")) / F.lit(float(HOUR))
    kept = periods
    if logic:
        kept = kept.filter((F.col("work") == 1) if logic == "work" else (F.col("work") != 1))
    if low_hours is not None:
        kept = kept.filter(hours >= low_hours)
    if high_hours is not None:
        kept = kept.filter(hours <= high_hours)
    inside = points_in_intervals(points, kept, pid, ts, bucket_seconds=bucket_seconds)
    if valid_rate is None:
        return inside
    good = inside.groupBy(pid, "start_us").agg(F.avg((F.col(value) >= 0).cast("double")).alias("_rate"))
    good = good.filter(F.col("_rate") >= valid_rate)
    return salted_join(inside, good.select(pid, "start_us"), [pid, "start_us"], "left_semi")


def min_distinct(df: DataFrame, value: str, n: int, by: Sequence[str]) -> DataFrame:
    """Groups with at least ``n`` distinct values (FLT-5); counted in two steps."""
    out = df.select(*by, value).distinct().groupBy(*by).agg(F.count(value).alias("distinct_values"))
    return out.filter(F.col("distinct_values") >= n)


def usable_days(
    phone: DataFrame, wrist: DataFrame, seconds: str, valid: str, min_seconds=300, min_valid=360, pid=PID, day="day",
    min_total: float | None = None,
) -> DataFrame:
    """Days with enough phone use and enough valid minutes (FLT-6)."""
    a = phone.groupBy(pid, day).agg(F.sum(seconds).alias("seconds")).filter(F.col("seconds") >= min_seconds)
    b = wrist.groupBy(pid, day).agg(F.count(valid).alias("valid")).filter(F.col("valid") >= min_valid)
    out = a.join(b, [pid, day])
    if min_total is not None:
        rich = out.groupBy(pid).agg(F.sum("seconds").alias("_t")).filter(F.col("_t") >= min_total)
        out = out.join(rich.select(pid), pid, "left_semi")
    return out


def known_location_share(df: DataFrame, location: str, by: Sequence[str], limit=0.5, unknown=("unknown", "other", "other_floor")) -> DataFrame:
    """Periods whose share of unknown places stays below the limit (FLT-7)."""
    share = F.avg(F.col(location).isin(list(unknown)).cast("double"))
    return df.groupBy(*by).agg(share.alias("unknown_share")).filter(F.col("unknown_share") < limit)


def clip(c: str | Column, low=None, high=None) -> Column:
    """Bound a column; null stays null (FLT-9)."""
    c = col(c)
    if low is not None:
        c = F.when(c < low, F.lit(low)).otherwise(c)
    if high is not None:
        c = F.when(c > high, F.lit(high)).otherwise(c)
    return c
