"""Scalar transforms of heart-rate and audio features (FN-11, FN-12, FN-14, FN-15)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from .time import col

ZONES = ("peak", "cardio", "fat_burn", "out_of_range")


def log_pitch(f0) -> Column:
    """Natural log of pitch; zero (unvoiced) is null (FN-11)."""
    return F.log(F.nullif(col(f0).cast("double"), F.lit(0.0)))


def band_ratio(low, high) -> Column:
    return F.try_divide(col(low), col(high))


def decibel(energy) -> Column:
    return 10 * F.log10(F.nullif(col(energy), F.lit(0.0)) * 1e12)


def arousal(percentile) -> Column:
    """Percentile rank to [-1, 1] (FN-12)."""
    return 2 * col(percentile) - 1


def blend(first, second, alpha: float) -> Column:
    return alpha * col(first) + (1 - alpha) * col(second)


def hr_zone(hr, max_hr) -> Column:
    """Heart-rate zone by share of the period's maximum (FN-14)."""
    share = F.try_divide(col(hr), col(max_hr))
    return F.when(share >= 0.85, ZONES[0]).when(share >= 0.7, ZONES[1]).when(share >= 0.5, ZONES[2]).when(share.isNotNull(), ZONES[3])


def zone_ratio(cols: Sequence[str]) -> dict[str, Column]:
    """Zone minutes as shares of their sum; missing zones count as zero (FN-15)."""
    parts = [F.coalesce(F.col(c), F.lit(0)) for c in cols]
    total = sum(parts[1:], parts[0])
    return {f"{c}_ratio": F.try_divide(p.cast("double"), total) for c, p in zip(cols, parts)}
