"""Filling gaps (IM-*)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.time import floor_div, us
from .ordered import framed, salted_join
from .sessions import PID, TS, time_slice


def fill_mean(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (PID,)) -> DataFrame:
    """Column mean of the group (IM-1)."""
    means = df.groupBy(*by).agg(*[F.avg(c).alias(f"_m_{c}") for c in cols])
    out = salted_join(df, means, list(by), "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"_m_{c}")) for c in cols}).drop(*[f"_m_{c}" for c in cols])


def fill_profile(df: DataFrame, value: str, slot: Column, work: str | None = None, pid=PID) -> DataFrame:
    """Time-of-day profile (by work flag, then overall), then the column mean (IM-2)."""
    rows = df.withColumn("_slot", slot)
    levels = ([[pid, work, "_slot"]] if work else []) + [[pid, "_slot"], [pid]]
    fills = []
    for i, key in enumerate(levels):
        prof = rows.groupBy(*key).agg(F.avg(value).alias(f"_p{i}"))
        rows = salted_join(rows, prof, key, "left")
        fills.append(F.col(f"_p{i}"))
    return rows.withColumn(value, F.coalesce(F.col(value), *fills)).drop("_slot", *[f"_p{i}" for i in range(len(levels))])


def fill_local(df: DataFrame, value: str, low=-3, high=2, early: int = 5, pid=PID, ts=TS, slice_days=1.0) -> DataFrame:
    """Rolling mean around the gap, the participant's mean in the first rows (IM-3)."""
    rolled = framed(
        df.withColumn("_us", us(ts)), [pid], ["_us"], -low, high,
        lambda w: {"_r": F.avg(value).over(w.rowsBetween(low, high))}, time_slice("_us", slice_days),
    )
    means = df.groupBy(pid).agg(F.avg(value).alias("_m"))
    out = salted_join(rolled, means, [pid], "left")
    fill = F.when(F.col("pos") <= early, F.col("_m")).otherwise(F.coalesce("_r", "_m"))
    return out.withColumn(value, F.coalesce(F.col(value), fill)).drop("_us", "_r", "_m", "pos")


def fill_knn(df: DataFrame, value: str, feature: str, k: int = 5, band_seconds: int = 86400, pid=PID, ts=TS) -> DataFrame:
    """Mean of the ``k`` rows nearest in ``feature`` within a time band, by inverse distance (IM-4).

    Along the sorted feature the nearest complete rows are among the ``k``
    before and the ``k`` after, so each gap meets at most ``2k`` candidates.
    """
    rows = df.withColumn("_us", us(ts)).withColumn("_band", floor_div("_us", band_seconds * 1_000_000))
    key = [pid, "_band"]
    usable = F.col(feature).isNotNull()
    w = Window.partitionBy(*key).orderBy(feature, "_us").rowsBetween(Window.unboundedPreceding, 0)
    known = F.col(value).isNotNull() & usable
    ranked = rows.filter(usable).withColumn("_c", F.count(F.when(known, 1)).over(w))
    complete = ranked.filter(known).select(*key, F.col("_c").alias("_r"), F.col(value).alias("_v"), F.col(feature).alias("_f"))
    gaps = ranked.filter(F.col(value).isNull()).select(*key, "_us", feature, "_c")
    wide = gaps.withColumn("_r", F.explode(F.sequence(F.col("_c") - k + 1, F.col("_c") + k)))
    near = wide.join(complete, [*key, "_r"]).withColumn("_d", F.abs(F.col("_f") - F.col(feature)))
    closest = Window.partitionBy(*key, "_us").orderBy("_d", "_r")
    near = near.withColumn("_i", F.row_number().over(closest)).filter(F.col("_i") <= k)
    weight = 1 / (F.col("_d") + F.lit(1e-6))
    fills = near.groupBy(*key, "_us").agg((F.sum(weight * F.col("_v")) / F.sum(weight)).alias("_fill"))
    out = rows.join(fills, [*key, "_us"], "left")
    return out.withColumn(value, F.coalesce(F.col(value), F.col("_fill"))).drop("_us", "_band", "_fill")


def fill_regression(df: DataFrame, cols: Sequence[str], rounds: int = 100, by: Sequence[str] = (PID,), ridge: float = 1e-6, tol: float = 1e-6) -> DataFrame:
    """Round-robin regression of each incomplete column on the others (IM-5).

    Starts from group means; every round refits all columns of all groups from
    sums of products and replaces only what was missing.  Rounds end when no filled
    value moves by more than ``tol`` of its column's largest size; RuntimeError if some still does after ``rounds``.
    """
    from ..session import cut_lineage
    from .regression import apply_fit, fit_by

    marked = df.withColumns({f"_na_{c}": F.col(c).isNull() for c in cols})
    current = fill_mean(marked, cols, by)
    for _ in range(rounds):
        current = current.withColumns({f"_was_{c}": F.col(c) for c in cols})
        for c in cols:
            others = [o for o in cols if o != c]
            fit = fit_by(current.filter(~F.col(f"_na_{c}")), c, others, by, ridge)
            current = apply_fit(current, fit, others, by, "_hat")
            current = current.withColumn(c, F.when(F.col(f"_na_{c}"), F.coalesce("_hat", c)).otherwise(F.col(c))).drop("_hat")
        shift = [F.max(F.when(F.col(f"_na_{c}"), F.abs(F.col(c) - F.col(f"_was_{c}")))) / F.max(F.abs(c)) for c in cols]
        current = cut_lineage(current)
        gaps = current.agg(*shift).first()
        current = current.drop(*[f"_was_{c}" for c in cols])
        if all(g is None or g <= tol for g in gaps):
            return current.drop(*[f"_na_{c}" for c in cols])
    raise RuntimeError(f"filled values still move after {rounds} rounds")


def only_if_complete(df: DataFrame, cols: Sequence[str], share: float = 0.75, by: Sequence[str] = (PID,)) -> DataFrame:
    """Rows of groups where enough rows are complete (IM-6)."""
    whole = F.lit(True)
    for c in cols:
        whole = whole & F.col(c).isNotNull()
    good = df.groupBy(*by).agg(F.avg(whole.cast("double")).alias("_s")).filter(F.col("_s") >= share)
    return salted_join(df, good.select(*by), list(by), "left_semi")


def fill_dataset_mean(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean over the whole table (IM-7); the means are one row."""
    means = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols]).withColumn("_one", F.lit(1))
    out = df.withColumn("_one", F.lit(1)).join(F.broadcast(means), "_one").drop("_one")
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"_m_{c}")) for c in cols}).drop(*[f"_m_{c}" for c in cols])


def null_below(df: DataFrame, value: str, low: float, also: Sequence[str] = ()) -> DataFrame:
    """Values below a limit, and columns tied to them, become null (IM-8)."""
    ok = F.col(value) >= low
    return df.withColumns({c: F.when(ok, F.col(c)) for c in [*also, value]})
