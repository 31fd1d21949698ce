"""Breakpoints by Gaussian likelihood (WN-15, WN-16)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.time import us
from ..session import cut_lineage
from .ordered import positions, running, salted_join
from .sessions import PID, TS, time_slice

SUMS = ("x", "y", "xx", "yy", "xy")


def prefix_sums(df: DataFrame, x: str, y: str, pid=PID, ts=TS, slice_days=1.0) -> DataFrame:
    """Row position and running sums of two columns and their products.

    Any segment's moments are differences of two of these rows, so later
    rounds need no ordering.  Both columns are centred per series: moments do
    not change, and squares of a large mean do not swallow them.
    """
    rows = df.select(pid, us(ts).alias("t_us"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    means = rows.groupBy(pid).agg(F.avg("_x").alias("_mx"), F.avg("_y").alias("_my"))
    rows = salted_join(rows, means, [pid]).select(pid, "t_us", (F.col("_x") - F.col("_mx")).alias("_x"), (F.col("_y") - F.col("_my")).alias("_y"))
    ops = {"pos": ("count", F.lit(1)), "s_x": ("sum", F.col("_x")), "s_y": ("sum", F.col("_y")),
           "s_xx": ("sum", F.col("_x") * F.col("_x")), "s_yy": ("sum", F.col("_y") * F.col("_y")), "s_xy": ("sum", F.col("_x") * F.col("_y"))}
    return running(rows, [pid], ["t_us"], ops, time_slice("t_us", slice_days)).drop("_x", "_y")


def _objective(n: Column, s: dict[str, Column], lam: float) -> Column:
    """``n log|S| - lam tr(S^-1)`` with ``S = cov + lam/n I``, for two columns."""
    mx, my = s["x"] / n, s["y"] / n
    a = s["xx"] / n - mx * mx + lam / n
    b = s["yy"] / n - my * my + lam / n
    c = s["xy"] / n - mx * my
    det = a * b - c * c
    det = F.when(det > 0, det)  # no likelihood without a proper covariance
    return n * F.log(det) - lam * (a + b) / det


def score_segments(prefix: DataFrame, segments: DataFrame, lam: float, pid=PID) -> DataFrame:
    """Best split of each segment: ``pid, first, last, best, gain``.

    ``segments`` holds ``first``/``last`` positions with the running sums just
    before the first row (``b_*``) and at the last (``e_*``).  Candidates leave
    at least two rows on the left and two on the right.
    """
    joined = salted_join(prefix, segments, [pid])
    i = F.col("pos") - F.col("first") + 1
    m = F.col("last") - F.col("first") + 1
    inside = joined.filter((i >= 2) & (i <= m - 2))  # a null gain never wins
    n_left, n_all = i.cast("double"), m.cast("double")
    left = {k: F.col(f"s_{k}") - F.col(f"b_{k}") for k in SUMS}
    right = {k: F.col(f"e_{k}") - F.col(f"s_{k}") for k in SUMS}
    whole = {k: F.col(f"e_{k}") - F.col(f"b_{k}") for k in SUMS}
    gain = _objective(n_all, whole, lam) - _objective(n_left, left, lam) - _objective(n_all - n_left, right, lam)
    scored = inside.select(pid, "first", "last", gain.alias("gain"), F.col("pos").alias("best"))
    best = F.max(F.struct("gain", (-F.col("best")).alias("p")))
    return scored.groupBy(pid, "first", "last").agg(best.alias("_b")).select(pid, "first", "last", (-F.col("_b.p")).alias("best"), F.col("_b.gain").alias("gain"))


def _with_sums(segments: DataFrame, prefix: DataFrame, pid=PID) -> DataFrame:
    at = prefix.select(pid, "pos", *[f"s_{k}" for k in SUMS])
    begin = at.select(pid, (F.col("pos") + 1).alias("first"), *[F.col(f"s_{k}").alias(f"b_{k}") for k in SUMS])
    end = at.select(pid, F.col("pos").alias("last"), *[F.col(f"s_{k}").alias(f"e_{k}") for k in SUMS])
    out = segments.join(begin, [pid, "first"], "left").join(end, [pid, "last"])
    return out.na.fill(0.0, [f"b_{k}" for k in SUMS])


def split_scan(df: DataFrame, x: str, y: str, lam: float = 1.0, pid=PID, ts=TS, slice_days=1.0) -> DataFrame:
    """Best single split per series (WN-15): position of the last row on the left, and its gain."""
    prefix = prefix_sums(df, x, y, pid, ts, slice_days)
    whole = prefix.groupBy(pid).agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    out = score_segments(prefix, _with_sums(whole, prefix, pid), lam, pid)
    at = prefix.select(pid, F.col("pos").alias("best"), "t_us")
    return out.join(at, [pid, "best"]).select(pid, F.col("last").alias("n"), "best", "gain", "t_us")


def greedy_segments(
    df: DataFrame, x: str, y: str, k: int, lam: float = 1.0, pid=PID, ts=TS, slice_days=1.0, adjust: int = 100
) -> DataFrame:
    """Up to ``k`` breakpoints per series, best first, then re-fitted between neighbours (WN-16).

    One Spark job per round works on all series at once: it splits each
    series' best segment and scores only the two new ones.  Returns one row
    per segment: ``pid, segment, first, last, start_us, end_us``.  Breakpoints are moved until
    none moves; RuntimeError if some still do after ``adjust`` rounds.
    """
    prefix = cut_lineage(prefix_sums(df, x, y, pid, ts, slice_days))
    whole = prefix.groupBy(pid).agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    known = cut_lineage(whole.join(score_segments(prefix, _with_sums(whole, prefix, pid), lam, pid), [pid, "first", "last"], "left"))
    for _ in range(k):
        w = Window.partitionBy(pid).orderBy(F.col("gain").desc_nulls_last(), "first")  # at most k + 1 segments
        ranked = known.withColumn("_r", F.row_number().over(w))
        split = ranked.filter((F.col("_r") == 1) & (F.col("gain") > 0))
        halves = split.select(pid, F.explode(F.array(
            F.struct(F.col("first").alias("first"), F.col("best").alias("last")),
            F.struct((F.col("best") + 1).alias("first"), F.col("last").alias("last")),
        )).alias("h")).select(pid, "h.first", "h.last")
        fresh = halves.join(score_segments(prefix, _with_sums(halves, prefix, pid), lam, pid), [pid, "first", "last"], "left")
        kept = ranked.filter((F.col("_r") > 1) | F.col("gain").isNull() | (F.col("gain") <= 0)).drop("_r")
        known = cut_lineage(kept.unionByName(fresh))
    known = known.select(pid, "first", "last")
    for _ in range(adjust):
        moved = _readjust(known, prefix, lam, pid)
        still = moved.join(known, [pid, "first", "last"], "left_anti").isEmpty()
        known = moved
        if still:
            break
    else:
        if adjust:
            raise RuntimeError(f"breakpoints still move after {adjust} rounds")
    number = F.row_number().over(Window.partitionBy(pid).orderBy("first"))
    at = prefix.select(pid, "pos", "t_us")
    out = known.select(pid, "first", "last").withColumn("segment", number)
    out = out.join(at.withColumnRenamed("pos", "first").withColumnRenamed("t_us", "start_us"), [pid, "first"])
    return out.join(at.withColumnRenamed("pos", "last").withColumnRenamed("t_us", "end_us"), [pid, "last"]).select(pid, "segment", "first", "last", "start_us", "end_us")


def _readjust(segments: DataFrame, prefix: DataFrame, lam: float, pid: str) -> DataFrame:
    """Move breakpoints to their best place between the neighbouring ones.

    Odd breakpoints move first, then even ones, so no two neighbours move at
    the same time.
    """
    for parity in (1, 0):
        w = Window.partitionBy(pid).orderBy("first")  # at most k + 1 segments
        chain = segments.withColumn("_i", F.row_number().over(w)).withColumn("_end", F.lead("last").over(w))
        spans = chain.filter((F.col("_i") % 2 == parity) & F.col("_end").isNotNull()).select(pid, "first", F.col("_end").alias("last"))
        moved = score_segments(prefix, _with_sums(spans, prefix, pid), lam, pid).filter("gain > 0").select(pid, "first", F.col("best").alias("_best"))
        chain = chain.join(moved, [pid, "first"], "left").withColumn("last", F.coalesce("_best", "last"))
        follow = F.lag("last").over(w) + 1
        segments = cut_lineage(chain.select(pid, F.coalesce(follow, F.col("first")).alias("first"), "last"))
    return segments
