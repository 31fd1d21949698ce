"""Putting irregular readings on time grids (RS-*)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.time import DAY, HOUR, MINUTE, SECOND, col, day_number, floor_div, us
from .ordered import framed, salted_join
from .sessions import PID, TS, time_slice


def window_rows(
    df: DataFrame, ts: str, step_us: int, low_us: int, high_us: int, origin: Column | None = None
) -> DataFrame:
    """Give every row each grid point ``t`` whose closed window ``[t+low, t+high]`` holds it.

    Grid points are multiples of ``step_us`` from ``origin``; the number of
    points per row is fixed by the window, so this is a narrow transformation.
    Adds ``t_us``.
    """
    start = origin if origin is not None else F.lit(0).cast("bigint")
    u = us(ts) - start
    first = -floor_div(F.lit(high_us).cast("bigint") - u, step_us)
    last = floor_div(u - F.lit(low_us).cast("bigint"), step_us)
    ks = F.when(first <= last, F.sequence(first, last))
    return df.withColumn("_k", F.explode(ks)).withColumn("t_us", F.col("_k") * F.lit(step_us) + start).drop("_k")


def resample_centered(
    df: DataFrame, off_seconds: int, means: Sequence[str] = (), sums: Sequence[str] = (),
    min_n: int = 1, pid=PID, ts=TS, whole_days: bool = False,
) -> DataFrame:
    """Centred tumbling buckets, closed at both ends (RS-1).

    Means need more than ``min_n`` samples, sums at least one.  With
    ``whole_days`` a bucket only sees samples of its own calendar day.
    """
    half = off_seconds * SECOND // 2
    placed = window_rows(df, ts, off_seconds * SECOND, -half, half)
    if whole_days:
        placed = placed.filter(floor_div("t_us", DAY) == day_number(ts))
    return placed.groupBy(pid, "t_us").agg(
        *[F.when(F.count(c) > min_n, F.avg(c)).alias(c) for c in means],
        *[F.when(F.count(c) > 0, F.sum(c)).alias(c) for c in sums],
    )


def resample_overlap(
    df: DataFrame, off_seconds: int, overlap_seconds: int, means: Sequence[str] = (), sums: Sequence[str] = (),
    min_n: int = 2, pid=PID, ts=TS,
) -> DataFrame:
    """Left-anchored sliding buckets ``[t-1s, t+off+overlap-1s]`` (RS-2)."""
    high = (off_seconds + overlap_seconds - 1) * SECOND
    placed = window_rows(df, ts, off_seconds * SECOND, -SECOND, high)
    return placed.groupBy(pid, "t_us").agg(
        *[F.when(F.count(c) > min_n, F.avg(c)).alias(c) for c in means],
        *[F.when(F.count(c) > 0, F.sum(c)).alias(c) for c in sums],
    )


def resample_multi(
    df: DataFrame, off_seconds: int, overlap_seconds: int, spec: dict[str, str], pid=PID, ts=TS,
    threshold: float | None = None, label: str = "end",
) -> DataFrame:
    """Several statistics per sliding bucket, by column family (RS-3).

    ``spec`` maps a column to ``sum`` (cadence, steps: zeros count), ``mean``
    or ``full`` (zero is missing; mean/std/max/min once more than
    ``threshold`` samples are valid, default a third of the bucket's seconds).
    """
    enough = off_seconds / 3 if threshold is None else threshold
    step, width = off_seconds * SECOND, (off_seconds + overlap_seconds) * SECOND
    placed = window_rows(df, ts, step, 0, width)
    aggs = []
    for c, family in spec.items():
        valid = F.when(F.col(c) != 0, F.col(c))
        if family == "sum":
            aggs += [
                F.max(c).alias(f"{c}_max"), F.avg(c).alias(f"{c}_mean"),
                F.stddev_pop(c).alias(f"{c}_std"), F.sum(c).alias(f"{c}_sum"),
            ]
        elif family == "mean":
            aggs.append(F.avg(valid).alias(f"{c}_mean"))
        else:
            ok = F.count(valid) > enough
            for name, fn in (("max", F.max), ("min", F.min), ("mean", F.avg), ("std", F.stddev_pop)):
                aggs.append(F.when(ok, fn(valid)).alias(f"{c}_{name}"))
    out = placed.groupBy(pid, "t_us").agg(*aggs)
    return out.withColumn("t_us", F.col("t_us") + F.lit(width)) if label == "end" else out


def peak_stats(
    df: DataFrame, value: str, off_seconds: int, overlap_seconds: int = 0, threshold: float = 3.0,
    min_distance: int = 6, margin_seconds: int = 2, pid=PID, ts=TS, slice_days: float = 1.0,
) -> DataFrame:
    """Max/min/mean of local peaks per bucket with a margin (RS-4).

    A peak is above the threshold and the largest value among the rows closer
    than ``min_distance``.
    """
    reach = min_distance - 1
    seen = framed(
        df.withColumn("_us", us(ts)), [pid], ["_us"], reach, reach,
        lambda w: {"_top": F.max(value).over(w.rowsBetween(-reach, reach))}, time_slice("_us", slice_days),
    )
    peaks = seen.filter((F.col(value) == F.col("_top")) & (F.col(value) > threshold))
    margin = margin_seconds * SECOND
    placed = window_rows(peaks, ts, off_seconds * SECOND, -margin, (off_seconds + overlap_seconds) * SECOND + margin)
    return placed.groupBy(pid, "t_us").agg(
        F.count(F.lit(1)).alias("peaks"), F.max(value).alias("peak_max"),
        F.min(value).alias("peak_min"), F.avg(value).alias("peak_mean"),
    )


def hrv(df: DataFrame, off_seconds: int, rr: Sequence[str], tick_ms: int = 4, pid=PID, ts=TS, threshold=None) -> DataFrame:
    """Time-domain beat-interval variability per bucket (RS-5)."""
    enough = off_seconds / 3 if threshold is None else threshold
    beats = df.select(
        pid, us(ts).alias("_us"), F.posexplode(F.array(*[F.col(c) for c in rr])).alias("_beat", "_tick")
    ).filter(F.col("_tick") != 0)
    beats = beats.withColumn("t_us", floor_div("_us", off_seconds * SECOND) * F.lit(off_seconds * SECOND))
    beats = beats.withColumn("nn", (F.col("_tick") * tick_ms).cast("double"))
    w = Window.partitionBy(pid, "t_us").orderBy("_us", "_beat")
    beats = beats.withColumn("d", F.col("nn") - F.lag("nn").over(w)).withColumn("hr", F.lit(60000.0) / F.col("nn"))
    n, mean, rmssd = F.count(F.lit(1)), F.avg("nn"), F.sqrt(F.avg(F.col("d") * F.col("d")))
    nn50, nn20 = F.count_if(F.abs("d") > 50), F.count_if(F.abs("d") > 20)
    out = beats.groupBy(pid, "t_us").agg(
        n.alias("n"), mean.alias("mean_nni"), F.median("nn").alias("median_nni"),
        (F.max("nn") - F.min("nn")).alias("range_nni"), F.stddev_samp("nn").alias("sdnn"),
        F.stddev_pop("d").alias("sdsd"), rmssd.alias("rmssd"),
        nn50.alias("nni_50"), (F.lit(100.0) * nn50 / n).alias("pnni_50"),
        nn20.alias("nni_20"), (F.lit(100.0) * nn20 / n).alias("pnni_20"),
        (F.stddev_samp("nn") / mean).alias("cvnni"), (rmssd / mean).alias("cvsd"),
        F.avg("hr").alias("mean_hr"), F.min("hr").alias("min_hr"), F.max("hr").alias("max_hr"),
        F.stddev_pop("hr").alias("std_hr"),
    )
    return out.filter(F.col("n") > enough)


def spread_sessions(
    df: DataFrame, seconds: str, off_seconds: int = 60, pid=PID, ts=TS, legacy: bool = False
) -> DataFrame:
    """Spread durations over buckets: seconds inside, sessions touching (RS-6).

    ``legacy`` counts whole-second samples minus one per touched bucket.
    """
    step = off_seconds * SECOND
    rows = df.withColumn("_a", us(ts)).withColumn("_b", F.col("_a") + F.round(F.col(seconds) * SECOND).cast("bigint"))
    rows = rows.withColumn("_k", F.explode(F.sequence(floor_div("_a", step), floor_div("_b", step))))
    low = F.greatest(F.col("_a"), F.col("_k") * step)
    high = F.least(F.col("_b"), (F.col("_k") + 1) * step)
    inside = (high - low) / F.lit(float(SECOND))
    if legacy:
        # whole-second marks a, a+1s, ... that fall into the closed bucket, less one
        ceil_low = -floor_div(F.col("_a") - low, SECOND)
        inside = (floor_div(high - F.col("_a"), SECOND) - ceil_low).cast("double")
    return rows.withColumn("_s", inside).groupBy(pid, (F.col("_k") * step).alias("t_us")).agg(
        F.sum("_s").alias("seconds"), F.count(F.lit(1)).alias("sessions")
    )


def spans_of(df: DataFrame, pid=PID, ts=TS) -> DataFrame:
    return df.groupBy(pid).agg(F.min(us(ts)).alias("start_us"), F.max(us(ts)).alias("end_us"))


def grid(spans: DataFrame, step_seconds: int, pid=PID, whole_days: bool = False) -> DataFrame:
    """All grid points of each ``start_us..end_us`` span (RS-9).

    Spans are opened into days first, so no task builds a whole span at once.
    """
    step = step_seconds * SECOND
    per_day = DAY // step
    if per_day * step != DAY:
        raise ValueError("the step must divide a day")
    days = spans.withColumn(
        "_day", F.explode(F.sequence(floor_div("start_us", DAY), floor_div("end_us", DAY)))
    )
    points = days.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(per_day - 1))))
    points = points.withColumn("t_us", F.col("_day") * DAY + F.col("_i") * F.lit(step).cast("bigint"))
    if not whole_days:
        first = floor_div("start_us", step) * step
        points = points.filter((F.col("t_us") >= first) & (F.col("t_us") <= F.col("end_us")))
    return points.drop("_day", "_i", "start_us", "end_us")


def densify(
    values: DataFrame, step_seconds: int, pid=PID, time="t_us", spans: DataFrame | None = None, whole_days=False
) -> DataFrame:
    """Left join a table of grid values onto the full grid (RS-9)."""
    if spans is None:
        spans = values.groupBy(pid).agg(F.min(time).alias("start_us"), F.max(time).alias("end_us"))
    full = grid(spans, step_seconds, pid, whole_days)
    return full.join(values.withColumnRenamed(time, "t_us"), [pid, "t_us"], "left")


def pad(df: DataFrame, cols: Sequence[str], value: float | None = None, noise: float | None = None, seed: int = 0,
        key: Sequence[str] = (PID, "t_us")) -> DataFrame:
    """Replace missing cells by a constant, or by ``value`` + Gaussian noise (RS-10).

    Noise is drawn from a hash of the row key, so repeated runs agree.
    """
    out = {}
    for i, c in enumerate(cols):
        fill = F.lit(value)
        if noise is not None:
            def draw(tag):
                h = F.pmod(F.xxhash64(*[F.col(k) for k in key], F.lit(f"{seed}:{i}:{tag}")), F.lit(1 << 40))
                return (h + 1) / F.lit(float((1 << 40) + 1))
            fill = fill + F.lit(noise) * F.sqrt(-2 * F.log(draw("r"))) * F.cos(2 * F.pi() * draw("a"))
        out[c] = F.coalesce(F.col(c), fill)
    return df.withColumns(out)


def foreground_share(df: DataFrame, off_seconds: int = 60, frame_seconds: float = 0.01, pid=PID, ts=TS) -> DataFrame:
    """Share of foreground frames per bucket on a zero-filled grid, labelled by the right edge (RS-8)."""
    step = off_seconds * SECOND
    counts = df.groupBy(pid, ((floor_div(us(ts), step) + 1) * step).alias("t_us")).agg(F.count(F.lit(1)).alias("_n"))
    spans = spans_of(df, pid, ts).withColumn("end_us", floor_div("end_us", step) * step)
    full = densify(counts, off_seconds, pid, spans=spans)
    frames = F.greatest(F.coalesce(F.col("_n"), F.lit(0)) - 1, F.lit(0))
    return full.select(pid, "t_us", (frames * frame_seconds / off_seconds).alias("foreground"))


def locate(
    df: DataFrame, place: str, signal: str, interval: int = 1, pid=PID, ts=TS, spans: DataFrame | None = None
) -> DataFrame:
    """Strongest place per interval of minutes (RS-7).

    The strongest signal per minute and place is widened to the minutes from
    ``t-interval`` to just before ``t+interval`` and the largest wins; equal
    signals go to the first place in alphabetical order.  With ``spans`` every
    grid point is returned, ``unknown`` where nothing was heard.
    """
    minute = (floor_div(us(ts), MINUTE) * MINUTE).alias("m_us")
    heard = df.groupBy(pid, minute, place).agg(F.max(signal).alias(signal)).filter(F.col(signal) > 0)
    step = interval * MINUTE
    high = MINUTE if interval == 1 else (interval - 1) * MINUTE
    first = -floor_div(F.lit(high).cast("bigint") - F.col("m_us"), step)
    last = floor_div(F.col("m_us") + F.lit(step).cast("bigint"), step)
    wide = heard.withColumn("_k", F.explode(F.sequence(first, last))).withColumn("t_us", F.col("_k") * F.lit(step))
    wide = wide.groupBy(pid, "t_us", place).agg(F.max(signal).alias(signal))
    best = wide.groupBy(pid, "t_us").agg(F.min(F.struct((-F.col(signal)).alias("s"), F.col(place).alias("p"))).alias("_b"))
    best = best.select(pid, "t_us", F.col("_b.p").alias("location"), (-F.col("_b.s")).alias("signal"))
    if spans is None:
        return best
    full = densify(best, interval * 60, pid, spans=spans)
    return full.withColumn("location", F.coalesce("location", F.lit("unknown")))


def subwindow_rms(
    runs: DataFrame, points: DataFrame, value: str, energy: str, window_seconds: int, off_seconds: int,
    min_minutes: float = 5, min_rows: int = 240, pid=PID, ts=TS, keep: Sequence[str] = ("state",), bucket_seconds=3600,
) -> DataFrame:
    """Sliding mean and root-mean-square inside same-place runs (RS-11).

    ``runs`` has ``start_us, end_us``; windows are anchored at the run start
    and must lie inside the run.  Zero values are missing.
    """
    from .intervals import points_in_intervals

    long_runs = runs.filter(F.col("end_us") - F.col("start_us") >= int(min_minutes * MINUTE))
    long_runs = long_runs.select(pid, "start_us", "end_us", *keep)
    inside = points_in_intervals(points.select(pid, ts, value, energy), long_runs, pid, ts, bucket_seconds=bucket_seconds)
    big = inside.groupBy(pid, "start_us").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_rows)
    inside = salted_join(inside, big.select(pid, "start_us"), [pid, "start_us"], "left_semi")
    width = window_seconds * SECOND
    placed = window_rows(inside, ts, off_seconds * SECOND, 0, width, F.col("start_us"))
    placed = placed.filter((F.col("t_us") >= F.col("start_us")) & (F.col("t_us") + width <= F.col("end_us")))
    v = F.when(F.col(value) != 0, F.col(value))
    return placed.groupBy(pid, *keep, "start_us", "t_us").agg(
        F.avg(v).alias("mean_value"), F.sqrt(F.avg(F.col(energy) * F.col(energy))).alias("rms_energy")
    )


def tod_points(
    df: DataFrame, value: str, points: int, window_minutes: int, how: str = "sum", min_n: int = 0, pid=PID, ts=TS
) -> DataFrame:
    """Per day and time-of-day point: sum or mean within half a window (RS-12)."""
    step = DAY // points
    half = window_minutes * MINUTE // 2
    placed = window_rows(df, ts, step, -half, half)
    agg = F.sum(value) if how == "sum" else F.avg(value)
    return placed.groupBy(
        pid, floor_div("t_us", DAY).alias("day"), floor_div(F.pmod("t_us", F.lit(DAY)), step).cast("int").alias("point")
    ).agg(F.when(F.count(value) > min_n, agg).alias("value"))


def shift_sections(
    df: DataFrame, shift_start_us: str, k: int = 4, shift_hours: int = 12, min_rows: float | None = None,
    measures: dict[str, Column] | None = None, pid=PID, ts=TS,
) -> DataFrame:
    """Cut shifts into ``k`` equal sections; keep sections at least half full (RS-13)."""
    length = shift_hours * HOUR // k
    need = shift_hours * 60 / k / 2 if min_rows is None else min_rows
    placed = df.withColumn("section", floor_div(us(ts) - F.col(shift_start_us), length))
    placed = placed.filter(F.col("section").between(0, k - 1)).withColumn("section", F.col("section").cast("int"))
    out = placed.groupBy(pid, shift_start_us, "section").agg(
        F.count(F.lit(1)).alias("n"), *[e.alias(n) for n, e in (measures or {}).items()]
    )
    return out.filter(F.col("n") >= need)


def diurnal(ts: str = TS) -> Column:
    """Night, morning, afternoon or evening by six-hour bin (RS-14)."""
    names = F.array(F.lit("night"), F.lit("morning"), F.lit("afternoon"), F.lit("evening"))
    return F.element_at(names, (F.floor(F.hour(col(ts)) / 6) + 1).cast("int"))


def doc_windows(df: DataFrame, word: str, step_minutes=10, span_minutes=20, min_words=1, pid=PID, ts=TS) -> DataFrame:
    """Overlapping windows of state words as documents (RS-15).

    A document is bounded by its span; words keep time order.
    """
    placed = window_rows(df, ts, step_minutes * MINUTE, 0, span_minutes * MINUTE)
    docs = placed.groupBy(pid, "t_us").agg(F.array_sort(F.collect_list(F.struct(us(ts).alias("u"), F.col(word).alias("w")))).alias("_w"))
    docs = docs.select(pid, "t_us", F.transform("_w", lambda x: x["w"]).alias("words"))
    return docs.filter(F.size("words") >= min_words)
