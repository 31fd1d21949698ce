"""Gap-based sessions, runs of equal state, islands of days (SES-*)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.time import DAY, HOUR, MINUTE, SECOND, col, floor_div, us
from .ordered import merge_runs, positions, running, with_neighbour

PID, TS = "participant_id", "ts"


def time_slice(time: str, days: float = 1.0) -> Column:
    return floor_div(time, int(days * DAY))


def sessions(
    df: DataFrame,
    gap_seconds: float,
    pid: str | Sequence[str] = PID,
    ts: str = TS,
    measures: dict | None = None,
    slice_days: float = 1.0,
) -> DataFrame:
    """Split a stream where consecutive samples are more than the gap apart (SES-1).

    Returns ``pid, start_us, end_us, n`` and the ``measures``.
    """
    keys = [pid] if isinstance(pid, str) else list(pid)
    gap = int(round(gap_seconds * SECOND))
    out = merge_runs(
        df.withColumn("_us", us(ts)),
        keys,
        "_us",
        lambda prev, cur: cur["start"] - prev["end"] > gap,
        time_slice("_us", slice_days),
        measures=measures,
    )
    return out.withColumnRenamed("start", "start_us").withColumnRenamed("end", "end_us")


def shift_sessions(df, gap_seconds=6 * 3600, min_minutes=30, max_minutes=900, **kw) -> DataFrame:
    """Sessions of a proximity stream as shifts, kept by length (SES-2)."""
    minutes = (F.col("end_us") - F.col("start_us")) / F.lit(float(MINUTE))
    return sessions(df, gap_seconds, **kw).filter((minutes >= min_minutes) & (minutes <= max_minutes))


def recordings(df, gap_seconds=8 * 3600, min_rows=0, max_rows=900, **kw) -> DataFrame:
    """Sessions kept by row count, with duration in hours (SES-3)."""
    hours = (F.col("end_us") - F.col("start_us")) / F.lit(float(HOUR))
    return sessions(df, gap_seconds, **kw).filter(F.col("n").between(min_rows, max_rows)).withColumn("hours", hours)


def keep_keys(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is in ``keys``, safe for hot keys."""
    from .ordered import salted_join

    return salted_join(df, keys.select(*on), on, "left_semi")


def valid_recordings(df, gap_seconds=2 * 3600, min_rows=240, max_rows=900, min_kept=5, pid=PID, **kw) -> DataFrame:
    """Recordings by size, only for participants that keep enough of them (SES-4)."""
    kept = sessions(df, gap_seconds, pid, **kw).filter(F.col("n").between(min_rows, max_rows))
    enough = kept.groupBy(pid).agg(F.count(F.lit(1)).alias("_k")).filter(F.col("_k") >= min_kept)
    return keep_keys(kept, enough, [pid])


def long_recordings(df, gap_seconds=4 * 3600, min_hours=2.0, min_kept=10, pid=PID, **kw) -> DataFrame:
    """Recordings by span, only for participants that keep enough of them (SES-5)."""
    kept = sessions(df, gap_seconds, pid, **kw).filter(F.col("end_us") - F.col("start_us") >= int(min_hours * HOUR))
    enough = kept.groupBy(pid).agg(F.count(F.lit(1)).alias("_k")).filter(F.col("_k") >= min_kept)
    return keep_keys(kept, enough, [pid])


def blocks(df, gap_seconds=120, min_minutes=180, **kw) -> DataFrame:
    """Nearly gap-free stretches of a minimum length (SES-6)."""
    return sessions(df, gap_seconds, **kw).filter(F.col("end_us") - F.col("start_us") >= min_minutes * MINUTE)


def utterances(df, pause=20.0, sub_gap=0.2, min_n=10, max_n=2000, pid=PID, ts=TS, measures=None, **kw) -> DataFrame:
    """Pause-separated utterances with the sub-segments inside them (SES-7).

    A pause longer than ``sub_gap`` closes a sub-segment, one longer than
    ``pause`` the utterance.  Sub-segments are built from frames, utterances
    from sub-segments; frames are read once.
    """
    inner = sessions(df, sub_gap, pid, ts, measures={"frames": ("count", F.lit(1))}, **kw)
    outer = merge_spans(inner, pause, pid, {
        "n": ("sum", F.col("frames")),
        "segments": ("count", F.lit(1)),
        "mean_segment": ("avg", F.col("frames")),
        "longest_segment": ("max", F.col("frames")),
    })
    return outer.filter((F.col("n") > min_n) & (F.col("n") < max_n))


def merge_spans(spans: DataFrame, gap_seconds: float, pid=PID, measures: dict | None = None, slice_days=1.0) -> DataFrame:
    """Join consecutive ``start_us/end_us`` spans that are within the gap."""
    keys = [pid] if isinstance(pid, str) else list(pid)
    gap = int(round(gap_seconds * SECOND))
    linked = with_neighbour(
        spans, keys, ["start_us"], {"_prev_end": F.col("end_us")}, time_slice("start_us", slice_days)
    )
    fresh = F.col("_prev_end").isNull() | (F.col("start_us") - F.col("_prev_end") > gap)
    marked = running(
        linked, keys, ["start_us"], {"_first": ("max", F.when(fresh, F.col("start_us")))}, time_slice("start_us", slice_days)
    )
    from .ordered import Measures

    m = Measures(measures or {}, "start_us")
    grouped = marked.groupBy(*keys, F.col("_first").alias("start_us")).agg(F.max("end_us").alias("end_us"), *m.parts())
    return grouped.select(*keys, "start_us", "end_us", *m.final())


def frame_runs(df, gap_seconds=0.1, **kw) -> DataFrame:
    """Lengths of unbroken frame runs (SES-8)."""
    return sessions(df, gap_seconds, **kw)


def work_runs(days: DataFrame, pid=PID, day="day", min_days=2) -> DataFrame:
    """Runs of consecutive day numbers (SES-9).

    ``days`` has one row per participant-day, so a participant's rows are
    bounded by the calendar.
    """
    unique = days.select(pid, day).distinct()
    island = F.col(day) - F.row_number().over(Window.partitionBy(pid).orderBy(day))
    runs = unique.withColumn("_island", island).groupBy(pid, "_island").agg(
        F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count(F.lit(1)).cast("bigint").alias("days")
    )
    return runs.drop("_island").filter(F.col("days") >= min_days)


def longest_valid_run(days: DataFrame, pid=PID, day="day", share="share", min_share=0.5, min_days=10) -> DataFrame:
    """Longest run of days whose valid share is above the limit (SES-10)."""
    runs = work_runs(days.filter(F.col(share) > min_share), pid, day, min_days)
    best = F.max_by(F.struct("first_day", "last_day", "days"), F.struct(F.col("days"), -F.col("first_day")))
    return runs.groupBy(pid).agg(best.alias("_b")).select(pid, "_b.*")


def state_runs(
    df: DataFrame, state: str | Sequence[str], pid=PID, ts=TS, measures=None, slice_days=1.0, time_is_us=False
) -> DataFrame:
    """Run-length form of a state sequence (SES-11): ``pid, state, start_us, end_us, n``."""
    keys = [pid] if isinstance(pid, str) else list(pid)
    states = [state] if isinstance(state, str) else list(state)

    def differs(prev, cur):
        out = F.lit(False)
        for s in states:
            out = out | ~prev[s].eqNullSafe(cur[s])
        return out

    out = merge_runs(
        df.withColumn("_us", F.col(ts) if time_is_us else us(ts)), keys, "_us", differs,
        time_slice("_us", slice_days), constant=states, measures=measures,
    )
    return out.withColumnRenamed("start", "start_us").withColumnRenamed("end", "end_us")


def speak_silence(df: DataFrame, value: str, threshold: float, pid=PID, ts=TS, **kw) -> DataFrame:
    """Lengths of speaking and silent runs of a thresholded minute series (SES-12)."""
    flagged = df.withColumn("speaking", (F.col(value) > threshold))
    runs = state_runs(flagged, "speaking", pid, ts, **kw)
    keys = [pid] if isinstance(pid, str) else list(pid)
    return runs.groupBy(*keys, "speaking").agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum("n").alias("minutes"),
        F.avg("n").alias("mean_run"),
        F.stddev_pop("n").alias("std_run"),
        F.max("n").alias("longest_run"),
    )


def cycle_starts(df: DataFrame, on: str, pid=PID, ts=TS, min_off: int = 3, slice_days=1.0) -> DataFrame:
    """First "on" step after at least ``min_off`` steps off, and cycle lengths (SES-13).

    Length is counted in steps to the next start of the participant, null for
    the last one.
    """
    keys = [pid]
    stepped = positions(df.withColumn("_us", us(ts)), keys, ["_us"], time_slice("_us", slice_days), "step")
    on_rows = stepped.filter(F.col(on))
    linked = with_neighbour(on_rows, keys, ["_us"], {"_prev_step": F.col("step")}, time_slice("_us", slice_days))
    starts = linked.filter(F.col("step") - F.coalesce(F.col("_prev_step"), F.lit(0)) > min_off)
    nexts = with_neighbour(starts, keys, ["_us"], {"_next": F.col("step")}, time_slice("_us", slice_days), forward=True)
    return nexts.select(
        pid, F.col("_us").alias("start_us"), "step", (F.col("_next") - F.col("step")).alias("cycle_steps")
    )


def inter_session(
    df: DataFrame, seconds: str, pid=PID, ts=TS, max_gap_seconds=4 * 3600, by: Sequence[Column | str] = (), slice_days=1.0
) -> DataFrame:
    """Mean pause between the end of a session and the next start (SES-14)."""
    linked = with_neighbour(
        df.withColumn("_us", us(ts)), [pid], ["_us"], {"_next": F.col("_us")}, time_slice("_us", slice_days), forward=True
    )
    pause = (F.col("_next") - F.col("_us")) / F.lit(float(SECOND)) - F.col(seconds)
    kept = linked.withColumn("pause", pause).filter(F.col("pause") <= max_gap_seconds)
    return kept.groupBy(pid, *by).agg(F.count(F.lit(1)).alias("pauses"), F.avg("pause").alias("mean_pause"))
