"""Streaming-safe forms of sessions and resampling.

Same columns as the batch operators; state is bounded by the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.time import us


def session_stream(df: DataFrame, gap: str, pid: str = "participant_id", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Sessions by gap (SES-1): rows more than ``gap`` (an interval, "10 minutes") apart are split, as in ``sessions``.

    Rows exactly a gap apart stay together, here too: Spark merges session windows that touch.  Rows may come in any order up to ``late`` behind the latest; a session is given out once the watermark has passed it.
    """
    w = F.session_window(F.col(ts), gap)
    out = df.withWatermark(ts, late).groupBy(pid, w.alias("w")).agg(
        F.min(us(ts)).alias("start_us"), F.max(us(ts)).alias("end_us"), F.count(F.lit(1)).alias("n")
    )
    return out.select(pid, "start_us", "end_us", "n")


def resample_stream(
    df: DataFrame, value: str, off_seconds: int, overlap_seconds: int = 0, min_n: int = 1, centered: bool = False,
    pid: str = "participant_id", ts: str = "ts", late: str = "1 hour",
) -> DataFrame:
    """Mean per tumbling or overlapping bucket (RS-1, RS-2); buckets are half-open in a stream."""
    width, step = f"{off_seconds + overlap_seconds} seconds", f"{off_seconds} seconds"
    shift = off_seconds // 2 if centered else 0
    start = f"{-shift % off_seconds} seconds" if centered else None
    w = F.window(F.col(ts), width, step, start) if start else F.window(F.col(ts), width, step)
    out = df.withWatermark(ts, late).groupBy(pid, w.alias("w")).agg(F.count(value).alias("n"), F.avg(value).alias("_m"))
    label = us("w.start") + shift * 1_000_000
    return out.select(pid, label.alias("t_us"), "n", F.when(F.col("n") > min_n, F.col("_m")).alias(value))
