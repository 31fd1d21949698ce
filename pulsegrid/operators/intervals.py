"""Joins of points and intervals by time (JN-*).

A range predicate alone would compare every point of a participant with every
interval.  Both sides get a time bucket: points one, intervals all they cover,
so the join is an equi join on ``(participant, bucket)`` with the range left as
a residual condition.  A busy participant is spread over its buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.time import DAY, HOUR, SECOND, col, day_number, floor_div, us
from .ordered import salted_join, with_neighbour
from .sessions import PID, TS, time_slice


def _opened(ivals: DataFrame, start: str, end: str, size: int) -> DataFrame:
    covered = F.sequence(floor_div(start, size), floor_div(end, size))
    return ivals.filter(F.col(start) <= F.col(end)).withColumn("_bucket", F.explode(covered))


def points_in_intervals(
    points: DataFrame, ivals: DataFrame, pid=PID, ts: str | Column = TS, start="start_us", end="end_us",
    closed: str = "both", bucket_seconds: int = 3600, how: str = "inner",
) -> DataFrame:
    """Points with the intervals that hold them (JN-1).

    ``ivals`` has microsecond bounds.  Choose ``bucket_seconds`` near the
    typical interval length: shorter repeats intervals, longer compares more.
    """
    size = bucket_seconds * SECOND
    left = points.withColumn("_us", us(ts)).withColumn("_bucket", floor_div("_us", size)).alias("p")
    right = _opened(ivals, start, end, size).alias("i")
    low, high = F.col(f"i.{start}"), F.col(f"i.{end}")
    u = F.col("p._us")
    inside = {
        "both": (u >= low) & (u <= high),
        "left": (u >= low) & (u < high),
        "right": (u > low) & (u <= high),
        "neither": (u > low) & (u < high),
    }[closed]
    cond = (F.col(f"p.{pid}") == F.col(f"i.{pid}")) & (F.col("p._bucket") == F.col("i._bucket")) & inside
    joined = left.join(right, cond, how)
    if how in ("left_semi", "left_anti"):
        return joined.drop("_us", "_bucket")
    kept = [F.col(f"p.{c}") for c in points.columns]
    return joined.select(*kept, *[F.col(f"i.{c}") for c in ivals.columns if c != pid])


def around_intervals(
    points: DataFrame, ivals: DataFrame, before_seconds: int, after_seconds: int, pid=PID, ts=TS,
    start="start_us", end="end_us", bucket_seconds: int = 3600,
) -> DataFrame:
    """Points up to so long before and after intervals, with a ``side`` column (JN-2, JN-4)."""
    sides = ivals.withColumn(
        "_w",
        F.explode(
            F.array(
                F.struct(F.lit("before").alias("side"), (F.col(start) - before_seconds * SECOND).alias("lo"), F.col(start).alias("hi")),
                F.struct(F.lit("after").alias("side"), F.col(end).alias("lo"), (F.col(end) + after_seconds * SECOND).alias("hi")),
            )
        ),
    ).select("*", "_w.side", F.col("_w.lo").alias("_lo"), F.col("_w.hi").alias("_hi")).drop("_w")
    out = points_in_intervals(points, sides, pid, ts, "_lo", "_hi", "both", bucket_seconds)
    return out.drop("_lo", "_hi")


def band_join(a: DataFrame, b: DataFrame, half_seconds: float, pid=PID, a_ts=TS, b_ts=TS, prefix="b_") -> DataFrame:
    """Rows of ``a`` with rows of ``b`` at most half a band away, both ends closed (JN-3)."""
    half = int(half_seconds * SECOND)
    renamed = b.select(F.col(pid), *[F.col(c).alias(prefix + c) for c in b.columns if c != pid])
    centre = us(prefix + b_ts)
    bands = renamed.withColumn("_lo", centre - half).withColumn("_hi", centre + half)
    size = max(1, int(2 * half_seconds))
    return points_in_intervals(a, bands, pid, a_ts, "_lo", "_hi", "both", size).drop("_lo", "_hi")


def interval_proximity(
    sleep: DataFrame, work: DataFrame, near_hours: float = 8, far_hours: float = 16, pid=PID
) -> DataFrame:
    """Flags whether work starts soon after a sleep or ended soon before it (JN-5).

    Both tables are ``pid, start_us, end_us``.  Only the next work start after
    the sleep and the last work end before it can decide, so each is found by
    one ordered pass over the union instead of a pair join.
    """
    nothing = F.lit(None).cast("bigint")

    def marks(df, name, own):
        kept = [F.col(c) if own else nothing for c in ("start_us", "end_us")]
        cells = [
            F.struct(F.col(f"{side}_us").alias("t"), F.lit(rank).alias("_o"), F.lit(f"{name}_{side}").alias("k"),
                     kept[0].alias("start_us"), kept[1].alias("end_us"))
            for rank, side in enumerate(("start", "end"))
        ]
        return df.select(pid, F.explode(F.array(*cells)).alias("m")).select(pid, "m.*")

    # starts sort before ends at equal times, so only strictly later work
    # starts lie ahead of a sleep end and strictly earlier work ends behind a start
    union = marks(sleep, "sleep", True).unionByName(marks(work, "work", False))
    from .ordered import running

    walked = running(
        union, [pid], ["t", "_o", "k", "start_us"], {"last_work": ("max", F.when(F.col("k") == "work_end", F.col("t")))}, time_slice("t", 7),
        ahead={"next_work": ("min", F.when(F.col("k") == "work_start", F.col("t")))},
    ).filter(F.col("k").startswith("sleep"))
    both = walked.groupBy(pid, "start_us", "end_us").agg(
        F.max(F.when(F.col("k") == "sleep_end", F.col("next_work"))).alias("next_work"),
        F.max(F.when(F.col("k") == "sleep_start", F.col("last_work"))).alias("last_work"),
    )
    ahead, since = F.col("next_work") - F.col("end_us"), F.col("start_us") - F.col("last_work")

    def flag(gap, hours):
        return F.coalesce((gap > 0) & (gap < int(hours * HOUR)), F.lit(False)).cast("int")

    return both.select(
        pid, "start_us", "end_us",
        flag(ahead, near_hours).alias("before_work_nearest"),
        flag(ahead, far_hours).alias("before_work"),
        flag(since, near_hours).alias("after_work"),
    )


def intervals_without_points(
    ivals: DataFrame, points: DataFrame, pid=PID, ts: str | Column = TS, start="start_us", end="end_us", bucket_seconds=3600
) -> DataFrame:
    """Intervals that hold no point (JN-6)."""
    hit = points_in_intervals(points, ivals, pid, ts, start, end, "both", bucket_seconds).select(pid, start, end).distinct()
    return ivals.join(hit, [pid, start, end], "left_anti")


def intervals_starting_in(
    segs: DataFrame, recs: DataFrame, pid=PID, rec_start="rec_start_us", rec_end="rec_end_us", bucket_seconds=3600
) -> DataFrame:
    """Segments joined to the recording their start lies in (JN-7)."""
    at = segs.withColumn("_ts", F.timestamp_micros("start_us"))
    return points_in_intervals(at, recs, pid, "_ts", rec_start, rec_end, "both", bucket_seconds).drop("_ts")


def nearest_within(a: DataFrame, b: DataFrame, seconds: float, pid=PID, a_time="start_us", b_time="start_us", prefix="b_") -> DataFrame:
    """Each row of ``a`` with its nearest row of ``b`` within the tolerance (JN-8).

    The nearest row is the last one before or the first one after, so one
    ordered pass over the union finds it.  Equal distances take the earlier.
    """
    tolerance = int(seconds * SECOND)
    payload = F.struct(*[F.col(c).alias(prefix + c) for c in b.columns if c != pid])
    left = a.select(pid, F.col(a_time).alias("_t"), F.lit(1).alias("_k"), F.struct(*[F.col(c) for c in a.columns]).alias("_a"))
    right = b.select(pid, F.col(b_time).alias("_t"), F.lit(0).alias("_k"), payload.alias("_b"))
    both = left.unionByName(right, allowMissingColumns=True)
    from .ordered import running

    hit = F.when(F.col("_k") == 0, F.struct(F.col("_t").alias("t"), F.col("_b").alias("b")))
    placed = running(both, [pid], ["_t", "_k"], {"_before": ("max", hit)}, time_slice("_t", 1), ahead={"_after": ("min", hit)})
    near = placed.filter("_k = 1")
    gap_b, gap_a = F.col("_t") - F.col("_before.t"), F.col("_after.t") - F.col("_t")
    use_before = gap_b.isNotNull() & (gap_a.isNull() | (gap_b <= gap_a))
    chosen = F.when(use_before, F.col("_before")).otherwise(F.col("_after"))
    near = near.withColumn("_c", chosen).filter(F.abs(F.col("_c.t") - F.col("_t")) <= tolerance)
    return near.select("_a.*", "_c.b.*")


def align(base: DataFrame, *others: DataFrame, on: Sequence[str] = (PID, "t_us")) -> DataFrame:
    """Left joins on participant and grid point (JN-9)."""
    for other in others:
        base = base.join(other, list(on), "left")
    return base


def attach_attributes(df: DataFrame, dim: DataFrame, pid=PID, how: str = "left") -> DataFrame:
    """Bring participant attributes to rows (JN-10); hot participants are salted."""
    return salted_join(df, dim, [pid], how)


def full_merge(*dims: DataFrame, on: Sequence[str] = (PID,)) -> DataFrame:
    """Full outer merge of attribute or daily tables (JN-11, JN-12)."""
    out = dims[0]
    for d in dims[1:]:
        out = out.join(d, list(on), "full")
    return out


def on_days(df: DataFrame, days: DataFrame, on: Sequence[str] = (PID, "day"), member: bool = True) -> DataFrame:
    """Rows whose key is (not) on a list (JN-13)."""
    return df.join(days.select(*on).distinct(), list(on), "left_semi" if member else "left_anti")


def match_places(events: DataFrame, places: DataFrame, digits: int = 3, exclude: Sequence[str] = (), name: str = "place") -> DataFrame:
    """Events at known coordinates, equal after rounding (JN-14)."""
    keyed = places.filter(~F.col(name).isin(list(exclude))) if exclude else places
    keyed = keyed.select(name, F.round("lat", digits).alias("_lat"), F.round("lon", digits).alias("_lon"))
    rounded = events.withColumn("_lat", F.round("lat", digits)).withColumn("_lon", F.round("lon", digits))
    return salted_join(rounded, keyed, ["_lat", "_lon"]).drop("_lat", "_lon")


def work_windows(days: DataFrame, shift: str = "day", hours: int = 24, pid=PID, day="day") -> DataFrame:
    """Working windows from work days (JN-17).

    Day shifts start at 07:00; night shifts at 19:00, and only when the next
    date is a work date too.
    """
    unique = days.select(pid, day, shift).distinct() if shift in days.columns else days.select(pid, day).distinct()
    kind = F.col(shift) if shift in days.columns else F.lit(shift)
    w = Window.partitionBy(pid).orderBy(day)
    marked = unique.withColumn("_next", F.lead(day).over(w)).withColumn("_kind", kind)
    kept = marked.filter((F.col("_kind") == "day") | (F.col("_next") == F.col(day) + 1))
    start = F.col(day) * DAY + F.when(F.col("_kind") == "day", 7 * HOUR).otherwise(19 * HOUR)
    return kept.select(pid, start.alias("start_us"), (start + hours * HOUR).alias("end_us"))


def fill_by_profile(df: DataFrame, profile: DataFrame, by: Sequence[str], value: str, filled: str = "profile") -> DataFrame:
    """Take missing values from a profile keyed by ``by`` (JN-16).

    ``profile`` is one row per key with the fill in column ``filled``.
    """
    out = salted_join(df, profile.select(*by, filled), by, "left")
    return out.withColumn(value, F.coalesce(F.col(value), F.col(filled))).drop(filled)


def pair_lags(
    events: DataFrame, types: Sequence[str], kind: str, time_us: str, period: Sequence[str], min_lag_steps: int = 2, slice_days=0.25, origin: Column | None = None,
) -> DataFrame:
    """Lags between earlier and later events of a period by type pair (JN-15).

    All earlier events but the immediate predecessors (``min_lag_steps``)
    count.  Lags are sums over the earlier events of each type, so running
    counts, sums and squares per type give count, mean and deviation exactly
    without forming the pairs.  ``n``, ``lag_us`` and ``lag2`` (seconds
    squared) are sums over the pairs an event closes.  ``origin`` is a time
    near the start of the period, if one follows from its key.
    """
    from .ordered import running

    skip = min_lag_steps - 1
    base = events.select(*period, F.col(kind).alias("_to"), F.col(time_us).alias("_t"))
    # times relative to the period's start keep sums exact and squares small
    if origin is None:
        start = base.groupBy(*period).agg(F.min("_t").alias("_t0"))
        base = salted_join(base, start, period).withColumn("_s", F.col("_t") - F.col("_t0"))
    else:
        base = base.withColumn("_s", F.col("_t") - origin)

    def square(c):
        sec = F.col(c) / F.lit(float(SECOND))
        return sec * sec

    if skip:
        for i in range(skip):
            base = with_neighbour(base, period, ["_t"], {f"_k{i}": F.col("_to") if i == 0 else F.col(f"_k{i-1}"),
                                                        f"_s{i}": F.col("_s") if i == 0 else F.col(f"_s{i-1}")}, time_slice("_t", slice_days))
    ops = {}
    for j, a in enumerate(types):
        mine = F.col("_to") == a
        ops[f"n{j}"] = ("sum", F.when(mine, 1).otherwise(0).cast("bigint"))
        ops[f"a{j}"] = ("sum", F.when(mine, F.col("_s")).otherwise(0))
        ops[f"q{j}"] = ("sum", F.when(mine, square("_s")).otherwise(0.0))
    run = running(base, period, ["_t"], ops, time_slice("_t", slice_days), include_current=False)
    cells = []
    for j, a in enumerate(types):
        n, s, q = (F.coalesce(F.col(f"{x}{j}"), F.lit(0)) for x in "naq")
        for i in range(skip):  # take the skipped predecessors out again
            same = F.coalesce(F.col(f"_k{i}") == a, F.lit(False))
            n = n - F.when(same, 1).otherwise(0)
            s = s - F.when(same, F.col(f"_s{i}")).otherwise(0)
            q = q - F.when(same, square(f"_s{i}")).otherwise(0.0)
        lag = n * F.col("_s") - s
        cross = 2 * F.col("_s") / F.lit(float(SECOND)) * (s / F.lit(float(SECOND)))
        lag2 = n * square("_s") - cross + q
        cells.append(F.struct(F.lit(a).alias("from_type"), n.alias("n"), lag.alias("lag_us"), lag2.alias("lag2")))
    rows = run.select(*period, F.col("_to").alias("to_type"), F.explode(F.array(*cells)).alias("c")).select(*period, "to_type", "c.*")
    return rows.filter(F.col("n") > 0)


def lag_summary(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean, deviation and count of lags by type pair, with the share per source type (ML-20).

    ``share`` is the part of a source type's pairs that end in the target
    type: how strongly one transition follows another.  ``bandwidth`` is the
    rule-of-thumb width 1.06 * std * n^(-1/5) and ``landmarks`` are mean and
    mean +- std.
    """
    out = pairs.groupBy(*by, "from_type", "to_type").agg(
        F.sum("n").cast("bigint").alias("n"), (F.sum("lag_us") / F.lit(float(SECOND))).alias("_s"), F.sum("lag2").alias("_q")
    )
    mean = F.col("_s") / F.col("n")
    std = F.sqrt(F.greatest(F.col("_q") / F.col("n") - mean * mean, F.lit(0.0)))
    total = F.sum("n").over(Window.partitionBy(*by, "from_type"))
    return out.select(
        *by, "from_type", "to_type", "n", mean.alias("mean_lag"), std.alias("std_lag"),
        (F.col("n") / total).alias("share"), (1.06 * std * F.pow(F.col("n"), -0.2)).alias("bandwidth"),
        F.greatest(mean - std, F.lit(0.0)).alias("landmark_low"), (mean + std).alias("landmark_high"),
    )
