"""Summaries of readings, segments, days, participants and cohorts (AG-*)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.signal import hr_zone
from ..functions.time import DAY, HOUR, MINUTE, SECOND, clock_hour, day_number, floor_div, from_us, minute_of_day, relative_hour, us
from .grid import grid
from .intervals import around_intervals, interval_proximity, points_in_intervals
from .ordered import Measures, merge_runs, quantiles, running, salted_join, with_neighbour
from .sessions import PID, TS, inter_session, sessions, time_slice


def nan_stats(df: DataFrame, by: Sequence[str], cols: Sequence[str], median: bool = True) -> DataFrame:
    """Null-aware mean, population std and variance, min, max, sum, range and median (AG-1)."""
    aggs = []
    for c in cols:
        aggs += [
            F.count(c).alias(f"{c}_n"), F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"),
            F.var_pop(c).alias(f"{c}_var"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"),
            F.sum(c).alias(f"{c}_sum"), (F.max(c) - F.min(c)).alias(f"{c}_range"),
        ]
    out = df.groupBy(*by).agg(*aggs)
    if median:
        for c in cols:
            out = out.join(quantiles(df, by, c, {f"{c}_median": 0.5}), list(by), "left")
    return out


def segment_gaussian(points: DataFrame, segs: DataFrame, cols: Sequence[str], pid=PID, ts=TS, bucket_seconds=3600) -> DataFrame:
    """Mean and sample variance of every column per segment (AG-2)."""
    inside = points_in_intervals(points, segs.select(pid, "start_us", "end_us"), pid, ts, bucket_seconds=bucket_seconds)
    return inside.groupBy(pid, "start_us", "end_us").agg(
        F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{c}_{n}") for c in cols for n, f in (("mean", F.avg), ("var", F.var_samp))]
    )


def segment_cov(points: DataFrame, segs: DataFrame, x: str, y: str, pid=PID, ts=TS, bucket_seconds=3600) -> DataFrame:
    """Means, 2x2 covariance and length of two columns per segment (AG-3)."""
    inside = points_in_intervals(points, segs.select(pid, "start_us", "end_us"), pid, ts, bucket_seconds=bucket_seconds)
    return inside.groupBy(pid, "start_us", "end_us").agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"), F.var_samp(x).alias("var_x"),
        F.covar_samp(x, y).alias("cov_xy"), F.var_samp(y).alias("var_y"),
    )


def location_ratio(loc: DataFrame, segs: DataFrame, location: str, places: Sequence[str], pid=PID, ts=TS, bucket_seconds=3600) -> DataFrame:
    """Share of each place inside a segment (AG-5); ``places`` are fixed columns."""
    inside = points_in_intervals(loc.select(pid, ts, location), segs.select(pid, "start_us", "end_us"), pid, ts, bucket_seconds=bucket_seconds)
    return inside.groupBy(pid, "start_us", "end_us").agg(
        *[F.avg((F.col(location) == p).cast("double")).alias(f"{p}_ratio") for p in places]
    )


def segment_features(
    points: DataFrame, loc: DataFrame, segs: DataFrame, recs: DataFrame, cols: Sequence[str], location: str,
    places: Sequence[str], pid=PID, ts=TS, bucket_seconds=3600,
) -> DataFrame:
    """One row per segment: reading statistics, minutes by place, hours, recording norms (AG-4).

    ``recs`` has ``rec_start_us, rec_end_us``; a segment belongs to the
    recording its start lies in, and the recording's mean and deviation are
    added as ``norm_*``.
    """
    from .intervals import intervals_starting_in

    placed = intervals_starting_in(segs.select(pid, "start_us", "end_us"), recs.select(pid, "rec_start_us", "rec_end_us"), pid, bucket_seconds=bucket_seconds)
    inside = points_in_intervals(points.select(pid, ts, *cols), placed, pid, ts, bucket_seconds=bucket_seconds)
    aggs = [
        f(c).alias(f"{c}_{n}")
        for c in cols
        for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("max", F.max), ("min", F.min))
    ] + [(F.max(c) - F.min(c)).alias(f"{c}_range") for c in cols]
    key = [pid, "start_us", "end_us", "rec_start_us"]
    feats = inside.groupBy(*key).agg(*aggs)
    where = points_in_intervals(loc.select(pid, ts, location), placed, pid, ts, bucket_seconds=bucket_seconds)
    minutes = where.groupBy(*key).agg(*[F.count_if(F.col(location) == p).alias(f"{p}_minutes") for p in places])
    recs2 = recs.select(pid, "rec_start_us", "rec_end_us")
    norms = points_in_intervals(points.select(pid, ts, *cols), recs2, pid, ts, "rec_start_us", "rec_end_us", bucket_seconds=bucket_seconds)
    norms = norms.groupBy(pid, "rec_start_us").agg(
        *[f(c).alias(f"norm_{c}_{n}") for c in cols for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    )
    out = feats.join(minutes, key, "left").join(norms, [pid, "rec_start_us"], "left")
    out = out.na.fill(0, [f"{p}_minutes" for p in places])
    start, end, rec = from_us("start_us"), from_us("end_us"), from_us("rec_start_us")
    return out.withColumns({
        "duration_minutes": (F.col("end_us") - F.col("start_us")) / F.lit(float(MINUTE)) + 1,
        "start_hour": clock_hour(start), "end_hour": clock_hour(end), "relative_start_hour": relative_hour(start, rec),
    })


def workday_flags(sources: dict[str, DataFrame], calendar: DataFrame, pid=PID, day="day") -> DataFrame:
    """Participant-day rows with a work flag from any source (AG-6).

    Each source is ``pid, day``; days are reduced per source before the union.
    ``calendar`` lists the days reported for every participant seen.
    """
    marks = None
    for df in sources.values():
        one = df.select(pid, day).distinct()
        marks = one if marks is None else marks.unionByName(one)
    marks = marks.distinct().withColumn("work", F.lit(1))
    # participants x study days: the calendar's size is fixed by the study
    first_last = calendar.agg(F.array_sort(F.collect_set(day)).alias("_days")).withColumn("_one", F.lit(1))
    people = marks.select(pid).distinct().withColumn("_one", F.lit(1))
    full = people.join(F.broadcast(first_last), "_one").select(pid, F.explode("_days").alias(day))
    return full.join(marks, [pid, day], "left").withColumn("work", F.coalesce("work", F.lit(0)))


def shift_table(sources: Sequence[tuple[str, DataFrame]], sleep: DataFrame | None = None, pid=PID) -> DataFrame:
    """One shift per participant and date with its source; later sources win (AG-7).

    Sources are ``(name, pid, shift_start_us, shift_end_us, seen_us)`` in rising
    priority; candidates that hold a sleep start are dropped, and within a
    source the last observation wins.
    """
    from .intervals import intervals_without_points

    union = None
    for rank, (name, df) in enumerate(sources):
        one = df.select(pid, "shift_start_us", "shift_end_us", "seen_us", F.lit(name).alias("source"), F.lit(rank).alias("_rank"))
        one = one.filter(F.col("shift_start_us").isNotNull())
        union = one if union is None else union.unionByName(one)
    if sleep is not None:
        at = sleep.select(pid, F.timestamp_micros("start_us").alias("_ts"))
        union = intervals_without_points(union, at, pid, "_ts", "shift_start_us", "shift_end_us", 12 * 3600)
    day = floor_div("shift_start_us", DAY)
    best = F.max(F.struct("_rank", "seen_us", "shift_start_us", "shift_end_us", "source"))
    return union.groupBy(pid, day.alias("day")).agg(best.alias("b")).select(
        pid, "day", "b.shift_start_us", "b.shift_end_us", "b.source", "b.seen_us"
    )


def compliance(
    stream: DataFrame, days: DataFrame, gap_seconds=8 * 3600, min_rows=1, max_rows=900, pid=PID, ts=TS
) -> DataFrame:
    """Recordings per work day, work days and mean recording hours (AG-8)."""
    rec = sessions(stream, gap_seconds, pid, ts)
    rec = rec.filter((F.col("n") - 1 >= min_rows) & (F.col("n") - 1 < max_rows))
    per = rec.groupBy(pid).agg(
        F.count(F.lit(1)).alias("recordings"), F.avg((F.col("end_us") - F.col("start_us")) / F.lit(float(HOUR))).alias("mean_hours")
    )
    worked = days.select(pid, "day").distinct().groupBy(pid).agg(F.count(F.lit(1)).alias("work_days"))
    return per.join(worked, pid, "left").withColumn("ratio", F.try_divide("recordings", "work_days"))


def day_compliance(stream: DataFrame, value: str, study_days: int = 70, pid=PID, ts=TS) -> DataFrame:
    """Days with any reading over the study length, at most 1 (AG-8)."""
    days = stream.filter(F.col(value).isNotNull()).groupBy(pid, day_number(ts).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return days.groupBy(pid).agg(
        F.count(F.lit(1)).alias("days"), F.least(F.lit(1.0), F.count(F.lit(1)) / F.lit(float(study_days))).alias("ratio"),
        F.avg(F.col("n") / 60.0).alias("mean_hours"),
    )


def sleep_slots(summary: DataFrame, slots: Sequence[tuple[str, str]], pid=PID, efficiency: Sequence[str | None] | None = None) -> DataFrame:
    """Wide daily sleep slots to rows; a repeated begin keeps the later end."""
    eff = efficiency or [None] * len(slots)
    cells = F.array(*[
        F.struct(us(b).alias("start_us"), us(e).alias("end_us"), (F.col(x) if x else F.lit(None).cast("double")).alias("efficiency"))
        for (b, e), x in zip(slots, eff)
    ])
    rows = summary.select(pid, F.explode(cells).alias("s")).select(pid, "s.*").dropna(subset=["start_us", "end_us"])
    best = F.max(F.struct("end_us", "efficiency"))
    return rows.groupBy(pid, "start_us").agg(best.alias("b")).select(pid, "start_us", "b.end_us", "b.efficiency")


def sleep_summary(
    sleep: DataFrame, minutes: DataFrame, work: DataFrame, hr="heart_rate", steps="step_count", pid=PID, ts=TS, min_rows=360
) -> DataFrame:
    """Sleep rows with activity 12 h before and after and work proximity (AG-9)."""
    near = around_intervals(minutes.select(pid, ts, hr, steps), sleep.select(pid, "start_us", "end_us"), 43200, 43200, pid, ts, bucket_seconds=6 * 3600)
    key = [pid, "start_us", "end_us", "side"]
    w = Window.partitionBy(*key)  # twelve hours of one participant
    near = near.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("max_hr", F.max(hr).over(w)).filter(F.col("_n") > min_rows)
    zoned = near.withColumn("_z", hr_zone(hr, "max_hr"))
    sides = zoned.groupBy(*key).agg(
        F.sum(steps).alias("steps"), F.max("max_hr").alias("max_hr"), F.max(steps).alias("max_steps"),
        *[(F.count_if(F.col("_z") == z) / F.count(F.lit(1))).alias(z) for z in ("peak", "cardio", "fat_burn", "out_of_range")],
    )
    metrics = ["steps", "max_hr", "max_steps", "peak", "cardio", "fat_burn", "out_of_range"]
    wide = sides.groupBy(pid, "start_us", "end_us").agg(
        *[F.max(F.when(F.col("side") == s, F.col(m))).alias(f"{m}_{s}") for s in ("before", "after") for m in metrics]
    )
    inside = points_in_intervals(minutes.select(pid, ts, steps), sleep.select(pid, "start_us", "end_us"), pid, ts, bucket_seconds=6 * 3600)
    moving = inside.groupBy(pid, "start_us", "end_us").agg(F.count_if(F.col(steps) > 0).alias("minutes_with_steps"))
    flags = interval_proximity(sleep, work, pid=pid)
    out = flags.join(wide, [pid, "start_us", "end_us"], "left").join(moving, [pid, "start_us", "end_us"], "left")
    return out.withColumn("hours", (F.col("end_us") - F.col("start_us")) / F.lit(float(HOUR))).na.fill(0, ["minutes_with_steps"])


def awake_table(
    periods: DataFrame, minutes: DataFrame, value_cols: Sequence[str], proximity: DataFrame | None = None,
    garment: DataFrame | None = None, survey: DataFrame | None = None, pid=PID, ts=TS, min_valid=180,
    min_proximity=5, min_garment=1800, bucket_seconds=6 * 3600,
) -> DataFrame:
    """Awake periods with reading statistics and a work flag from three sources (AG-10)."""
    key = [pid, "start_us", "end_us"]
    inside = points_in_intervals(minutes.select(pid, ts, *value_cols), periods.select(*key), pid, ts, bucket_seconds=bucket_seconds)
    all_valid = F.lit(True)
    for c in value_cols:
        all_valid = all_valid & (F.col(c) >= 0)
    first = value_cols[-1]
    aggs = [F.count_if(F.col(first) >= 0).alias("valid_length")]
    for c in value_cols:
        ok = F.when(all_valid, F.col(c))
        aggs += [F.avg(ok).alias(f"{c}_mean"), F.stddev_pop(ok).alias(f"{c}_std")]
    out = periods.join(inside.groupBy(*key).agg(*aggs).filter(F.col("valid_length") > min_valid), key)
    work = F.lit(False)
    for name, df, limit in (("_p", proximity, min_proximity), ("_g", garment, min_garment), ("_s", survey, 0)):
        if df is None:
            continue
        hits = points_in_intervals(df.select(pid, ts), periods.select(*key), pid, ts, bucket_seconds=bucket_seconds)
        out = out.join(hits.groupBy(*key).agg(F.count(F.lit(1)).alias(name)), key, "left")
        work = work | (F.coalesce(F.col(name), F.lit(0)) > limit)
    return out.withColumn("work", work.cast("int")).drop("_p", "_g", "_s")


def duration_stats(seconds: str) -> list[Column]:
    s = F.col(seconds)
    return [
        F.count(F.lit(1)).alias("frequency"), F.sum(s).alias("total_time"), F.avg(s).alias("mean_time"),
        F.count_if(s <= 60).alias("less_than_1min"), F.count_if((s > 60) & (s <= 300)).alias("1min_5min"),
        F.count_if(s > 60).alias("above_1min"), F.count_if(s >= 300).alias("above_5min"),
    ]


def daily_phone(sessions_df: DataFrame, seconds: str, days: DataFrame | None = None, pid=PID, ts=TS, max_gap_seconds=4 * 3600) -> DataFrame:
    """Per day: counts and times of phone use, mean pause, work flag (AG-11).

    Pauses are between sessions of the same day.
    """
    rows = sessions_df.withColumn("day", day_number(ts)).withColumn("_us", us(ts))
    linked = with_neighbour(rows, [pid, "day"], ["_us"], {"_next": F.col("_us")}, time_slice("_us", 0.25), forward=True)
    pause = (F.col("_next") - F.col("_us")) / F.lit(float(SECOND)) - F.floor(F.col(seconds))
    out = linked.groupBy(pid, "day").agg(
        *duration_stats(seconds), F.avg(F.when(pause <= max_gap_seconds, pause)).alias("mean_inter")
    )
    if days is None:
        return out
    marks = days.select(pid, "day").distinct().withColumn("work", F.lit(1))
    return out.join(marks, [pid, "day"], "left").withColumn("work", F.coalesce("work", F.lit(0)))


def daily_features(phone: DataFrame, wrist: DataFrame, summary: DataFrame, value_cols: Sequence[str], pid=PID, ts=TS, min_valid=720) -> DataFrame:
    """Daily phone rows joined with the day's readings and its summary (AG-12)."""
    daily = wrist.groupBy(pid, day_number(ts).alias("day")).agg(
        F.count(value_cols[0]).alias("valid"), *[f(c).alias(f"{c}_{n}") for c in value_cols for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("sum", F.sum))]
    ).filter(F.col("valid") >= min_valid)
    return phone.join(daily, [pid, "day"]).join(summary, [pid, "day"], "left")


def profile(daily: DataFrame, metrics: Sequence[str], by: Sequence[str] = (PID,), work: str | None = "work") -> DataFrame:
    """Mean and deviation of daily metrics overall, on work days and on off days (AG-13)."""
    aggs = []
    for m in metrics:
        for tag, cond in (("", None),) + ((("work_", 1), ("off_", 0)) if work else ()):
            c = F.col(m) if cond is None else F.when(F.col(work) == cond, F.col(m))
            aggs += [F.avg(c).alias(f"{tag}{m}_mean"), F.stddev_pop(c).alias(f"{tag}{m}_std")]
    return daily.groupBy(*by).agg(*aggs)


def phone_around_sleep(sessions_df: DataFrame, sleep: DataFrame, seconds: str, pid=PID, ts=TS, min_hours=4, margin_seconds=1800) -> DataFrame:
    """Phone use during each long sleep and shortly before and after (AG-14)."""
    long_sleep = sleep.filter(F.col("end_us") - F.col("start_us") >= int(min_hours * HOUR)).select(pid, "start_us", "end_us")
    src = sessions_df.select(pid, ts, seconds)
    during = points_in_intervals(src, long_sleep, pid, ts, bucket_seconds=6 * 3600).withColumn("side", F.lit("during"))
    near = around_intervals(src, long_sleep, margin_seconds, margin_seconds, pid, ts, bucket_seconds=3600)
    s = F.col(seconds)
    stats = during.unionByName(near.select(*during.columns)).groupBy(pid, "start_us", "end_us", "side").agg(
        F.count(F.lit(1)).alias("frequency"), F.sum(s).alias("total_time"), F.avg(s).alias("mean_time"),
        F.avg((s <= 60).cast("double")).alias("less_than_1min"), F.avg((s > 60).cast("double")).alias("above_1min"),
    )
    full = long_sleep.withColumn("side", F.explode(F.array(F.lit("before"), F.lit("during"), F.lit("after"))))
    return full.join(stats, [pid, "start_us", "end_us", "side"], "left").na.fill(0, ["frequency", "total_time"])


def metrics_by_run_day(
    sessions_df: DataFrame, sleep: DataFrame, runs: DataFrame, seconds: str, start_hour: int = 7, pid=PID, ts=TS, max_gap_seconds=4 * 3600
) -> DataFrame:
    """Phone and sleep per position in a work run: the day before, each day, the day after (AG-15).

    A position runs 24 h from ``start_hour``; positions with fewer than four
    phone sessions have no mean pause, sleep counts when over 2 h in total.
    """
    days = runs.withColumn("position", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("days") + 1)))
    start = (F.col("first_day") + F.col("position") - 1) * DAY + start_hour * HOUR
    days = days.select(pid, "first_day", "days", "position", start.alias("start_us"), (start + DAY).alias("end_us"))
    phone = points_in_intervals(sessions_df.select(pid, ts, seconds), days, pid, ts, closed="left", bucket_seconds=12 * 3600)
    key = [pid, "first_day", "days", "position"]
    # at most a day of one participant's phone sessions per window
    w = Window.partitionBy(*key).orderBy(ts)
    pause = (us(F.lead(ts).over(w)) - us(ts)) / F.lit(float(SECOND)) - F.floor(F.col(seconds))
    use = phone.withColumn("_p", pause).groupBy(*key).agg(
        F.count(F.lit(1)).alias("frequency"), F.sum(seconds).alias("total_time"), F.avg(seconds).alias("mean_time"),
        F.count_if(F.col(seconds) > 60).alias("above_1min"), F.count_if(F.col(seconds) <= 60).alias("less_than_1min"),
        F.when(F.count(F.lit(1)) > 3, F.avg(F.when(F.col("_p") <= max_gap_seconds, F.col("_p")))).alias("mean_inter"),
    )
    at = sleep.select(pid, F.timestamp_micros("start_us").alias(ts), ((F.col("end_us") - F.col("start_us")) / F.lit(float(HOUR))).alias("_h"))
    slept = points_in_intervals(at, days, pid, ts, closed="left", bucket_seconds=12 * 3600).groupBy(*key).agg(F.sum("_h").alias("sleep_hours"))
    slept = slept.filter(F.col("sleep_hours") > 2)
    out = days.drop("start_us", "end_us").join(use, key, "left").join(slept, key, "left")
    return out.na.fill(0, ["frequency", "total_time", "above_1min", "less_than_1min"])


def day_profile(df: DataFrame, value: str, slot: Column | str, by: Sequence[str] = (PID,)) -> DataFrame:
    """Average reading per time-of-day slot within ``by`` (AG-16)."""
    return df.groupBy(*by, (slot if isinstance(slot, Column) else F.col(slot)).alias("slot")).agg(
        F.avg(value).alias("profile"), F.count(value).alias("n")
    )


def weekly_profile(df: DataFrame, value: str, prof: DataFrame, slots: int, max_missing: int, pid=PID, ts=TS, slot: Column | None = None) -> DataFrame:
    """Weekly average per slot, kept when few slots are missing, filled from the overall profile (AG-17)."""
    week = floor_div(day_number(ts), 7).alias("week")
    seen = df.groupBy(pid, week, slot.alias("slot")).agg(F.avg(value).alias("value")).filter(F.col("value").isNotNull())
    full_enough = seen.groupBy(pid, "week").agg(F.count(F.lit(1)).alias("_k")).filter(F.lit(slots) - F.col("_k") < max_missing)
    cells = full_enough.select(pid, "week", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    out = cells.join(seen, [pid, "week", "slot"], "left").join(prof.select(pid, "slot", "profile"), [pid, "slot"], "left")
    return out.select(pid, "week", "slot", F.coalesce("value", "profile").alias("value"))


def tod_pdf(df: DataFrame, state: str, states: Sequence, bins: int, by: Sequence[str] = (PID,), ts=TS, add: int = 1) -> DataFrame:
    """Share of each state per time-of-day bin with add-one smoothing (AG-18).

    Bins without any observation are uniform.
    """
    binned = df.withColumn("bin", floor_div(F.pmod(us(ts), F.lit(DAY)), DAY // bins).cast("int"))
    return pdf_of_counts(binned.groupBy(*by, "bin", state).agg(F.count(F.lit(1)).alias("n")), state, states, bins, by, add)


def pdf_of_counts(counts: DataFrame, state: str, states: Sequence, bins: int, by: Sequence[str], add: int = 1) -> DataFrame:
    """Smoothed distribution per bin from counts, as an array in ``states`` order turned to rows."""
    per_bin = counts.groupBy(*by, "bin").agg(
        F.array(*[F.coalesce(F.sum(F.when(F.col(state) == s, F.col("n"))), F.lit(0)) for s in states]).alias("c")
    )
    full = counts.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    out = full.join(per_bin, [*by, "bin"], "left")
    c = F.coalesce("c", F.array_repeat(F.lit(0).cast("bigint"), len(states)))
    total = F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x) + add * len(states)
    shares = F.transform(c, lambda x: (x + add) / total)
    names = F.array(*[F.lit(s) for s in states])
    rows = out.select(*by, "bin", F.explode(F.arrays_zip(names.alias("s"), shares.alias("p"))).alias("z"))
    return rows.select(*by, "bin", F.col("z.s").alias(state), F.col("z.p").alias("p"))


def location_distribution(pct: DataFrame, value: str, location: str, section: str, by: Sequence[str] = (PID,)) -> DataFrame:
    """Distribution of a value per place and section, and over all sections (AG-19)."""
    rows = pct.filter(F.col(value).isNotNull()).withColumn("_sec", F.explode(F.array(F.col(section).cast("string"), F.lit("global"))))
    rows = rows.drop(section).withColumnRenamed("_sec", section)
    key = [*by, section, location]
    above = F.count_if(F.col(value) > 0)
    n = F.count(F.lit(1))
    stats = rows.groupBy(*key).agg(
        n.alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), (above / n).alias("share_above"),
        ((n - above) / n).alias("share_below"), F.try_divide(above, n - above).alias("ratio"),
    )
    return stats.join(quantiles(rows, key, value, {"q10": 0.1, "q25": 0.25, "q75": 0.75, "q90": 0.9}), key)


def stay_speak_rate(df: DataFrame, value: str, location: str, section: Sequence[str]) -> DataFrame:
    """Share of minutes spent, and of those spoken in, per place and section (AG-20)."""
    per = df.groupBy(*section, location).agg(F.count(F.lit(1)).alias("stay"), F.count(value).alias("speak"))
    total = F.sum("stay").over(Window.partitionBy(*section))
    return per.select(
        *section, location, "stay", "speak", (F.col("stay") / total).alias("stay_rate"), (F.col("speak") / F.col("stay")).alias("speak_rate")
    )


def snippet_features(
    frames: DataFrame, utterances: DataFrame, positive: Sequence[str] = (), above: dict[str, float] | None = None,
    plain: Sequence[str] = (), pid=PID, ts=TS, snippet_seconds=20, frame_rate=100, bucket_seconds=60,
) -> DataFrame:
    """Audio features per utterance with per-column validity (AG-21).

    ``positive`` columns count above zero and at least one such frame of each
    is required; ``above`` maps columns to a floor; ``plain`` count always.
    """
    inside = points_in_intervals(frames, utterances, pid, ts, bucket_seconds=bucket_seconds)
    extra = [c for c in ("segments", "mean_segment") if c in utterances.columns]
    rules = {c: F.col(c) > 0 for c in positive} | {c: F.col(c) > v for c, v in (above or {}).items()} | {c: F.lit(True) for c in plain}
    aggs = [F.count(F.lit(1)).alias("n")]
    for c, ok in rules.items():
        v = F.when(ok, F.col(c))
        q = F.percentile(v, F.array(F.lit(0.1), F.lit(0.9)))  # an utterance is bounded by its length limit
        aggs += [F.count(v).alias(f"_{c}"), F.avg(v).alias(f"{c}_mean"), F.stddev_pop(v).alias(f"{c}_std"), q[0].alias(f"{c}_q10"), q[1].alias(f"{c}_q90")]
    out = inside.groupBy(pid, "start_us", "end_us", *extra).agg(*aggs)
    for c in positive:
        out = out.filter(F.col(f"_{c}") > 0)
    return out.withColumn("foreground_ratio", F.col("n") / F.lit(float(frame_rate * snippet_seconds))).drop(*[f"_{c}" for c in rules])


THRESHOLDS = (0, 1, 2, 3, 5, 6)


def speech_days(minutes: DataFrame, shifts: DataFrame, value: str, pid=PID, ts=TS, min_minutes=360, max_minutes=800,
                speak_above=3.0, min_speak=15, max_silence=180, thresholds=THRESHOLDS, bucket_seconds=6 * 3600) -> DataFrame:
    """Speech statistics of each valid shift (AG-22).

    Silence is the step between two speaking minutes that are not adjacent,
    or the start up to the first speaking minute when below 100; shifts that
    are too short or long, too silent, or hold too long a silence go.
    """
    inside = points_in_intervals(minutes.select(pid, ts, value), shifts.select(pid, "start_us", "end_us"), pid, ts, bucket_seconds=bucket_seconds)
    key = [pid, "start_us", "end_us"]
    w = Window.partitionBy(*key).orderBy(ts)  # one shift of minutes at most
    inside = inside.withColumn("_i", F.row_number().over(w))
    speaks = F.when(F.col(value) > speak_above, F.col("_i"))
    before = F.max(speaks).over(w.rowsBetween(Window.unboundedPreceding, -1))
    step = F.coalesce(F.col("_i") - before, F.when(F.col("_i") <= 100, F.col("_i") - 1))
    inside = inside.withColumn("_gap", F.when(speaks.isNotNull() & ((step > 1) | before.isNull()), step))
    v, n = F.col(value), F.count(F.lit(1))
    out = inside.groupBy(*key).agg(
        n.alias("duration"), F.coalesce(F.max("_gap"), F.lit(0)).alias("longest_silence"),
        F.count_if(v > speak_above).alias("_speak"),
        *[F.count_if(v > t).alias(f"above_{t}s") for t in thresholds],
        *[(F.count_if(v > t) / n).alias(f"above_{t}s_share") for t in thresholds],
    )
    return out.filter(
        (F.col("duration") > min_minutes) & (F.col("duration") < max_minutes) & (F.col("_speak") >= min_speak) & (F.col("longest_silence") <= max_silence)
    ).drop("_speak")


def speech_day_stats(days: DataFrame, pid=PID, min_shifts: int = 5, thresholds=THRESHOLDS) -> DataFrame:
    """Participant means and deviations over valid shifts (AG-22)."""
    out = days.groupBy(pid).agg(
        F.count(F.lit(1)).alias("shifts"),
        *[f(c).alias(f"{c}_{n}") for t in thresholds for c in (f"above_{t}s", f"above_{t}s_share") for n, f in (("mean", F.avg), ("std", F.stddev_pop))],
    )
    return out.filter(F.col("shifts") > min_shifts)


def sleep_by_class(sleep: DataFrame, pid=PID, min_hours: float = 2.0) -> DataFrame:
    """Duration, efficiency and start-time spread by kind of sleep (AG-23).

    Sleeps before work are work-day sleeps, others are off-day sleeps; short
    off-day sleeps are naps.  Needs ``start_us, end_us, before_work,
    after_work, efficiency``.
    """
    hours = (F.col("end_us") - F.col("start_us")) / F.lit(float(HOUR))
    kind = (
        F.when((F.col("before_work") == 1) & (hours >= min_hours), "work")
        .when((F.col("before_work") == 0) & (hours >= min_hours), "off")
        .when(F.col("before_work") == 0, "nap")
    )
    h = F.hour(from_us("start_us"))
    rows = sleep.withColumns({"_h": hours, "kind": kind, "_start": F.when(h >= 12, h - 24).otherwise(h)}).filter("kind is not null")
    return rows.groupBy(pid, "kind").agg(
        F.count(F.lit(1)).alias("n"), F.avg("_h").alias("duration_mean"), F.stddev_pop("_h").alias("duration_std"),
        F.avg("efficiency").alias("efficiency_mean"), F.stddev_pop("efficiency").alias("efficiency_std"), F.stddev_pop("_start").alias("start_std"),
    )


def scores_by_unit(dim: DataFrame, unit: str, unit_type: str, scores: Sequence[str]) -> DataFrame:
    """Mean and deviation of scores per unit and per unit type (AG-24)."""
    level = F.when(F.grouping(unit) == 0, "unit").otherwise("type").alias("level")
    return dim.groupingSets([[unit], [unit_type]], unit, unit_type).agg(
        level, F.count(F.lit(1)).alias("n"), *[f(s).alias(f"{s}_{n}") for s in scores for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    ).select("level", F.coalesce(F.col(unit).cast("string"), F.col(unit_type).cast("string")).alias("name"), "n", *[f"{s}_{n}" for s in scores for n in ("mean", "std")])


def cohort_shares(dim: DataFrame, groups: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Share of participants for which each condition holds (AG-25); unknowns are left out."""
    return dim.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c.cast("double")).alias(n) for n, c in groups.items()])


def mode_of(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Most frequent value per group; ties go to the smallest (AG-26)."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("k"), F.col(value).alias("v")))
    return counts.groupBy(*by).agg(best.alias("b")).select(*by, F.col("b.v").alias(value), (-F.col("b.k")).alias("n"))


def sleep_transitions(sleep: DataFrame, shift: str, pid=PID) -> DataFrame:
    """How a participant changes over to work: a class per sleep before work (AG-27).

    ``sleep`` has ``start_us, end_us, before_work_nearest, after_work``.  Night
    workers are classed by the sleeps of the last 24 h (nap, no_sleep, switch,
    incomplete), day workers by the start times of the last two main sleeps of
    36 h (con, non_con).
    """
    back = 24 if shift == "night" else 36
    anchors = sleep.filter((F.col("before_work_nearest") == 1) & (F.col("after_work") == 0)).select(
        pid, F.col("start_us").alias("anchor_us"), (F.col("start_us") - back * HOUR).alias("lo"), (F.col("start_us") + MINUTE).alias("hi")
    )
    points = sleep.withColumn("_ts", F.timestamp_micros("start_us"))
    seen = points_in_intervals(points, anchors, pid, "_ts", "lo", "hi", bucket_seconds=12 * 3600)
    hours = (F.col("end_us") - F.col("start_us")) / F.lit(float(HOUR))
    if shift == "night":
        pack = F.struct("start_us", "end_us")
        w = seen.groupBy(pid, "anchor_us").agg(F.count(F.lit(1)).alias("k"), F.min(pack).alias("a"), F.max(pack).alias("b"))
        h1, h2 = F.hour(from_us("a.start_us")), F.hour(from_us("b.start_us"))
        gap = (F.col("b.start_us") - F.col("a.end_us")) / F.lit(float(HOUR))
        span = (F.col("b.end_us") - F.col("a.start_us")) / F.lit(float(HOUR))
        evening = (h1 >= 18) | (h1 < 3)
        two = (
            F.when((gap < 2) & evening & (span < 8), "no_sleep").when((gap < 2) & evening, "switch").when(gap < 2, "incomplete")
            .when(h2.between(10, 17) & ((h1 >= 20) | (h1 < 8)), "nap")
        )
        long = (F.col("a.end_us") - F.col("a.start_us")) / F.lit(float(HOUR)) > 8
        one = (
            F.when(h1.between(3, 11) & ~long, "incomplete").when(evening & ~long, "no_sleep").when(evening & long, "switch")
            .when(h1.between(10, 17), "nap")
        )
        kind = F.when(F.col("k") == 2, two).when(F.col("k") == 1, one)
        return w.select(pid, "anchor_us", kind.alias("kind")).filter(F.col("kind").isNotNull())
    main = seen.filter((F.col("after_work") == 0) & (hours > 4))
    h = clock_hour(from_us("start_us"))
    main = main.withColumn("_h", F.when(h > 12, h - 24).otherwise(h))
    last = F.slice(F.sort_array(F.collect_list(F.struct(F.col("start_us"), F.col("_h").alias("h"))), asc=False), 1, 2)  # 36 h of sleeps
    w = main.groupBy(pid, "anchor_us").agg(last.alias("l")).filter(F.size("l") == 2)
    diff = F.abs(F.col("l")[0]["h"] - F.col("l")[1]["h"])
    return w.select(pid, "anchor_us", F.when(diff < 1, "con").otherwise("non_con").alias("kind"))


def class_frequency(df: DataFrame, kinds: Sequence[str], kind="kind", by: Sequence[str] = (PID,)) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.avg((F.col(kind) == k).cast("double")).alias(k) for k in kinds])


def sleep_development(sleep: DataFrame, pid=PID, run_gap_hours=30, same_night_hours=8, min_hours=3.0) -> DataFrame:
    """First, middle and last sleep of work runs and the trend of their length (AG-28).

    A run starts with a sleep before but not after work and goes on while
    sleeps follow each other within ``run_gap_hours``; sleeps that start within
    ``same_night_hours`` count as one.  Participants get the mean triple over
    runs of at least three nights and a class by its slope.
    """
    keys = [pid]
    first_of_run = (F.col("before_work") == 1) & (F.col("after_work") == 0)
    tied = (F.col("before_work") == 1) | (F.col("after_work") == 1)
    rows = sleep.withColumn("_h", (F.col("end_us") - F.col("start_us")) / F.lit(float(HOUR)))
    slice_ = time_slice("start_us", 30)
    rows = with_neighbour(rows, keys, ["start_us"], {"_prev": F.col("start_us"), "_ptied": tied, "_pfirst": first_of_run}, slice_)
    gap = F.coalesce((F.col("start_us") - F.col("_prev")) / F.lit(float(HOUR)), F.lit(1e9))
    joined_first = first_of_run & F.coalesce(F.col("_pfirst"), F.lit(False)) & (gap < same_night_hours)
    opens = ~tied | ~F.coalesce(F.col("_ptied"), F.lit(False)) | (gap >= run_gap_hours) | (first_of_run & ~joined_first)
    rows = running(
        rows.withColumn("_night", opens | (gap >= same_night_hours)), keys, ["start_us"],
        {"_run": ("max", F.when(opens, F.col("start_us"))), "_at": ("max", F.when(F.col("_night"), F.col("start_us")))}, slice_,
    ).filter(tied)
    nights = rows.groupBy(pid, "_run", "_at").agg(F.sum("_h").alias("h"))
    runs = nights.groupBy(pid, "_run").agg(
        F.count(F.lit(1)).alias("k"), F.min("h").alias("_least"), F.sum("h").alias("_sum"),
        F.min_by("h", "_at").alias("first"), F.max_by("h", "_at").alias("last"),
    ).filter((F.col("k") >= 3) & (F.col("_least") > min_hours))
    triple = runs.withColumn("middle", (F.col("_sum") - F.col("first") - F.col("last")) / (F.col("k") - 2))
    out = triple.groupBy(pid).agg(F.count(F.lit(1)).alias("runs"), *[F.avg(c).alias(c) for c in ("first", "middle", "last")])
    slope = (F.col("last") - F.col("first")) / 2  # least squares over 0, 1, 2
    return out.withColumn("slope", slope).withColumn(
        "trend", F.when(slope > 0.1, "increase").when(slope < -0.1, "decrease").otherwise("unchanged")
    )


def room_contrast(df: DataFrame, value: str, room: str, threshold: float, by: Sequence[str] = (PID,)) -> DataFrame:
    """Median, mean and quartiles per room and flags for room pairs that differ (AG-29).

    The pairs are of rooms, a fixed short list, not of rows.
    """
    stats = df.filter(F.col(value).isNotNull()).groupBy(*by, room).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    stats = stats.join(quantiles(df, [*by, room], value, {"q25": 0.25, "median": 0.5, "q75": 0.75}), [*by, room])
    a, b = stats.alias("a"), stats.alias("b")
    same = F.col(f"a.{room}") < F.col(f"b.{room}")
    for k in by:
        same = same & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    pairs = a.join(b, same).select(
        *[F.col(f"a.{k}") for k in by], F.col(f"a.{room}").alias("room_a"), F.col(f"b.{room}").alias("room_b"),
        *[F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in ("n", "mean", "q25", "median", "q75")],
    )
    diff = F.col("median_a") - F.col("median_b")
    return pairs.withColumn("difference", diff).withColumn("differs", F.abs(diff) > threshold)


def transition_counts(runs: DataFrame, state: str, by: Sequence[str] = (PID,), order="start_us", slice_days=1.0, cut: Sequence[str] = ()) -> DataFrame:
    """Counts of state-to-state changes from the run-length form (AG-30).

    ``cut`` columns (a day, say) end the sequence at their borders.
    """
    keys = [*by, *cut]
    linked = with_neighbour(runs, keys, [order], {"to_state": F.col(state)}, time_slice(order, slice_days), forward=True)
    return linked.filter(F.col("to_state").isNotNull()).groupBy(*by, F.col(state).alias("from_state"), "to_state").agg(F.count(F.lit(1)).alias("n"))


def state_shares(df: DataFrame, state: str, by: Sequence[str]) -> DataFrame:
    """Share of each state per group, a day say (AG-30)."""
    counts = df.groupBy(*by, state).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))
