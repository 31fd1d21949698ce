"""Ordered analytics on streams (WN-*)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.time import DAY, HOUR, SECOND, day_number, floor_div, us
from .ordered import SLICE, framed, positions, running, salted_join, value_counts, value_slices, with_neighbour
from .sessions import PID, TS, state_runs, time_slice


def time_diff(df: DataFrame, pid=PID, ts=TS, slice_days=1.0, name="gap_seconds") -> DataFrame:
    """Seconds since the previous sample (WN-1)."""
    base = df.withColumn("_us", us(ts))
    linked = with_neighbour(base, [pid], ["_us"], {"_prev": F.col("_us")}, time_slice("_us", slice_days))
    return linked.withColumn(name, (F.col("_us") - F.col("_prev")) / F.lit(float(SECOND))).drop("_us", "_prev")


def change_events(states: DataFrame, state: str, pid=PID, ts=TS, drop_state=None, slice_days=1.0) -> DataFrame:
    """State changes as ``(from_state, to_state, index, t_us)`` (WN-2).

    ``index`` is the row number (from 0) of the first row of the new state.
    Changes into or out of ``drop_state`` are left out.
    """
    rows = positions(states.withColumn("_us", us(ts)), [pid], ["_us"], time_slice("_us", slice_days), "_pos")
    linked = with_neighbour(rows, [pid], ["_us"], {"from_state": F.col(state)}, time_slice("_us", slice_days))
    out = linked.filter(F.col("from_state").isNotNull() & (F.col("from_state") != F.col(state)))
    if drop_state is not None:
        out = out.filter((F.col("from_state") != drop_state) & (F.col(state) != drop_state))
    return out.select(pid, "from_state", F.col(state).alias("to_state"), (F.col("_pos") - 1).alias("index"), F.col("_us").alias("t_us"))


def rolling_mean(df: DataFrame, value: str, low=-3, high=2, pid=PID, ts=TS, name="rolling", slice_days=1.0) -> DataFrame:
    """Mean over rows ``low..high`` around the row (WN-3)."""
    return framed(
        df.withColumn("_us", us(ts)), [pid], ["_us"], -low, max(high, 0),
        lambda w: {name: F.avg(value).over(w.rowsBetween(low, high))}, time_slice("_us", slice_days),
    ).drop("_us")


def moving_average(df: DataFrame, value: str, n: int, pid=PID, ts=TS, name="moving", slice_days=1.0) -> DataFrame:
    """Mean of the last ``n`` rows where there are that many (WN-5)."""
    out = framed(
        df.withColumn("_us", us(ts)), [pid], ["_us"], n - 1, 0,
        lambda w: {name: F.avg(value).over(w.rowsBetween(-(n - 1), 0))}, time_slice("_us", slice_days),
    )
    return out.filter(F.col("pos") >= n).drop("_us")


def remove_weekly_level(df: DataFrame, cols: Sequence[str], before=7, after=6, pid=PID, ts=TS) -> DataFrame:
    """Subtract each day's mean over the days around it (WN-4).

    Sums and counts per day are combined over a range of day numbers; the rows
    meet their day's level by (participant, day).
    """
    rows = df.withColumn("_day", day_number(ts))
    days = rows.groupBy(pid, "_day").agg(*[f(c).alias(f"_{n}_{c}") for c in cols for n, f in (("s", F.sum), ("n", F.count))])
    w = Window.partitionBy(pid).orderBy("_day").rangeBetween(-before, after)  # a participant's days
    level = days.select(pid, "_day", *[F.try_divide(F.sum(f"_s_{c}").over(w), F.sum(f"_n_{c}").over(w)).alias(f"_l_{c}") for c in cols])
    out = rows.join(level, [pid, "_day"])
    return out.withColumns({c: F.col(c) - F.coalesce(F.col(f"_l_{c}"), F.lit(0.0)) for c in cols}).drop("_day", *[f"_l_{c}" for c in cols])


def circular_smooth(pdf: DataFrame, n_bins: int, by: Sequence[str], state: str, p="p") -> DataFrame:
    """Three-point circular mean over bins, renormalised per bin (WN-6)."""
    spread = pdf.withColumn("_b", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
    spread = spread.withColumn("bin", F.pmod(F.col("bin") + F.col("_b"), F.lit(n_bins)))
    smooth = spread.groupBy(*by, "bin", state).agg((F.sum(p) / 3).alias(p))
    return smooth.withColumn(p, F.col(p) / F.sum(p).over(Window.partitionBy(*by, "bin")))


def savgol_5_3(df: DataFrame, value: str, pid=PID, ts=TS, name="smooth", slice_days=1.0) -> DataFrame:
    """Savitzky-Golay smoothing, five points, cubic (WN-7).

    Inner rows use the weights (-3, 12, 17, 12, -3)/35; the two rows at each
    end take the cubic fitted through the first or last five.  Series shorter
    than five rows are returned unsmoothed.
    """
    weights = {  # fixed values: cubic least squares on five points, per position
        0: (69, 4, -6, 4, -1), 1: (2, 27, 12, -8, 2), 2: (-3, 12, 17, 12, -3), 3: (2, -8, 12, 27, 2), 4: (-1, 4, -6, 4, 69),
    }
    scale = {0: 70.0, 1: 35.0, 2: 35.0, 3: 35.0, 4: 70.0}

    def compute(w):
        def fit(at: int) -> Column:
            total = F.lit(0.0)
            for j, k in enumerate(weights[at]):
                step = j - at
                v = F.col(value) if step == 0 else (F.lead(value, step).over(w) if step > 0 else F.lag(value, -step).over(w))
                total = total + v * float(k)
            return total / scale[at]

        first = F.col("pos") <= 2
        # rows to the end, seen as far as the halo reaches
        left = F.sum(F.lit(1)).over(w.rowsBetween(1, 2))
        left = F.coalesce(left, F.lit(0))
        edge = F.when(F.col("pos") == 1, fit(0)).when(F.col("pos") == 2, fit(1)).when(left == 1, fit(3)).when(left == 0, fit(4)).otherwise(fit(2))
        return {name: F.coalesce(edge, F.col(value))}

    return framed(df.withColumn("_us", us(ts)), [pid], ["_us"], 4, 4, compute, time_slice("_us", slice_days)).drop("_us")


def normalize(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (PID,), how: str = "zscore", given: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """z-score or min-max within groups, over all rows, or by given bounds (WN-8).

    Group statistics are aggregated first and joined back, so a hot group is
    never gathered.  ``given`` maps a column to (mean, std) or (min, max).
    """
    if given:
        def scaled(c, a, b):
            return (F.col(c) - a) / F.lit(float(b)) if how == "zscore" else (F.col(c) - a) / F.lit(float(b - a))
        return df.withColumns({c: scaled(c, *given[c]) for c in cols})
    pair = ((F.avg, "a"), (F.stddev_samp, "b")) if how == "zscore" else ((F.min, "a"), (F.max, "b"))
    stats = [f(c).alias(f"_{n}_{c}") for c in cols for f, n in pair]
    if by:
        out = salted_join(df, df.groupBy(*by).agg(*stats), list(by), "left")  # rows without a key keep nulls
    else:
        # a single row of two numbers per column
        out = df.withColumn("_one", F.lit(1)).join(F.broadcast(df.agg(*stats).withColumn("_one", F.lit(1))), "_one").drop("_one")
    width = {c: F.col(f"_b_{c}") if how == "zscore" else F.col(f"_b_{c}") - F.col(f"_a_{c}") for c in cols}
    out = out.withColumns({c: F.try_divide(F.col(c) - F.col(f"_a_{c}"), width[c]) for c in cols})
    return out.drop(*[f"_{n}_{c}" for c in cols for n in "ab"])


def keep_chain(
    spans: DataFrame, bound: Column, pid=PID, min_spans: int = 1, start="start_us", end="end_us", last_us: str | None = None
) -> DataFrame:
    """Follow kept spans: from the kept one to the next that starts after its bound.

    ``bound`` (of a span) is the time a later start must pass.  The kept span
    moves only when a period is emitted, which ``lag`` cannot express.  The
    fold runs over one sorted array of spans per participant: sleeps, a few
    per calendar day, never readings.
    """
    cell = F.struct(F.col(start).alias("s"), F.col(end).alias("e"), bound.alias("b"))
    lists = spans.groupBy(pid).agg(F.array_sort(F.collect_list(cell)).alias("_x")).filter(F.size("_x") >= min_spans)
    empty = F.expr("cast(array() as array<struct<start_us:bigint,sleep_end_us:bigint,end_us:bigint>>)")
    state = F.struct(F.element_at("_x", 1).alias("kept"), empty.alias("out"))

    def step(acc, cur):
        go = cur["s"] > acc["kept"]["b"]
        period = F.struct(acc["kept"]["s"].alias("start_us"), acc["kept"]["e"].alias("sleep_end_us"), cur["s"].alias("end_us"))
        return F.struct(
            F.when(go, cur).otherwise(acc["kept"]).alias("kept"),
            F.when(go, F.array_append(acc["out"], period)).otherwise(acc["out"]).alias("out"),
        )

    folded = lists.select(pid, F.aggregate("_x", state, step).alias("_f"))
    return folded.select(pid, F.explode("_f.out").alias("p")).select(pid, "p.*")


def awake_periods(sleep: DataFrame, pid=PID, min_sleeps=5, main_hours=4, gap_hours=10, long_gap_hours=16) -> DataFrame:
    """Awake periods between main sleeps (WN-9): ``start_us, sleep_end_us, end_us``.

    A period runs from the last kept sleep to the current one when the gap is
    over 16 h, or over 10 h after a kept sleep of more than 4 h.  Sleeps with
    the same start keep the longer end.
    """
    unique = sleep.groupBy(pid, "start_us").agg(F.max("end_us").alias("end_us"))
    wait = F.when(F.col("end_us") - F.col("start_us") > main_hours * HOUR, gap_hours * HOUR).otherwise(long_gap_hours * HOUR)
    return keep_chain(unique, F.col("end_us") + wait, pid, min_sleeps)


def between_sleep_spans(sleep: DataFrame, data: DataFrame, min_gap_hours=10, pid=PID, ts=TS) -> DataFrame:
    """Spans of at least ten hours between sleeps, the last one to the end of data (WN-20).

    Starts at the first reading; sleeps that follow too soon are skipped
    without moving the start.
    """
    ends = data.groupBy(pid).agg(F.min(us(ts)).alias("_first"), F.max(us(ts)).alias("_last"))
    base = sleep.select(pid, "start_us", "end_us").join(ends.select(pid), pid, "left_semi")
    opening = ends.select(pid, F.col("_first").alias("start_us"), F.col("_first").alias("end_us"))
    cell = F.struct(F.col("start_us").alias("s"), F.col("end_us").alias("e"))
    lists = base.groupBy(pid).agg(F.array_sort(F.collect_list(cell)).alias("_x"))  # sleeps, a few per day
    lists = ends.join(lists, pid, "left").withColumn("_x", F.coalesce("_x", F.expr("cast(array() as array<struct<s:bigint,e:bigint>>)")))
    empty = F.expr("cast(array() as array<struct<start_us:bigint,end_us:bigint>>)")

    def step(acc, cur):
        go = cur["s"] - acc["at"] >= min_gap_hours * HOUR
        return F.struct(
            F.when(go, cur["e"]).otherwise(acc["at"]).alias("at"),
            F.when(go, F.array_append(acc["out"], F.struct(acc["at"].alias("start_us"), cur["s"].alias("end_us")))).otherwise(acc["out"]).alias("out"),
        )

    folded = lists.withColumn("_f", F.aggregate("_x", F.struct(F.col("_first").alias("at"), empty.alias("out")), step))
    spans = F.array_append(F.col("_f.out"), F.struct(F.col("_f.at").alias("start_us"), F.col("_last").alias("end_us")))
    return folded.select(pid, F.explode(spans).alias("p")).select(pid, "p.*").filter("end_us > start_us")


def percentile_in(ref: DataFrame, query: DataFrame, value: str, by: Sequence[str], slices: int = 32, name="percentile") -> DataFrame:
    """Share of the reference sample at or below each query value, within ``by`` (WN-10).

    Both sides are counted into one value-ordered pass; the order is cut into
    balanced value ranges.
    """
    side = query.withColumn("_q", F.struct(*[F.col(c) for c in query.columns]))
    rows = ref.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n")).withColumn("_k", F.lit(0))
    both = rows.unionByName(side.select(*by, value, "_q", F.lit(1).alias("_k"), F.lit(0).cast("bigint").alias("_n")), allowMissingColumns=True)
    sliced = value_slices(both, by, value, slices)
    ranked = running(sliced, by, [value, "_k"], {"_below": ("sum", F.col("_n"))}, F.col(SLICE))
    totals = rows.groupBy(*by).agg(F.sum("_n").alias("_total"))
    hit = salted_join(ranked.filter("_k = 1").drop(SLICE), totals, list(by), "left")
    return hit.select("_q.*", (F.col("_below") / F.col("_total")).alias(name))


def rank_extremes(dim: DataFrame, cols: Sequence[str], k: int = 5, pid=PID) -> DataFrame:
    """Top and bottom ``k`` participants per score, scores ranked by spread (WN-11).

    Rank filters keep ``k`` rows per task before the shuffle.
    """
    long = dim.select(pid, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot([pid], list(cols), "score", "value").filter(F.col("value").isNotNull())
    spread = long.groupBy("score").agg(F.stddev_pop("value").alias("spread"))
    spread = spread.withColumn("score_rank", F.row_number().over(Window.orderBy(F.col("spread").desc(), "score")))  # one row per score
    ends = None
    for status, order in (("high", F.col("value").desc()), ("low", F.col("value").asc())):
        w = Window.partitionBy("score").orderBy(order, pid)
        one = long.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).withColumn("status", F.lit(status))
        ends = one if ends is None else ends.unionByName(one)
    return ends.join(F.broadcast(spread.select("score", "score_rank")), "score")


def split_cohort(df: DataFrame, value: str, at: str | float = "median", name="cohort", low="low", high="high") -> DataFrame:
    """Two labels by median, mean or a constant (WN-12)."""
    from .ordered import quantiles

    if isinstance(at, str):
        cut = quantiles(df, [], value, {"_cut": 0.5}) if at == "median" else df.agg(F.avg(value).alias("_cut"))
        # one number; none if all values are null
        df = df.withColumn("_one", F.lit(1)).join(F.broadcast(cut.withColumn("_one", F.lit(1))), "_one", "left").drop("_one")
        limit = F.col("_cut")
    else:
        limit = F.lit(at)
    return df.withColumn(name, F.when(F.col(value) >= limit, high).when(F.col(value).isNotNull(), low)).drop("_cut")


def stack_windows(df: DataFrame, cols: Sequence[str], w: int, pid=PID, ts=TS, name="window", slice_days=1.0) -> DataFrame:
    """Vectors of ``w`` consecutive rows; incomplete ones at the end are dropped (WN-13)."""
    def compute(win):
        cells = [F.lead(F.col(c).cast("double"), i).over(win) if i else F.col(c).cast("double") for i in range(w) for c in cols]
        return {name: F.array(*cells), "_full": F.lead(F.lit(1), w - 1).over(win).isNotNull() if w > 1 else F.lit(True)}

    out = framed(df.withColumn("_us", us(ts)), [pid], ["_us"], 0, w - 1, compute, time_slice("_us", slice_days))
    return out.filter("_full").drop("_us", "_full")


def lag_matrix(df: DataFrame, cols: Sequence[str], p: int, pid=PID, order="day", spread: Column | None = None) -> DataFrame:
    """Columns ``c_1 .. c_p`` with the values of the rows before (WN-14)."""
    return framed(
        df, [pid], [order], p, 0,
        lambda w: {f"{c}_{i}": F.lag(c, i).over(w) for c in cols for i in range(1, p + 1)},
        spread if spread is not None else floor_div(order, 365),
    )


def breaks_to_segments(bps: DataFrame, time="t_us", min_seconds: float = 0, pid=PID, slice_days=7.0) -> DataFrame:
    """Consecutive breakpoints as segments, short ones dropped (WN-17)."""
    linked = with_neighbour(bps.select(pid, time), [pid], [time], {"end_us": F.col(time)}, time_slice(time, slice_days), forward=True)
    out = linked.filter(F.col("end_us").isNotNull()).withColumnRenamed(time, "start_us")
    return out.filter(F.col("end_us") - F.col("start_us") >= int(min_seconds * SECOND))


def mask_and_delta(df: DataFrame, value: str, pid=PID, ts=TS, hide: float = 0.0, seed: int = 0, slice_days=1.0) -> DataFrame:
    """Mask, seconds since the last observed value, and a hash-drawn evaluation mask (WN-19).

    The first row has delta 0; later rows count from the last row that was
    observed before them.
    """
    base = df.withColumn("_us", us(ts)).withColumn("mask", F.col(value).isNotNull().cast("int"))
    seen = running(
        base, [pid], ["_us"], {"_last": ("max", F.when(F.col("mask") == 1, F.col("_us"))), "_first": ("min", F.col("_us"))},
        time_slice("_us", slice_days), include_current=False,
    )
    since = F.coalesce(F.col("_last"), F.col("_first"), F.col("_us"))
    draw = F.pmod(F.xxhash64(pid, F.col("_us"), F.lit(seed)), F.lit(1_000_000)) / 1_000_000.0
    out = seen.withColumn("delta", (F.col("_us") - since) / F.lit(float(SECOND)))
    return out.withColumn("eval_mask", ((F.col("mask") == 1) & (draw < hide)).cast("int")).drop("_us", "_last", "_first")


def chunks(df: DataFrame, cols: Sequence[str], length: int, pid=PID, ts=TS, slice_days=1.0) -> DataFrame:
    """Consecutive rows as arrays of a fixed length; the rest is dropped (WN-19)."""
    rows = positions(df.withColumn("_us", us(ts)), [pid], ["_us"], time_slice("_us", slice_days), "_pos")
    rows = rows.withColumn("chunk", floor_div(F.col("_pos") - 1, length))
    cell = F.struct("_us", *cols)
    out = rows.groupBy(pid, "chunk").agg(F.array_sort(F.collect_list(cell)).alias("_x"))  # `length` rows
    out = out.filter(F.size("_x") == length)
    return out.select(pid, "chunk", *[F.col(f"_x.{c}").alias(c) for c in cols])
