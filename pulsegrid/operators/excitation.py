"""Self- and cross-exciting event streams: decayed sums and infectivity by expectation maximisation (ML-20)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.time import DAY, SECOND, floor_div
from ..session import cut_lineage
from .ordered import running, salted_join

#: Frames are this many mean decay times wide: what happened before the previous frame has decayed below 2^-92, less than a double can hold beside 1.
REACH = 64.0


def _total(terms: Sequence[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def decayed_sums(
    events: DataFrame, types: Sequence[str], kind: str, time_us: str, series: Sequence[str], decay_seconds: float, slice_days: float = 1.0,
) -> DataFrame:
    """Per series and time: how many events of each type, and the decayed sums of all earlier ones.

    Returns ``series, time_us, counts, near``; ``near[j]`` is the sum of ``exp(-lag / decay_seconds)`` over the
    events of ``types[j]`` strictly before.  Events of other types, and rows with a null type or time, do not count; events at one time
    do not act on each other.  No pairs are formed: weights relative to the start of a frame are summed up in slices of ``slice_days``, and each
    frame gets one row of sums of the frame before.
    """
    if decay_seconds <= 0:
        raise ValueError("decay_seconds must be positive")
    width = max(1, int(REACH * decay_seconds * SECOND))
    rate = 1.0 / (decay_seconds * SECOND)
    known = events.where(F.col(kind).isin(*types) & F.col(time_us).isNotNull())
    # rows of a moment are merged first: repeated rows are counts
    at = known.groupBy(*series, F.col(time_us).alias("_t")).agg(*[F.count(F.when(F.col(kind) == a, 1)).alias(f"_n{j}") for j, a in enumerate(types)])
    at = at.withColumn("_frame", floor_div("_t", width))
    at = at.withColumn("_up", F.exp((F.col("_t") - F.col("_frame") * width) * rate))
    keys = [*series, "_frame"]
    weights = {f"_s{j}": F.col(f"_n{j}") * F.col("_up") for j in range(len(types))}
    before = at.groupBy(*keys).agg(*[F.sum(w).alias(f"_p{n[2:]}") for n, w in weights.items()]).withColumn("_frame", F.col("_frame") + 1)
    run = running(at, keys, ["_t"], {n: ("sum", w) for n, w in weights.items()}, floor_div("_t", int(slice_days * DAY)), include_current=False)
    out = salted_join(run, before, keys, "left")
    fade = F.exp(F.lit(-width * rate))
    near = [(F.coalesce(f"_s{j}", F.lit(0.0)) + F.coalesce(f"_p{j}", F.lit(0.0)) * fade) / F.col("_up") for j in range(len(types))]
    return out.select(*series, F.col("_t").alias(time_us), F.array(*[f"_n{j}" for j in range(len(types))]).alias("counts"), F.array(*near).alias("near"))


def infectivity(
    events: DataFrame, types: Sequence[str], kind: str, time_us: str, series: Sequence[str], decay_seconds: float, by: Sequence[str] = (),
    rounds: int = 100, tolerance: float = 1e-9, slice_days: float = 1.0,
) -> DataFrame:
    """How strongly events of one type call forth events of another (ML-20).

    Model: the rate of type ``i`` is ``base_i`` plus, for each earlier event of type ``j`` of the series, ``infectivity_ij`` times an exponential
    density of mean ``decay_seconds``; ``infectivity_ij`` is the expected number of direct followers.  A series is watched from its
    first to its last event.  All series with equal ``by`` (a subset of ``series``; none: all series) share one model, all models are
    fitted in the same jobs.

    Returns ``by, from_type, to_type, infectivity, base_rate`` (of ``to_type``, per second), ``log_likelihood`` (of the
    model before its last step) and ``rounds``.  Each round is one scan of the decayed sums, aggregated to one row per model and
    type; the likelihood never falls.  Rounds end when no model's likelihood rises by more than ``tolerance`` of itself, or after
    ``rounds``; ``tolerance=0`` gives exactly ``rounds``.  Models whose series have no extent in time give no row; a type without
    events has rates 0.
    """
    d, by, series = len(types), list(by), list(series)
    if not set(by) <= set(series):
        raise ValueError("by must be part of series")
    per_second = 1.0 / decay_seconds
    sums = cut_lineage(decayed_sums(events, types, kind, time_us, series, decay_seconds, slice_days))
    span = sums.groupBy(*series).agg(F.min(time_us).alias("_from"), F.max(time_us).alias("_to"))
    left = (F.col("_to") - F.col(time_us)) / F.lit(float(SECOND))
    seen = -F.expm1(-left * per_second)  # share of an event's effect that falls before the end
    lasting = salted_join(sums, span.select(*series, "_to"), series).groupBy(*by).agg(
        *[F.sum(F.col("counts")[j]).alias(f"_n{j}") for j in range(d)], *[F.sum(F.col("counts")[j] * seen).alias(f"_k{j}") for j in range(d)])
    watched = span.groupBy(*by).agg((F.sum(F.col("_to") - F.col("_from")) / F.lit(float(SECOND))).alias("_watched"))
    share = F.array(*[F.col(f"_k{j}") for j in range(d)])
    start = (lasting.join(watched, by) if by else lasting.crossJoin(watched)).where("_watched > 0")  # without ``by`` both have one row
    model = cut_lineage(start.select(
        *by, "_watched", share.alias("_share"),
        F.explode(F.array(*[F.struct(F.lit(i).alias("_i"), F.col(f"_n{i}").alias("_n")) for i in range(d)])).alias("c"),
    ).select(*by, "_watched", "_share", "c._i", (F.col("c._n") * 0.5 / F.col("_watched")).alias("_base"),
             F.array(*[F.when(F.col("_share")[j] > 0, F.lit(0.5 / d)).otherwise(0.0) for j in range(d)]).alias("_effect")))
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("_i"), F.col("counts")[i].alias("_n")) for i in range(d)]))
    rows = cut_lineage(sums.select(*by, cells.alias("c"), "near").select(*by, "c.*", "near").where("_n > 0"))

    def pull(j):
        return F.col("_effect")[j] * F.col("near")[j] * per_second

    last = None
    for done in range(1, rounds + 1):
        small = model.select(*by, "_i", "_base", "_effect")
        # without ``by`` the model has one row per type
        on = salted_join(rows, small, [*by, "_i"]) if by else rows.join(F.broadcast(small), "_i")
        rate = on.withColumn("_rate", F.col("_base") + _total([pull(j) for j in range(d)]))
        got = rate.groupBy(*by, "_i").agg(
            F.sum(F.col("_n") * F.col("_base") / F.col("_rate")).alias("_own"), F.sum(F.col("_n") * F.log("_rate")).alias("_log"),
            *[F.sum(F.col("_n") * pull(j) / F.col("_rate")).alias(f"_r{j}") for j in range(d)])
        step = model.join(got, [*by, "_i"], "left")
        expected = F.col("_base") * F.col("_watched") + _total([F.col("_effect")[j] * F.col("_share")[j] for j in range(d)])
        effect = F.array(*[F.when(F.col("_share")[j] > 0, F.coalesce(F.col(f"_r{j}"), F.lit(0.0)) / F.col("_share")[j]).otherwise(0.0) for j in range(d)])
        model = cut_lineage(step.select(
            *by, "_i", "_watched", "_share", (F.coalesce(F.col("_own"), F.lit(0.0)) / F.col("_watched")).alias("_base"), effect.alias("_effect"),
            (F.coalesce(F.col("_log"), F.lit(0.0)) - expected).alias("_fit")))
        fits = model.groupBy(*by).agg(F.sum("_fit").alias("_fit"))
        if last is not None and tolerance > 0:
            change = F.col("a._fit") - F.col("b._fit") > tolerance * F.abs("b._fit")
            a, b = fits.alias("a"), last.alias("b")
            rising = a.join(b, by) if by else a.crossJoin(b)
            if rising.where(change).isEmpty():
                break
        last = fits
    names = F.array(*[F.lit(a) for a in types])
    long = model.join(fits.withColumnRenamed("_fit", "log_likelihood"), by) if by else model.crossJoin(fits.withColumnRenamed("_fit", "log_likelihood"))
    return long.select(
        *by, names[F.col("_i")].alias("to_type"), F.col("_base").alias("base_rate"), "log_likelihood",
        F.posexplode("_effect").alias("_j", "infectivity"),
    ).select(*by, names[F.col("_j")].alias("from_type"), "to_type", "infectivity", "base_rate", "log_likelihood", F.lit(done).alias("rounds"))
