"""Ordered work on streams where one key may hold a large share of all rows.

A plain ``Window.partitionBy(pid)`` sends a whole participant to one task.
Here every key is cut into *slices* (time ranges, or value ranges for ordered
values).  The sort happens per ``(key, slice)``; what crosses a slice border
is carried by a table with one row per slice, which is small.

* :func:`with_neighbour` -- lag / lead over slice borders
* :func:`running`        -- running sum / count / min / max over slice borders
* :func:`framed`         -- any frame of fixed row width, by blocks with halos
* :func:`merge_runs`     -- aggregate consecutive rows into runs
* :func:`value_slices`   -- balanced slices of an arbitrary value column
* :func:`salted_join`    -- join facts with a one-row-per-key table
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.time import col, floor_div

SLICE = "_slice"


def salted_join(
    facts: DataFrame, dim: DataFrame, keys: Sequence[str], how: str = "inner", salts: int = 8
) -> DataFrame:
    """Join many facts per key with a table of few rows per key.

    The table is repeated ``salts`` times so a hot key spreads over that many
    tasks; runtime re-planning still turns it into a broadcast when the
    measured table is small.  The salt (a hash of the row and its input
    partition) only routes rows, the result does not depend on it.
    """
    # two columns are enough to spread rows, and leave the others prunable
    ranked = [T.TimestampNTZType, T.TimestampType, T.LongType, T.DoubleType, T.IntegerType, T.StringType]
    plain = [f for f in facts.schema if f.name not in keys and type(f.dataType) in ranked]
    chosen = [f.name for f in sorted(plain, key=lambda f: ranked.index(type(f.dataType)))[:2]]
    route = F.xxhash64(*chosen) if chosen else F.lit(0).cast("bigint")
    left = facts.withColumn("_salt", F.pmod(route + F.spark_partition_id(), F.lit(salts)))
    right = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def with_neighbour(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    carry: dict[str, Column],
    spread: Column,
    forward: bool = False,
) -> DataFrame:
    """Add columns evaluated on the row before (or after) within the key.

    ``spread`` numbers the slices and must not decrease along ``order``.
    """
    step, far = (F.lead, F.lag) if forward else (F.lag, F.lead)
    base = df.withColumn(SLICE, spread).withColumn(
        "_carry", F.struct(*[e.alias(n) for n, e in carry.items()])
    )
    w = Window.partitionBy(*keys, SLICE).orderBy(*order)
    inside = base.withColumn("_near", step("_carry").over(w)).withColumn("_far", far(F.lit(1)).over(w))
    edges = inside.filter(F.col("_far").isNull()).select(*keys, SLICE, F.col("_carry").alias("_edge"))
    edges = edges.withColumn("_edge", step("_edge").over(Window.partitionBy(*keys).orderBy(SLICE)))
    out = inside.join(edges, [*keys, SLICE], "left")
    kept = [c for c in df.columns if c not in carry]
    return out.select(*kept, *[F.coalesce(F.col("_near"), F.col("_edge"))[n].alias(n) for n in carry])


_COMBINE: dict[str, Callable[[Column, Column], Column]] = {
    "sum": lambda a, b: F.coalesce(a, b * 0) + F.coalesce(b, a * 0),
    "count": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "max": lambda a, b: F.greatest(a, b),
    "min": lambda a, b: F.least(a, b),
}
_OPS = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}
_MERGE = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence,
    ops: dict[str, tuple[str, Column]],
    spread: Column,
    include_current: bool = True,
    descending: bool = False,
    ahead: dict[str, tuple[str, Column]] | None = None,
) -> DataFrame:
    """Running aggregates in ``order`` within ``keys``.

    ``ops`` maps a new column to ``(sum|count|min|max, expression)``.  With
    ``descending`` the order columns and the slices are walked backwards;
    ``ahead`` adds aggregates walked the other way, over the same shuffle.
    """
    walks = [(ops, descending)] + ([(ahead, not descending)] if ahead else [])
    every = {n: o for some, _ in walks for n, o in some.items()}
    plain = [c for c in df.columns if c != SLICE]
    base = df.select(*plain, *[e.alias(f"_v_{n}") for n, (_, e) in every.items()], spread.alias(SLICE))
    totals = base.groupBy(*keys, SLICE).agg(*[_OPS[o](f"_v_{n}").alias(f"_c_{n}") for n, (o, _) in every.items()])
    local, carried = [], []
    for some, backwards in walks:
        turn = (lambda c: col(c).desc()) if backwards else (lambda c: col(c).asc())
        w = (
            Window.partitionBy(*keys, SLICE)
            .orderBy(*[turn(c) for c in order])
            .rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
        )
        across = Window.partitionBy(*keys).orderBy(turn(SLICE)).rowsBetween(Window.unboundedPreceding, -1)
        local += [_OPS[o](f"_v_{n}").over(w).alias(f"_l_{n}") for n, (o, _) in some.items()]
        carried += [_MERGE[o](f"_c_{n}").over(across).alias(f"_c_{n}") for n, (o, _) in some.items()]
    out = base.select("*", *local).join(totals.select(*keys, SLICE, *carried), [*keys, SLICE], "left")
    kept = [c for c in df.columns if c not in every]
    return out.select(
        *kept, *[_COMBINE[o](F.col(f"_l_{n}"), F.col(f"_c_{n}")).alias(n) for n, (o, _) in every.items()]
    )


def positions(df: DataFrame, keys: Sequence[str], order: Sequence, spread: Column, name: str = "pos") -> DataFrame:
    """Row number within the key, from 1."""
    return running(df, keys, order, {name: ("count", F.lit(1))}, spread)


def framed(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence,
    before: int,
    after: int,
    compute: Callable[[Window], dict[str, Column]],
    spread: Column,
    block: int = 65_536,
    position: str | None = None,
) -> DataFrame:
    """Evaluate window expressions that look ``before``/``after`` rows around.

    Rows are numbered within the key and cut into blocks of ``block`` rows;
    each block also receives the rows its frames reach into.  Blocks have
    equal size whatever the key's share of the data.  ``compute`` receives the
    window (ordered, without frame) and returns the new columns; it can use
    the column ``pos``.
    """
    if max(before, after) > block:
        raise ValueError("frame wider than the block")
    numbered = positions(df, keys, order, spread, "pos") if position is None else df.withColumn("pos", F.col(position))
    zero_based = F.col("pos") - 1
    own = floor_div(zero_based, block)
    offset = F.pmod(zero_based, F.lit(block))
    homes = F.array(
        own,
        F.when(offset < after, own - 1),
        F.when(offset >= block - before, own + 1),
    )
    spreaded = numbered.withColumn("_own", own).withColumn("_block", F.explode(F.array_compact(homes)))
    w = Window.partitionBy(*keys, "_block").orderBy("pos")
    new = compute(w)
    out = spreaded.select("*", *[e.alias(n) for n, e in new.items()])
    kept = [c for c in df.columns if c not in new]
    if "pos" not in kept and "pos" not in new:
        kept.append("pos")
    return out.filter(F.col("_own") == F.col("_block")).select(*kept, *new)


class Measures:
    """Aggregates that can be computed in parts and merged.

    ``spec`` maps an output name to ``(kind, column)`` with kind one of
    ``count sum min max avg std var first last``; ``first``/``last`` follow
    ``time``.  ``std``/``var`` are population forms.
    """

    def __init__(self, spec: dict[str, tuple[str, Column]], time: str = "_t"):
        self.spec, self.time = spec, time

    def parts(self) -> list[Column]:
        out = []
        for name, (kind, c) in self.spec.items():
            c = col(c)
            if kind in ("count", "avg", "std", "var"):
                out.append(F.count(c).alias(f"_{name}_n"))
            if kind in ("sum", "min", "max"):
                out.append(getattr(F, kind)(c).alias(f"_{name}_a"))
            if kind == "avg":
                out.append(F.sum(c).alias(f"_{name}_a"))
            if kind in ("std", "var"):
                out.append(F.avg(c).alias(f"_{name}_a"))
                out.append((F.var_pop(c) * F.count(c)).alias(f"_{name}_q"))
            if kind in ("first", "last"):
                pick = F.min if kind == "first" else F.max
                out.append(pick(F.struct(F.col(self.time), c.alias("v"))).alias(f"_{name}_a"))
        return out

    def merge(self) -> list[Column]:
        out = []
        for name, (kind, _) in self.spec.items():
            n, a, q = F.col(f"_{name}_n"), F.col(f"_{name}_a"), F.col(f"_{name}_q")
            if kind in ("count", "avg", "std", "var"):
                out.append(F.sum(n).alias(f"_{name}_n"))
            if kind in ("sum", "avg"):
                out.append(F.sum(a).alias(f"_{name}_a"))
            if kind in ("min", "first"):
                out.append(F.min(a).alias(f"_{name}_a"))
            if kind in ("max", "last"):
                out.append(F.max(a).alias(f"_{name}_a"))
            if kind in ("std", "var"):
                # one entry per slice of a run, merged pair by pair: squares of large means would cancel
                whole = F.aggregate(F.collect_list(F.when(n > 0, F.struct(n.cast("double").alias("n"), a.alias("a"), q.alias("q")))), F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("a"), F.lit(0.0).alias("q")), _pooled)
                out.append(F.when(whole["n"] > 0, whole["a"]).alias(f"_{name}_a"))
                out.append(whole["q"].alias(f"_{name}_q"))
        return out

    def final(self) -> list[Column]:
        out = []
        for name, (kind, _) in self.spec.items():
            n, a, q = F.col(f"_{name}_n"), F.col(f"_{name}_a"), F.col(f"_{name}_q")
            value = {
                "count": n,
                "avg": F.when(n > 0, a / n),
                "var": F.when(n > 0, F.greatest(q / n, F.lit(0.0))),
                "std": F.when(n > 0, F.sqrt(F.greatest(q / n, F.lit(0.0)))),
                "first": a["v"] if kind in ("first", "last") else None,
                "last": a["v"] if kind in ("first", "last") else None,
            }.get(kind, a)
            out.append(value.alias(name))
        return out


def _pooled(x: Column, y: Column) -> Column:
    """Count, mean and squared deviations of two sets together."""
    n, d = x["n"] + y["n"], y["a"] - x["a"]
    return F.struct(n.alias("n"), (x["a"] + d * y["n"] / n).alias("a"), (x["q"] + y["q"] + d * d * x["n"] * y["n"] / n).alias("q"))


def merge_runs(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    breaks: Callable[[dict[str, Column], dict[str, Column]], Column],
    spread: Column,
    constant: Sequence[str] = (),
    measures: dict[str, tuple[str, Column]] | None = None,
    order: Sequence[str] | None = None,
) -> DataFrame:
    """Aggregate consecutive rows into runs: ``keys, <constant>, start, end, n, ...``.

    ``breaks(prev, cur)`` says whether a new run begins; both sides offer
    ``end`` and ``start`` (times) and the ``constant`` columns, which keep one
    value throughout a run.  One shuffle of the rows: runs are first built per
    ``(key, slice)``; only the first and last run of each slice can continue
    across a border, so only those are merged over the whole key.
    """
    order = list(order or [time])
    m = Measures(measures or {}, "_t")
    base = df.withColumn("_t", F.col(time)).withColumn(SLICE, spread)
    w = Window.partitionBy(*keys, SLICE).orderBy(*order)
    prev = {"start": F.lag("_t").over(w), "end": F.lag("_t").over(w)}
    cur = {"start": F.col("_t"), "end": F.col("_t")}
    for c in constant:
        prev[c], cur[c] = F.lag(c).over(w), F.col(c)
    first = F.row_number().over(w) == 1
    flagged = base.withColumn("_new", F.when(first | breaks(prev, cur), 1).otherwise(0))
    numbered = flagged.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = numbered.groupBy(*keys, SLICE, "_run").agg(
        *[F.first(c).alias(c) for c in constant],
        F.min("_t").alias("start"),
        F.max("_t").alias("end"),
        F.count(F.lit(1)).alias("n"),
        *m.parts(),
    )
    parts = parts.withColumn("_runs", F.max("_run").over(Window.partitionBy(*keys, SLICE)))
    at_border = (F.col("_run") == 1) | (F.col("_run") == F.col("_runs"))
    across = Window.partitionBy(*keys).orderBy(SLICE, "_run")
    prev = {"start": F.lag("start").over(across), "end": F.lag("end").over(across)}
    cur = {"start": F.col("start"), "end": F.col("end")}
    for c in constant:
        prev[c], cur[c] = F.lag(c).over(across), F.col(c)
    fresh = (F.col("_run") > 1) | F.lag("_run").over(across).isNull() | breaks(prev, cur)
    border = parts.filter(at_border).withColumn("_new", F.when(fresh, 1).otherwise(0))
    border = border.withColumn("_id", F.sum("_new").over(across.rowsBetween(Window.unboundedPreceding, 0)))
    joined = border.groupBy(*keys, "_id").agg(
        *[F.first(c).alias(c) for c in constant],
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.sum("n").alias("n"),
        *m.merge(),
    )
    whole = parts.filter(~at_border).drop(SLICE, "_run", "_runs").unionByName(joined.drop("_id"))
    return whole.select(*keys, *constant, "start", "end", "n", *m.final())


def value_slices(df: DataFrame, by: Sequence[str], value: str, slices: int = 32) -> DataFrame:
    """Number balanced ranges of ``value`` within each group as ``_slice``.

    Borders come from a mergeable quantile sketch, so the ranges hold about
    equally many rows whatever the distribution; equal values share a range.
    """
    shares = [i / slices for i in range(1, slices)]
    sketch = F.percentile_approx(value, shares, slices * 20).alias("_bounds")
    if by:
        placed = salted_join(df, df.groupBy(*by).agg(sketch), by, "left")
    else:
        # a single row of `slices` numbers: its size is fixed
        bounds = df.agg(sketch).withColumn("_one", F.lit(1))
        placed = df.withColumn("_one", F.lit(1)).join(F.broadcast(bounds), "_one", "left").drop("_one")

    def search(low: int, high: int) -> Column:
        """Number of bounds below the value, by halving."""
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.get("_bounds", F.lit(mid)) < F.col(value), search(mid + 1, high)).otherwise(search(low, mid))

    return placed.withColumn(SLICE, search(0, slices - 1).cast("bigint")).drop("_bounds")


def value_counts(df: DataFrame, by: Sequence[str], value: str, **more: Column) -> DataFrame:
    """Distinct values with their counts: what ranks and distributions need."""
    rows = df.filter(F.col(value).isNotNull())
    return rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), *[e.alias(k) for k, e in more.items()])


def cumulative(df: DataFrame, by: Sequence[str], value: str, ops: dict[str, str], slices: int = 32) -> DataFrame:
    """Running sums of ``ops`` columns in ``value`` order (values distinct)."""
    sliced = value_slices(df, by, value, slices)
    out = running(sliced, by, [value], {new: ("sum", F.col(old)) for new, old in ops.items()}, F.col(SLICE))
    return out.drop(SLICE)


def quantiles(
    df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float], slices: int = 32
) -> DataFrame:
    """Exact interpolated quantiles per group without gathering a group.

    Values are counted, cut into balanced ranges, and only the ranges that
    hold a wanted rank are sorted.
    """
    key = list(by) or ["_all"]
    rows = df if by else df.withColumn("_all", F.lit(1))
    sliced = value_slices(value_counts(rows, key, value), key if by else [], value, slices)
    sizes = sliced.groupBy(*key, SLICE).agg(F.sum("n").alias("_n"))
    ordered = Window.partitionBy(*key).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = sizes.withColumn("_upto", F.sum("_n").over(ordered)).withColumn(
        "_total", F.sum("_n").over(Window.partitionBy(*key))
    )
    rank = {name: p * (F.col("_total") - 1) for name, p in probs.items()}

    def holds(target: Column, low: Column, high: Column) -> Column:
        return (target >= low) & (target < high)

    needed = F.lit(False)
    for r in rank.values():
        for edge in (F.floor(r), F.ceil(r)):
            needed = needed | holds(edge, F.col("_upto") - F.col("_n"), F.col("_upto"))
    wanted = sizes.filter(needed)
    near = sliced.join(wanted, [*key, SLICE])
    inside = Window.partitionBy(*key, SLICE).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("_hi", F.col("_upto") - F.col("_n") + F.sum("n").over(inside)).withColumn(
        "_lo", F.col("_hi") - F.col("n")
    )
    picks = []
    for name, r in rank.items():
        for tag, edge in (("l", F.floor(r)), ("h", F.ceil(r))):
            picks.append(F.max(F.when(holds(edge, F.col("_lo"), F.col("_hi")), F.col(value))).alias(f"_{name}_{tag}"))
    found = near.groupBy(*key, "_total").agg(*picks)
    out = [
        (
            F.col(f"_{name}_l")
            + (F.col(f"_{name}_h") - F.col(f"_{name}_l")) * (rank[name] - F.floor(rank[name]))
        ).alias(name)
        for name in probs
    ]
    return found.select(*by, *out)
