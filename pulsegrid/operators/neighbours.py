"""Exact nearest neighbours in several columns, by a tree of boxes built with Spark aggregates (ST-15, IM-4).

Equal points count as one with a weight, so that any box of more than one point can be cut.  Boxes of more than
``LEAF`` points are cut at quantiles of their widest side, all boxes of all groups in one aggregate a level, until none
is larger.  A point first meets its own leaf; the distance it finds there bounds the search, and it then goes down from
the root into every child whose box is nearer than that.  When it has been in all of these, no nearer point
is left: the search is exact, no group is gathered, and no list of pairs is written.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.special import digamma
from ..session import cut_lineage

#: Points of a leaf at most, children of a cut at most, visitors that meet a leaf in one block.
LEAF, WAYS, VISITORS = 1024, 16, 1024
_DOUBLES = T.ArrayType(T.DoubleType())


def _tree(points: DataFrame, d: int, root: Column, leaf: int | None = None, ways: int | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """Points with their leaf ``_node``, and per level the cuts ``_node -> _child`` with the children's boxes and least weights.

    Points of one root are distinct, and lack the same values if any.
    """
    leaf, ways = leaf or LEAF, ways or WAYS
    at = points.withColumn("_node", root)
    levels, done = [], None
    while True:
        low, high = [F.array(*[f(F.col("_v")[i]) for i in range(d)]) for f in (F.min, F.max)]
        boxes = at.groupBy("_node").agg(F.count(F.lit(1)).alias("_n"), low.alias("_low"), high.alias("_high"))
        large = boxes.filter(F.col("_n") > leaf)
        sides = F.zip_with("_low", "_high", lambda a, b: b - a)
        large = cut_lineage(large.select("_node", "_n", "_low", "_high", (F.array_position(sides, F.array_max(sides)) - 1).cast("int").alias("_axis")))
        if large.isEmpty():
            return (at if done is None else done.unionByName(at)), levels
        # widest side of the box; its values at quantiles, below the largest one, are the cuts
        open_ = at.join(large.select("_node", "_axis"), "_node")
        x = F.col("_v")[F.col("_axis")]
        marks = [i / ways for i in range(1, ways)]
        cuts = open_.groupBy("_node").agg(F.percentile_approx(x, F.array(*map(F.lit, marks)), F.lit(10 * ways)).alias("_q"))
        side = lambda c: F.col(c)[F.col("_axis")]
        middle = side("_low") + (side("_high") - side("_low")) / 2
        middle = F.when(middle < side("_high"), middle).otherwise(side("_low"))
        cuts = cuts.join(large, "_node").withColumn("_q", F.array_distinct(F.filter("_q", lambda q: q < side("_high"))))
        cuts = cut_lineage(cuts.select("_node", "_axis", F.when(F.size("_q") > 0, F.col("_q")).otherwise(F.array(middle)).alias("_q")))
        moved = open_.drop("_axis").join(cuts, "_node").withColumn("_child", F.xxhash64("_node", F.size(F.filter("_q", lambda q: F.col("_v")[F.col("_axis")] > q))))
        moved = cut_lineage(moved.select(*points.columns, "_node", "_child"))
        low, high = [F.array(*[f(F.col("_v")[i]) for i in range(d)]) for f in (F.min, F.max)]
        levels.append(cut_lineage(moved.groupBy("_node", "_child").agg(low.alias("_low"), high.alias("_high"), F.min("_m").alias("_light"))))
        closed = at.join(large.select("_node"), "_node", "left_anti")
        done = closed if done is None else done.unionByName(closed)
        at = moved.select(*points.columns, F.col("_child").alias("_node"))


def _k_least(x: np.ndarray, y: np.ndarray, many: np.ndarray, k: int) -> np.ndarray:
    """Distances of each row of ``x`` to the ``k`` nearest of the weighted points ``y``; missing ones are infinite."""
    out = np.full((len(x), k), np.inf)
    step = max(1, (1 << 22) // max(len(y), 1))
    take = min(k, len(y))
    for i in range(0, len(x), step):
        d2 = ((x[i : i + step, None, :] - y[None, :, :]) ** 2).sum(2)
        near = np.argpartition(d2, take - 1, axis=1)[:, :take]
        part = np.take_along_axis(d2, near, 1)
        order = np.argsort(part, axis=1, kind="stable")
        part, copies = np.take_along_axis(part, order, 1), many[np.take_along_axis(near, order, 1)]
        ends = np.cumsum(copies, axis=1)
        for j in range(k):  # the j-th nearest row lies in the first point whose copies reach it
            at = (ends <= j).sum(1)
            has = at < take
            out[i : i + step][has, j] = np.sqrt(part[has, at[has]])
    return out


def _own_leaf(k: int):
    """Per point of a leaf: its ``k`` least distances there, itself left out once."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                many = np.asarray(batch.column("_many")[i].values)
                y = np.asarray(batch.column("_pts")[i].values.flatten()).reshape(len(many), -1)
                least = _k_least(y, y, many, k + 1)[:, 1:]
                yield pa.RecordBatch.from_arrays([
                    batch.column("_g").take(pa.array([i] * len(y))), batch.column("_node").take(pa.array([i] * len(y))), batch.column("_ids")[i].values,
                    pa.array(list(y), pa.list_(pa.float64())), pa.array(many), pa.array(list(least), pa.list_(pa.float64()))], ["_g", "_home", "_id", "_v", "_m", "_least"])

    return run


def _visits(k: int):
    """Blocks of visitors against the points of a leaf."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                many = np.asarray(batch.column("_many")[i].values)
                y = np.asarray(batch.column("_pts")[i].values.flatten()).reshape(len(many), -1)
                who = batch.column("_who")[i].values
                x = np.asarray(who.field("_v").flatten()).reshape(len(who), -1)
                yield pa.RecordBatch.from_arrays([who.field("_id"), pa.array(list(_k_least(x, y, many, k)), pa.list_(pa.float64()))], ["_id", "_least"])

    return run


def _dealt(visits: DataFrame, who: Column, fields: Sequence[str]) -> DataFrame:
    """``_node, _block, _who``: visitors of a leaf in blocks of about ``VISITORS``, however many there are."""
    blocks = visits.groupBy("_node").agg(F.floor(F.count(F.lit(1)) / VISITORS + 1).alias("_blocks"))
    dealt = visits.join(blocks, "_node").withColumn("_block", F.pmod(F.xxhash64(who), F.col("_blocks")))
    return dealt.groupBy("_node", "_block").agg(F.collect_list(F.struct(*fields)).alias("_who"))


def nearest_distance(df: DataFrame, cols: Sequence[str], k: int, by: Sequence[str]) -> DataFrame:
    """``_g, n, distance``: how far the ``k``-th nearest other row of its group is, per distinct point; ``n`` rows are equal to it.

    ``_g`` holds the columns of ``by``.  The distance is infinite in groups of ``k`` rows or fewer.  Rows with a null or NaN go.
    """
    d = len(cols)
    values = [F.col(c).cast("double") for c in cols]
    whole = df
    for v in values:
        whole = whole.filter(v.isNotNull() & ~F.isnan(v))
    points = whole.select(F.struct(*by).alias("_g"), F.array(*[v + F.lit(0.0) for v in values]).alias("_v"))  # -0.0 is 0.0
    points = cut_lineage(points.groupBy("_g", "_v").agg(F.count(F.lit(1)).alias("_m")).withColumn("_id", F.monotonically_increasing_id()))
    placed, levels = _tree(points, d, F.xxhash64("_g"))
    packed = placed.groupBy("_g", "_node").agg(F.collect_list(F.struct("_id", "_v", "_m")).alias("_x"))  # ``LEAF`` points at most
    leaves = cut_lineage(packed.select("_g", "_node", F.col("_x._id").alias("_ids"), F.col("_x._v").alias("_pts"), F.col("_x._m").alias("_many")))
    key = points.schema["_g"]
    own_type = T.StructType([key, *[T.StructField(*x) for x in (("_home", T.LongType()), ("_id", T.LongType()), ("_v", _DOUBLES), ("_m", T.LongType()), ("_least", _DOUBLES))]])
    own = cut_lineage(leaves.mapInArrow(_own_leaf(k), own_type))
    found = own.select("_id", "_least")
    if levels:
        reach = F.col("_least")[k - 1]
        walk = own.select("_id", "_v", "_home", reach.alias("_r"), F.xxhash64("_g").alias("_node"))
        visits = None
        for level in levels:
            gap = F.transform(F.arrays_zip("_v", "_low", "_high"), lambda z: F.greatest(z["_low"] - z["_v"], z["_v"] - z["_high"], F.lit(0.0)))
            away = F.aggregate(gap, F.lit(0.0), lambda a, g: a + g * g)
            # a hair wider, so that rounding of a box's distance hides nothing
            went = walk.join(level, "_node").filter(away <= F.col("_r") * F.col("_r") * (1 + 1e-12)).select("_id", "_v", "_home", "_r", F.col("_child").alias("_node"))
            stay = walk.join(level.select("_node").distinct(), "_node", "left_anti")
            visits = stay if visits is None else visits.unionByName(stay)
            walk = cut_lineage(went)
        visits = visits.unionByName(walk).filter("_node != _home").select("_id", "_v", "_node")
        visits = cut_lineage(visits)
        dealt = _dealt(visits, F.col("_id"), ["_id", "_v"])
        met = dealt.join(leaves.select("_node", "_pts", "_many"), "_node").mapInArrow(_visits(k), T.StructType([T.StructField("_id", T.LongType()), T.StructField("_least", _DOUBLES)]))
        # leaves that a point has been in
        found = found.unionByName(met).groupBy("_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("_least"))), 1, k).alias("_least"))
    return own.select("_g", "_m", "_id").join(found, "_id").select("_g", F.col("_m").alias("n"), F.col("_least")[k - 1].alias("distance"))


def knn_entropy(df: DataFrame, cols: Sequence[str], k: int = 3, by: Sequence[str] = ("participant_id",)) -> DataFrame:
    """``by, n, entropy``: nearest-neighbour entropy estimate of the joint density of ``cols`` per group, in nats (ST-15).

    Groups of ``k`` rows or fewer have none and are left out.
    """
    d = len(cols)
    far = nearest_distance(df, cols, k, by)
    tiny = 2.220446049250313e-16
    per = far.groupBy("_g").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.log(F.col("distance") + tiny)) / F.sum("n")).alias("_m")).filter(F.col("n") > k)
    # log of the unit ball's volume: pi^(d/2) / gamma(d/2 + 1)
    ball = 0.5 * d * np.log(np.pi) - sum(np.log(x) for x in np.arange(0.5 * d, 0, -1) if x > 0) - (0.5 * np.log(np.pi) if d % 2 else 0.0)
    value = d * F.col("_m") + float(ball) + digamma(F.col("n").cast("double")) - digamma(F.lit(float(k)))
    return per.select("_g.*", "n", value.alias("entropy"))


def knn_mutual_information(df: DataFrame, variables: Sequence[Sequence[str]], k: int = 3, by: Sequence[str] = ("participant_id",)) -> DataFrame:
    """``by, n, information``: entropies of the variables (each a list of columns) less the joint one, on rows where all are there."""
    every = [c for v in variables for c in v]
    whole = cut_lineage(df.dropna(subset=every).select(*by, *every))
    parts = [knn_entropy(whole, v, k, by).select(F.struct(*by).alias("_g"), "n", F.col("entropy").alias("_e")) for v in variables]
    parts.append(knn_entropy(whole, every, k, by).select(F.struct(*by).alias("_g"), "n", (-F.col("entropy")).alias("_e")))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("_g", "n").agg(F.sum("_e").alias("information")).select("_g.*", "n", "information")


def _masked_visits(k: int):
    """Per visitor: the least distances in a leaf, each with the count of rows and the sum of the wanted value there."""
    near = pa.list_(pa.struct([("d", pa.float64()), ("n", pa.int64()), ("s", pa.float64())]))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                many = np.asarray(batch.column("_many")[i].values)
                y = batch.column("_pts")[i].values.flatten().to_numpy(zero_copy_only=False).reshape(len(many), -1)
                who = batch.column("_who")[i].values
                x = who.field("_v").flatten().to_numpy(zero_copy_only=False).reshape(len(who), -1)
                wanted, found = np.asarray(who.field("_j")), []
                step = max(1, (1 << 21) // y.size)
                for at in range(0, len(x), step):
                    gap = (x[at : at + step, None, :] - y[None, :, :]) ** 2
                    both = ~np.isnan(gap)
                    shared = both.sum(2)
                    far = np.where(shared > 0, np.sqrt(np.where(both, gap, 0.0).sum(2) / np.maximum(shared, 1)), np.inf)
                    for row, j in zip(far, wanted[at : at + step]):
                        order = np.argsort(row, kind="stable")
                        last = min(np.searchsorted(np.cumsum(many[order]), k), len(order) - 1)
                        pick = np.flatnonzero((row <= row[order[last]]) & np.isfinite(row))
                        each, back = np.unique(row[pick], return_inverse=True)
                        n, s = np.bincount(back, many[pick], len(each)), np.bincount(back, many[pick] * y[pick, j], len(each))
                        found.append([{"d": float(a), "n": int(b), "s": float(c)} for a, b, c in zip(each, n, s)])
                yield pa.RecordBatch.from_arrays([who.field("_row"), who.field("_j"), pa.array(found, near)], ["_row", "_j", "_near"])

    return run


def fill_nearest(df: DataFrame, cols: Sequence[str], k: int = 5, by: Sequence[str] = ("participant_id",)) -> DataFrame:
    """Gaps of ``cols`` filled from the ``k`` rows of the group that are nearest in the other columns (IM-4).

    The distance of two rows is the root of the mean squared difference over the columns that both have.  A gap takes
    the mean of its column over the ``k`` nearest rows that have it, weighted by ``1 / (distance + 1e-6)``; all rows
    at the ``k``-th distance count.  Rows without any value, and gaps that no row of the group can fill, stay as they are.  NaN counts
    as a gap.  Normalise columns of different size first.

    Rows that lack the same columns share a tree.  A gap first meets one leaf of each tree that can fill it, which bounds its
    search, then all leaves whose boxes are near enough.
    """
    d = len(cols)
    clean = [F.when(F.isnan(F.col(c).cast("double")), None).otherwise(F.col(c).cast("double") + F.lit(0.0)) for c in cols]
    bits = F.lit(0)
    for i, c in enumerate(clean):
        bits = bits + F.when(c.isNotNull(), 1 << i).otherwise(0)
    rows = cut_lineage(df.withColumns({"_row": F.monotonically_increasing_id(), "_g": F.struct(*by), "_v": F.array(*clean), "_mask": bits}))
    seen = rows.filter("_mask > 0")
    points = cut_lineage(seen.groupBy("_g", "_mask", "_v").agg(F.count(F.lit(1)).alias("_m")))
    placed, levels = _tree(points, d, F.xxhash64("_g", "_mask"))
    packed = placed.groupBy("_node").agg(F.collect_list(F.struct("_v", "_m")).alias("_x"))  # ``LEAF`` points at most
    leaves = cut_lineage(packed.select("_node", F.col("_x._v").alias("_pts"), F.col("_x._m").alias("_many")))
    gaps = F.filter(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.get("_v", i).isNull())
    asks = seen.filter(F.col("_mask") < (1 << d) - 1).select("_row", "_g", "_v", F.col("_mask").alias("_own"), F.explode(gaps).alias("_j"))
    trees = points.select("_g", "_mask").distinct().withColumn("_node", F.xxhash64("_g", "_mask"))  # one per set of gaps
    able = (F.expr("shiftright(_mask, _j) & 1") == 1) & (F.col("_mask").bitwiseAND(F.col("_own")) > 0)
    begin = cut_lineage(asks.join(trees, "_g").filter(able).select("_row", "_j", "_v", "_node"))

    def down(walk: DataFrame, bound: bool) -> DataFrame:
        """Leaves below the nodes of ``walk``: those within ``_r``, or the nearest child each time."""
        ends = None
        for level in levels:
            gap = F.transform(F.arrays_zip("_v", "_low", "_high"), lambda z: F.greatest(z["_low"] - z["_v"], z["_v"] - z["_high"], F.lit(0.0)))
            held = F.filter(F.transform(F.arrays_zip("_v", "_low", F.col("_gap").alias("_gap")), lambda z: F.when(z["_v"].isNotNull() & z["_low"].isNotNull(), z["_gap"])), lambda g: g.isNotNull())
            away = F.sqrt(F.aggregate("_held", F.lit(0.0), lambda a, g: a + g * g) / F.size("_held"))
            joined = walk.join(level, "_node").withColumn("_gap", gap).withColumn("_held", held).withColumn("_away", away)
            keep = [c for c in walk.columns if c != "_node"]
            if bound:
                went = joined.filter(F.col("_away") <= F.col("_r") * (1 + 1e-12)).select(*keep, F.col("_child").alias("_node"))
            else:
                went = joined.groupBy("_row", "_j", "_node").agg(F.min_by(F.struct("_v", "_child"), F.struct("_away", "_child")).alias("_b")).select("_row", "_j", F.col("_b._v").alias("_v"), F.col("_b._child").alias("_node"))
            stay = walk.join(level.select("_node").distinct(), "_node", "left_anti")
            ends = stay if ends is None else ends.unionByName(stay)
            walk = cut_lineage(went)
        return walk if ends is None else ends.unionByName(walk)

    near_type = T.StructType([T.StructField("_row", T.LongType()), T.StructField("_j", T.IntegerType()), T.StructField("_near", T.ArrayType(T.StructType([T.StructField("d", T.DoubleType()), T.StructField("n", T.LongType()), T.StructField("s", T.DoubleType())])))])

    def met(visits: DataFrame) -> DataFrame:
        """What the leaves hold: distances in order, and the ``k``-th one."""
        dealt = _dealt(visits, F.col("_row"), ["_row", "_j", "_v"])
        found = dealt.join(leaves, "_node").mapInArrow(_masked_visits(k), near_type)
        found = found.groupBy("_row", "_j").agg(F.array_sort(F.flatten(F.collect_list("_near"))).alias("_near"))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(float("inf")).alias("d"))
        last = F.aggregate("_near", start, lambda a, x: F.when(a["n"] >= k, a).otherwise(F.struct((a["n"] + x["n"]).alias("n"), x["d"].alias("d"))))
        return found.withColumn("_last", last)

    if levels:
        reach = met(down(begin, False)).select("_row", "_j", F.when(F.col("_last.n") >= k, F.col("_last.d")).otherwise(float("inf")).alias("_r"))
        found = met(down(cut_lineage(begin.join(reach, ["_row", "_j"])), True).select("_row", "_j", "_v", "_node"))
    else:
        found = met(begin)
    taken = F.filter("_near", lambda x: x["d"] <= F.col("_last.d"))
    total = lambda f: F.aggregate(taken, F.lit(0.0), lambda a, x: a + x[f] / (x["d"] + 1e-6))
    fills = found.filter(F.size("_near") > 0).select("_row", "_j", (total("s") / total("n")).alias("_fill"))
    fills = fills.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("_j", "_fill"))).alias("_fills"))  # one per column
    out = rows.join(fills, "_row", "left")
    filled = {c: F.coalesce(v, F.try_element_at("_fills", F.lit(i))) for i, (c, v) in enumerate(zip(cols, clean))}
    return out.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns])
