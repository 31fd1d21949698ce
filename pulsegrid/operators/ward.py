"""Ward's hierarchy by rounds that merge reciprocal nearest clusters (ML-13).

A cluster is one row: count and mean.  Two clusters cost ``n m / (n + m)`` times the squared distance of their means, which
is what their scatter grows by.  Clusters that are each other's cheapest partner merge in any correct order, so many such
pairs merge at once and the tree is that of one merge at a time.  A round cuts groups into leaves of neighbours; a task merges
the clusters of a leaf as long as a pair costs less than either one would with the nearest box outside and its lightest
cluster.  The next round cuts at other places.  If a round merges little, partners are searched in a tree of boxes: the
cheapest one in the own leaf bounds the search, and a child is entered only if its box and its lightest cluster could be
cheaper.  Groups that are down to ``WHOLE`` clusters are finished inside a task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..session import cut_lineage, release_shuffles
from .neighbours import _dealt, _tree

#: Clusters of a group that one task takes to the end, and of a leaf at most; costs that it computes at once.
WHOLE, AT_ONCE = 8192, 1 << 21
#: Children of a cut, round by round: few, so that leaves are no rods, and changing, so that a border does not stay.
CUTS = (4, 3, 5)
#: The share of clusters that a round inside leaves has to leave behind less than.
SLOW = 0.8
_DOUBLES = T.ArrayType(T.DoubleType())


def _costs(n: np.ndarray, x: np.ndarray, m: np.ndarray, y: np.ndarray) -> np.ndarray:
    gap = np.zeros((len(x), len(y)))
    for j in range(x.shape[1]):
        gap += (x[:, j, None] - y[None, :, j]) ** 2
    return n[:, None] * m[None, :] / (n[:, None] + m[None, :]) * gap


def _merged(ids: np.ndarray, n: np.ndarray, x: np.ndarray, reach=None):
    """``(gone, into, height, step)`` of merges of a few clusters, and ids, counts and means of those left; ids ascend.

    ``reach`` tells what clusters would cost with the nearest others at least; only cheaper pairs merge.
    """
    ids, n, x, out, step = ids.copy(), n.astype(float), x.astype(float), [], 0

    def search(rows: np.ndarray, told: bool) -> None:
        """The cheapest partner of ``rows``, the first of ties; if ``told``, the others hear of them."""
        some = max(1, AT_ONCE // len(ids))
        for i in range(0, len(rows), some):
            at = rows[i : i + some]
            cost = _costs(n[at], x[at], n, x)
            cost[np.arange(len(at)), at] = np.inf
            best[at] = cost.argmin(1)
            least[at] = cost[np.arange(len(at)), best[at]]
            if told:
                who = cost.argmin(0)
                heard = cost[who, np.arange(len(ids))]
                nearer = (heard < least) | ((heard == least) & (at[who] < best))
                best[nearer], least[nearer] = at[who[nearer]], heard[nearer]

    best, least = np.zeros(len(ids), np.int64), np.full(len(ids), np.inf)
    edge = np.full(len(ids), np.inf) if reach is None else reach(n, x)
    search(np.arange(len(ids)), False)
    while len(ids) > 1:
        at = np.arange(len(ids))
        # a hair more, so that rounding hides nothing
        sure = least * (1 + 1e-9) < edge if reach is not None else np.ones(len(ids), bool)
        a = at[(best[best] == at) & (at < best) & sure & sure[best]]
        if not len(a):
            break
        b = best[a]
        out += [(int(ids[j]), int(ids[i]), float(least[i]), step) for i, j in zip(a, b)]
        both = n[a] + n[b]
        x[a] = (n[a, None] * x[a] + n[b, None] * x[b]) / both[:, None]
        n[a] = both
        changed = np.zeros(len(ids), bool)
        changed[a] = changed[b] = True
        lost = changed[best] & ~changed
        stay = np.delete(at, b)
        moved = np.cumsum(np.isin(at, stay, assume_unique=True)) - 1
        best = moved[best]
        ids, n, x, edge, best, least, lost, changed = (v[stay] for v in (ids, n, x, edge, best, least, lost, changed))
        # no merged cluster is cheaper than both of its parts were: others keep their partners, but for ties
        least[changed | lost] = np.inf
        search(np.flatnonzero(lost), False)
        search(np.flatnonzero(changed), True)
        if reach is not None:
            edge[changed] = reach(n[changed], x[changed])
        step += 1
    return out, ids, n, x


def merges_of(ids: np.ndarray, n: np.ndarray, x: np.ndarray) -> list[tuple[int, int, float, int]]:
    """``(gone, into, height, step)`` of all merges of a few clusters, down to one; ids ascend."""
    return _merged(ids, n, x)[0]


def _page(batch: pa.RecordBatch, i: int):
    x = batch.column("_pts")[i].values
    ids, n = (np.asarray(x.field(c)) for c in ("_id", "_m"))
    v = np.asarray(x.field("_v").flatten()).reshape(len(ids), -1)
    order = np.argsort(ids)
    return ids[order], n[order].astype(float), v[order]


def _cheapest(ids, n, x, whose, m, y):
    """Per cluster ``ids`` the cheapest of ``whose`` but itself, the smaller id of ties: its id and cost."""
    cost = _costs(n, x, m, y)
    cost[ids[:, None] == whose[None, :]] = np.inf
    at = cost.argmin(1)
    return whose[at], cost[np.arange(len(ids)), at]


_BEST = T.StructType([T.StructField("_id", T.LongType()), T.StructField("_to", T.LongType()), T.StructField("_cost", T.DoubleType())])


def _inside(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            ids, n, x = _page(batch, i)
            to, cost = _cheapest(ids, n, x, ids, n, x)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(to), pa.array(cost)], ["_id", "_to", "_cost"])


def _visiting(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            ids, n, x = _page(batch, i)
            who = batch.column("_who")[i].values
            own, m = np.asarray(who.field("_id")), np.asarray(who.field("_m")).astype(float)
            to, cost = _cheapest(own, m, np.asarray(who.field("_v").flatten()).reshape(len(own), -1), ids, n, x)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(to), pa.array(cost)], ["_id", "_to", "_cost"])


def _partners(clusters: DataFrame, d: int) -> DataFrame:
    """``_id, _to, _cost``: the cheapest partner of every cluster in its group."""
    placed, levels = _tree(clusters, d, F.xxhash64("_g"))
    placed = cut_lineage(placed)
    leaves = placed.groupBy("_node").agg(F.collect_list(F.struct("_id", "_m", "_v")).alias("_pts"))
    own = cut_lineage(leaves.mapInArrow(_inside, _BEST))
    walk = placed.select("_id", "_m", "_v", F.col("_node").alias("_home"), F.xxhash64("_g").alias("_node")).join(own.select("_id", F.col("_cost").alias("_r")), "_id")
    ends = None
    for level in levels:
        gap = F.transform(F.arrays_zip("_v", "_low", "_high"), lambda z: F.greatest(z["_low"] - z["_v"], z["_v"] - z["_high"], F.lit(0.0)))
        near = F.aggregate(gap, F.lit(0.0), lambda a, g: a + g * g) * F.col("_m") * F.col("_light") / (F.col("_m") + F.col("_light"))
        # a hair wider, so that rounding hides nothing
        went = walk.join(level, "_node").filter(near <= F.col("_r") * (1 + 1e-9)).select(*[c for c in walk.columns if c != "_node"], F.col("_child").alias("_node"))
        stay = walk.join(level.select("_node").distinct(), "_node", "left_anti")
        ends = stay if ends is None else ends.unionByName(stay)
        walk = cut_lineage(went)
    visits = (walk if ends is None else ends.unionByName(walk)).filter("_node != _home").select("_id", "_m", "_v", "_node")
    met = _dealt(cut_lineage(visits), F.col("_id"), ["_id", "_m", "_v"]).join(leaves, "_node").mapInArrow(_visiting, _BEST)
    return own.unionByName(met).groupBy("_id").agg(F.min(F.struct("_cost", "_to")).alias("_b")).select("_id", F.col("_b._to").alias("_to"), F.col("_b._cost").alias("_cost"))


def _outside(levels: Sequence[DataFrame], roots: DataFrame) -> DataFrame:
    """``_node, _boxes``: the boxes beside each leaf and beside each node above it; they hold all clusters of the group outside the leaf."""
    paths, ends = roots.withColumn("_boxes", F.array().cast("array<struct<_child:long,_low:array<double>,_high:array<double>,_light:long>>")), None
    for level in levels:
        kids = level.groupBy("_node").agg(F.collect_list(F.struct("_child", "_low", "_high", F.col("_light").cast("long").alias("_light"))).alias("_kids"))
        stay = paths.join(kids, "_node", "left_anti")
        ends = stay if ends is None else ends.unionByName(stay)
        down = paths.join(kids, "_node").select("_boxes", "_kids", F.explode("_kids._child").alias("_node"))
        paths = cut_lineage(down.select("_node", F.concat("_boxes", F.filter("_kids", lambda k: k["_child"] != F.col("_node"))).alias("_boxes")))
    return paths if ends is None else ends.unionByName(paths)


def _settled(batches):
    """Merges inside leaves that nothing outside can be cheaper for, and the clusters left, which have no ``into``."""
    for batch in batches:
        for i in range(batch.num_rows):
            boxes = batch.column("_boxes")[i].values
            page = _page(batch, i)
            d = page[2].shape[1]
            low, high = (np.asarray(boxes.field(c).flatten()).reshape(len(boxes), d) for c in ("_low", "_high"))
            light = np.asarray(boxes.field("_light")).astype(float)

            def reach(n, x):
                gap = np.zeros((len(x), len(light)))
                for j in range(d):
                    gap += np.maximum(np.maximum(low[None, :, j] - x[:, j, None], x[:, j, None] - high[None, :, j]), 0.0) ** 2
                return (n[:, None] * light / (n[:, None] + light) * gap).min(1, initial=np.inf)

            out, ids, n, x = _merged(*page, reach)
            gone, into, height, step = list(zip(*out)) or [()] * 4
            none = [None] * len(ids)
            g = batch.column("_g").take(pa.array([i] * (len(out) + len(ids)), pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [g, pa.array([*gone, *ids.tolist()], pa.int64()), pa.array([*into, *none], pa.int64()), pa.array([*height, *none], pa.float64()), pa.array([*step, *none], pa.int64()),
                 pa.array([None] * len(out) + n.astype(np.int64).tolist(), pa.int64()), pa.array([None] * len(out) + x.tolist(), pa.list_(pa.float64()))],
                ["_g", "gone", "into", "height", "step", "_m", "_v"])


def _leaf_round(busy: DataFrame, d: int, ways: int, shape: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Merges inside leaves, and the clusters left."""
    placed, levels = _tree(busy, d, F.xxhash64("_g"), WHOLE, ways)
    boxes = _outside(levels, busy.select(F.xxhash64("_g").alias("_node")).distinct())
    leaves = placed.groupBy("_node").agg(F.first("_g").alias("_g"), F.collect_list(F.struct("_id", "_m", "_v")).alias("_pts")).join(boxes, "_node")
    out = cut_lineage(leaves.mapInArrow(_settled, T.StructType([*shape.fields, T.StructField("_m", T.LongType()), T.StructField("_v", _DOUBLES)])))
    return out.filter("into is not null").select(*shape.names), out.filter("into is null").select("_g", F.col("gone").alias("_id"), "_m", "_v")


def _group_round(busy: DataFrame, d: int) -> tuple[DataFrame, DataFrame]:
    """Merges of all clusters of a group that are each other's cheapest partner, and the clusters left."""
    best = cut_lineage(_partners(busy, d))
    back = best.select(F.col("_id").alias("_to"), F.col("_to").alias("_id"))
    pairs = cut_lineage(best.join(back, ["_id", "_to"], "left_semi").filter("_id < _to"))
    other = busy.select(F.col("_id").alias("_to"), F.col("_m").alias("_m2"), F.col("_v").alias("_v2"))
    joined = cut_lineage(busy.join(pairs, "_id").join(other, "_to"))
    mean = F.zip_with("_v", "_v2", lambda a, b: (F.col("_m") * a + F.col("_m2") * b) / (F.col("_m") + F.col("_m2")))
    merged = joined.select("_g", "_id", (F.col("_m") + F.col("_m2")).alias("_both"), mean.alias("_mean")).toDF("_g", "_id", "_m", "_v")
    used = pairs.select("_id").unionByName(pairs.select(F.col("_to").alias("_id")))
    left = busy.join(used, "_id", "left_anti").select("_g", "_id", "_m", "_v").unionByName(merged)
    return joined.select("_g", F.col("_to").alias("gone"), F.col("_id").alias("into"), F.col("_cost").alias("height"), F.lit(0).cast("long").alias("step")), left


def ward_merges(points: DataFrame, d: int) -> DataFrame:
    """``_g, gone, into, height, step`` of all merges; ``points`` has ``_g, _id, _m, _v``, equal points of a group as one."""
    now, ready, merges, step = cut_lineage(points), None, None, 0
    shape = T.StructType([points.schema["_g"], *[T.StructField(*x) for x in (("gone", T.LongType()), ("into", T.LongType()), ("height", T.DoubleType()), ("step", T.LongType()))]])

    def noted(new: DataFrame) -> None:
        nonlocal merges
        new = new.withColumn("step", F.col("step") + step)
        merges = new if merges is None else merges.unionByName(new)

    turn, slow = 0, False
    while True:
        large = now.groupBy("_g").agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") > WHOLE).select("_g")
        small = now.join(large, "_g", "left_anti")
        ready = small if ready is None else ready.unionByName(small)
        busy = cut_lineage(now.join(large, "_g", "left_semi"))
        many = busy.count()
        if not many:
            break
        new, left = _group_round(busy, d) if slow else _leaf_round(busy, d, CUTS[turn % len(CUTS)], shape)
        noted(new)
        turn, step = turn + 1, step + WHOLE  # a leaf takes fewer steps
        # clusters whose means are equal cost nothing
        left = cut_lineage(left)
        same = left.groupBy("_g", "_v").agg(F.min("_id").alias("_first"), F.sum("_m").alias("_m"))
        twins = left.drop("_m").join(same.drop("_m"), ["_g", "_v"]).filter("_id != _first")
        noted(cut_lineage(twins.select("_g", F.col("_id").alias("gone"), F.col("_first").alias("into"), F.lit(0.0).alias("height"), F.lit(0).cast("long").alias("step"))))
        now, step = cut_lineage(same.select("_g", F.col("_first").alias("_id"), "_m", "_v")), step + 1
        slow = not slow and now.count() > SLOW * many
        release_shuffles(points.sparkSession)  # plans and files of the round

    def finish(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                out = merges_of(*_page(batch, i))
                g = batch.column("_g").take(pa.array([i] * len(out), pa.int64()))
                columns = list(zip(*out)) or [()] * 4
                yield pa.RecordBatch.from_arrays([g, *[pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64()))]], ["_g", "gone", "into", "height", "step"])

    rest = ready.groupBy("_g").agg(F.collect_list(F.struct("_id", "_m", "_v")).alias("_pts")).mapInArrow(finish, shape)  # ``WHOLE`` clusters at most
    noted(rest)
    return cut_lineage(merges)


def ward(df: DataFrame, cols: Sequence[str], k: int = 3, by: Sequence[str] = ()) -> DataFrame:
    """Rows with ``cluster``: the tree of their group cut into ``k`` clusters, numbered by their first row (ML-13).

    Normalise columns first.  Equal rows are together; a group of fewer than ``k`` distinct rows has as many clusters.
    Of partners that cost the same the one whose first row comes earlier is taken.  Rows with a null go; no rows give no rows.
    """
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("_all"))
    whole = df.dropna(subset=list(cols)).withColumns({"_g": group, "_v": F.array(*[F.col(c).cast("double") + F.lit(0.0) for c in cols])})
    rows = cut_lineage(whole.withColumn("_row", F.monotonically_increasing_id()))
    points = cut_lineage(rows.groupBy("_g", "_v").agg(F.min("_row").alias("_id"), F.count(F.lit(1)).alias("_m")))
    merges = ward_merges(points, len(cols))
    top = Window.partitionBy("_g").orderBy(F.desc("height"), F.desc("step"), F.desc("gone"))
    apart = merges.withColumn("_i", F.row_number().over(top)).filter(F.col("_i") < k).select("gone")
    up = merges.join(apart, "gone", "left_anti").select(F.col("gone").alias("_id"), F.col("into").alias("_top"))
    at = cut_lineage(points.select("_g", "_v", "_id").join(up, "_id", "left").select("_g", "_v", "_id", F.coalesce("_top", "_id").alias("_top")))
    while True:  # every way up is halved
        jump = at.select(F.col("_id").alias("_top"), F.col("_top").alias("_higher"))
        new = cut_lineage(at.join(jump, "_top").select("_g", "_v", "_id", F.col("_higher").alias("_top"), (F.col("_higher") != F.col("_top")).alias("_moved")))
        at = new.drop("_moved")
        if new.filter("_moved").isEmpty():
            break
    number = at.select("_g", "_top").distinct().withColumn("cluster", F.row_number().over(Window.partitionBy("_g").orderBy("_top")) - 1)  # ``k`` rows a group
    named = at.join(number, ["_g", "_top"]).select("_g", "_v", "cluster")
    return rows.join(named, ["_g", "_v"]).select(*df.columns, "cluster")
