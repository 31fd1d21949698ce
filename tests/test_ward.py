"""Ward's tree against plain agglomeration."""

import numpy as np
import pytest

from pulsegrid.operators import neighbours as NB, ward as WD


def plain(x, k):
    """One cheapest merge at a time; heights, and the members of the last ``k`` clusters."""
    clusters = {}
    for i, v in enumerate(map(tuple, x)):
        clusters.setdefault(v, []).append(i)
    clusters, heights = list(clusters.values()), []
    cut = [set(c) for c in clusters] if len(clusters) <= k else None
    while len(clusters) > 1:
        best = None
        for a in range(len(clusters)):
            for b in range(a + 1, len(clusters)):
                p, q = x[clusters[a]], x[clusters[b]]
                cost = len(p) * len(q) / (len(p) + len(q)) * ((p.mean(0) - q.mean(0)) ** 2).sum()
                if best is None or cost < best[0]:
                    best = cost, a, b
        heights.append(best[0])
        clusters[best[1]] = clusters[best[1]] + clusters.pop(best[2])
        if len(clusters) == k:
            cut = [set(c) for c in clusters]
    return np.array(heights), cut


@pytest.mark.parametrize("d, k, whole, leaf", [(2, 3, 2048, 1024), (2, 4, 24, 8)])
def test_tree_is_that_of_plain_agglomeration(spark, monkeypatch, d, k, whole, leaf):
    monkeypatch.setattr(WD, "WHOLE", whole)
    monkeypatch.setattr(NB, "LEAF", leaf)
    monkeypatch.setattr(NB, "WAYS", 3)
    rng = np.random.default_rng(d)
    data = {"a": np.concatenate([rng.normal(c, 1, (14, d)) for c in (0, 6, -9)]), None: rng.normal(size=(23, d)), "two": rng.normal(size=(2, d)), "one": np.ones((5, d))}
    data["a"][3:6] = data["a"][3]
    names = [f"x{i}" for i in range(d)]
    rows = [(g, i, *map(float, v)) for g, x in data.items() for i, v in enumerate(x)] + [("a", -1, *[None] * d)]
    df = spark.createDataFrame(rows, "g string, i int, " + ", ".join(f"{c} double" for c in names)).coalesce(1)
    got = {}
    for r in WD.ward(df, names, k, ["g"]).collect():
        got.setdefault(r.g, {}).setdefault(r.cluster, set()).add(r.i)
    assert set(got) == set(data)
    for g, x in data.items():
        assert sorted(map(sorted, got[g].values())) == sorted(map(sorted, plain(x, k)[1]))
        assert sorted(got[g]) == list(range(len(got[g])))
        assert [min(got[g][c]) for c in sorted(got[g])] == sorted(min(m) for m in got[g].values())


def test_heights(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(WD, "WHOLE", 20)
    monkeypatch.setattr(NB, "LEAF", 7)
    x = np.random.default_rng(5).normal(size=(50, 2))
    points = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(x)], "_id long, _m long, _v array<double>").withColumn("_g", F.struct(F.lit(0).alias("g")))
    merges = WD.ward_merges(points, 2).collect()
    assert len({r.gone for r in merges}) == 49 and all(r.into < r.gone for r in merges)
    np.testing.assert_allclose(sorted(r.height for r in merges), np.sort(plain(x, 1)[0]), rtol=1e-9)


def test_no_rows(spark):
    df = spark.createDataFrame([], "x double, y double")
    assert WD.ward(df, ["x", "y"]).collect() == []


def test_rounds_inside_leaves_merge_only_what_is_cheaper_than_outside(spark, monkeypatch):
    """Several groups and weights, leaves of a few clusters: members are those of one merge at a time, after several rounds."""
    from pyspark.sql import functions as F

    rounds = []
    for name in ("_leaf_round", "_group_round"):
        monkeypatch.setattr(WD, name, lambda *a, name=name, run=getattr(WD, name): rounds.append(name) or run(*a))
    monkeypatch.setattr(WD, "WHOLE", 40)
    rng = np.random.default_rng(8)
    data = {g: np.concatenate([rng.normal(c, s, (50, 2)) for c, s in ((0, 1), (9, 0.1), (-30, 5))]) for g in ("a", None)}
    rows = [(g, i, *map(float, v)) for g, x in data.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "g string, i int, x double, y double").coalesce(1)
    got = {}
    for r in WD.ward(df, ["x", "y"], 5, ["g"]).collect():
        got.setdefault(r.g, {}).setdefault(r.cluster, set()).add(r.i)
    for g, x in data.items():
        assert sorted(map(sorted, got[g].values())) == sorted(map(sorted, plain(x, 5)[1]))
    assert "_leaf_round" in rounds


def test_a_cluster_beside_a_border_waits():
    """The pair 0 and 3 costs 4.5; a single cluster outside at distance 2 would cost 2, one at distance 9 would not."""
    ids, n, x = np.array([1, 2]), np.ones(2), np.array([[0.0], [3.0]])
    for away, many in ((2.0, 0), (9.0, 1)):
        reach = lambda n, x: n / (n + 1) * (x[:, 0] - (3 + away)) ** 2
        assert len(WD._merged(ids, n, x, reach)[0]) == many


@pytest.mark.parametrize("at_once", [40, 1 << 21])
def test_merges_in_a_task_are_those_of_plain_agglomeration(monkeypatch, at_once):
    """Partners are kept from step to step; ties on a lattice, several blocks of costs."""
    monkeypatch.setattr(WD, "AT_ONCE", at_once)
    rng = np.random.default_rng(3)
    for x in (rng.normal(size=(70, 3)), np.unique(rng.integers(0, 9, (60, 2)).astype(float), axis=0)):
        merges = WD.merges_of(np.arange(len(x)), np.ones(len(x)), x)
        assert len({m[0] for m in merges}) == len(x) - 1 and all(m[1] < m[0] for m in merges)
        if x.shape[1] == 3:
            np.testing.assert_allclose(sorted(m[2] for m in merges), np.sort(plain(x, 1)[0]), rtol=1e-9)
        members = {i: [i] for i in range(len(x))}
        for gone, into, height, _ in sorted(merges, key=lambda m: m[3]):
            p, q = x[members[into]], x[members[gone]]
            np.testing.assert_allclose(height, len(p) * len(q) / (len(p) + len(q)) * ((p.mean(0) - q.mean(0)) ** 2).sum(), rtol=1e-9)
            members[into] += members.pop(gone)


def test_size_estimates_of_stored_tables_stay_small(spark):
    """The estimate of a join is a product; over rounds its digits doubled until they filled the driver."""
    from pyspark.sql import functions as F
    from pulsegrid.session import cut_lineage

    now = spark.range(20).withColumn("x", F.col("id") % 3)
    for _ in range(8):
        now = cut_lineage(now.alias("a").join(now.alias("b"), "id").select("id", F.col("a.x").alias("x")))
    assert now._jdf.queryExecution().analyzed().stats().sizeInBytes() < 1 << 64
    assert sorted(map(tuple, now.collect())) == [(i, i % 3) for i in range(20)]
