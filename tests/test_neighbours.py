"""Nearest neighbours in several columns against all distances."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import neighbours as NB


def psi(x):
    out = 0.0
    while x < 12:
        out, x = out - 1 / x, x + 1
    return out + math.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)


def kth(x, k):
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    return np.sort(d, 1)[:, k - 1]


def entropy(x, k):
    n, d = x.shape
    return d * np.log(kth(x, k) + np.finfo(float).eps).mean() + d / 2 * math.log(math.pi) - math.lgamma(d / 2 + 1) + psi(n) - psi(k)


def clouds(d):
    rng = np.random.default_rng(d)
    hot = rng.normal(0, 0.01, (500, d))
    wide = rng.normal(0, 50, (60, d))
    return {"hot": np.concatenate([hot, wide, np.repeat(hot[:1], 40, 0)]), "ties": rng.integers(0, 4, (150, d)).astype(float), None: rng.normal(size=(30, d)), "few": rng.normal(size=(3, d))}


@pytest.mark.parametrize("d, k, leaf, ways", [(1, 1, 16, 4), (2, 3, 16, 4), (2, 3, 1024, 16), (3, 5, 40, 16), (4, 2, 25, 3)])
def test_entropy_is_that_of_all_distances(spark, monkeypatch, d, k, leaf, ways):
    monkeypatch.setattr(NB, "LEAF", leaf)
    monkeypatch.setattr(NB, "WAYS", ways)
    monkeypatch.setattr(NB, "VISITORS", 30)
    names = [f"x{i}" for i in range(d)]
    data = clouds(d)
    rows = [(g, *map(float, v)) for g, x in data.items() for v in x] + [("hot", *[None] * d), ("hot", *[float("nan")] * d)]
    df = spark.createDataFrame(rows, "g string, " + ", ".join(f"{c} double" for c in names)).repartition(6)
    got = {r.g: r for r in NB.knn_entropy(df, names, k, ["g"]).collect()}
    assert set(got) == {g for g, x in data.items() if len(x) > k}
    for g, r in got.items():
        assert r.n == len(data[g]) and r.entropy == pytest.approx(entropy(data[g], k), abs=1e-9)
    far = sorted(x for r in NB.nearest_distance(df.filter("g = 'hot'"), names, k, ["g"]).collect() for x in [r.distance] * r.n)
    np.testing.assert_allclose(far, np.sort(kth(data["hot"], k)), rtol=1e-12)


def test_mutual_information_of_columns(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=300)
    data = np.column_stack([x, x + 0.3 * rng.normal(size=300), rng.normal(size=300)])
    df = spark.createDataFrame([("a", *map(float, v)) for v in data], "g string, x double, y double, z double")
    near, apart = (NB.knn_mutual_information(df, [["x"], [c]], 3, ["g"]).first().information for c in ("y", "z"))
    assert near == pytest.approx(entropy(data[:, :1], 3) + entropy(data[:, 1:2], 3) - entropy(data[:, :2], 3), abs=1e-9)
    assert near > 0.8 and abs(apart) < 0.2


def test_no_rows(spark):
    df = spark.createDataFrame([], "g string, x double, y double")
    assert NB.knn_entropy(df, ["x", "y"], 3, ["g"]).collect() == []


def filled(x, k):
    """The definition, row by row."""
    out = x.copy()
    for i, j in zip(*np.nonzero(np.isnan(x))):
        far = []
        for r in range(len(x)):
            both = ~np.isnan(x[i]) & ~np.isnan(x[r])
            if not np.isnan(x[r, j]) and both.any():
                far.append((math.sqrt(((x[i] - x[r])[both] ** 2).sum() / both.sum()), x[r, j]))
        far.sort()
        near = [f for f in far if f[0] <= far[min(k, len(far)) - 1][0]]
        if near:
            out[i, j] = sum(v / (d + 1e-6) for d, v in near) / sum(1 / (d + 1e-6) for d, _ in near)
    return out


@pytest.mark.parametrize("d, k, leaf", [(2, 3, 8), (3, 5, 12), (4, 1, 10), (3, 4, 1024)])
def test_gaps_take_the_nearest_rows(spark, monkeypatch, d, k, leaf):
    monkeypatch.setattr(NB, "LEAF", leaf)
    monkeypatch.setattr(NB, "WAYS", 4)
    monkeypatch.setattr(NB, "VISITORS", 9)
    rng = np.random.default_rng(10 * d + k)
    data = {"a": rng.integers(0, 9, (120, d)).astype(float), None: rng.normal(size=(70, d)), "lone": np.full((2, d), np.nan), "two": rng.normal(size=(2, d))}
    for g in ("a", None):
        data[g][rng.random(data[g].shape) < 0.15] = np.nan
    data["a"][:20] = data["a"][0]
    data["lone"][0, 0] = 1.0
    names = [f"x{i}" for i in range(d)]
    rows = [(g, i, *[None if math.isnan(x) and (i + n) % 2 else float(x) for n, x in enumerate(v)]) for g, x in data.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "g string, i int, " + ", ".join(f"{c} double" for c in names)).repartition(5)
    got = {(r.g, r.i): [np.nan if r[c] is None else r[c] for c in names] for r in NB.fill_nearest(df, names, k, ["g"]).collect()}
    assert len(got) == len(rows)
    for g, x in data.items():
        np.testing.assert_allclose([got[g, i] for i in range(len(x))], filled(x, k), rtol=1e-9)


def test_nothing_to_fill(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 4.0)], "g string, x double, y double")
    assert sorted(map(tuple, NB.fill_nearest(df, ["x", "y"], 2, ["g"]).collect())) == [("a", 1.0, 2.0), ("a", 3.0, 4.0)]
    assert NB.fill_nearest(df.limit(0), ["x", "y"], 2, ["g"]).collect() == []
