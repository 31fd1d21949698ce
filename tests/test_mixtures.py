"""Mixtures per group against plain expectation-maximisation of each group alone."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import mixtures as MX

RIDGE = 1e-2


def density(x, w, m, c):
    d = x.shape[1]
    inv, det = np.linalg.inv(c), np.linalg.det(c)
    y = x - m
    return w * np.exp(-0.5 * np.einsum("ij,jk,ik->i", y, inv, y)) / np.sqrt((2 * np.pi) ** d * det)


def plain_em(x, means, cov, k, tol):
    """Textbook rounds; the sequence of penalised likelihoods and the last parameters."""
    n, d = x.shape
    w, m, c = np.full(k, 1 / k), means[:k].copy(), np.tile(cov + 1e-3 * np.eye(d), (k, 1, 1))
    values = [-np.inf]
    while True:
        p = np.stack([density(x, w[j], m[j], c[j]) for j in range(k)], 1)
        ll = np.log(p.sum(1)).sum()
        values.append(ll - 0.5 * RIDGE * sum(np.trace(np.linalg.inv(s)) for s in c))
        if values[-1] - values[-2] <= tol * n:
            return values[1:], ll, (w, m, c)
        r = p / p.sum(1, keepdims=True)
        w = r.mean(0)
        m = (r.T @ x) / r.sum(0)[:, None]
        c = np.stack([((x - m[j]).T * r[:, j] @ (x - m[j]) + RIDGE * np.eye(d)) / r[:, j].sum() for j in range(k)])


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(2)
    two = np.concatenate([rng.normal(-3, 0.5, (60, 2)), rng.normal(3, 0.7, (80, 2))])
    one = rng.normal(0, 1, (90, 2))
    three = np.concatenate([rng.normal(c, 0.3, (50, 2)) for c in ([0, 0], [4, 0], [0, 5])])
    return {"a": two, "b": one, None: three}


@pytest.fixture
def table(spark, groups):
    rows = [(g, float(i), v.tolist()) for g, x in groups.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows + [("a", 0.0, None), ("b", 0.0, [None, 1.0])], "g string, i double, v array<double>").repartition(5)


@pytest.mark.parametrize("block_rows, tol", [(4096, 1e-7), (100, 1e-3)])
def test_every_fit_is_the_plain_one(spark, groups, table, monkeypatch, block_rows, tol):
    """Groups fitted inside a task, and groups ``a`` and null by rounds."""
    monkeypatch.setattr(MX, "BLOCK_ROWS", block_rows)
    fits = MX.fit_mixtures(table, "v", [1, 2, 3], ["g"], ridge=RIDGE, tol=tol).collect()
    assert len(fits) == 9
    for r in fits:
        x = groups[r.g]
        order = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>").orderBy(F.xxhash64("v"), "v").collect()
        values, ll, (w, m, c) = plain_em(x, np.array([o.v for o in order]), np.cov(x.T, bias=True), r.k, tol)
        assert all(b >= a - 1e-9 for a, b in zip(values, values[1:]))
        assert r.n == len(x) and r.rounds == len(values)
        assert r.value == pytest.approx(values[-1], abs=1e-6) and r.loglik == pytest.approx(ll, abs=1e-6)
        np.testing.assert_allclose(r.params, np.concatenate([w, m.ravel(), c.ravel()]), atol=1e-5)


def test_groups_choose_their_own_count(table, groups):
    out = MX.mixture_by(table, "v", [1, 2, 3, 4], ["g"]).collect()
    assert len(out) == sum(map(len, groups.values()))
    assert {r.g: r.components for r in out} == {"a": 2, "b": 1, None: 3}
    sides = {(r.v[0] > 0, r.cluster) for r in out if r.g == "a"}
    assert len(sides) == 2


def test_small_groups_and_no_rows(spark):
    rows = [("same", [1.0, 1.0])] * 5 + [("single", [2.0, 3.0]), ("pair", [0.0, 0.0]), ("pair", [9.0, 9.0])]
    df = spark.createDataFrame(rows, "g string, v array<double>")
    fits = MX.fit_mixtures(df, "v", [2, 3], ["g"]).collect()
    assert {(r.g, r.k) for r in fits} == {("same", 1), ("single", 1), ("pair", 2)}
    assert MX.fit_mixtures(df.limit(0), "v", [2], ["g"]).collect() == []
    assert MX.mixture_by(df.limit(0), "v", [2], ["g"]).collect() == []


def test_groups_fitted_together_are_those_fitted_alone():
    """Before, every group of a task ran its own rounds."""
    rng = np.random.default_rng(4)
    xs = [rng.normal(0, 1, (n, 2)) + rng.integers(0, 2, (n, 1)) * 5 for n in (3, 40, 7, 25)]
    xs.append(np.repeat(xs[0][:1], 4, 0))
    start = lambda x: np.concatenate([[0.5, 0.5], x[0], x[-1], np.tile((np.cov(x.T, bias=True) + 1e-3 * np.eye(2)).ravel(), 2)])
    found = MX._fit_together(xs, [start(x) for x in xs], 2, 2, 1000, 1e-6, 1e-2)
    for x, (params, value, loglik, turn) in zip(xs, found):
        now, before = start(x), -np.inf
        for n in range(1, 1000):
            sums = MX.expected(x, now, 2)
            best, following = MX.maximised(sums, now, 2, 2, 1e-2)
            if best - before <= 1e-6 * len(x):
                break
            now, before = following, best
        assert turn == n and value == pytest.approx(best) and loglik == pytest.approx(sums[0])
        assert params == pytest.approx(now)
    with pytest.raises(RuntimeError):
        MX._fit_together(xs, [start(x) for x in xs], 2, 2, 2, 1e-6, 1e-2)
