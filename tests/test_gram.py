"""Moments of array columns and the systems solved on them, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import clustering as C, gram as GM
from pulsegrid.operators.regression import full_matrix


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 6)) @ rng.normal(size=(6, 6)) + 1000.0
    label = rng.integers(0, 3, 400)
    return x + 2.0 * np.eye(6)[label], label


@pytest.fixture
def table(spark, points):
    rows = [(int(l) if l else None, v.tolist()) for v, l in zip(*points)]
    rows += [(1, None), (1, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2, [float("nan")] * 6)]
    return spark.createDataFrame(rows, "label int, v array<double>").repartition(7)


def test_moments_per_group(points, table, monkeypatch):
    for held in (1 << 23, 1):
        monkeypatch.setattr(GM, "_HELD", held)
        got = {r.label: r for r in GM.array_moments(table, "v", ["label"]).collect()}
        assert set(got) == {None, 1, 2}
        for l, r in got.items():
            own = points[0][points[1] == (l or 0)]
            assert r.n == len(own)
            np.testing.assert_allclose(r.means, own.mean(0), rtol=1e-12)
            np.testing.assert_allclose(full_matrix(np.asarray(r.covs), 6), np.cov(own.T, bias=True), rtol=1e-8, atol=1e-9)
    one = GM.array_moments(table, "v").collect()
    assert len(one) == 1 and one[0].n == 400


def test_moments_of_nothing_and_of_unequal_arrays(spark):
    none = spark.createDataFrame([], "g int, v array<double>")
    assert GM.array_moments(none, "v").collect() == [] and GM.array_moments(none, "v", ["g"]).collect() == []
    with pytest.raises(Exception):
        GM.array_moments(spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0])], "g int, v array<double>").coalesce(1), "v").collect()


def test_discriminant_solves_the_eigenproblem(points, table):
    x, label = points
    got = C.discriminant(table.withColumn("label", F.coalesce("label", F.lit(0))), "v", "label").collect()
    grand = x.mean(0)
    within = sum((x[label == l] - x[label == l].mean(0)).T @ (x[label == l] - x[label == l].mean(0)) for l in range(3))
    between = sum((label == l).sum() * np.outer(x[label == l].mean(0) - grand, x[label == l].mean(0) - grand) for l in range(3))
    w, v = np.linalg.eig(np.linalg.solve(within, between))
    order = np.argsort(-w.real)[:2]
    by_vector = {tuple(r.v): (r.axis_1, r.axis_2) for r in got}
    assert len(by_vector) == 400
    for j, i in enumerate(order):
        axis = v[:, i].real / np.linalg.norm(v[:, i].real)
        axis = axis if axis[np.argmax(np.abs(axis))] >= 0 else -axis
        np.testing.assert_allclose([by_vector[tuple(r.tolist())][j] for r in x], (x - grand) @ axis, rtol=1e-4, atol=1e-4)


def test_plan_does_not_grow_with_the_vector(spark):
    def size(d):
        df = spark.createDataFrame([(i % 2, [float((i * j) % 5 + i) for j in range(d)]) for i in range(40)], "label int, v array<double>")
        return C.discriminant(df, "v", "label", 1)._jdf.queryExecution().analyzed().treeString().count("\n")

    assert size(3) == size(200)


def test_components_match_correlation_axes(points, table):
    x = points[0]
    got = {tuple(r.v): r.components for r in C.pca(table, "v", 3).collect()}
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    w, v = np.linalg.eigh(np.corrcoef(x.T))
    for j, i in enumerate(np.argsort(-w)[:3]):
        axis = v[:, i] if v[np.argmax(np.abs(v[:, i])), i] >= 0 else -v[:, i]
        np.testing.assert_allclose([got[tuple(r.tolist())][j] for r in x], z @ axis, atol=1e-7)


def test_lasso_meets_the_optimality_conditions(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 7)) * [1, 5, 0.1, 1, 2, 1, 0] + 3
    x[:, 4] = x[:, 3] + 0.1 * rng.normal(size=300)
    y = x[:, 0] - 2 * x[:, 3] + rng.normal(size=300)
    alphas = [2.0, 0.3, 0.05, 0.001]
    rows = [(i % 4, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "part int, " + ", ".join(f"x{j} double" for j in range(7)) + ", y double")
    got = C.lasso_cv(df, "y", [f"x{j}" for j in range(7)], alphas, fold=F.col("part")).collect()

    def check(x, y, alpha, b0, b):
        s = x.std(0)
        grad = np.divide((x - x.mean(0)).T @ (y - b0 - x @ b) / len(y), s, out=np.zeros(7), where=s > 0)
        assert b[6] == 0
        for j in range(6):
            assert abs(grad[j] - alpha * np.sign(b[j])) < 1e-8 if b[j] else abs(grad[j]) <= alpha + 1e-8

    part = np.arange(300) % 4
    for r, alpha in zip(got, alphas):
        check(x, y, alpha, r.intercept, np.array(r.coefficients))
        for f in range(4):
            tx, ty = x[part != f], y[part != f]
            b = GM.lasso_path(np.cov(np.column_stack([tx, ty]).T, bias=True), alphas)[alphas.index(alpha)]
            b0 = ty.mean() - tx.mean(0) @ b
            check(tx, ty, alpha, b0, b)
            ox, oy = x[part == f], y[part == f]
            assert r.fold_r2[f] == pytest.approx(1 - ((oy - b0 - ox @ b) ** 2).sum() / ((oy - oy.mean()) ** 2).sum(), abs=1e-9)
    assert [r.best for r in got].index(True) == int(np.argmax([r.r2 for r in got])) and sum(r.best for r in got) == 1


def test_lasso_of_one_fold_and_of_nothing(spark):
    df = spark.createDataFrame([(float(i), float(2 * i)) for i in range(9)], "x double, y double")
    one = C.lasso_cv(df, "y", ["x"], [0.1], fold=F.lit(1)).first()
    assert one.r2 is None and not one.best and one.coefficients[0] < 2
    assert C.lasso_cv(df.limit(0), "y", ["x"], [0.1]).collect() == []
