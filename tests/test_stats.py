import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import special as SP
from pulsegrid.operators import aggregates as A, regression as R, stats as ST, windows as W


def test_tail_probabilities():
    assert SP.t_two_sided([2.228138852], [10])[0] == pytest.approx(0.05, abs=1e-8)
    assert SP.t_two_sided([0.0], [3])[0] == pytest.approx(1.0)
    assert SP.f_upper([4.964602744], [1], [10])[0] == pytest.approx(0.05, abs=1e-8)
    assert SP.f_upper([3.708264820], [3], [10])[0] == pytest.approx(0.05, abs=1e-8)
    np.testing.assert_allclose(SP.chi2_upper([3.841458821, 18.30703805, 0.0], [1, 10, 4]), [0.05, 0.05, 1.0], atol=1e-8)


def test_kolmogorov_and_digamma(spark):
    r = spark.range(1).select(SP.kolmogorov_p(F.lit(1.3580986)).alias("p"), SP.kolmogorov_p(F.lit(0.0)).alias("one"), SP.digamma(F.lit(1.0)).alias("d")).first()
    assert r.p == pytest.approx(0.05, abs=1e-5) and r.one == 1.0 and r.d == pytest.approx(-0.5772156649, abs=1e-9)


def test_ks_against_brute_force(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=150).round(1), (rng.normal(size=220) + 0.4).round(1)
    df = spark.createDataFrame([("a", float(v)) for v in a] + [("b", float(v)) for v in b], "g string, v double")
    r = ST.ks_2samp(df, "g", "a", "b", ["v"], slices=8).first()
    grid = np.unique(np.r_[a, b])
    want = max(abs((a <= x).mean() - (b <= x).mean()) for x in grid)
    assert r.d == pytest.approx(want) and 0 <= r.p <= 1 and (r.n_a, r.n_b) == (150, 220)


def test_bh_matches_step_up(spark):
    p = [0.01, 0.02, 0.02, 0.04, 0.2, 0.9]
    out = ST.bh_adjust(spark.createDataFrame([(i, v) for i, v in enumerate(p)], "i int, p double"), "p", 0.05, slices=4).orderBy("i").collect()
    m, s = len(p), np.array(p)
    want = [min(1.0, min(s[j] * m / (j + 1) for j in range(i, m))) for i in range(m)]
    want[1] = want[2] = min(want[1], want[2])
    np.testing.assert_allclose([r.p_adjusted for r in out], want)
    assert [r.reject for r in out] == [w <= 0.05 for w in want]


def test_spearman_with_ties(spark):
    x, y = [1, 2, 2, 4, 5, 5, 7], [2, 1, 3, 3, 6, 5, 9]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    rank = lambda v: np.array([sum(w < u for w in v) + (sum(w == u for w in v) + 1) / 2 for u in v])
    assert ST.spearman(df, ["x", "y"]).first().r == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1])


def test_constant_columns_give_null(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(5)], "x double, y double")
    assert ST.pearson(df, ["x", "y"]).first().r is None
    assert ST.hist_mi(df, "x", "y", 4).first().mi == pytest.approx(0.0)


def test_ols_and_granger(spark):
    rng = np.random.default_rng(2)
    n = 200
    x = rng.normal(size=n)
    y = np.r_[0, x[:-1]] * 0.8 + rng.normal(size=n) * 0.3
    df = spark.createDataFrame([("a", i, float(u), float(v)) for i, (u, v) in enumerate(zip(x, y))], "participant_id string, day long, x double, y double")
    g = {r.cause: r for r in R.granger(df, "x", "y", 2).collect()}
    assert g["x"].f_p < 1e-6 < 0.001 < g["y"].f_p and g["x"].chi2_p < 1e-6
    out = R.ols_by(df.withColumn("z", 3 * F.col("x") - 2 * F.col("y") + 1), "z", ["x", "y"]).collect()
    assert {r.x: round(r.beta, 8) for r in out} == {"x": 3.0, "y": -2.0} and out[0].r2 == pytest.approx(1.0)


def test_cosinor_recovers_rhythm(spark):
    hours = np.arange(0, 72, 0.5)
    rows = [("a", float(h), 60 + 8 * math.cos(2 * math.pi * (h - 15) / 24)) for h in hours]
    r = R.cosinor(spark.createDataFrame(rows, "participant_id string, h double, v double"), "v", F.col("h")).first()
    assert (round(r.mesor, 6), round(r.amplitude, 6), round(r.peak_hour, 6)) == (60.0, 8.0, 15.0)


def test_knn_entropy_of_gaussian(spark):
    v = np.random.default_rng(4).normal(scale=2.0, size=4000)
    r = ST.knn_entropy(spark.createDataFrame([("a", float(x)) for x in v], "participant_id string, v double"), "v", 3).first()
    assert r.entropy == pytest.approx(0.5 * math.log(2 * math.pi * math.e * 4), abs=0.08)


def test_histogram_information_of_gaussians(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=20000)
    y = 0.8 * x + 0.6 * rng.normal(size=20000)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    assert ST.hist_mi(df, "x", "y", 24).first().mi == pytest.approx(-0.5 * math.log(1 - 0.64), abs=0.06)


@pytest.fixture(scope="module")
def days(spark):
    rng = np.random.default_rng(6)
    rows = []
    for d in range(16):
        for b in range(4):
            for _ in range(6):
                early = d < 8
                rows.append(("a", d, b, "x" if rng.random() < (0.9 if early and b == 1 else 0.3) else "y"))
    return spark.createDataFrame(rows, "participant_id string, day long, bin int, state string")


def test_change_test_matches_brute_force(days):
    got = {(r.window, r.bin): r.distance for r in ST.change_test(days, "state", ["x", "y"], 4, agg=4, slide=4, shuffles=0).collect()}
    table = days.toPandas()

    def pdf(ds):
        c = np.array([[((table.day.isin(ds)) & (table.bin == b) & (table.state == s)).sum() + 1 for s in "xy"] for b in range(4)], float)
        p = c / c.sum(1, keepdims=True)
        p = (p + np.roll(p, 1, 0) + np.roll(p, -1, 0)) / 3
        return p / p.sum(1, keepdims=True)

    for w in range(3):
        p, q = pdf(range(w * 4, w * 4 + 4)), pdf(range(w * 4 + 4, w * 4 + 8))
        for b in range(4):
            assert got[(w, b)] == pytest.approx((((p - q) * np.log(p / q)).sum(1) / 2)[b])
    assert len(got) == 12


def test_change_scores_are_probabilities(days):
    test = ST.change_test(days, "state", ["x", "y"], 4, agg=4, slide=4, shuffles=50, seed=1)
    rows = ST.change_score(test, 0.1).collect()
    assert all(0 <= r.p <= 1 for r in rows)
    middle = {r.bin: r.p for r in rows if r.window == 1}
    assert middle[1] <= 0.1  # the planted change
    again = ST.change_score(ST.change_test(days, "state", ["x", "y"], 4, agg=4, slide=4, shuffles=50, seed=1), 0.1)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again.collect()))
    overlap = ST.change_test(days, "state", ["x", "y"], 4, agg=4, slide=2, shuffles=2, mode="overlap")
    assert overlap.filter("distance < -1e-12").isEmpty() and not overlap.isEmpty()


def test_pdfs_sum_to_one(days):
    ts = days.withColumn("ts", F.timestamp_micros(F.col("bin") * 21_600_000_000))
    pdf = W.circular_smooth(A.tod_pdf(ts, "state", ["x", "y"], 4), 4, ["participant_id"], "state")
    assert all(r[2] == pytest.approx(1.0) for r in pdf.groupBy("participant_id", "bin").agg(F.sum("p")).collect())


@pytest.mark.parametrize("shift", [0.0, 1e8, 1e9])
def test_anova_and_slice_variance_do_not_depend_on_the_level(spark, stream, shift):
    from pulsegrid.operators import sessions as S

    draw = np.random.default_rng(4)
    groups = [draw.normal(m, 1.0, 30).round(3) for m in (0.0, 0.5, 2.0)]
    rows = [(str(g), float(v) + shift) for g, vs in enumerate(groups) for v in vs]
    r = ST.anova(spark.createDataFrame(rows, "g string, v double"), "g", ["v"]).first()
    grand = np.mean(np.concatenate(groups))
    between = sum(len(g) * (g.mean() - grand) ** 2 for g in groups) / 2
    within = sum(((g - g.mean()) ** 2).sum() for g in groups) / 87
    assert r.f == pytest.approx(between / within, rel=1e-4) and 0 < r.p < 1e-6
    values = draw.normal(size=60).round(3)
    df = stream([("a", i * 7200, float(v) + shift) for i, v in enumerate(values)])
    sd = S.sessions(df, 3 * 3600, measures={"sd": ("std", F.col("value"))}).first().sd
    assert sd == pytest.approx(values.std(), rel=1e-5)


def test_poisson_tails():
    exact = lambda n, lam: math.fsum(math.exp(-lam + i * math.log(lam) - math.lgamma(i + 1)) for i in range(n, n + 4000))
    for n, lam in ((1, 0.5), (5, 2.0), (1600, 1499.8), (2000, 1499.8), (3000, 1499.8)):
        assert SP.poisson_upper([n], [lam])[0] == pytest.approx(exact(n, lam), rel=1e-7)


def test_change_windows_keep_absent_days(spark):
    rows = [("a", d, 0, "x") for d in range(20) if d != 9]
    out = ST.change_test(spark.createDataFrame(rows, "participant_id string, day long, bin int, state string"), "state", ["x", "y"], 1, agg=4, slide=2, shuffles=0, smooth=False)
    assert sorted(r.window for r in out.collect()) == list(range(8))


def test_rows_without_statistics_stay(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0)], "participant_id string, v double")
    assert sorted((r.participant_id or "", r.v) for r in W.normalize(df, ["v"]).fillna(0.0).collect()) == [("", 0.0), ("a", pytest.approx(-0.7071, abs=1e-4)), ("a", pytest.approx(0.7071, abs=1e-4))]
    empty = df.withColumn("v", F.lit(None).cast("double"))
    assert [r.cohort for r in W.split_cohort(empty, "v").collect()] == [None] * 3


@pytest.mark.parametrize("correct", [False, True])
def test_packed_windows_score_as_rows_of_shuffles_do(spark, correct):
    rng = np.random.default_rng(5)
    rows = [(f"p{p}", int(d) + p, int(b), "xyz"[s]) for p in range(3) for d, b, s in zip(rng.integers(0, 15, 120), rng.integers(0, 3, 120), rng.integers(0, 3, 120))]
    days = spark.createDataFrame(rows, "participant_id string, day long, bin int, state string")
    run = lambda packed: ST.change_test(days, "state", ["x", "y", "z"], 3, agg=4, slide=2, shuffles=40, seed=3, packed=packed)
    long, packed = run(False), run(True)
    assert packed.count() * 41 * 3 == long.count() > 0
    a, b = ST.change_score(long, 0.2, correct=correct), ST.change_score(packed, 0.2, correct=correct)
    assert sorted(a.columns) == sorted(b.columns)
    assert sorted(a.collect()) == sorted(b.select(a.columns).collect())
    # neither the shuffles nor the scores of a packed window cross the network
    plan = packed._jdf.queryExecution().toString(), ST.change_score(packed, 0.2)._jdf.queryExecution().toString()
    assert plan[0].count("Exchange") == plan[1].count("Exchange")


def test_shuffled_distances_of_many_windows_are_those_of_one():
    rng = np.random.default_rng(6)
    counts = rng.integers(0, 9, (5, 6, 8)).astype(float)
    orders = ST._day_orders(np.arange(3, 9), 20, 1)
    together = ST._shuffled_distances(orders, counts, 4, 4, 4, 2, True)
    for i in range(5):
        assert (ST._shuffled_distances(orders, counts[i : i + 1], 4, 4, 4, 2, True) == together[i]).all()
