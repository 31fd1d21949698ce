import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions.time import us
from pulsegrid.operators import ordered as O, windows as W
from pulsegrid.operators.sessions import time_slice


@pytest.fixture(scope="module")
def hot(stream):
    """One participant with nearly all rows over many days, some with few."""
    rng = np.random.default_rng(3)
    rows = [("hot", int(s), float(v)) for s, v in zip(np.sort(rng.choice(20 * 86400, 2000, replace=False)), rng.normal(size=2000))]
    rows += [("one", 5, 1.0)] + [("few", 86400 * i, float(i)) for i in range(4)]
    return stream(rows).withColumn("us", us("ts"))


def frame(df, *cols):
    return df.select("participant_id", "us", *cols).orderBy("participant_id", "us").toPandas()


def expected(hot):
    return hot.select("participant_id", "us", "value").orderBy("participant_id", "us").toPandas()


def test_neighbours_cross_slices(hot):
    got = frame(O.with_neighbour(hot, ["participant_id"], ["us"], {"prev": F.col("value")}, time_slice("us")), "prev")
    pd.testing.assert_series_equal(got.prev, expected(hot).groupby("participant_id").value.shift(1), check_names=False)
    got = frame(O.with_neighbour(hot, ["participant_id"], ["us"], {"nxt": F.col("value")}, time_slice("us"), forward=True), "nxt")
    pd.testing.assert_series_equal(got.nxt, expected(hot).groupby("participant_id").value.shift(-1), check_names=False)


def test_running_both_ways(hot):
    out = O.running(hot, ["participant_id"], ["us"], {"c": ("sum", F.col("value")), "top": ("max", F.col("value"))}, time_slice("us"),
                    ahead={"rest": ("count", F.lit(1))})
    got, want = frame(out, "c", "top", "rest"), expected(hot)
    g = want.groupby("participant_id")
    np.testing.assert_allclose(got.c, g.value.cumsum(), atol=1e-9)
    np.testing.assert_allclose(got.top, g.value.cummax())
    np.testing.assert_array_equal(got.rest, g.value.transform("size") - g.cumcount())


def test_frames_cross_blocks(hot):
    out = O.framed(hot, ["participant_id"], ["us"], 3, 2, lambda w: {"m": F.avg("value").over(w.rowsBetween(-3, 2))}, time_slice("us"), block=64)
    want = expected(hot).groupby("participant_id").value.apply(lambda s: pd.Series([s.iloc[max(0, i - 3): i + 3].mean() for i in range(len(s))]))
    np.testing.assert_allclose(frame(out, "m").m, want.to_numpy())
    assert out.count() == hot.count()


def test_quantiles_exact(hot):
    got = O.quantiles(hot, ["participant_id"], "value", {"q": 0.25, "m": 0.5}, slices=8).toPandas().set_index("participant_id")
    for pid, grp in expected(hot).groupby("participant_id"):
        assert got.loc[pid, "m"] == pytest.approx(np.median(grp.value))
        assert got.loc[pid, "q"] == pytest.approx(np.quantile(grp.value, 0.25))


def test_value_slices_are_balanced(hot):
    sizes = O.value_slices(hot.filter("participant_id = 'hot'"), ["participant_id"], "value", 8).groupBy("_slice").count().toPandas()
    assert len(sizes) == 8 and sizes["count"].max() < 2 * sizes["count"].min()


def test_salted_join_keeps_every_row_once(hot, spark):
    dim = hot.groupBy("participant_id").agg(F.count("*").alias("n"))
    out = O.salted_join(hot, dim, ["participant_id"])
    assert out.count() == hot.count()
    assert out.filter("participant_id = 'hot' and n <> 2000").isEmpty()


def test_savgol_matches_polynomial_fit(hot):
    got = W.savgol_5_3(hot.filter("participant_id = 'hot'"), "value").orderBy("us").toPandas()
    v = got.value.to_numpy()
    x = np.arange(5)
    for i in (0, 1, 2, 700, len(v) - 2, len(v) - 1):
        lo = min(max(i - 2, 0), len(v) - 5)
        assert got.smooth[i] == pytest.approx(np.polyval(np.polyfit(x, v[lo: lo + 5], 3), i - lo), abs=1e-8)


def test_percentile_counts_reference(stream, spark):
    ref = stream([("a", i, float(v)) for i, v in enumerate([1, 2, 2, 3])])
    q = spark.createDataFrame([("a", 2.0), ("a", 0.5), ("a", 9.0)], "participant_id string, value double")
    got = {r.value: r.percentile for r in W.percentile_in(ref, q, "value", ["participant_id"], slices=4).collect()}
    assert got == {2.0: 0.75, 0.5: 0.0, 9.0: 1.0}
