import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions.time import us
from pulsegrid.operators import filters as FL, grid as G, impute as IM, intervals as I, sessions as S, topk as TK, windows as W

M = 60_000_000
H = 60 * M


def rel(df, us0, *cols):
    """Times relative to the first day, in seconds."""
    return [tuple((v - us0) / 1e6 if c.endswith("_us") and v is not None else v for c, v in zip(cols, r)) for r in df.select(*cols).orderBy(*cols).collect()]


def test_sessions_split_only_above_gap(stream, us0):
    df = stream([("a", 0, 1.0), ("a", 100, 3.0), ("a", 201, 5.0), ("b", 7, 2.0), ("a", 86400 * 2, 1.0)])
    out = S.sessions(df, 100, measures={"m": ("avg", F.col("value")), "sd": ("std", F.col("value")), "f": ("first", F.col("value"))})
    assert rel(out, us0, "participant_id", "start_us", "end_us", "n", "m", "sd", "f") == [
        ("a", 0.0, 100.0, 2, 2.0, 1.0, 1.0), ("a", 201.0, 201.0, 1, 5.0, 0.0, 5.0), ("a", 172800.0, 172800.0, 1, 1.0, 0.0, 1.0), ("b", 7.0, 7.0, 1, 2.0, 0.0, 2.0)]


def test_session_over_many_slices_is_one(stream, us0):
    df = stream([("a", 3600 * h, 1.0) for h in range(100)])
    assert rel(S.sessions(df, 3600), us0, "start_us", "end_us", "n") == [(0.0, 99 * 3600.0, 100)]
    assert S.sessions(df, 3599).agg(F.sum("n")).first()[0] == 100


def test_state_runs_worked_example(stream, us0):
    states = [1, 1, 1, 2, 2, 2, 3, 3, 3, 1, 1, 1, 1]
    df = stream([("a", 40000 * i, s) for i, s in enumerate(states)], "state int")
    out = S.state_runs(df, "state")
    assert [(s / 40000, e / 40000, k) for s, e, k in rel(out, us0, "start_us", "end_us", "state")] == [(0, 2, 1), (3, 5, 2), (6, 8, 3), (9, 12, 1)]


def test_cycle_starts_need_rest(stream):
    on = [0, 0, 0, 1, 1, 0, 0, 1, 0, 0, 0, 1, 0]
    df = stream([("a", i, bool(v)) for i, v in enumerate(on)], "on boolean")
    assert [(r.step, r.cycle_steps) for r in S.cycle_starts(df, "on").orderBy("step").collect()] == [(4, 8), (12, None)]


def test_day_runs(spark):
    days = spark.createDataFrame([("a", d) for d in (1, 2, 3, 5, 8, 9)], "participant_id string, day long")
    assert [tuple(r) for r in S.work_runs(days).orderBy("first_day").collect()] == [("a", 1, 3, 3), ("a", 8, 9, 2)]


def test_centered_buckets_share_edges(stream, us0):
    df = stream([("a", 30, 10.0), ("a", 40, 20.0), ("a", 200, 5.0)])
    out = G.resample_centered(df, 60, ["value"])
    assert rel(out, us0, "t_us", "value") == [(0.0, None), (60.0, 15.0), (180.0, None)]


def test_whole_days_cut_midnight(stream, us0):
    df = stream([("a", -10, 1.0), ("a", 10, 3.0)])
    assert rel(G.resample_centered(df, 60, ["value"], min_n=0, whole_days=True), us0, "t_us", "value") == [(0.0, 3.0)]


def test_overlap_and_label(stream, us0):
    df = stream([("a", s, 1.0) for s in (0, 1, 2, 59)])
    assert rel(G.resample_overlap(df, 60, 0, ["value"]), us0, "t_us", "value") == [(0.0, 1.0), (60.0, None)]
    out = G.resample_multi(stream([("a", 0, 0.0), ("a", 10, 4.0), ("a", 20, 6.0)]), 60, 0, {"value": "full"}, threshold=1)
    assert rel(out, us0, "t_us", "value_mean")[-1] == (60.0, 5.0)


@pytest.mark.parametrize("seconds,want", [(0, [(0.0, 0.0, 1)]), (60, [(0.0, 30.0, 1), (60.0, 30.0, 1)]), (30, [(0.0, 30.0, 1), (60.0, 0.0, 1)])])
def test_spread_sessions(stream, us0, seconds, want):
    out = G.spread_sessions(stream([("a", 30, seconds)], "seconds int").withColumnRenamed("seconds", "sec"), "sec")
    assert rel(out, us0, "t_us", "seconds", "sessions") == want


def test_foreground_grid(stream, us0):
    df = stream([("a", 1, 1.0), ("a", 2, 1.0), ("a", 130, 1.0)])
    got = rel(G.foreground_share(df), us0, "t_us", "foreground")
    assert [t for t, _ in got] == [0.0, 60.0, 120.0] and got[1][1] == pytest.approx(0.01 / 60)


def test_locate_prefers_strength_then_name(stream, us0):
    df = stream([("a", 0, "ns", 150), ("a", 5, "pat", 150), ("a", 61, "med", 180)], "place string, rssi int")
    got = {r.t_us: r.location for r in G.locate(df, "place", "rssi").collect()}
    assert got[us0] == "med" and got[us0 - M] == "ns"


def test_locate_unknown_on_grid(stream, spark, us0):
    df = stream([("a", 0, "ns", 150)], "place string, rssi int")
    spans = spark.createDataFrame([("a", us0, us0 + 10 * M)], "participant_id string, start_us long, end_us long")
    out = {(r.t_us - us0) / M: r.location for r in G.locate(df, "place", "rssi", spans=spans).collect()}
    assert out[0] == "ns" and out[5] == "unknown" and len(out) == 11


def test_hrv_of_known_beats(stream):
    df = stream([("a", i, v, 0) for i, v in enumerate([200, 210, 190, 200])], "rr0 int, rr1 int")
    r = G.hrv(df, 60, ["rr0", "rr1"], threshold=1).first()
    nn = np.array([800, 840, 760, 800.0])
    assert (r.n, r.mean_nni, r.range_nni, r.nni_50) == (4, 800.0, 80.0, 1)
    assert r.sdnn == pytest.approx(nn.std(ddof=1)) and r.rmssd == pytest.approx(np.sqrt((np.diff(nn) ** 2).mean()))


def test_pad_noise_is_repeatable(stream, spark):
    df = spark.range(500).select(F.lit("a").alias("participant_id"), F.col("id").alias("t_us"), F.lit(None).cast("double").alias("v"))
    a, b = (G.pad(df, ["v"], -50.0, noise=2.0, seed=1).toPandas().sort_values("t_us").v.to_numpy() for _ in range(2))
    assert (a == b).all() and abs(a.mean() + 50) < 0.5 and 1.5 < a.std() < 2.5


def ivals(spark, us0, rows):
    return spark.createDataFrame([(p, us0 + int(a * 1e6), us0 + int(b * 1e6)) for p, a, b in rows], "participant_id string, start_us long, end_us long")


def test_closed_ends(stream, spark, us0):
    pts = stream([("a", s, 1.0) for s in (0, 10, 20)])
    iv = ivals(spark, us0, [("a", 0, 10), ("a", 10, 20), ("b", 0, 99), ("a", 5, 4)])
    counts = {c: I.points_in_intervals(pts, iv, closed=c, bucket_seconds=7).count() for c in ("both", "left", "right", "neither")}
    assert counts == {"both": 4, "left": 2, "right": 2, "neither": 0}


def test_interval_join_equals_plain_join(stream, spark, us0):
    rng = np.random.default_rng(1)
    pts = stream([("a", int(s), 1.0) for s in rng.integers(0, 500000, 300)])
    spans = [("a", int(a), int(a + d)) for a, d in zip(rng.integers(0, 500000, 60), rng.integers(0, 90000, 60))]
    iv = ivals(spark, us0, spans)
    at = [r[0] for r in pts.select(us("ts")).collect()]
    want = sum(us0 + a * 1_000_000 <= u <= us0 + b * 1_000_000 for u in at for _, a, b in spans)
    assert I.points_in_intervals(pts, iv).count() == want


def test_nearest_takes_earlier_on_tie(spark, us0):
    a, b = ivals(spark, us0, [("a", 100, 101), ("a", 1000, 1001)]), ivals(spark, us0, [("a", 90, 91), ("a", 110, 111), ("a", 1400, 1402)])
    assert rel(I.nearest_within(a, b, 300), us0, "start_us", "b_start_us") == [(100.0, 90.0)]


def test_proximity_is_strict(spark, us0):
    sleep, work = ivals(spark, us0, [("a", 36000, 72000)]), ivals(spark, us0, [("a", 72000, 80000), ("a", 72000 + 9 * 3600, 72000 + 10 * 3600), ("a", 0, 36000)])
    r = I.interval_proximity(sleep, work).first()
    assert (r.before_work_nearest, r.before_work, r.after_work) == (0, 1, 0)


def test_anti_join_and_night_windows(stream, spark, us0):
    iv = ivals(spark, us0, [("a", 0, 10), ("a", 20, 30)])
    assert rel(I.intervals_without_points(iv, stream([("a", 10, 1.0)])), us0, "start_us") == [(20.0,)]
    days = spark.createDataFrame([("a", d) for d in (1, 2, 5)], "participant_id string, day long")
    assert [r.start_us // H for r in I.work_windows(days, "night", 12).collect()] == [24 + 19]


def test_pair_lags_skip_predecessor(stream):
    df = stream([("a", s, k) for s, k in ((0, "x"), (10, "y"), (30, "x"), (60, "y"))], "kind string").withColumn("us", us("ts"))
    got = sorted((r.from_type, r.to_type, r.n, r.lag_us / 1e6, round(r.lag2, 3)) for r in I.pair_lags(df, ["x", "y"], "kind", "us", ["participant_id"]).collect())
    assert got == [("x", "x", 1, 30.0, 900.0), ("x", "y", 1, 60.0, 3600.0), ("y", "y", 1, 50.0, 2500.0)]


def test_awake_periods_move_only_on_emission(spark, us0):
    h = 3600
    sleeps = [("a", 0, 7 * h), ("a", 10 * h, 11 * h), ("a", 24 * h, 25 * h), ("a", 36 * h, 43 * h), ("a", 60 * h, 61 * h), ("a", 60 * h, 68 * h)]
    got = rel(W.awake_periods(ivals(spark, us0, sleeps)), us0, "start_us", "end_us")
    # 24h comes over 10h after the kept long sleep; 36h is only 11h after a short one; 60h is 35h after it
    assert got == [(0.0, 24.0 * h), (24.0 * h, 60.0 * h)]
    assert W.awake_periods(ivals(spark, us0, sleeps[:3])).isEmpty()


def test_between_sleep_spans_chain(stream, spark, us0):
    h = 3600
    data = stream([("a", 0, 1.0), ("a", 50 * h, 1.0)])
    sleeps = ivals(spark, us0, [("a", 5 * h, 6 * h), ("a", 12 * h, 20 * h), ("a", 25 * h, 26 * h), ("a", 40 * h, 47 * h)])
    assert rel(W.between_sleep_spans(sleeps, data), us0, "start_us", "end_us") == [(0.0, 12.0 * h), (20.0 * h, 40.0 * h), (47.0 * h, 50.0 * h)]


def test_knn_fill_by_feature(stream):
    rows = [("a", i, v, f) for i, (v, f) in enumerate([(10.0, 1.0), (20.0, 2.0), (None, 2.1), (40.0, 9.0), (None, 100.0)])]
    out = {r.f: r.value for r in IM.fill_knn(stream(rows, "value double, f double"), "value", "f", k=2).collect()}
    w = 1 / (np.array([0.1, 1.1]) + 1e-6)
    assert out[2.1] == pytest.approx((w * [20, 10]).sum() / w.sum()) and out[100.0] is not None


def test_regression_fill_recovers_line(stream):
    rows = [("a", i, None if i % 7 == 3 else 2.0 * i + 1, float(i)) for i in range(60)]
    out = IM.fill_regression(stream(rows, "y double, x double"), ["y", "x"], 2).toPandas()
    np.testing.assert_allclose(out.y, 2 * out.x + 1, atol=1e-3)


def test_mask_delta_and_chunks(stream):
    df = stream([("a", 0, 1.0), ("a", 5, None), ("a", 9, None), ("a", 20, 2.0)])
    got = [(r["mask"], r.delta) for r in W.mask_and_delta(df, "value").orderBy("ts").collect()]
    assert got == [(1, 0.0), (0, 5.0), (0, 9.0), (1, 20.0)]
    assert [r.value for r in W.chunks(df, ["value"], 3).collect()] == [[1.0, None, None]]


def test_filters_and_sampling(stream, spark):
    df = stream([("a", i, float(i)) for i in range(5)] + [("b", 0, 1.0)])
    assert FL.having_count(df, 2).count() == 5
    days = spark.createDataFrame([(p, d) for p in "ab" for d in range(9)], "participant_id string, day long")
    one, two = (sorted(map(tuple, TK.sample_days(days, 4, 5, ["participant_id"]).collect())) for _ in range(2))
    assert one == two and len(one) == 8
