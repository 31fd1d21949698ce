import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import clustering as C, segment as SG, states as SM


def test_planted_breaks_are_found(stream):
    rng = np.random.default_rng(0)
    means = [(0, 0), (6, 0), (6, 6), (-4, 2)]
    rows = []
    for pid, sizes in (("a", [40, 30, 50, 40]), ("b", [25, 60, 20, 30])):
        t = 0
        for (mx, my), n in zip(means, sizes):
            for _ in range(n):
                rows.append((pid, t * 5000, float(rng.normal(mx)), float(rng.normal(my))))
                t += 1
    out = SG.greedy_segments(stream(rows, "x double, y double"), "x", "y", 3).collect()
    ends = {p: sorted(r["last"] for r in out if r.participant_id == p) for p in "ab"}
    for got, want in ((ends["a"], [40, 70, 120, 160]), (ends["b"], [25, 85, 105, 135])):
        assert len(got) == 4 and max(abs(g - w) for g, w in zip(got, want)) <= 1


def test_split_scan_needs_room(stream):
    assert SG.split_scan(stream([("a", i, 1.0, 2.0) for i in range(3)], "x double, y double"), "x", "y").isEmpty()


def blobs(spark, centres, n=40, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(p, float(rng.normal(x, 0.3)), float(rng.normal(y, 0.3)), i) for p in ("p", "q") for i, (x, y) in enumerate(centres) for _ in range(n)]
    return spark.createDataFrame(rows, "participant_id string, x double, y double, truth int")


def test_dp_means_finds_number_of_clusters(spark):
    out = C.dp_means(blobs(spark, [(0, 0), (8, 0), (0, 8)]), ["x", "y"], 9.0)
    assert [r.k for r in out.groupBy("participant_id").agg(F.countDistinct("cluster").alias("k")).collect()] == [3, 3]
    assert out.groupBy("participant_id", "truth").agg(F.countDistinct("cluster").alias("k")).filter("k > 1").isEmpty()


def test_grouped_kmeans_per_participant(spark):
    df = blobs(spark, [(0, 0), (8, 0)])
    out = C.kmeans_by(df, ["x", "y"], 2)
    assert out.count() == df.count()
    assert out.groupBy("participant_id", "truth").agg(F.countDistinct("cluster").alias("k")).filter("k > 1").isEmpty()
    agree = C.cluster_agreement(out.filter("participant_id = 'p'"), "truth", "cluster").first()
    assert agree.nmi == pytest.approx(1.0) and agree.vi == pytest.approx(0.0, abs=1e-9)
    assert C.macro_f1(out.filter("participant_id = 'p'"), "truth", "cluster").first().macro_f1 == 1.0


def test_hierarchy_splits_centred_scores(spark):
    out = C.hierarchy(blobs(spark, [(-4, -4), (4, -4), (4, 4)]), ["x", "y"], 3)
    assert out.select("cluster").distinct().count() == 3


def path_cost(costs, path, penalty):
    return sum(c[s] for c, s in zip(costs, path)) + penalty * sum(a != b for a, b in zip(path, path[1:]))


@pytest.mark.parametrize("penalty", [0.0, 1.5, 100.0])
def test_cheapest_path_is_optimal(spark, penalty):
    rng = np.random.default_rng(7)
    data = {s: rng.integers(0, 9, (n, 3)).astype(float) for s, n in (("u", 6), ("v", 1))}
    rows = [(s, i, [float(x) for x in row]) for s, arr in data.items() for i, row in enumerate(arr)]
    out = SM.min_cost_path(spark.createDataFrame(rows, "series string, t_us long, costs array<double>"), penalty, ["series"]).collect()
    for s, arr in data.items():
        path = [r.state for r in sorted((r for r in out if r.series == s), key=lambda r: r.t_us)]
        best = min(path_cost(arr, p, penalty) for p in itertools.product(range(3), repeat=len(arr)))
        assert path_cost(arr, path, penalty) == pytest.approx(best)
        assert all(r.cost == pytest.approx(best) for r in out if r.series == s)


def test_state_model_recovers_regimes(spark):
    rng = np.random.default_rng(8)
    rows = [("s", i, [float(rng.normal(0 if (i // 40) % 2 == 0 else 5)), float(rng.normal(0))]) for i in range(160)]
    out = SM.state_model(spark.createDataFrame(rows, "series string, t_us long, window array<double>"), 2, 3.0, ["series"])
    states = [r.state for r in out.orderBy("t_us").collect()]
    assert sum(a != b for a, b in zip(states, states[1:])) == 3


def greedy_counts(seq, n):
    found = {}
    for i in range(len(seq) - n + 1):
        gram = ">".join(seq[i:i + n])
        at = found.setdefault(gram, [])
        if not at or i - at[-1] >= n:
            at.append(i)
    return {g: len(v) for g, v in found.items()}


def plain_repeats(seq, least):
    """Every repeat whose neighbours differ on both sides, with occurrences apart from each other."""
    found = {}
    for n in range(2, len(seq)):
        at = {}
        for i in range(len(seq) - n + 1):
            at.setdefault(">".join(seq[i:i + n]), []).append(i)
        for gram, places in at.items():
            left = {seq[i - 1] if i else ("start", i) for i in places}
            right = {seq[i + n] if i + n < len(seq) else "end" for i in places}
            if len(places) > 1 and len(left) > 1 and len(right) > 1:
                kept = [places[0]]
                for i in places[1:]:
                    if i - kept[-1] >= n:
                        kept.append(i)
                if len(kept) >= least:
                    found[gram] = len(kept)
    return found


@pytest.mark.parametrize("least", [1, 2, 3])
def test_repeats_of_any_length(spark, least):
    rng = np.random.default_rng(21)
    walk = [str(x) for x in rng.integers(0, 4, 90)]
    seqs = {"a": list("ABCABDABCABDABCABDEABCABDABC"), "long": walk + ["x"] + walk[5:70] + ["y"] + walk[20:], "b": list("AABAAABAABAABAAAB"), None: list("XYXYXYXYXYX"), "one": ["A"], "none": list("ABCD")}
    rows = [(p, c, i * 3_600_000_000) for p, s in seqs.items() for i, c in enumerate(s)]
    df = spark.createDataFrame(rows, "participant_id string, state string, start_us long")
    got = {}
    for r in SM.maximal_motifs(df.filter("participant_id is not null"), "state", least).collect():
        assert r.length == r.motif.count(">") + 1
        got.setdefault(r.participant_id, {})[r.motif] = r.n
    assert least > 2 or max(m.count(">") for m in got["long"]) >= 64
    for p, s in seqs.items():
        if p is not None:
            assert got.get(p, {}) == plain_repeats(s, least)
    assert SM.maximal_motifs(df.limit(0), "state").collect() == []


def test_motifs_match_greedy_count(spark):
    rng = np.random.default_rng(9)
    seqs = {"a": list("ABABABABCABCABCBABAB"), "b": []}
    while len(seqs["b"]) < 150:
        c = "ABC"[rng.integers(3)]
        if not seqs["b"] or seqs["b"][-1] != c:
            seqs["b"].append(c)
    rows = [(p, c, i * 3_600_000_000) for p, s in seqs.items() for i, c in enumerate(s)]
    runs = spark.createDataFrame(rows, "participant_id string, state string, start_us long")
    out = {(r.participant_id, r.motif): r for r in SM.ngram_motifs(runs, "state", 2, 4, 1).collect()}
    for p, s in seqs.items():
        for n in (2, 3, 4):
            for gram, k in greedy_counts(s, n).items():
                assert out[(p, gram)].n == k, (p, gram)
    assert all(0 <= r.poisson_p <= 1 for r in out.values())


def test_cca_finds_shared_signal(spark):
    rng = np.random.default_rng(10)
    z = rng.normal(size=400)
    rows = [(float(v + 0.2 * a), float(a), float(-v + 0.2 * b), float(b)) for v, a, b in zip(z, rng.normal(size=400), rng.normal(size=400))]
    out = C.cca(spark.createDataFrame(rows, "x1 double, x2 double, y1 double, y2 double"), ["x1", "x2"], ["y1", "y2"]).orderBy("component").collect()
    assert out[0].correlation > 0.95 and out[1].correlation < 0.3


@pytest.mark.parametrize("shift", [0.0, 1e9])
def test_split_does_not_depend_on_the_level(stream, shift):
    draw = np.random.default_rng(1)
    rows = [("a", i, float(x) + shift, float(y) + shift) for i, (x, y) in enumerate(np.r_[draw.normal(0, 1, (100, 2)), draw.normal(4, 1, (100, 2))].round(3))]
    got = SG.split_scan(stream(rows, "x double, y double"), "x", "y").first()
    assert got.best in (99, 100, 101) and 0 < got.gain < 1e5


def test_paths_over_slices_are_optimal(spark):
    draw = np.random.default_rng(6)
    costs = draw.integers(0, 9, (25, 3)).astype(float)
    df = spark.createDataFrame([("a", i, c.tolist()) for i, c in enumerate(costs)] + [(None, 0, [1.0, 0.0, 2.0])], "series string, t_us long, costs array<double>")
    whole = SM.min_cost_path(df, 2.5, ["series"]).orderBy("series", "t_us").collect()
    for cut in ({"slice_width": 1}, {"slice_width": 4}, {"slice_width": 100}, {"max_rows": 1}, {"max_rows": 7}, {}):
        got = SM.min_cost_path(df, 2.5, ["series"], **cut).orderBy("series", "t_us").collect()
        assert got == whole
        path = [r.state for r in got if r.series == "a"]
        assert [r.switched for r in got if r.series == "a"] == [False, *[x != y for x, y in zip(path, path[1:])]]
        value = costs[0]
        for c in costs[1:]:
            value = np.minimum(value, value.min() + 2.5) + c
        paid = sum(costs[i][s] for i, s in enumerate(path)) + 2.5 * sum(a != b for a, b in zip(path, path[1:]))
        assert paid == pytest.approx(value.min()) and got[0].cost is not None
        assert [r.state for r in got if r.series is None] == [1]


def test_many_series_of_any_length_walk_together(spark):
    """Each of 300 series gets the path it has alone, in small and large batches, with a column carried along."""
    draw = np.random.default_rng(12)
    data = {f"s{i}": draw.integers(0, 9, (int(n), 4)).astype(float) for i, n in enumerate(draw.integers(1, 40, 300))}
    rows = [(s, i, c.tolist(), f"{s}-{i}") for s, arr in data.items() for i, c in enumerate(arr)]
    df = spark.createDataFrame(rows, "series string, t_us long, costs array<double>, mark string")
    for cut in ({}, {"max_rows": 16}):
        got = {}
        for r in SM.min_cost_path(df, 3.0, ["series"], carry=["mark"], **cut).collect():
            assert r.mark == f"{r.series}-{r.t_us}"
            got.setdefault(r.series, {})[r.t_us] = r
        for s, arr in data.items():
            path = [got[s][i].state for i in range(len(arr))]
            value = arr[0]
            for c in arr[1:]:
                value = np.minimum(value, value.min() + 3.0) + c
            assert path_cost(arr, path, 3.0) == pytest.approx(value.min()) == got[s][0].cost


def test_unfinished_fits_raise(spark):
    rows = spark.createDataFrame([("a", float(i), float(i * i % 7)) for i in range(12)], "participant_id string, x double, y double")
    with pytest.raises(RuntimeError):
        C.dp_means(rows, ["x", "y"], 0.5, rounds=1)


def test_groups_without_spread_keep_a_row(spark):
    rows = [("a", float(i), float(i % 3)) for i in range(9)] + [("b", 1.0, float(i)) for i in range(4)]
    got = {r.g: r.correlation for r in C.cca(spark.createDataFrame(rows, "g string, x double, y double"), ["x"], ["y"], 0.01, ["g"]).collect()}
    assert got["b"] is None and got["a"] is not None


def test_kmeans_reads_whole_array_column(spark):
    rows = [(1, [1.0, 1.0, 1.0, 1.0, float(i % 2) * 9 + i / 100]) for i in range(8)] + [(1, None), (1, [1.0, 1.0, 1.0, 1.0, None])]
    df = spark.createDataFrame(rows, "label int, v array<double>")
    got = C.kmeans_by(df, "v", 2, ["label"]).collect()
    assert len(got) == 8 and len({(r.cluster, r.v[4] > 5) for r in got}) == 2 and max(r.distance2 for r in got) < 0.01
    as_columns = C.kmeans_by(df.dropna().select("label", *[df.v[i].alias(f"v{i}") for i in range(5)]), [f"v{i}" for i in range(5)], 2, ["label"]).collect()
    assert sorted(round(r.distance2, 9) for r in got) == sorted(round(r.distance2, 9) for r in as_columns)


@pytest.mark.parametrize("name", ["permutation_change", "synchrony"])
def test_change_queries_draw_the_default_number_of_shuffles(monkeypatch, spark, name):
    from pulsegrid.plans import q_stats

    seen = []
    monkeypatch.setattr(q_stats.ST, "change_test", lambda *a, **options: seen.append(options.get("shuffles", 100)))
    monkeypatch.setattr(q_stats.ST, "change_score", lambda *a: None)
    monkeypatch.setattr(q_stats.ST, "synchrony", lambda *a: None)

    class Tables:
        readings = spark.sql("select timestamp_ntz'2024-01-01 00:00:00' ts, 'click' state")

    getattr(q_stats, name)(Tables)
    assert seen and set(seen) == {100}


@pytest.mark.parametrize("held", [1, 1 << 20])
def test_large_groups_settle_as_small_ones_do(monkeypatch, spark, held):
    rng = np.random.default_rng(9)
    rows = [(f"g{g}", i, [float(x) for x in rng.normal(i % 3 * 4 * (g < 2), 1, 3)]) for g, n in enumerate((90, 70, 30, 2)) for i in range(n)] + [(None, 0, [1.0, 2.0, 3.0]), ("g0", 99, None)]
    df = spark.createDataFrame(rows, "g string, i int, v array<double>")
    take = lambda: sorted((r.g, r.i, r.cluster, round(r.distance2, 9)) for r in C.kmeans_by(df, "v", 3, ["g"]).collect())
    inside = take()
    monkeypatch.setattr(C, "BLOCK_ROWS", 40)
    monkeypatch.setattr(C, "HELD_DOUBLES", held)
    assert take() == inside and len(inside) == 192
    pooled = C.kmeans_by(df.filter("g = 'g0'"), "v", 3, []).collect()
    assert sorted((r.i, r.cluster) for r in pooled) == [(i, c) for g, i, c, _ in inside if g == "g0"]


def test_rounds_of_kmeans_leave_rows_where_they_are(monkeypatch, spark):
    """Before, each round shuffled all rows."""
    monkeypatch.setattr(C, "BLOCK_ROWS", 40)
    monkeypatch.setattr(C, "_sums_of_blocks", lambda blocks, centres, run=C._sums_of_blocks: plans.append(blocks) or run(blocks, centres))
    plans = []
    rng = np.random.default_rng(10)
    df = spark.createDataFrame([("g", [float(x) for x in rng.normal(0, 1, 2)]) for _ in range(200)], "g string, v array<double>")
    assert C.kmeans_by(df, "v", 4, ["g"]).count() == 200
    assert len(plans) > 3 and len({id(b) for b in plans}) == 1 and plans[0].count() <= C.SALTS


def test_state_model_of_cut_series_is_that_of_whole_ones(monkeypatch, spark):
    rng = np.random.default_rng(11)
    rows = [(s, i, [float(rng.normal(3 * (i // 25 % 3))), float(rng.normal(0))], i % 7) for s, n in (("a", 300), ("b", 120), ("c", 1), (None, 30)) for i in range(n)]
    df = spark.createDataFrame(rows, "series string, t_us long, window array<double>, extra int")
    take = lambda: sorted(map(str, SM.state_model(df, 3, 2.0, ["series"]).collect()))
    whole = take()
    monkeypatch.setattr(SM, "STEP_ROWS", 40)
    turns = []
    monkeypatch.setattr(SM._Blocks, "turn", lambda self, *a, run=SM._Blocks.turn: turns.append(self.blocks.count()) or run(self, *a))
    assert take() == whole and len(whole) == 451
    # windows are packed once: before, every round shuffled and wrote all of them
    assert len(set(turns)) == 1 and 10 <= turns[0] < 60


def plain_walk(costs, penalty):
    """One row after the other: stay unless another state is cheaper, the lowest of equal ones."""
    value, back = costs[0], []
    for row in costs[1:]:
        switch = value.min() + penalty
        back.append([s if v <= switch else int(value.argmin()) for s, v in enumerate(value)])
        value = np.minimum(value, switch) + row
    out = [int(value.argmin())]
    for b in reversed(back):
        out.append(b[out[-1]])
    return out[::-1], value.min()


@pytest.mark.parametrize("penalty", [0.0, 2.0, 50.0])
def test_series_cut_into_pieces_walk_the_same_path(monkeypatch, penalty):
    """Ties included; a long series takes as many steps as a piece has rows, before it took one for each of its rows."""
    monkeypatch.setattr(SM, "PIECE", 7)
    steps = []
    monkeypatch.setattr(SM._Paths, "forward", lambda self, *a, run=SM._Paths.forward, **b: steps.append(len(self.active)) or run(self, *a, **b))
    rng = np.random.default_rng(4)
    sizes = [300, 1, 7, 50, 8]
    for costs in (rng.integers(0, 4, (sum(sizes), 3)).astype(float), rng.normal(size=(sum(sizes), 3)) ** 2):
        starts = np.cumsum([0, *sizes])[:-1]
        state, paid = SM._Pieces(costs, starts, penalty).walk()
        for i, (a, n) in enumerate(zip(starts, sizes)):
            path, cost = plain_walk(costs[a : a + n], penalty)
            assert state[a : a + n].tolist() == path and paid[i] == pytest.approx(cost)
    assert max(steps) <= 7


def test_rounds_of_state_model_write_no_table(monkeypatch, spark):
    rng = np.random.default_rng(11)
    rows = [(s, i, [float(rng.normal(2 * (i // 25 % 3))), float(rng.normal(0))]) for s, n in (("a", 300), ("b", 120), (None, 30)) for i in range(n)]
    df = spark.createDataFrame(rows, "series string, t_us long, window array<double>")
    written, turns = [], []
    monkeypatch.setattr(SM, "cut_lineage", lambda x, run=SM.cut_lineage: written.append(x) or run(x))

    def turn(self, *a, run=SM._Blocks.turn):
        before = len(written)
        out = run(self, *a)
        turns.append(len(written) - before)
        return out

    monkeypatch.setattr(SM._Blocks, "turn", turn)
    assert SM.state_model(df, 3, 2.0, ["series"]).count() == 450
    assert len(turns) > 1 and not any(turns)
