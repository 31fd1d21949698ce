import math
import random

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import excitation as E

SECOND = 1_000_000


def planted(draw, base, effect, decay, until):
    """Events of a branching process: immigrants by ``base``, followers by ``effect[from][to]`` and exponential lags."""
    todo, out = [], []
    for k, rate in enumerate(base):
        t = draw.expovariate(rate)
        while t < until:
            todo.append((t, k))
            t += draw.expovariate(rate)
    while todo:
        t, k = todo.pop()
        out.append((t, k))
        for to, mean in enumerate(effect[k]):
            n, u = 0, draw.expovariate(1.0)
            while u < mean:
                n, u = n + 1, u + draw.expovariate(1.0)
            todo += [(s, to) for s in (t + draw.expovariate(1 / decay) for _ in range(n)) if s < until]
    return sorted(out)


def plain_fit(series, d, decay, rounds):
    """Textbook rounds over all pairs of events."""
    watched = sum(s[-1][0] - s[0][0] for s in series)
    kept = [sum(1 - math.exp(-(s[-1][0] - t) / decay) for s in series for t, k in s if k == j) for j in range(d)]
    base = [0.5 * sum(k == i for s in series for _, k in s) / watched for i in range(d)]
    effect = [[0.5 / d if kept[j] > 0 else 0.0 for j in range(d)] for _ in range(d)]
    fits = []
    for _ in range(rounds):
        own, caused, fit = [0.0] * d, [[0.0] * d for _ in range(d)], 0.0
        for s in series:
            for t, i in s:
                parts = [0.0] * d
                for u, j in s:
                    if u < t:
                        parts[j] += effect[i][j] * math.exp(-(t - u) / decay) / decay
                rate = base[i] + sum(parts)
                fit += math.log(rate)
                own[i] += base[i] / rate
                for j in range(d):
                    caused[i][j] += parts[j] / rate
        fits.append(fit - sum(base) * watched - sum(effect[i][j] * kept[j] for i in range(d) for j in range(d)))
        base = [x / watched for x in own]
        effect = [[caused[i][j] / kept[j] if kept[j] > 0 else 0.0 for j in range(d)] for i in range(d)]
    return base, effect, fits


def frame(spark, series, names="ab"):
    rows = [(f"g{n % 2}", f"p{n}", int(round(t * SECOND)), names[k]) for n, s in enumerate(series) for t, k in s]
    return spark.createDataFrame(rows, "g string, p string, t long, kind string")


@pytest.mark.parametrize("slice_days,decay", [(1.0, 30.0), (20 / 86400, 30.0), (3 / 86400, 0.5)])
def test_decayed_sums_match_pairs(spark, slice_days, decay):
    draw = random.Random(4)
    series = [sorted((draw.randrange(200) / 2, draw.randrange(2)) for _ in range(60)) for _ in range(3)]  # with ties in time
    got = E.decayed_sums(frame(spark, series), "ab", "kind", "t", ["g", "p"], decay, slice_days).collect()
    assert len(got) == sum(len({t for t, _ in s}) for s in series)
    for r in got:
        s = series[int(r.p[1:])]
        t = r.t / SECOND
        assert list(r.counts) == [sum((u, k) == (t, j) for u, k in s) for j in range(2)]
        want = [sum(math.exp(-(t - u) / decay) for u, k in s if k == j and u < t) for j in range(2)]
        assert r.near == pytest.approx(want, rel=1e-9, abs=1e-20)


def test_rounds_match_plain_form_and_likelihood_rises(spark):
    draw = random.Random(1)
    series = [[(round(t, 3), k) for t, k in planted(draw, (0.05, 0.02), ((0.2, 0.5), (0.0, 0.3)), 5.0, 200.0)] for _ in range(4)]
    got = {(r.g, r.from_type, r.to_type): r for r in E.infectivity(frame(spark, series), "ab", "kind", "t", ["g", "p"], 5.0, ["g"], rounds=3, tolerance=0).collect()}
    for g in range(2):
        base, effect, fits = plain_fit(series[g::2], 2, 5.0, 3)
        assert fits == sorted(fits)
        for i, to in enumerate("ab"):
            for j, frm in enumerate("ab"):
                r = got[(f"g{g}", frm, to)]
                assert (r.infectivity, r.base_rate, r.log_likelihood) == pytest.approx((effect[i][j], base[i], fits[-1]), rel=1e-6)


def test_planted_rates_are_recovered(spark):
    draw = random.Random(7)
    series = [planted(draw, (0.05, 0.02), ((0.2, 0.5), (0.0, 0.3)), 5.0, 4000.0) for _ in range(8)]
    out = E.infectivity(frame(spark, series), "ab", "kind", "t", ["p"], 5.0, rounds=25, tolerance=1e-6).collect()
    got = {(r.from_type, r.to_type): r.infectivity for r in out}
    base = {r.to_type: r.base_rate for r in out}
    assert got[("a", "a")] == pytest.approx(0.2, abs=0.07) and got[("a", "b")] == pytest.approx(0.5, abs=0.07)
    assert got[("b", "a")] < 0.07 and got[("b", "b")] == pytest.approx(0.3, abs=0.07)
    assert base["a"] == pytest.approx(0.05, rel=0.15) and base["b"] == pytest.approx(0.02, rel=0.25)


def test_empty_single_events_and_unknown_types(spark):
    empty = frame(spark, [[(1.0, 0)]]).where("false")
    assert E.infectivity(empty, "ab", "kind", "t", ["p"], 5.0, ["p"], rounds=2).collect() == []
    one = frame(spark, [[(1.0, 0)], [(1.0, 0), (2.0, 0)]]).unionByName(spark.createDataFrame([("g", "p1", 5, "c"), ("g", "p1", None, "a")], "g string, p string, t long, kind string"))
    got = E.infectivity(one, "ab", "kind", "t", ["p"], 5.0, ["p"], rounds=2).collect()
    assert {r.p for r in got} == {"p1"} and {r.infectivity for r in got if "b" in (r.from_type, r.to_type)} == {0.0}
    with pytest.raises(ValueError):
        E.infectivity(one, "ab", "kind", "t", ["p"], 5.0, ["g"])
