"""Topic fit with its words in tables: against the same rounds written out on dense matrices, and what must not reach the driver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions.special import digamma_of, trigamma_of
from pulsegrid.operators import clustering as C, wordtopics as WT

SCHEMA = "id long, words array<string>"


def fit(spark, docs, *args):
    df = spark.createDataFrame(docs, SCHEMA).repartition(1).sortWithinPartitions("id")  # so a round draws by the ids
    return WT.topics_in_tables(df, WT.word_counts(df, "words"), *args)


def texts(n):
    rng = np.random.default_rng(5)
    return [(i, [f"{'abc'[i % 3]}{j}" for j in rng.integers(0, 12, rng.integers(1, 30))] + ["the"] * (i % 4)) for i in range(n)]


def dense(spark, docs, k, rounds, seed):
    """Online rounds as MLlib describes them: words x topics held whole."""
    words = sorted({w for _, d in docs for w in d})
    at = {w: i for i, w in enumerate(words)}
    hashes = np.array([r.h for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).orderBy("w").collect()])
    df = np.zeros(len(words))
    for _, d in docs:
        df[[at[w] for w in set(d)]] += 1
    counts = np.zeros((len(docs), len(words)))
    for i, d in docs:
        for w in d:
            counts[i, at[w]] += 1
    x = counts * np.log((len(docs) + 1) / (df + 1))
    full = x.sum(axis=1) > 0
    x[full] /= x[full].sum(axis=1, keepdims=True)
    lam, alpha, step = WT.start_weights(hashes, k, seed), np.full(k, 1 / k), 0
    elog = lambda v: digamma_of(v) - digamma_of(v.sum(axis=-1, keepdims=True))

    def settle(row, beta, first):
        gamma = first
        while True:
            theta = np.exp(elog(gamma))
            new = alpha + theta * (beta.T @ (row / (beta @ theta + 1e-100)))
            gap, gamma = np.abs(new - gamma).mean(), new
            if gap <= 1e-3:
                theta = np.exp(elog(gamma))
                return gamma, np.outer(row / (beta @ theta + 1e-100), theta) * beta

    for r in range(1, rounds + 1):
        drawn = [v._doc for v in spark.range(len(docs)).toDF("_doc").filter(WT.drawn_in("_doc", r, seed)).collect() if full[v._doc]]
        if not drawn:
            continue
        beta, first = np.exp(elog(lam.T).T), np.random.default_rng([seed, step]).gamma(100, 0.01, k)
        fits = [settle(x[i], beta, first) for i in drawn]
        step += 1
        rate = (1024 + step) ** -0.51
        lam = (1 - rate) * lam + rate * (sum(f[1] for f in fits) * len(docs) / np.ceil(0.05 * len(docs)) + 1 / k)
        logs = sum(elog(f[0]) for f in fits)
        slope, c, q = logs - len(drawn) * elog(alpha), len(drawn) * trigamma_of(alpha.sum()), -len(drawn) * trigamma_of(alpha)
        new = alpha - rate * (slope - (slope / q).sum() / (1 / c + (1 / q).sum())) / q
        alpha = new if (new > 0).all() else alpha
    assert step >= 3
    beta, first = np.exp(elog(lam.T).T), np.random.default_rng([seed, step]).gamma(100, 0.01, k)
    shares = {i: settle(x[i], beta, first)[0] for i in range(len(docs)) if full[i]}
    tops = [[words[i] for i in np.argsort(-lam[:, j], kind="stable")[:10]] for j in range(k)]
    return {i: g / g.sum() for i, g in shares.items()}, tops


@pytest.mark.parametrize("chunk", [WT.CHUNK, 7])
def test_rounds_in_tables_are_the_dense_rounds(spark, monkeypatch, chunk):
    docs = texts(90) + [(90, []), (91, ["once"])]
    want, tops = dense(spark, docs, 3, 6, 4)
    for name in ("CHUNK", "BLOCK", "ROUND_BLOCK"):
        monkeypatch.setattr(WT, name, chunk if name == "CHUNK" else 10 * chunk)
    shares, key_words = fit(spark, docs, 3, "words", 1.0, 6, 4)
    got = {r.id: r.topics for r in shares.collect()}
    assert len(got) == len(docs) and got[90] == [0.0] * 3
    assert want.keys() == got.keys() - {90}
    for i, g in want.items():
        assert np.allclose(got[i], g, atol=1e-9)
    assert {r.topic: r.key_words for r in key_words.collect()} == dict(enumerate(tops))


def test_large_vocabulary_stays_off_the_driver(spark, monkeypatch):
    """Beyond the words that may be held neither MLlib's vocabulary nor its word weights are built; every document keeps its row."""

    def held(*args, **kw):
        raise AssertionError("words on the driver")

    rows = [(i % 40, d) for i, d in texts(60)] + [(None, []), (7, None), (7, [])]
    docs = spark.createDataFrame(rows, "key long, words array<string>")
    monkeypatch.setattr(C, "HELD_WORDS", 36, raising=False)
    with monkeypatch.context() as m:
        m.setattr(C, "CountVectorizer", held)
        m.setattr(C, "LDA", held)
        named, key_words = C.topics(docs, 4, rounds=3, keep=["key"])
        got = named.collect()
        assert named.columns == ["key", "topics", "topic", "weight"]
        assert sorted(str(r.key) for r in got) == sorted(str(k) for k, _ in rows)
        empty = [r for r in got if r.weight == 0.0]
        assert len(empty) == 3 and all(r.topics == [0.0] * 4 and r.topic == 0 for r in empty)
        assert all(abs(sum(r.topics) - 1) < 1e-9 and r.weight == max(r.topics) == r.topics[r.topic] for r in got if r.weight)
        assert [len(r.key_words) for r in key_words.collect()] == [10] * 4
    monkeypatch.setattr(C, "HELD_WORDS", 37)  # as many words as there are: MLlib's fit
    few, _ = C.topics(docs, 4, rounds=3, keep=["key"])
    assert few.schema == named.schema or [f.dataType for f in few.schema][2:] == [f.dataType for f in named.schema][2:]
    assert few.count() == len(rows)


def test_rare_words_and_no_rows(spark):
    docs = [(0, ["x", "y"]), (1, ["x", "z", "z"]), (2, ["q"]), (3, [])]
    shares, key_words = fit(spark, docs, 2, "words", 0.5, 2, 0)
    assert sorted((r.id, sum(r.topics) > 0) for r in shares.collect()) == [(0, True), (1, True), (2, False), (3, False)]  # only x is in half of the documents
    assert {tuple(r.key_words) for r in key_words.collect()} == {("x",)}
    none, key_words = fit(spark, [], 2, "words", 1.0, 2, 0)
    assert none.collect() == [] and key_words.collect() == []


def test_first_weights_are_gamma_draws():
    hashes = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 50_000)
    got = WT.start_weights(hashes, 4, 0)
    assert np.allclose(got.mean(axis=0), 1, atol=2e-3) and np.allclose(got.var(axis=0), 0.01, atol=3e-4)
    assert np.allclose(((got - 1) ** 3).mean(axis=0), 2e-4, atol=5e-5)  # the third moment of that gamma distribution
    assert np.abs(np.corrcoef(got.T) - np.eye(4)).max() < 0.02
    assert np.array_equal(got[:9], WT.start_weights(hashes[:9], 4, 0)) and not np.array_equal(got, WT.start_weights(hashes, 4, 1))
    assert np.allclose(trigamma_of(np.array([1.0, 0.25])), [np.pi**2 / 6, 17.197329154507], atol=1e-9)
