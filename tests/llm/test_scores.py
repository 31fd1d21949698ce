import collections
import math
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import digest, ppm, resample

SYLLABLES = ["an", "the", "or", "ti", "on", "re", "é", "Wo", "x9"]


def texts(seed, n=60):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices(SYLLABLES, k=draw.randint(1, 3)))
    return [None, "", " \n ", "a"] + [draw.choice([" ", "\n", "  "]).join(word() for _ in range(draw.randint(1, 60))) for _ in range(n)]


def lowered(text):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()


class BruteModel:
    """The byte model straight from its definition: one dictionary per order, symbols excluded one by one."""

    def __init__(self, train, order):
        self.order, self.counts = order, [collections.defaultdict(dict) for _ in range(order + 1)]
        for data in train:
            padded = b"\n" * order + data
            for i in range(order, len(padded)):
                for j in range(order, -1, -1):
                    row = self.counts[j][padded[i - j : i]]
                    new = padded[i] not in row
                    row[padded[i]] = row.get(padded[i], 0) + 1
                    if not new:  # seen in the longer context: shorter ones are left alone
                        break

    def log_probability(self, data):
        padded, total = b"\n" * self.order + data, 0.0
        for i in range(self.order, len(padded)):
            excluded, s = set(), padded[i]
            for j in range(self.order, -1, -1):
                row = self.counts[j].get(padded[i - j : i], {})
                open_ = {k: c for k, c in row.items() if k not in excluded}
                t, d = sum(open_.values()), len(open_)
                if s in open_:
                    total += math.log10((2 * open_[s] - 1) / (2 * t))
                    break
                if d:
                    total += math.log10(d / (2 * t))
                excluded |= set(row)
            else:
                total -= math.log10(256 - len(excluded))
        return total


@pytest.mark.parametrize("order, block", [(5, 24 << 20), (2, 300)])
def test_scores_match_brute_force(spark, order, block):
    rows = list(enumerate(texts(3)))
    got = {r.id: r for r in ppm.score(spark.createDataFrame(rows, "doc_id long, text string"), ppm.held_out(), order=order, block_bytes=block).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    tokens = {i: [*lowered(t), None] for i, t in rows}
    count = collections.Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(count.values()), len(count)
    model = BruteModel([b" ".join(lowered(t)) + b"\n" for i, t in rows if not held[i]], order)
    for i, t in rows:
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(tokens[i]), sum(count[w] > 0 for w in tokens[i]), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens[i]), rel=1e-9)
        assert r.score == pytest.approx(model.log_probability(b" ".join(lowered(t)) + b"\n"), rel=1e-5)


def test_model_without_training_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "ab"), (None, None)], "doc_id long, text string")
    got = {r.id: r for r in ppm.score(docs, F.lit(True)).collect()}
    assert got[1].train_tokens == 0 and got[1].score == pytest.approx(3 * math.log10(1 / 256)) and got[None].n_tokens == 1
    assert ppm.score(docs.limit(0), ppm.held_out()).collect() == []


@pytest.mark.parametrize("order", [0, 2, 5, 6])
@pytest.mark.parametrize("size", [1, 300, 1 << 17])
def test_a_block_is_read_the_same_in_slices_of_any_size(monkeypatch, order, size):
    monkeypatch.setattr(ppm, "SLICE_BYTES", size)
    block = [(t or "").encode() for t in texts(5)]
    code, length, words, per_text = ppm._read(block, order)
    data = [b" ".join(lowered(t.decode())) + b"\n" for t in block]
    padded = [b"\n" * order + x for x in data]
    assert code.tolist() == [int.from_bytes(x[i : i + order + 1]) for x in padded for i in range(len(x) - order)]
    assert length.tolist() == [len(x) for x in data] and per_text.tolist() == [len(x.split()) for x in data]
    spelt = [w for x in data for w in x.split()]
    assert len(set(words.tolist())) == len(set(spelt)) == len(set(zip(words.tolist(), spelt)))


def test_lookup_finds_keys_that_share_slots():
    keys = np.sort(np.unique(np.random.default_rng(2).integers(0, 1 << 63, 5000).astype(np.uint64)))
    keys = np.unique(np.concatenate([keys, keys + np.uint64(1), np.arange(3000, dtype=np.uint64)]))
    for values in (np.arange(len(keys), dtype=np.float32), np.arange(len(keys)) + 2.0**40):
        look = ppm._Lookup(keys, values)
        assert look(keys[::-1]).tolist() == values[::-1].tolist() and look(keys[:0]).tolist() == []
    assert ppm._Lookup(keys[:0], values[:0])(keys[:0]).tolist() == []


def test_counting_a_block_costs_less_than_a_sort_of_as_many_numbers():
    draw = random.Random(6)
    vocabulary = ["".join(draw.choices(SYLLABLES, k=draw.randint(1, 4))) for _ in range(20000)]
    block = [" ".join(draw.choices(vocabulary, k=400)) for _ in range(2400)]
    table = pa.table({"block": [0] * len(block), "held": [k % 7 == 2 for k in range(len(block))], "text": block})
    numbers = np.random.default_rng(0).integers(0, 1 << 48, sum(map(len, block)))

    def cpu(work):
        took = []
        for _ in range(3):
            began = time.process_time()
            work()
            took.append(time.process_time() - began)
        return min(took)

    assert cpu(lambda: ppm._distinct(5, 9)(table)) < 0.6 * cpu(lambda: np.argsort(numbers, kind="stable"))


def test_edits_next_texts_and_fingerprints(spark, monkeypatch):
    rows = [(i * 3, t) for i, t in enumerate(texts(4))] + [(None, "no id"), (500, "é" * 4000), (501, "é" * 4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for size in (8 << 20, 400):
        got = {r.id: r for r in spark.createDataFrame([], "id long").sparkSession.createDataFrame(
            [tuple(r) for r in digest.next_texts(docs, block_bytes=size).collect()], "id long, text string, n_chars long, next string").collect()}
        order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
        for k, (i, t) in enumerate(order):
            assert (got[i].text, got[i].n_chars, got[i].next) == (t or "", len(t or ""), order[(k + 1) % len(order)][1] or "")
    edits = {r.id: r for r in digest.compare_edits(docs).collect()}
    assert edits[500].near_next == 1.0 and edits[500].fingerprint == edits[501].fingerprint
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in edits.values())
    single = digest.compare_edits(spark.createDataFrame([(1, "only one text here")], "doc_id long, text string")).collect()
    assert len(single) == 1 and single[0].near_next == 1.0
    assert digest.compare_edits(docs.limit(0)).collect() == []


def test_digest_tells_edited_from_unrelated():
    draw = np.random.default_rng(1)
    text = lambda: bytes(draw.integers(97, 110, 2000).astype(np.uint8))
    a, b = text(), text()
    same, edited, other = digest.likeness([digest.fingerprint_of(a)] * 3, [digest.fingerprint_of(x) for x in (a, a[:1500] + b[:500], b)])
    assert same == 1 and edited > other + 0.2


def test_resampling_rejects_junk_and_keeps_good(spark):
    draw = random.Random(9)
    word = lambda: "".join(draw.choices(SYLLABLES, k=2))
    rows, labels = [(None, "no id", 0), (900, None, 0), (901, "", 0)], []
    for i in range(300):
        junk = i % 4 == 0
        rows.append((i, " ".join(word() + ("%%%" if junk else "") for _ in range(60)), i))
        if i % 3:
            labels.append((i, int(not junk), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, k long")
    marked = spark.createDataFrame([*labels, (None, 1, 0), (5, None, 0), (100_000, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.id: r.kept for r in resample.quality_sample(docs, marked).collect()}
    assert all(got[i] == (i % 4 != 0) for i in range(300)) and got[901]
    assert sorted(r.doc_id for r in resample.keep_sampled(docs, marked).where("doc_id < 300").collect()) == [i for i in range(300) if i % 4]
    assert all(r.kept for r in resample.quality_sample(docs, marked.limit(0)).collect())
    assert resample.quality_sample(docs.limit(0), marked).collect() == []


@pytest.mark.parametrize("k", [0, 1, 37, 200, 399, 400])
def test_gumbel_top_k_takes_the_largest(spark, k, monkeypatch):
    rows = [(i, i * 7, 3, float(i % 50)) for i in range(400)]
    weights = spark.createDataFrame(rows, "id long, rid long, n_grams long, log_weight double")
    cut = resample.top_k_cut
    monkeypatch.setattr(resample, "top_k_cut", lambda scores, n: cut(scores, n, 10))
    got = resample.gumbel_top_k(weights, k).collect()
    assert sum(r.kept for r in got) == k
    assert {r.id for r in got if r.kept} == {r.id for r in sorted(got, key=lambda r: -r.sample_key)[:k]}


def test_top_k_cut_with_ties(spark):
    rows = [(1.0 if i < 300 else 2.0, (i * 2654435761 % 1000) << 41) for i in range(320)]
    scores = spark.createDataFrame(rows, "sample_key double, tie long")
    for k in (5, 20, 21, 150, 320):
        assert resample.top_k_cut(scores, k, 10) == sorted(rows, reverse=True)[k - 1]


@pytest.mark.parametrize("keys", [[1.0] * 200, [float(i % 10) for i in range(200)], [1.0, 1.0 + 2**-52] * 100, [-1e300, 0.0, 1e300, 5e-324] * 50])
def test_top_k_cut_ends_with_few_keys(spark, keys):
    rows = [(key, i * 7919 % 200) for i, key in enumerate(keys)]
    scores = spark.createDataFrame(rows, "sample_key double, tie long")
    for k in (1, 77, 200):
        assert resample.top_k_cut(scores, k, 4) == sorted(rows, reverse=True)[k - 1]


def test_best_cut_takes_the_middle_of_the_gap():
    weights, good = np.array([-100.0, -50, 1, 2, 3]), np.array([False, False, True, True, True])
    assert resample.best_cut(weights, good) == -24.5
    assert resample.best_cut(weights, np.ones(5, bool)) is None


def test_shouted_and_repeated_words_keep_their_own_grams():
    grams = lambda text: set(resample.hashed_grams([text], 1 << 30)[0].tolist())
    assert not grams(b"NASA") & grams(b"WHEREAS") and grams(b"NASA NASA") > grams(b"NASA")
    assert len(grams(b"go go")) == 2 and not grams(b"go go") & grams(b"no no")
