import random

import numpy as np
import pyarrow as pa
import pytest

from pulsegrid.llm import neardup

WORDS = [f"w{i}" for i in range(400)]


def sets(text, n):
    import re

    ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if len(ws) >= n else ({tuple(ws)} if ws else set())


def brute(rows, n, percent):
    s = {i: sets(t, n) for i, t in rows}
    root = {i: i for i in s}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(s)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]):
                p, q = sorted((top(a), top(b)))
                root[q] = p
    return {i: (len(s[i]), top(i)) for i in s}


def corpus(seed):
    draw = random.Random(seed)
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (4, "one"), (5, "one two"), (6, "One  TWO")]
    for _ in range(12):
        base = draw.choices(WORDS, k=draw.randint(4, 150))
        for _ in range(draw.randint(1, 9)):
            copy = list(base)
            for _ in range(draw.randint(0, max(1, len(copy) // 12))):
                copy[draw.randrange(len(copy))] = draw.choice(WORDS)
            rows.append((len(rows) * 3, " ".join(copy)))
    rows.append((len(rows) * 3, " ".join(draw.choices(WORDS, k=30_000))))
    return rows


@pytest.mark.parametrize("seed, n", [(1, 2), (2, 5)])
def test_components_match_brute_force(spark, seed, n):
    rows = corpus(seed)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=n).collect()
    assert {r.id: (r.n_shingles, r.component_id) for r in got} == brute(rows, n, 80)
    assert all(r.kept == (r.id == r.component_id) for r in got)


@pytest.mark.parametrize("small, leaders, slice_shingles", [(1000, 1, 300), (0, 1, 300), (0, 2, 1), (3, 50, 1000000)])
def test_buckets_with_many_components_are_searched_to_the_end(spark, monkeypatch, small, leaders, slice_shingles):
    """Members that miss the first leader are found in one part, or by rare shingles and later leaders in small rounds and slices."""
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "LEADERS", leaders)
    monkeypatch.setattr(neardup, "SLICE_SHINGLES", slice_shingles)
    draw = random.Random(5)
    shared, rows = draw.choices(WORDS, k=60), []
    for group in range(6):
        own = draw.choices(WORDS, k=25)
        for copy in range(4):
            ws = shared + own
            ws[draw.randrange(len(ws))] = f"x{group}-{copy}"
            rows.append((copy * 6 + group, " ".join(ws)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2, rows=2, least=0.3).collect()
    assert {r.id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 2, 80)


def test_components_of_a_chain(spark):
    links = [(i + 1, i) for i in range(40)] + [(100, 102), (101, 102)]
    got = neardup.components(spark.createDataFrame(links, "a long, b long"))
    assert {r.id: r.comp for r in got.collect()} == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_nulls_repeats_and_clashing_columns(spark):
    text = " ".join(WORDS[:30])
    rows = [(None, text, 1), (7, text, 2), (7, text, 2), (9, text, 3), (8, None, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id long").withColumnRenamed("id", "band")
    got = neardup.near_duplicates(docs).collect()
    assert sorted((r.id is None, r.id, r.component_id, r.kept) for r in got if r.id is not None) == [
        (False, 7, 7, True), (False, 7, 7, True), (False, 8, 8, True), (False, 9, 7, False)]
    assert [r.kept for r in got if r.id is None] == [True]
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, r.band) for r in kept.collect()) == [(False, 7, 2), (False, 7, 2), (False, 8, 4), (True, 0, 1)]


def test_empty_table(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_min_max_agreement_estimates_similarity():
    a, b = np.arange(1000, dtype=np.uint64), np.arange(250, 1250, dtype=np.uint64)
    starts = np.array([0, 1000, 2000])
    sig = neardup.signatures(np.concatenate([a, b]), starts, 400)
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.06


def test_linked_texts_share_a_rare_shingle():
    """Whatever the counters say, the chosen shingles of two texts at 0.8 meet."""
    draw = random.Random(9)
    for _ in range(60):
        base = draw.choices(WORDS, k=draw.randrange(3, 60))
        other = [draw.choice(WORDS) if draw.random() < 0.04 else w for w in base]
        common = np.array(draw.choices(range(5), k=neardup.COUNTERS))
        batch = pa.RecordBatch.from_pydict({"id": [1, 2], "text": [" ".join(base), " ".join(other)]})
        picked = {}
        for part in neardup._rare_shingles(2, 80, common)([batch]):
            for band, i in zip(part.column("band").to_pylist(), part.column("id").to_pylist()):
                picked.setdefault(i, set()).add(band)
        a, b = ({tuple(ws[i : i + 2]) for i in range(len(ws) - 1)} for ws in (base, other))
        if 100 * len(a & b) >= 80 * len(a | b):
            assert picked[1] & picked[2]
