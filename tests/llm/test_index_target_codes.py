"""Positional index, target resampling and vector codes against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import codes, postings, target

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return WORD.findall((text or "").translate(lower))


TEXT = "one two three four five six seven eight nine ten eleven twelve"
DOCS = [
    (1, f"Lead in. {TEXT} and out"), (2, TEXT.upper().replace(" ", "--")), (3, TEXT.replace("six", "sechs")), (4, None), (5, ""),
    (6, "a b c a b c a b c"), (6, "a b"), (6, "a b"), (None, "x ÄÖ z a b c"), (7, "the " * 4000 + TEXT + " the" * 4000), (8, "ten nine eight " + TEXT[:30]), (9, "Ä ä É k " * 3)]
ITEMS = [(10, TEXT), (11, TEXT + " and"), (12, "a b c"), (12, "b c a b c a b c a"), (13, None), (14, ""), (15, "ä"), (None, "ÄÖ Z"), (16, "the " * 12), (17, "never seen words"), (10, TEXT)]


def hits(text, items, size):
    ws, hit, found = words(text), set(), set()
    for item, t in items:
        iw = words(t)
        n = min(size, len(iw))
        for i in range(len(iw) - n + 1) if n else ():
            for j in range(len(ws) - n + 1):
                if ws[j : j + n] == iw[i : i + n]:
                    hit |= set(range(j, j + n))
                    if item is not None:
                        found.add(str(item))
    return len(ws), len(hit), sorted(found)


@pytest.mark.parametrize("size", [1, 2, 3, 10])
def test_contamination_is_what_a_plain_search_finds(spark, size):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumns({"doc": F.lit("x"), "pos": F.lit(1), "item": F.lit(2), "term": F.lit(3), "wid": F.lit(4)})
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("doc_id", F.lit(5))
    got = postings.contamination(docs, items, size)
    assert got.columns == ["id", "n_words", "n_hit", "n_items", "item_ids", "contaminated"]
    want = sorted((str(i), *hits(t, ITEMS, size)[:2], hits(t, ITEMS, size)[2]) for i, t in DOCS)
    rows = got.collect()
    assert sorted((str(r.id), r.n_words, r.n_hit, r.item_ids) for r in rows) == want
    assert all(r.contaminated == (r.n_hit > 0) and r.n_items == len(r.item_ids) for r in rows)


def test_contamination_of_empty_tables(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert postings.contamination(docs.limit(0), items).count() == 0
    clean = postings.contamination(docs, items.limit(0))
    assert clean.count() == len(DOCS) and clean.where("contaminated").count() == 0


@pytest.mark.parametrize("slack", [0, 1, 3])
def test_proximity(spark, slack):
    rows = [(1, "red green blue"), (2, "red x green y blue"), (3, "blue green red"), (4, "red a b c d e green blue"), (5, "green blue"), (6, "red green green a blue red")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, "red green blue")], "item_id long, text string")
    index = postings.build_index(docs)
    plans = postings.plan_windows(index, postings.windows_of(items, 3))
    steps = plans.first().steps
    found = {(r.doc, r.start) for r in postings.matches(index, plans, slack).collect()}
    keys = {r[0]: r[1] for r in docs.select("doc_id", postings.document_key("doc_id", "text")).collect()}
    asked, want = words("red green blue"), set()
    for i, text in rows:
        ws = words(text)
        for p, w in enumerate(ws):
            if w == asked[steps[0].off]:
                start = p - steps[0].off
                if all(any(ws[q] == t and abs(q - start - k) <= slack for q in range(len(ws))) for k, t in enumerate(asked) if k != steps[0].off):
                    want.add((keys[i], start))
    assert found == want


def sample(docs, target_texts, percent, least, runs, buckets):
    def feats(t):
        w = words(t)
        return [" ".join(w[i : i + n]) for n in range(1, runs + 1) for i in range(len(w) - n + 1)]

    b = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(b(f) for _, x in docs for f in feats(x)), Counter(b(f) for x in target_texts for f in feats(x))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[k] + 1) * (S + buckets) / ((s[k] + 1) * (T + buckets)))) for k in range(buckets)]
    out = []
    for i, x in docs:
        f = feats(x)
        w = sum(gain[b(y)] for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x)) >= least))
    order = sorted((k for k, r in enumerate(out) if r[4]), key=lambda k: (-out[k][3], out[k][0] is None, out[k][0], k))
    rank = {k: n + 1 for n, k in enumerate(order[: percent * len(order) // 100])}
    return [(*r[:4], rank.get(k)) for k, r in enumerate(out)]


def texts(n):
    rng = np.random.default_rng(5)
    vocabulary = ["alpha", "Beta", "gämma", "delta9", "ε", "zeta", "eta"]
    return [" ".join(rng.choice(vocabulary, rng.integers(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("percent,least,runs,buckets", [(10, 5, 1, 10000), (50, 20, 1, 64), (100, 0, 2, 300), (37, 1, 3, 100)])
def test_resampling_is_the_plain_draw(spark, percent, least, runs, buckets):
    docs = [(i, t) for i, t in enumerate(texts(150))] + [(None, "alpha beta " * 9), (None, None), (400, ""), (401, "zeta " * 3000)] + [(77, "eta " * 25)] * 40
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).withColumns({"row": F.lit(1), "id": F.lit(2), "score": F.lit(3)})
    got = target.resample(frame, spark.createDataFrame([(t,) for t in texts(20)[10:]] + [(None,)], "text string"), percent, least, runs, buckets)
    want = sample(docs, texts(20)[10:], percent, least, runs, buckets)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got.select("id", "n_features", "weight", "score", "rank").collect()), key=key) == sorted(want, key=key)


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert target.resample(none, none).count() == 0
    few = target.resample(spark.createDataFrame([(1, "alpha " * 30)], "doc_id long, text string"), none)
    assert [(r.n_features, r["rank"]) for r in few.collect()] == [(30, None)]


def test_cut_by_bisection_of_any_numbers(spark):
    rng = np.random.default_rng(3)
    for low, high, n, k in [(-5, 5, 400, 133), (-(1 << 62), 1 << 62, 300, 299), (7, 8, 100, 1), (0, 3, 50, 50)]:
        rows = [(int(x), i) for i, x in enumerate(rng.integers(low, high, n))]
        frame = spark.createDataFrame(rows, "a long, b long").cache()
        orders = [F.col("a"), F.col("b")]
        got = target.ranked(target.top_k(frame, orders, k), orders).collect()
        assert sorted((r["rank"], r.a, r.b) for r in got) == [(i + 1, *r) for i, r in enumerate(sorted(rows)[:k])]


def lloyd(rows, parts, entries, rounds):
    kept = [(i, l, [math.floor(1024 * x) for x in v]) for i, l, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    d = len(kept[0][2]) // parts
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [[r[2][p * d : p * d + d] for r in first] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [[min((dist(r[2][p * d : p * d + d], c), e) for e, c in enumerate(books[p])) for p in range(parts)] for r in kept]
    for _ in range(rounds):
        got = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [r[2][p * d : p * d + d] for r, g in zip(kept, got) if g[p][1] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    got = assign()
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    total = Counter()
    for r, g in zip(kept, got):
        total[r[1]] += sum(x[0] for x in g)
    return [(r[0], "".join(f"{x[1]:02x}" for x in g), sum(x[0] for x in g), total[r[1]], sha) for r, g in zip(kept, got)]


@pytest.mark.parametrize("scale,partitions", [(1.0, 3), (3000.0, 1), (1.0, 17)])
def test_codes_are_those_of_plain_lloyd(spark, scale, partitions):
    rng = np.random.default_rng(11)
    rows = [(int(i), int(i % 3) if i % 4 else None, [float(np.float32(x)) for x in rng.normal(size=8) * scale]) for i in rng.permutation(120)]
    rows += [(5, 1, rows[0][2])] * 60 + [(None, 2, rows[3][2]), (300, None, None), (301, 0, [None] * 8), (302, 0, [float("nan")] + [0.0] * 7), (303, 0, [float("inf")] + [0.0] * 7)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumns({"row": F.lit(1), "v": F.lit(2), "key": F.lit(3), "error": F.lit(4)})
    got = codes.compress(frame, parts=4, entries=16, rounds=4, partitions=partitions)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(lloyd(rows, 4, 16, 4), key=key)


def test_codes_of_small_and_unfit_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    assert codes.compress(make([])).count() == 0
    assert codes.compress(make([(1, 1, None), (2, 1, [float("nan")] * 4)])).count() == 0
    assert codes.compress(make([(9, 1, [1.0, 2.0, 3.0, 4.0])])).first()[:4] == (9, "00000000", 0, 0)
    with pytest.raises(ValueError):
        codes.compress(make([(1, 1, [1.0] * 4), (2, 1, [1.0] * 8)]))
    with pytest.raises(ValueError):
        codes.compress(make([(1, 1, [1.0] * 6)]))
    with pytest.raises(Exception, match="components must be below"):
        codes.compress(make([(1, 1, [1e30] * 4)])).collect()
