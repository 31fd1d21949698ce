import random
import re

import pytest

from pulsegrid.llm import repeats
from pulsegrid.llm.automaton import SuffixAutomaton

WORDS = [f"w{i}" for i in range(60)]


def brute(rows, n):
    split = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    first = {}
    for i in sorted(split):
        for p in range(len(split[i]) - n + 1):
            first.setdefault(tuple(split[i][p : p + n]), i)
    out = {}
    for i, ws in split.items():
        gone = set()
        for p in range(len(ws) - n + 1):
            if first[tuple(ws[p : p + n])] < i:
                gone.update(range(p, p + n))
        out[i] = (len(ws), len(gone), " ".join(w for p, w in enumerate(ws) if p not in gone))
    return out


def corpus(seed, docs=40):
    draw = random.Random(seed)
    passages = [draw.choices(WORDS, k=draw.randint(10, 40)) for _ in range(6)]
    rows = [(0, None), (1, ""), (2, "short text")]
    for i in range(docs):
        ws = []
        for _ in range(draw.randint(1, 5)):
            ws += draw.choices(WORDS, k=draw.randint(0, 20))
            if draw.random() < 0.6:
                p = draw.choice(passages)
                a = draw.randint(0, 5)
                ws += p[a : len(p) - draw.randint(0, 5)]
        rows.append((3 + i * 2, draw.choice([" ", "\n", "  \t"]).join(ws)))
    rows.append((200, "again " * 300))
    rows.append((201, "again " * 50 + "end"))
    return rows


@pytest.mark.parametrize("seed, n, hot", [(1, 13, 1000), (2, 13, 2), (3, 4, 3), (4, 60, 1000)])
def test_matches_brute_force(spark, seed, n, hot):
    rows = corpus(seed)
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), words=n, hot=hot, rejoin=True).collect()
    assert {r.doc_id: (r["__n_words"], r["__n_removed"], r.text or "") for r in got} == brute(rows, n)
    assert [r.text for r in got if r.doc_id == 0] == [None]


def test_white_space_of_kept_words_stays(spark):
    ws = " ".join(WORDS[:15])
    rows = [(1, ws), (2, f"  Kept\n\nhere {ws}\tand  after \n")]
    got = {r.doc_id: r.text for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ws, 2: "  Kept\n\nhere and  after \n"}


def test_other_columns_nulls_and_repeated_rows(spark):
    ws = " ".join(WORDS[:20])
    rows = [(None, ws, 1, "a"), (5, ws, 2, None), (5, ws, 2, None), (6, ws, None, "c"), (6, "other text", 4, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, anchor long, rest string")
    got = repeats.remove_repeats(docs)
    assert got.columns == [*docs.columns, "__n_words", "__n_removed"]
    key = lambda r: (r.doc_id or 0, r.text, r.anchor or 0)
    assert sorted(map(key, got.collect())) == [(0, ws, 1), (5, ws, 2), (5, ws, 2), (6, "", 0), (6, "other text", 4)]
    assert repeats.remove_repeats(docs.limit(0)).collect() == []


def test_automaton_owner_of_every_window():
    draw = random.Random(8)
    texts = [draw.choices("abc", k=30) for _ in range(5)]
    sam = SuffixAutomaton()
    for i, t in enumerate(texts):
        sam.add(t, 10 - i)
    for probe in [*texts, draw.choices("abcd", k=60)]:
        for p, (length, owner) in enumerate(sam.stream(probe, 4)):
            holds = lambda n: [10 - i for i, t in enumerate(texts) if any(t[k : k + n] == probe[p + 1 - n : p + 1] for k in range(len(t) - n + 1))]  # noqa: B023, E731
            assert length == max((n for n in range(p + 2) if n == 0 or holds(n)), default=0)
            assert owner == (min(holds(4)) if length >= 4 else None)
