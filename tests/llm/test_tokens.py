import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from pulsegrid.llm import bpe, packing, wordtable

TEXTS = [
    None, "", " ", "  ", "\n", "a", " a", "a  b", "a   b\n\n  c \t d ", "it's we'll I'M  done.  ", "<|endoftext|>", "x <|endoftext|> y", "x  <|endoftext|>\n <|endoftext|>z",
    "éè  ê  b 　 c d", "日本語 の  文章 です", "🙂 🙂🙂  end", "tab\t tab \u0085 next", "a  b", "\x00 \x01b", "12345 678  9", "<|endoftext|" + ">" * 3, "word " * 5000, "x" * 3000,
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(bpe.default_tokenizer())


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 5 == 0 else f"s{i % 3}") for i, t in enumerate(TEXTS)] + [(None, "no id", "s1"), (3, "  ", "s0")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string"), rows


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("block", [1 << 24, 200])
def test_word_table_encodes_like_the_library(spark, tokenizer, docs, block):
    df, rows = docs
    got = sorted((r.id if r.id is not None else -1, list(r.ids), r.decoded) for r in wordtable.encode(df, block_bytes=block).collect())
    want = sorted((i if i is not None else -1, ids := ids_of(tokenizer, t), tokenizer.decode(ids, skip_special_tokens=False)) for i, t, _ in rows)
    assert got == want


def test_decode_joins_pieces(spark, tokenizer):
    rows = [(i, ids_of(tokenizer, t)) for i, t in enumerate(TEXTS)] + [(90, None), (91, []), (92, [188, 50_000_000])]
    got = {r.id: r.text for r in wordtable.decode(spark.createDataFrame(rows, "id long, ids array<int>")).collect()}
    assert {i: got[i] for i, _ in enumerate(TEXTS)} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert got[90] is None and got[91] == "" and len(got) == len(rows)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert wordtable.encode(none).collect() == []
    assert packing.pack(none).collect() == []


def check_pieces(tokenizer, rows, got, length):
    total, places = {}, {}
    for i, t, _ in rows:
        total.setdefault(i, []).append(np.array([*ids_of(tokenizer, t), 0], "<u4"))
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.id, []).append(r)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, wholes in total.items():
        want = sorted((s, len(w)) for w in wholes for s in [0])
        assert sum(n for _, n in want) == sum(r.length for r in by_doc[i])
        if len(wholes) == 1:
            parts = sorted(by_doc[i], key=lambda r: r.start)
            assert [r.start for r in parts] == [sum(q.length for q in parts[:k]) for k in range(len(parts))]
            assert all(zlib.crc32(wholes[0][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(wholes[0]) for r in parts)
    for parts in places.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        size = sum(n for _, n in parts)
        assert size <= length and size & (size - 1) == 0
    full = sum(sum(n for _, n in p) == length for p in places.values())
    assert full == sum(r.length for r in got) // length or len(places) - full <= length.bit_length()


@pytest.mark.parametrize("weights", [None, {"s0": 3.0, "s1": 1.0}, {"s9": 1.0}])
def test_pieces_hold_every_id_once(spark, tokenizer, docs, weights):
    df, rows = docs
    got = packing.pack(df, weights=weights, length=64, window_sequences=2).collect()
    check_pieces(tokenizer, rows, got, 64)


def test_windows_hold_the_mixture(spark):
    rows = [(i, "word " * (5 + i % 90), f"s{i % 4}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for weights in (None, {"s0": 0.5, "s1": 0.3, "s2": 0.15, "s3": 0.05}):
        got = {}
        for r in packing.mixture(packing.pack(df, weights=weights, length=64, window_sequences=8)).collect():
            got.setdefault(r.window, {})[r.queue] = r.tokens
        total = {q: sum(w.get(q, 0) for w in got.values()) for q in ("s0", "s1", "s2", "s3")}
        share = {q: n / sum(total.values()) for q, n in total.items()} if weights is None else weights
        left = dict(total)
        for w in sorted(got)[:-1]:
            assert abs(sum(got[w].values()) - 512) <= 4
            for q in total:
                if all(left[p] > 512 for p in total):  # until a queue runs dry
                    assert abs(got[w].get(q, 0) - share[q] * 512) <= 1.01
                left[q] -= got[w].get(q, 0)


def test_equal_hashes_fall_back_to_bytes(monkeypatch):
    from pulsegrid.llm import textbytes

    monkeypatch.setattr(textbytes, "span_hashes", lambda buf, s, e: (e - s).astype(np.uint64))
    chunks, which, own = bpe.text_chunks([b"ab cd ab", b"", b"xy ab"])
    assert [chunks[i] for i in which] == [b"ab", b" cd", b" ab", b"xy", b" ab"] and own.tolist() == [0, 0, 0, 2, 2]
