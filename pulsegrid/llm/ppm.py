"""Document scores by prediction with partial matching over bytes (operator 4)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .store import blocks, written
from .textbytes import LOWER, SPACE, raw, span_hashes, word_spans

GRAMS, WORDS = 0, 1
END = 0x0A
SLICE_BYTES = 1 << 17


def held_out(key: str = "doc_id", parts: int = 7, part: int = 2) -> Column:
    """Whether crc32 of the id's text leaves ``part``; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), "UTF-8")) % parts == part


def _slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``SLICE_BYTES``, whose arrays stay in a core's cache; a longer text is one range."""
    at, size = 0, 0
    for k, text in enumerate(texts):
        if size and size + len(text) > SLICE_BYTES:
            yield at, k
            at, size = k, 0
        size += len(text) + 1
    if texts:
        yield at, len(texts)


def _canonical(texts: list[bytes], order: int):
    """A text as the model reads it: lowered words with one blank between and one end byte last.

    Gives the ``order + 1`` bytes that end at each byte as one number (before a text stand end bytes), how many bytes each text has, hashes of words
    and how many words each text has.
    """
    gap = b"\n" * (order + 1)  # white space that ends a text, and the end bytes that stand before the next
    buf = LOWER[np.frombuffer(gap[1:] + gap.join([*texts, b""]), np.uint8)]
    stop = np.cumsum([len(t) + order + 1 for t in texts]) - 1
    s, e = word_spans(buf)
    words = span_hashes(buf, s, e)
    upto = np.searchsorted(s, stop)
    per_text = np.diff(upto, prepend=0)
    length = np.maximum(np.diff(np.concatenate([[0], np.cumsum(e - s + 1)])[upto], prepend=0), 1)
    mask = ~SPACE[buf]
    mask[e] = True
    mask[stop[per_text == 0]] = True
    buf[e] = 0x20
    buf[e[upto[per_text > 0] - 1]] = END
    before = np.concatenate([[0], stop[:-1] + 1])
    first = np.cumsum(length + order) - length - order
    for j in range(order):
        mask[before + j] = True
    code, have = buf[mask].astype(np.uint64), 1
    while have <= order:
        code[have:] |= code[:-have] << np.uint64(8 * have)
        have *= 2
    keep = np.ones(len(code), bool)
    for j in range(order):
        keep[first + j] = False
    return code[keep] & np.uint64((1 << 8 * (order + 1)) - 1), length, words, per_text


def _read(texts: list[bytes], order: int):
    """``_canonical`` of a block, slice by slice."""
    code, at = np.empty(sum(map(len, texts)) + len(texts), np.uint64), 0
    rest = []
    for a, b in _slices(texts):
        part, *more = _canonical(texts[a:b], order)
        code[at : at + len(part)] = part
        at += len(part)
        rest.append(more)
    return code[:at], *(np.concatenate(x) for x in zip(*rest))


def _pack(keys: np.ndarray) -> bytes:
    """Ascending 64-bit numbers by their differences, byte planes apart."""
    return zlib.compress(np.diff(keys.view(np.uint64), prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64).view(np.int64)


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (keys.view(np.uint64) % np.uint64(buckets)).astype(np.int64)


def _split(keys: np.ndarray, buckets: int):
    """Places of the keys bucket by bucket, ascending inside; the buckets and how many keys each has."""
    bucket = _bucket(keys, buckets)
    many = np.bincount(bucket, minlength=1)
    found = np.flatnonzero(many)
    return np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable"), found, many[found]


def _distinct_sorted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct unsigned keys ascending and how often each occurs; sorts ``keys`` in place."""
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    return keys[first], np.diff(first, append=len(keys))


def _distinct(order: int, buckets: int):
    """Distinct n-grams and words of a block with their counts in its training texts, one row per kind and bucket."""

    def run(table: pa.Table) -> pa.Table:
        texts = raw(table.column("text").combine_chunks())
        train = ~np.array(table.column("held").to_pylist(), bool)
        code, length, words, per_text = _read(texts, order)
        block, out = table.column("block")[0].as_py(), []
        for kind, keys, many in ((GRAMS, code, length), (WORDS, words, per_text)):
            use = np.repeat(train, many)
            seen, count = _distinct_sorted(keys[use])
            every, _ = _distinct_sorted(np.concatenate([seen, _distinct_sorted(keys[~use])[0]]))
            counts = np.zeros(len(every), "<u4")
            counts[np.searchsorted(every, seen)] = count
            every = every.view(np.int64)
            places, found, many = _split(every, buckets)
            at = 0
            for b, m in zip(found.tolist(), many.tolist()):
                pick = places[at : at + m]
                out.append((block, kind, b, _pack(every[pick]), zlib.compress(counts[pick].tobytes(), 1)))
                at += m
        names, kinds = ["block", "kind", "bucket", "keys", "counts"], [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 5, kinds)], names)

    return run


def _summed(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a bucket and their counts over all blocks."""
    keys = [_unpack(x) for x in table.column("keys").to_pylist()]
    counts = [np.frombuffer(zlib.decompress(x), "<u4") for x in table.column("counts").to_pylist()]
    every, back = np.unique(np.concatenate(keys).view(np.uint64), return_inverse=True)
    return every.view(np.int64), np.bincount(back, np.concatenate(counts)).astype(np.int64)


def _totals(table: pa.Table) -> pa.Table:
    keys, counts = _summed(table)
    return pa.table({"kind": pa.array(np.full(len(keys), table.column("kind")[0].as_py())), "key": pa.array(keys), "c": pa.array(counts)})


def _answer(parcels: pa.Table, model: pa.Table) -> pa.Table:
    """Each block's values for its keys in order: log probabilities of n-grams, counts of words."""
    if not parcels.num_rows:
        return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())], ["block", "kind", "bucket", "values", "width"])
    kind = parcels.column("kind")[0].as_py()
    if kind == WORDS:
        keys, values = _summed(parcels)
        values = values.astype("<f4" if values.max() < 1 << 24 else "<f8")
    else:
        keys, values = model.column("key").to_numpy(), model.column("logp").to_numpy().astype("<f8")
        order = np.argsort(keys)
        keys, values = keys[order], values[order].astype("<f4")
    keys = keys.view(np.uint64)
    out = [zlib.compress(values[np.searchsorted(keys, _unpack(x).view(np.uint64))].astype("<f8" if values.dtype == "<f8" else "<f4").tobytes(), 1) for x in parcels.column("keys").to_pylist()]
    wide = pa.array(np.full(len(out), values.dtype.itemsize))
    return pa.table({"block": parcels.column("block"), "kind": parcels.column("kind"), "bucket": parcels.column("bucket"), "values": pa.array(out, pa.binary()), "width": wide})


class _Lookup:
    """Values of sorted keys for many queries: tables of slots, each with its key's value if one key has it; keys that share one go to the next, at last by binary search."""

    HASHES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xC4CEB9FE1A85EC53)

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.keys, self.values, self.tables = keys, values, []
        for factor in map(np.uint64, self.HASHES):
            shift = np.uint64(64 - max(4, len(keys).bit_length() + 2))
            slot = self._slot(keys, factor, shift)
            table = np.full(1 << (64 - int(shift)), np.nan, values.dtype)
            table[slot] = values
            shared = np.bincount(slot, minlength=1)[slot] > 1
            table[slot[shared]] = np.nan
            self.tables.append((factor, shift, table))
            keys, values = keys[shared], values[shared]

    @staticmethod
    def _slot(keys: np.ndarray, factor: np.uint64, shift: np.uint64) -> np.ndarray:
        return ((keys * factor) >> shift).view(np.int64)

    def __call__(self, query: np.ndarray) -> np.ndarray:
        out, left = np.full(len(query), np.nan, self.values.dtype), np.arange(len(query))
        for factor, shift, table in self.tables:
            out[left] = table[self._slot(query[left], factor, shift)]
            left = left[np.isnan(out[left])]
        out[left] = self.values[np.searchsorted(self.keys, query[left])]
        return out


def _score(order: int, buckets: int, tokens: int, kinds: int, ends: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        texts = raw(docs.column("text").combine_chunks())
        code, length, words, per_text = _read(texts, order)
        answers, look = answers.sort_by([("kind", "ascending"), ("bucket", "ascending")]), {}
        rows = list(zip(*(answers.column(c).to_pylist() for c in ("kind", "values", "width"))))
        for kind, keys in ((GRAMS, code), (WORDS, words)):
            every, _ = _distinct_sorted(keys.copy())
            places, _, _ = _split(every.view(np.int64), buckets)
            got = [np.frombuffer(zlib.decompress(v), f"<f{w}") for k, v, w in rows if k == kind]
            filled = np.empty(len(every), max((x.dtype for x in got), key=lambda t: t.itemsize, default=np.float32))
            filled[places] = np.concatenate(got) if got else []
            look[kind] = _Lookup(every, filled)
        whole = np.log10(tokens + kinds + 1)
        base, known, score = np.empty(len(texts)), np.empty(len(texts), np.int64), np.empty(len(texts))
        code_at, word_at = 0, 0
        for a, b in _slices(texts):
            text, own = np.repeat(np.arange(b - a), length[a:b]), np.repeat(np.arange(b - a), per_text[a:b])
            logp = look[GRAMS](code[code_at : code_at + len(text)])
            count = look[WORDS](words[word_at : word_at + len(own)]).astype(np.float64)
            code_at, word_at = code_at + len(text), word_at + len(own)
            base[a:b] = np.bincount(own, np.log10(count + 1) - whole, b - a) + np.log10(ends + 1) - whole
            known[a:b] = np.bincount(own, count > 0, b - a).astype(np.int64) + (ends > 0)
            score[a:b] = np.bincount(text, logp, b - a) / np.log(10)
        return pa.table({
            "id": docs.column("id"), "held_out": docs.column("held"), "n_tokens": pa.array(per_text + 1), "n_known": pa.array(known), "n_bytes": pa.array(length),
            "base_score": pa.array(base), "score": pa.array(score)})

    return run


def _low(c: str, size: int) -> Column:
    """The last ``size`` bytes of an n-gram."""
    return F.col(c).bitwiseAND(F.lit((1 << (8 * size)) - 1))


def byte_model(grams: DataFrame, order: int) -> DataFrame:
    """``key, logp`` for every ``order + 1``-gram of ``grams(key, c)``, also for those with count 0.

    The context trie is one table per order: n-gram counts, and per context its total ``t``, number of
    symbols ``d``, and both for the next shorter context without the symbols seen here (``tx, dx``).  Counts of shorter
    contexts are updated only by symbols new to the longer one, so they count distinct longer n-grams.  A symbol of
    count ``c`` has probability ``(2c - 1) / 2t``, the escape ``d / 2t``.  After an escape the symbols
    of the longer context are excluded, exactly those that its shorter contexts have in common with it.
    Past order 0 the bytes not seen at all share the rest evenly.
    """
    level = {order: written(grams.where("c > 0").withColumnRenamed("key", "g"))}
    for j in range(order - 1, -1, -1):
        level[j] = written(level[j + 1].groupBy(_low("g", j + 1).alias("g")).agg(F.count("*").alias("c")))
    context = {}
    for j in range(order + 1):
        rows = level[j].withColumn("ctx", F.shiftright("g", 8))
        if not j:
            context[0] = written(rows.groupBy("ctx").agg(F.sum("c").alias("t"), F.count("*").alias("d")).select("ctx", "t", "d", F.lit(0).cast("long").alias("tx"), F.lit(0).cast("long").alias("dx")))
            continue
        lower = level[j - 1].select(F.col("g").alias("short"), F.col("c").alias("cs"))
        sums = rows.withColumn("short", _low("g", j)).join(lower, "short").groupBy("ctx").agg(F.sum("c").alias("t"), F.count("*").alias("d"), F.sum("cs").alias("x"))
        up = context[j - 1].select(F.col("ctx").alias("up"), F.col("t").alias("tu"), F.col("d").alias("du"))
        context[j] = written(sums.withColumn("up", _low("ctx", j - 1)).join(up, "up").select("ctx", "t", "d", (F.col("tu") - F.col("x")).alias("tx"), (F.col("du") - F.col("d")).alias("dx")))
    first = context[0].agg(F.max("d")).first()[0] or 0
    todo = grams.select("key", "c", F.lit(0.0).alias("acc"), F.lit(None).cast("long").alias("tn"), F.lit(None).cast("long").alias("dn"))
    done = []
    for j in range(order, -1, -1):
        if j < order:
            todo = todo.withColumn("g", _low("key", j + 1)).join(level[j], "g", "left").drop("g")
        here = todo.withColumn("ctx", F.shiftright(_low("key", j + 1), 8)).join(context[j], "ctx", "left")
        t, d = F.coalesce("tn", "t"), F.coalesce("dn", "d")
        found = F.coalesce(F.col("c") > 0, F.lit(False))
        cost = F.when(found, F.log((2 * F.col("c") - 1) / (2 * t))).when((d > 0) & (t > 0), F.log(d / (2 * t))).otherwise(0.0)
        judged = written(here.select("key", found.alias("found"), (F.col("acc") + cost).alias("acc"), F.col("tx").alias("tn"), F.col("dx").alias("dn")))
        done.append(judged.where("found").select("key", F.col("acc").alias("logp")))
        todo = judged.where("not found").select("key", "acc", "tn", "dn")
    done.append(todo.select("key", (F.col("acc") - F.log(F.lit(float(max(256 - first, 1))))).alias("logp")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def score(docs: DataFrame, held: Column, key: str = "doc_id", text: str = "text", order: int = 5, block_bytes: int = 6 << 20) -> DataFrame:
    """``id, held_out, n_tokens, n_known, n_bytes, train_tokens, base_score, score`` of every row.

    Both models learn from the rows where ``held`` is false and score all rows.  Tokens are A-Z lowered words and one end.
    ``base_score`` is the add-one word model.  ``score`` is the log10 probability that the byte model of ``order`` gives the
    same tokens, written as words with one blank between and an end byte.

    Texts are grouped in blocks of about ``block_bytes``.  Each block sends its distinct n-grams and words with
    counts, one row per bucket; buckets add counts up over all blocks; the model is built from these tables; each block gets
    the values for its own keys back and adds them up by document.  So no model is broadcast,
    and a frequent n-gram is one entry per block.  Keys are exact for n-grams and 64-bit hashes for words.

    A null text is empty: one token, the end.  Null ids count by ``held``.  Repeated rows count as often as they are
    there.  Without training rows all bytes are equally likely.  An empty table gives an empty result.
    """
    if not 0 <= order <= 6:
        raise ValueError("order must be 0 to 6")
    many = blocks(docs, text, block_bytes)
    buckets = many | 1
    spot = F.pmod(F.xxhash64(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(-1)), F.octet_length(F.coalesce(F.col(f"`{text}`"), F.lit("")))), F.lit(many))
    placed = docs.select(
        spot.cast("long").alias("block"), F.col(f"`{key}`").cast("long").alias("id"), F.coalesce(held, F.lit(False)).alias("held"), F.col(f"`{text}`").cast("string").alias("text"))
    parcels = written(placed.groupBy("block").applyInArrow(_distinct(order, buckets), "block long, kind long, bucket long, keys binary, counts binary"))
    totals = written(parcels.groupBy("kind", "bucket").applyInArrow(_totals, "kind long, key long, c long"))
    ends = placed.where(~F.col("held")).count()
    words = totals.where((F.col("kind") == WORDS) & (F.col("c") > 0)).agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    kinds, tokens = words[0] + (ends > 0), words[1] + ends
    model = byte_model(totals.where(F.col("kind") == GRAMS).select("key", "c"), order)
    model = model.select(F.lit(GRAMS).cast("long").alias("kind"), (F.col("key") % buckets).alias("bucket"), "key", "logp")
    answers = parcels.groupBy("kind", "bucket").cogroup(model.groupBy("kind", "bucket")).applyInArrow(_answer, "block long, kind long, bucket long, values binary, width long")
    scored = placed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _score(order, buckets, tokens, kinds, ends),
        "id long, held_out boolean, n_tokens long, n_known long, n_bytes long, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(tokens).cast("long"))
