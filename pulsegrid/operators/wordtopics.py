"""Topic model with its words in tables: rounds of variational fitting as joins and sums, for vocabularies of any size (ML-14).

The model is MLlib's online fit with its defaults.  A word's weight in a topic moves in every round, but by the same rule for all words
that are not drawn: after some rounds it is ``scale * (start + drawn) + shift``.  ``start`` comes from a hash of the word and ``drawn`` is
summed over the documents a round draws, so a round touches only its documents' words; the driver holds a few numbers per topic.
Documents are fitted in blocks, and a block is sent each of its words once, whatever number of its documents holds it.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.special import digamma_of, trigamma_of
from ..session import release_shuffles, shared_folder

#: MLlib's defaults: share of the documents in a round, what slows early rounds, how a round's weight falls, shape of the first draws,
#: the change at which a document is settled.
SHARE, OFFSET, DECAY, SHAPE, SETTLED = 0.05, 1024.0, 0.51, 100.0, 1e-3

#: Words, with repeats, in a block of documents: in a round, and of all documents at the end; different words fitted together in a task.
ROUND_BLOCK, BLOCK, CHUNK = 500_000, 1_000_000, 200_000

#: Parts in which all documents are fitted at the end.
PARTS = 4

def _steps(at: np.ndarray) -> np.ndarray:
    return np.asarray(at, np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def start_weights(hashes: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Words x topics from a gamma distribution of mean 1, each word's by its hash alone (rejection after Marsaglia and Tsang)."""
    own = hashes.astype(np.int64).view(np.uint64)[:, None]
    keys = _mixed(own + _steps(seed % 2**32 * k + np.arange(1, k + 1))).ravel()
    out, todo = np.empty(keys.size), np.arange(keys.size)
    d = SHAPE - 1 / 3
    step = 0
    while todo.size:
        u = ((_mixed(keys[todo] + _steps(step + np.arange(1, 4))[:, None]) >> np.uint64(11)).astype(float) + 0.5) / 2.0**53
        x = np.sqrt(-2 * np.log(u[0])) * np.cos(2 * np.pi * u[1])
        v = np.maximum(1 + x / np.sqrt(9 * d), 1e-9) ** 3
        taken = np.log(u[2]) < x * x / 2 + d - d * v + d * np.log(v)
        out[todo[taken]] = d * v[taken] / SHAPE
        todo, step = todo[~taken], step + 3
    return out.reshape(-1, k)


def expected_log(x: np.ndarray) -> np.ndarray:
    """Mean logarithm of Dirichlet shares, one distribution per row."""
    return digamma_of(x) - digamma_of(x.sum(axis=-1, keepdims=True))


def infer(weights: np.ndarray, beta: np.ndarray, sizes: np.ndarray, first: np.ndarray, alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Topic counts of each document, and what each of its words adds to the topics; documents leave the loop when they are settled."""
    weights = weights / np.repeat(np.add.reduceat(weights, np.cumsum(sizes) - sizes), sizes)
    counts, live = np.tile(first, (len(sizes), 1)), np.arange(len(sizes))
    w, b, n = weights, beta, sizes
    while live.size:
        at = np.repeat(np.arange(live.size), n)
        theta = np.exp(expected_log(counts[live]))
        per_word = w / (np.einsum("ij,ij->i", b, theta[at]) + 1e-100)
        new = alpha + theta * np.add.reduceat(b * per_word[:, None], np.cumsum(n) - n)
        moving = np.abs(new - counts[live]).mean(axis=1) > SETTLED
        counts[live] = new
        if not moving.all():
            kept = moving[at]
            live, w, b, n = live[moving], w[kept], b[kept], n[moving]
    theta = np.exp(expected_log(counts))[np.repeat(np.arange(len(sizes)), sizes)]
    return counts, theta * beta * (weights / (np.einsum("ij,ij->i", beta, theta) + 1e-100))[:, None]


def drawn_in(doc: str, at: int | Column, seed: int) -> Column:
    """Whether a round draws the document: each round a share of them, by a hash."""
    return F.pmod(F.xxhash64(doc, F.lit(at).cast("int"), F.lit(seed)), F.lit(1 << 20)) < int(SHARE * (1 << 20))


@dataclass
class _State:
    """The numbers of a fit that do not grow with documents or words."""

    k: int
    seed: int
    alpha: np.ndarray
    sums: np.ndarray
    documents: int
    scale: float = 1.0
    shift: float = 0.0
    rounds: int = 0

    def weights(self, hashes: np.ndarray, drawn: np.ndarray) -> np.ndarray:
        return self.scale * (start_weights(hashes, self.k, self.seed) + drawn) + self.shift

    def first(self) -> np.ndarray:
        return np.random.default_rng([self.seed % 2**32, self.rounds]).gamma(SHAPE, 1 / SHAPE, self.k)


def _matrix(of: Callable[[str], pa.Array], k: int) -> np.ndarray:
    return np.stack([np.asarray(of(f"s{j}"), float) for j in range(k)], axis=1)


def _fitted(docs: pa.Table, words: pa.Table, state: _State) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of a block's documents: their rows, topic counts, the rows of their words, what these add; words not in ``words`` do not count."""
    lists = docs.column("_words").combine_chunks()
    codes = pc.index_in(lists.flatten(), value_set=words.column("_word")).to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(docs.num_rows), np.asarray(lists.value_lengths()))
    known = ~np.isnan(codes)
    pairs, counts = np.unique(rows[known] * words.num_rows + codes[known].astype(np.int64), return_counts=True)
    rows, codes = np.divmod(pairs, max(words.num_rows, 1))
    weights = counts * np.log((state.documents + 1) / (np.asarray(words.column("_df")) + 1))[codes]
    rows, codes, weights = rows[weights > 0], codes[weights > 0], weights[weights > 0]
    hashes = np.asarray(words.column("_hash"))
    beta = np.exp(digamma_of(state.weights(hashes, _matrix(words.column, state.k))) - digamma_of(state.sums))
    named, sizes = np.unique(rows, return_counts=True)
    ends, first, at = np.cumsum(sizes), state.first(), 0
    while at < len(named):
        low = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, low + CHUNK, "right")))
        own = codes[low : ends[to - 1]]
        topics, added = infer(weights[low : ends[to - 1]], beta[own], sizes[at:to], first, state.alpha)
        yield named[at:to], topics, own, added
        at = to


def _dealt(docs: DataFrame, tokens: float, block: int) -> DataFrame:
    """The documents with a block each, by a hash of their keys."""
    return docs.withColumn("_block", F.pmod(F.xxhash64("_doc", F.lit(1)), F.lit(int(np.ceil(tokens / block)) or 1)))


def _in_blocks(docs: DataFrame, words: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``run`` on each block's documents and words (with what was drawn of them)."""
    words = words.withColumn("_hash", F.xxhash64("_word")).withColumn("_of", F.col("_block") + 0).drop("_block")  # also if both are of one table
    return docs.groupBy("_block").cogroup(words.groupBy("_of")).applyInArrow(run, schema)


def _with_drawn(words: DataFrame, drawn: DataFrame | None, k: int) -> DataFrame:
    names = [f"s{j}" for j in range(k)]
    if drawn is None:
        return words.withColumns({n: F.lit(0.0) for n in names})
    return words.join(drawn, "_word", "left").fillna(0.0, names)


def _round(docs: DataFrame, words: DataFrame, state: _State) -> DataFrame:
    """``_kind, _word, s0, s1, ...``: what the documents add to words (0), to all words (1), their mean logarithms (2), their number (3)."""
    names = ["_kind", "_word", *[f"s{j}" for j in range(state.k)]]

    def run(docs, words):
        own, rest = np.zeros((words.num_rows, state.k)), np.zeros((3, state.k))
        for named, topics, codes, added in _fitted(docs, words, state):
            for j in range(state.k):
                own[:, j] += np.bincount(codes, added[:, j], words.num_rows)
            rest += [added.sum(axis=0), expected_log(topics).sum(axis=0), np.full(state.k, float(len(named)))]
        kinds = pa.array(np.concatenate([np.zeros(len(own)), [1, 2, 3]]).astype(np.int32))
        texts = pa.chunked_array([*words.column("_word").cast(pa.string()).chunks, pa.nulls(3, pa.string())])
        return pa.table([kinds, texts, *[pa.array(c) for c in np.concatenate([own, rest]).T]], names)

    added = _in_blocks(docs, words, run, ", ".join(["_kind int", "_word string", *[f"{n} double" for n in names[2:]]]))
    return added.groupBy("_kind", "_word").agg(*[F.sum(n).alias(n) for n in names[2:]])


def _better_alpha(alpha: np.ndarray, logs: np.ndarray, n: float, rate: float) -> np.ndarray:
    """One Newton step for the documents' topic prior, from ``logs`` summed over ``n`` documents; a step that leaves the positive is not made."""
    slope = n * (logs / n - expected_log(alpha))
    c, q = n * trigamma_of(alpha.sum()), -n * trigamma_of(alpha)
    new = alpha - rate * (slope - (slope / q).sum() / (1 / c + (1 / q).sum())) / q
    return new if (new > 0).all() else alpha


def _started(words: DataFrame, k: int, seed: int) -> tuple[int, np.ndarray]:
    """Number of the words and the sums of their first weights."""

    def run(batches):
        for batch in batches:
            sums = start_weights(np.asarray(batch.column("_hash")), k, seed).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([float(v)]) for v in (batch.num_rows, *sums)], ["n", *[f"s{j}" for j in range(k)]])

    sums = words.select(F.xxhash64("_word").alias("_hash")).mapInArrow(run, ", ".join(["n double", *[f"s{j} double" for j in range(k)]]))
    n, *rest = sums.groupBy().sum().first()
    return int(n or 0), np.array([v or 0.0 for v in rest])


def _top_words(words: DataFrame, state: _State, n: int) -> DataFrame:
    """``topic, key_words``: the words of largest weight; a task sends ``n`` per topic."""

    def run(batches):
        best = [(np.empty(0), pa.array([], pa.string()))] * state.k
        for batch in batches:
            weights = state.weights(np.asarray(batch.column("_hash")), _matrix(batch.column, state.k))
            texts = batch.column("_word").cast(pa.string())
            for j, (held, named) in enumerate(best):
                all_weights, all_texts = np.concatenate([held, weights[:, j]]), pa.concat_arrays([named, texts])
                at = np.argsort(-all_weights, kind="stable")[:n]
                best[j] = all_weights[at], all_texts.take(pa.array(at))
        for j, (held, named) in enumerate(best):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), j, np.int32)), named, pa.array(held)], ["topic", "_word", "_weight"])

    tops = words.mapInArrow(run, "topic int, _word string, _weight double")
    ranked = tops.withColumn("_rank", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("_weight"), "_word"))).filter(F.col("_rank") <= n)
    return ranked.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("_rank", "_word"))).alias("_w")).select("topic", F.col("_w._word").alias("key_words"))


def word_counts(docs: DataFrame, words: str) -> DataFrame:
    """``_word, _df``: each word and the number of documents that hold it, as a stored table."""
    found = docs.select(F.explode(F.array_distinct(words)).alias("_word")).filter("_word is not null")
    return _stored(found.groupBy("_word").agg(F.count(F.lit(1)).alias("_df")), _folder(docs))


def _folder(df: DataFrame) -> str:
    return f"{shared_folder(df.sparkSession)}/wordtopics-{uuid.uuid4().hex}"


def _stored(df: DataFrame, path: str, *by: str) -> DataFrame:
    """A table in the folder all executors share; word lists take a fraction of a checkpoint's place."""
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    release_shuffles(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def topics_in_tables(docs: DataFrame, vocabulary: DataFrame, k: int, words: str, min_df: float, rounds: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The columns of ``docs`` but ``words``, with ``topics`` (zeros without a word that counts), and ``topic, key_words``; ``vocabulary`` as from ``word_counts``."""
    folder, kept = _folder(docs), [c for c in docs.columns if c != words]
    table = _stored(docs.withColumnRenamed(words, "_words").withColumn("_doc", F.monotonically_increasing_id()), f"{folder}/docs")
    total, tokens = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("_words")), F.lit(0))).first()
    vocabulary = vocabulary.filter(F.col("_df") >= (min_df if min_df >= 1 else min_df * total))
    size, sums = _started(vocabulary, k, seed)
    state = _State(k, seed, np.full(k, 1 / k), sums, total)

    at = F.filter(F.sequence(F.lit(1), F.lit(rounds)), lambda r: drawn_in("_doc", r, seed)) if rounds else F.array().cast("array<int>")
    sample = _dealt(table.select("_doc", "_words", F.explode(at).alias("_round")), SHARE * tokens, ROUND_BLOCK)
    sample = _stored(sample.repartition("_round", "_block"), f"{folder}/sample", "_round")
    own = sample.select("_round", "_block", F.explode("_words").alias("_word")).distinct().join(vocabulary, "_word")
    own = _stored(own, f"{folder}/words", "_round")
    sums_type = ", ".join(["_kind int", "_word string", *[f"s{j} double" for j in range(k)]])
    drawn = None
    for r in range(1, rounds + 1):
        rate = (OFFSET + state.rounds + 1) ** -DECAY
        mine = _with_drawn(own.filter(F.col("_round") == r).drop("_round"), drawn, k)
        added = _round(sample.filter(F.col("_round") == r).drop("_round"), mine, state)
        scale = state.scale * (1 - rate)
        share = rate * total / max(np.ceil(SHARE * total), 1.0) / scale
        names = [f"s{j}" for j in range(k)]
        added = added.select("_kind", "_word", *[(F.col(n) * F.when(F.col("_kind") <= 1, F.lit(float(share))).otherwise(1.0)).alias(n) for n in names])
        held = _stored(added, f"{folder}/drawn/_at={r}")
        whole = {row._kind: np.array([row[n] for n in names]) for row in held.filter("_kind > 0").collect()}
        if not whole or not whole[3][0]:  # no document with words was drawn
            continue
        drawn = docs.sparkSession.read.schema(sums_type).parquet(f"{folder}/drawn").filter("_kind = 0").groupBy("_word").agg(*[F.sum(n).alias(n) for n in names])
        # `sums` are those of all words: old ones fade, each word gains the prior, drawn words gain what was added
        sums = (1 - rate) * state.sums + size * rate / k + scale * whole[1]
        alpha = _better_alpha(state.alpha, whole[2], whole[3][0], rate)
        state = _State(k, seed, alpha, sums, total, scale, (1 - rate) * state.shift + rate / k, state.rounds + 1)

    def run(docs, words):
        shares = np.zeros((docs.num_rows, k))
        for named, topics, _, _ in _fitted(docs, words, state):
            shares[named] = topics / topics.sum(axis=1, keepdims=True)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, shares.size + 1, k, dtype=np.int32)), pa.array(shares.ravel()))
        return pa.table([docs.column("_doc"), lists], ["_doc", "topics"])

    known = _with_drawn(vocabulary, drawn, k)
    known = _stored(known, f"{folder}/known")
    dealt = _dealt(table.select("_doc", "_words"), tokens, BLOCK)
    shares = []
    for part in range(PARTS):  # one after the other, so the shuffle files of a part make room for the next
        own = dealt.filter(F.pmod(F.xxhash64("_block"), F.lit(PARTS)) == part).repartition("_block")
        found = own.select("_block", F.explode("_words").alias("_word")).distinct()
        shares.append(_stored(_in_blocks(own, found.join(known, "_word"), run, "_doc long, topics array<double>"), f"{folder}/shares/{part}"))
    tops = _top_words(known.select("_word", F.xxhash64("_word").alias("_hash"), *[f"s{j}" for j in range(k)]), state, 10)
    return table.select("_doc", *kept).join(functools.reduce(DataFrame.unionByName, shares), "_doc").drop("_doc"), tops
