"""Quality selection by importance resampling with hashed n-gram models (operator 10)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .store import written
from .textbytes import joined, mix, raw, slices, span_hashes

#: Byte classes: blank, letter, digit, mark.
_KIND = np.full(256, 3, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2


def hashed_grams(texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of every token and pair of tokens.

    Tokens are runs of letters, of digits or of marks, each counted as it is spelled.
    """
    buf, starts = joined(texts)
    kind = _KIND[buf]
    edge = np.flatnonzero(np.diff(kind.astype(np.int16), prepend=-1))
    end = np.append(edge[1:], len(buf))
    solid = kind[edge] != 0
    s, e = edge[solid], end[solid]
    h, own = span_hashes(buf, s, e), np.searchsorted(starts, s, "right") - 1
    pair = np.flatnonzero(own[:-1] == own[1:])
    gram = np.concatenate([h, mix(h[pair] * np.uint64(3) + h[pair + 1])])
    return (gram % np.uint64(buckets)).astype(np.int64), np.concatenate([own, own[pair]])


def _counts(buckets: int):
    def run(batches):
        raw_n, target_n = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in slices(batches, "text"):
            gram, own = hashed_grams(raw(batch.column("text")), buckets)
            target = np.array(batch.column("target").to_pylist(), bool)
            raw_n += np.bincount(gram, minlength=buckets)
            target_n += np.bincount(gram[target[own]], minlength=buckets)
        seen = np.flatnonzero(raw_n)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(raw_n[seen]), pa.array(target_n[seen])], ["bucket", "raw", "target"])

    return run


def _weights(ratio: np.ndarray):
    def run(batches):
        for batch in slices(batches, "text"):
            texts = raw(batch.column("text"))
            gram, own = hashed_grams(texts, len(ratio))
            n = np.bincount(own, minlength=len(texts))
            w = np.bincount(own, ratio[gram], minlength=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("rid"), pa.array(n.astype(np.int64)), pa.array(w.astype(np.float64))], ["id", "rid", "n_grams", "log_weight"])

    return run


def importance_weights(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = 1 << 16) -> DataFrame:
    """``id, rid, n_grams, log_weight`` of each row of ``docs``.

    ``target`` names the ids of target documents.  Its size must be bounded by the caller, as it is
    broadcast.  Both models are add-one smoothed distributions over ``buckets`` hashed
    1- and 2-grams: one of the target documents, one of all documents.
    The weight is the sum over a text's n-grams of the log ratio of the two.  A
    task sends one row per bucket.  The model has ``buckets`` doubles.  Null and empty
    texts have no n-grams and weight 0; rows with null id are scored and never target.
    """
    src = docs.select(
        F.col(f"`{key}`").cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("rid"), F.col(f"`{text}`").alias("text"))
    flags = target.select("id", F.lit(True).alias("target")).distinct()
    marked = src.join(F.broadcast(flags), "id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))
    model = marked.mapInArrow(_counts(buckets), "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    counts = np.zeros((2, buckets))
    for row in model.collect():  # ``buckets`` rows at most
        counts[:, row.bucket] = row.target, row.raw
    share = np.log(counts + 1) - np.log(counts.sum(1, keepdims=True) + buckets)
    return src.mapInArrow(_weights(share[0] - share[1]), "id long, rid long, n_grams long, log_weight double")


def top_k_cut(scores: DataFrame, k: int, driver_rows: int = 100_000) -> tuple[float, int]:
    """The ``k``-th largest ``(sample_key, tie)`` of ``scores``; exact, with at most ``driver_rows`` rows read by the driver.

    Quantile sketches narrow the range until it is small enough to read; where one leaves it as it was, the range is halved.
    """
    left, part = k, scores
    while True:
        n = part.count()
        if n <= driver_rows:
            rows = sorted(((r.sample_key, r.tie) for r in part.select("sample_key", "tie").collect()), reverse=True)
            return rows[left - 1]
        at = 1 - left / n
        low, high = part.approxQuantile("sample_key", [max(0.0, at - 0.003), min(1.0, at + 0.003)], 0.001)
        above = part.where(F.col("sample_key") > high).count()
        if above >= left:  # the sketch was off on this side
            part = part.where(F.col("sample_key") > high)
            continue
        within = part.where(F.col("sample_key").between(low, high))
        m = within.count()
        if above + m < left:
            left, part = left - above - m, part.where(F.col("sample_key") < low)
        elif low == high:  # one value fills the range: ties go by ``tie``
            left -= above
            ties = within.groupBy((F.shiftright("tie", 40)).alias("high")).count().orderBy(F.desc("high"))
            for r in ties.toLocalIterator():
                if left <= r["count"]:
                    part = within.where(F.shiftright("tie", 40) == r.high).withColumn("sample_key", F.lit(low))
                    rows = part.select("tie").orderBy(F.desc("tie")).limit(left).agg(F.min("tie")).first()
                    return low, rows[0]
                left -= r["count"]
        else:
            left, part = left - above, within
            if m == n:  # the sketch told nothing apart: halve the range, both halves have rows
                mid = low + (high - low) / 2
                upper = part.where(F.col("sample_key") > (mid if low <= mid < high else low))
                more = upper.count()
                left, part = (left, upper) if more >= left else (left - more, part.where(F.col("sample_key") <= (mid if low <= mid < high else low)))


def gumbel_top_k(weights: DataFrame, k: int | None, seed: int = 1, temperature: float = 1.0) -> DataFrame:
    """Weights with ``sample_key`` and ``kept``: a sample of ``k`` rows without replacement.

    Row ``i`` is drawn by the largest ``log_weight / temperature + Gumbel noise``.  The noise comes from a hash of
    id, text and seed, so a rerun draws the same rows.  Ties go by a second hash, then all ties are kept.  With ``k`` None all rows are kept.
    """
    bits = F.shiftrightunsigned(F.xxhash64(F.coalesce("id", F.lit(-1)), "rid", F.lit(seed)), 11)
    noise = -F.log(-F.log((bits + F.lit(0.5)) / F.lit(float(1 << 53))))
    keyed = weights.withColumn("sample_key", F.col("log_weight") / temperature + noise).withColumn("tie", F.xxhash64("rid", F.coalesce("id", F.lit(-1)), F.lit(seed + 1)))
    keyed = written(keyed)
    if k is None:
        return keyed.withColumn("kept", F.lit(True)).drop("tie")
    if k <= 0:
        return keyed.withColumn("kept", F.lit(False)).drop("tie")
    cut, tie = top_k_cut(keyed, k)
    return keyed.withColumn("kept", (F.col("sample_key") > cut) | ((F.col("sample_key") == cut) & (F.col("tie") >= tie))).drop("tie")


def best_cut(weights: np.ndarray, good: np.ndarray, good_cost: float = 4.0) -> float | None:
    """The weight that separates good from bad rows with the least cost; the middle of the best gap.

    Losing a good row costs ``good_cost`` times keeping a bad one.  None without rows of both kinds.
    """
    if good.all() or not good.any():
        return None
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order]
    lost, held = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[(~g).sum()], (~g).sum() - np.cumsum(~g)])
    cost = good_cost * lost / g.sum() + held / (~g).sum()
    edge = np.concatenate([[w[0] - 1], (w[1:] + w[:-1]) / 2, [w[-1] + 1]])
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    gap = np.concatenate([[0], np.diff(w), [0]])[best]
    return float(edge[best[np.argmax(gap)]])


def quality_sample(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", quality: str = "quality", toxic: str = "toxic",
    max_labelled: int = 200_000, buckets: int = 1 << 16, seed: int = 1,
) -> DataFrame:
    """``id, rid, n_grams, log_weight, sample_key, kept``: the documents drawn as good text.

    Target text is what ``labels`` calls good and not toxic.  At most ``max_labelled`` labelled rows, those with
    the smallest hash of their id, fit the target model and the sample size; everything else covers all documents.
    The sample size is the number of documents whose weight passes the cut that best parts the labelled rows (a lost good one costs four kept bad ones).
    Gumbel noise of scale 1 then decides near the cut only, since weights are sums over a whole text.

    Null labels are ignored; contradicting labels count as bad; of a labelled id's rows the smallest weight is fitted.  Without bad labelled rows all documents are kept.
    Empty and null texts have weight 0, usually above the cut.  Repeated rows share one result.  An empty table gives an empty result.
    """
    known = (
        labels.select(F.col(f"`{key}`").cast("long").alias("id"), (F.col(f"`{quality}`") == 1).alias("good"), (F.coalesce(F.col(f"`{toxic}`"), F.lit(0)) == 1).alias("toxic"))
        .where("id is not null and good is not null").groupBy("id").agg(F.min("good").alias("good"), F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(max_labelled)
    )
    known = written(known)
    weights = written(importance_weights(docs, known.where("good and not toxic"), key, text, buckets))
    judged = weights.join(F.broadcast(known.where("good or not toxic")), "id").groupBy("id").agg(F.min("log_weight").alias("log_weight"), F.first("good").alias("good")).toPandas()
    cut = best_cut(judged.log_weight.to_numpy(float), judged.good.to_numpy(bool)) if len(judged) else None
    k = None if cut is None else weights.where(F.col("log_weight") >= cut).count()
    return gumbel_top_k(weights, k, seed)


def keep_sampled(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that ``quality_sample`` does not draw."""
    gone = quality_sample(docs, labels, key, text, **options).where(~F.col("kept")).select(F.col("id").alias("__id"), F.col("rid").alias("__rid")).distinct()
    rid = F.xxhash64(F.coalesce(docs[f"`{text}`"], F.lit("")))
    return docs.join(gone, docs[f"`{key}`"].cast("long").eqNullSafe(gone["__id"]) & (rid == gone["__rid"]), "left_anti")
