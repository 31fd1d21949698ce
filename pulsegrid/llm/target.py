"""Resampling of documents towards a target text by importance weights, drawn exactly at any size (operator 12).

Words (and runs of words) are hashed to buckets; one array of ``buckets`` gains, log ratios of the target's and all
documents' bucket counts, scores every document.  The draw is Gumbel top-k without a global sort: the scores are
written once, a numeric bisection finds the cut by exact counts over them (first on the score, then on the id of rows
that tie, then on the row number of repeated ids), and only the drawn rows are range-partitioned to be ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .postings import words
from .store import written

#: Counts a job of the bisection takes at once.
PROBES = 15
_LAST = (1 << 63) - 1


def features(text: Column, runs: int = 1) -> Column:
    """All runs of 1 to ``runs`` consecutive words, joined by one space, repeats kept."""
    each = words(text)
    if runs == 1:
        return each
    none = F.array().cast("array<string>")

    def of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(each) - (n - 1))
        return F.when(F.size(each) >= n, F.transform(starts, lambda i: F.array_join(F.slice(each, i, n), " "))).otherwise(none)

    return F.concat(each, *[of(n) for n in range(2, runs + 1)])


def bucket(feature: Column, buckets: int) -> Column:
    return F.crc32(feature.cast("binary")) % buckets


def _counts(texts: DataFrame, text: str, runs: int, buckets: int, name: str) -> DataFrame:
    each = texts.select(F.explode(features(F.col(text), runs)).alias("f"))
    return each.groupBy(bucket(F.col("f"), buckets).alias("b")).agg(F.count("*").alias(name))


def gains(docs: DataFrame, target: DataFrame, runs: int, buckets: int, text: str = "text", target_text: str = "text") -> list[int]:
    """Per bucket ``floor(1000 * ln(ratio))`` of add-one shares in the target and in all documents.

    The driver gets at most ``buckets`` rows of counts.
    """
    both = _counts(docs, text, runs, buckets, "s").join(_counts(target, target_text, runs, buckets, "t"), "b", "full")
    held = written(both.select("b", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")))
    whole, aim = (float(x or 0) + buckets for x in held.agg(F.sum("s"), F.sum("t")).first())
    ratio = lambda s, t: F.floor(1000 * F.log((t + 1.0) * F.lit(whole) / ((s + 1.0) * F.lit(aim)))).cast("long")
    out = [held.sparkSession.range(1).select(ratio(F.lit(0), F.lit(0))).first()[0]] * buckets
    for b, g in held.select("b", ratio(F.col("s"), F.col("t"))).collect():
        out[b] = g
    return out


def _floored(total: Column, n: Column) -> Column:
    return ((total - F.pmod(total, n)) / n).cast("long")


def scored(docs: DataFrame, gain: list[int], seed: str, runs: int, least: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``row, id, n_features, weight, score, enters``, written; ``enters`` are rows with ``least`` words.

    A null text has no words and weight 0; a null id counts as an empty one in the noise.
    """
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")
    rows = docs.select(F.col(id).alias("id"), words(F.col(text)).alias("w"), F.col(text).alias("t"))
    rows = rows.select("id", F.size("w").alias("n_words"), (F.col("w") if runs == 1 else features(F.col("t"), runs)).alias("f"))
    total = F.aggregate("f", F.lit(0).cast("long"), lambda a, x: a + F.get(table, bucket(x, len(gain)).cast("int")))
    n = F.size("f").cast("long")
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    rows = rows.select("id", "n_words", n.alias("n_features"), total.alias("total"), noise.alias("noise"))
    weight = F.when(F.col("n_features") > 0, _floored(F.col("total"), F.col("n_features"))).otherwise(0).cast("long")
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "id", "n_features", weight.alias("weight"), "noise", (F.col("n_words") >= least).alias("enters"))
    return written(rows.select("row", "id", "n_features", "weight", (F.col("weight") + F.col("noise")).alias("score"), "enters"))


def _threshold(rows: DataFrame, order: Column, wanted: int) -> tuple[int, int]:
    """Smallest ``t`` so that ``wanted`` rows have ``order <= t``, and how many rows lie below it."""
    low, high = rows.agg(F.min(order), F.max(order)).first()
    below = 0
    while low < high:
        step = max(1, (high - low) // (PROBES + 1))
        at = [x for x in range(low, high, step)][:PROBES]  # high itself is known to do
        got = rows.agg(*[F.count_if(order <= F.lit(x)) for x in at]).first()
        enough = [x for x, n in zip(at, got) if n >= wanted]
        short = [(x, n) for x, n in zip(at, got) if n < wanted]
        high = enough[0] if enough else high
        if short:
            low, below = short[-1][0] + 1, short[-1][1]
    return low, below


def top_k(rows: DataFrame, orders: list[Column], k: int) -> DataFrame:
    """The ``k`` first of ``rows`` (a written table) by whole-number columns; the last one is unique.

    Each bisection job reads numbers of the written table and returns ``PROBES`` counts.  Every round shrinks the range
    that holds the cut to a sixteenth, so rounds follow the width of the numbers and not the count of rows.
    """
    tied, taken, wanted = F.lit(True), F.lit(False), k
    for i, order in enumerate(orders):
        t, below = _threshold(rows.where(tied), order, wanted)
        taken, tied, wanted = taken | (tied & (order < F.lit(t))), tied & (order == F.lit(t)), wanted - below
        if i == len(orders) - 1 or rows.where(tied).count() == wanted:
            break
    return rows.where(taken | tied)


def ranked(rows: DataFrame, orders: list[Column], name: str = "rank") -> DataFrame:
    """``rows`` numbered 1, 2, 3... in order: ranges of rows are sorted apart, each starts where the ones before end."""
    cols = [o.alias(f"o{i}") for i, o in enumerate(orders)]
    names = [f"o{i}" for i in range(len(orders))]
    dealt = rows.select("*", *cols).repartitionByRange(*names).sortWithinPartitions(*names)
    held = written(dealt.withColumn("at", F.monotonically_increasing_id()).drop(*names))
    part = F.shiftright("at", 33)
    starts = held.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # a row for each range
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    out = held.withColumn("part", part).join(starts, "part")
    return out.withColumn(name, F.col("base") + F.col("at").bitwiseAND((1 << 33) - 1) + 1).drop("part", "base", "at")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least: int = 20, runs: int = 1, buckets: int = 10000, seed: str = "2024",
             id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """``id, n_features, weight, score, rank`` of every row of ``docs``; ``rank`` is null where it isn't drawn.

    Of the N rows with ``least`` words or more, ``floor(percent * N / 100)`` are drawn: those of the highest score, ties to the
    smaller id (a whole number; null last), repeated ids in the order of rows.  Repeated rows each count.  Without
    documents there are no rows, with too few none is drawn; without target text its bucket counts are 0.
    """
    rows = scored(docs, gains(docs, target, runs, buckets, text, target_text), seed, runs, least, id, text)
    entered = rows.where("enters")
    k = entered.count() * percent // 100
    if not k:
        return rows.select("id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    orders = [-F.col("score"), F.coalesce(F.col("id").cast("long"), F.lit(_LAST)), F.col("row")]
    drawn = ranked(top_k(entered, orders, k).select("row", "id", "score"), orders).select("row", "rank")
    return rows.join(drawn, "row", "left").select("id", "n_features", "weight", "score", "rank")
