"""Quartile bucket digests of documents (operator 1)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .store import blocks
from .textbytes import mix, raw, slices

BUCKETS = 512
_LENGTH_STEP = 1.1
#: Hash of a byte at each place of a triplet; the three are added.
_PLACE = [mix(np.arange(256, dtype=np.uint64) + np.uint64(1000 * i)) >> np.uint64(32) for i in (1, 2, 3)]


def bucket_counts(data: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """How many byte triplets fall in each bucket: neighbours, and triplets that skip one of four bytes."""
    out = np.zeros(buckets, np.int64)
    a, b, c = (p[data] for p in _PLACE)
    for i, j in ((1, 2), (1, 3), (2, 3)):
        if len(data) > j:
            m = len(data) - j
            h = (a[:m] + b[i : i + m] + c[j : j + m]) * np.uint64(2654435761 + 2 * (i + 4 * j))
            out += np.bincount(((h >> np.uint64(12)) % np.uint64(buckets)).astype(np.int64), minlength=buckets)
    return out


def fingerprint_of(data: bytes, buckets: int = BUCKETS) -> str:
    """Hex digest: a length code, then per bucket the quarter (0 to 3) in which its count lies.

    Quartiles are those of the text's own counts.  Equal counts share a quarter, so a
    bucket's code depends on the text alone.  Texts under three bytes have all codes 0.
    """
    view = np.frombuffer(data, np.uint8)
    counts = bucket_counts(view, buckets)
    ranked = np.sort(counts)
    cuts = ranked[[buckets // 4 - 1, buckets // 2 - 1, 3 * buckets // 4 - 1]]
    codes = (counts > cuts[0]).astype(np.uint8) + (counts > cuts[1]) + (counts > cuts[2])
    packed = (codes[::4] << 6 | codes[1::4] << 4 | codes[2::4] << 2 | codes[3::4]).astype(np.uint8)
    size = min(255, round(np.log(len(data) + 1) / np.log(_LENGTH_STEP))) if len(data) else 0
    return bytes([size]).hex() + packed.tobytes().hex()


def _codes(prints: list[str]) -> tuple[np.ndarray, np.ndarray]:
    table = np.frombuffer(bytes.fromhex("".join(prints)), np.uint8).reshape(len(prints), -1)
    body = table[:, 1:]
    return table[:, 0].astype(np.int64), np.stack([body >> s & 3 for s in (6, 4, 2, 0)], 2).reshape(len(prints), -1).astype(np.int64)


def likeness(one: list[str], other: list[str]) -> np.ndarray:
    """Likeness from 0 to 1 of digests, pair by pair: one minus the bounded difference score.

    A bucket differs by the distance of its quarters, with 6 for opposite quarters.  Two unrelated
    random digests differ by ``1.5 + 0.375`` per bucket on average; a mean difference of that or more is
    likeness 0.  Lengths add their distance beyond one step, at most a fifth.
    """
    if not one:
        return np.empty(0)
    (la, a), (lb, b) = _codes(one), _codes(other)
    gap = np.abs(a - b)
    score = np.where(gap == 3, 6, gap).mean(1) / 1.625
    score += np.minimum(np.maximum(np.abs(la - lb) - 1, 0) * 0.01, 0.2)
    return 1 - np.minimum(score, 1.0)


def fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, fingerprint`` of every row.  A null text counts as empty; equal texts have equal fingerprints."""

    def run(batches):
        for batch in slices(batches, "text"):
            prints = pa.array([fingerprint_of(t) for t in raw(batch.column("text"))], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), prints], ["id", "fingerprint"])

    src = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    return src.mapInArrow(run, "id long, fingerprint string")


def next_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = 8 << 20) -> DataFrame:
    """``id, text, n_chars, next``: each text (null: empty) with the next one in ascending ``key``; the last meets the first.

    Ids are cut in ranges of about ``block_bytes`` of text by a quantile sketch.  Each
    range also gets the first text of the next one, so texts cross the network once, and a window orders one
    range.  Null ids come first; rows with one id are ordered by their text.  One row alone is its own next.
    """
    src = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    parts = blocks(docs, text, block_bytes)
    cuts = sorted({int(x) for x in src.approxQuantile("id", [i / parts for i in range(1, parts)], 1 / (16 * parts))}) if parts > 1 else []
    # one number per range
    table = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.expr("cast(array() as array<bigint>)")
    place = F.expr("aggregate(sequence(0, 31), struct(0 as lo, size(cuts) as hi), (s, i) -> if(s.lo < s.hi, "
                   "if(cuts[cast((s.lo + s.hi) / 2 as int)] <= id, struct(cast((s.lo + s.hi) / 2 as int) + 1 as lo, s.hi as hi), "
                   "struct(s.lo as lo, cast((s.lo + s.hi) / 2 as int) as hi)), s), s -> s.lo)")
    ranged = src.withColumn("cuts", table).withColumn("range", F.when(F.col("id").isNull(), F.lit(0)).otherwise(place)).drop("cuts")
    firsts = sorted(
        ((r.range, r.id, r.some_null) for r in ranged.groupBy("range").agg(F.min("id").alias("id"), F.max(F.col("id").isNull()).alias("some_null")).collect()))
    if not firsts:
        return src.select("id", "text", F.length("text").cast("long").alias("n_chars"), F.lit("").alias("next"))
    # the first row of a range goes to the range before it as well; there is one such row per range
    spark = docs.sparkSession
    back = spark.createDataFrame(
        [(r, None if null else i, firsts[k - 1][0], k == 0) for k, (r, i, null) in enumerate(firsts)], "range int, first long, to int, wraps boolean")
    edge = (
        ranged.join(F.broadcast(back), "range").where(F.col("id").eqNullSafe(F.col("first")))
        .groupBy("to", "wraps", "id").agg(F.min("text").alias("text"))
        .select("id", "text", F.col("to").alias("range"), F.lit(1).alias("late"))
    )
    order = Window.partitionBy("range").orderBy("late", F.asc_nulls_first("id"), "text")
    both = ranged.select("id", "text", "range", F.lit(0).alias("late")).unionByName(edge)
    size = F.length("text")
    led = both.withColumn("next", F.lead("text").over(order)).where("late = 0")
    return led.select("id", "text", size.cast("long").alias("n_chars"), F.col("next"))


def compare_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text and of the next one, and their likeness.

    The edited text is the text with its last ``floor(n_chars / 4)`` code points replaced by as many from the start of the next text,
    or by all of that if it is shorter.  See ``next_texts`` for order, nulls and ties.
    """
    rows = next_texts(docs, key, text)
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - quarter), F.substring("next", F.lit(1), quarter)))

    def run(batches):
        for batch in slices(batches, "text"):
            own, edited, after = ([fingerprint_of(t) for t in raw(batch.column(c))] for c in ("text", "edited", "next"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("n_chars"), batch.column("edited_sha256"), pa.array(own, pa.string()), pa.array(edited, pa.string()),
                 pa.array(likeness(own, edited)), pa.array(likeness(own, after))],
                ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return rows.select("id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "text", "edited", "next").mapInArrow(
        run, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
