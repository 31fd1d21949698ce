"""Mixture-controlled packing of token sequences (operator 2)."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .bpe import default_tokenizer, encode_texts
from .store import written
from .textbytes import raw, slices


#: Chunks that a worker remembers here (about 200 bytes each): most distinct chunks of its tasks, which it then encodes once.
REMEMBERED = 600_000


def _encode(path: str, end_id: int):
    def run(batches):
        for batch in slices(batches, "text"):
            ids, at = encode_texts(path, raw(batch.column("text")), REMEMBERED)
            kind = "<u2" if not len(ids) or ids.max() < 1 << 16 else "<u4"
            width, data, end = int(kind[-1]), ids.astype(kind).tobytes(), np.array([end_id], kind).tobytes()
            out = [data[a * width : b * width] + end for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("queue"), pa.array(np.diff(at) + 1), pa.array(np.full(len(out), width)), pa.array(out, pa.binary())],
                ["id", "queue", "n", "width", "ids"])

    return run


def _pieces(length: int, total: int):
    """Cut each document where sequences end.  What does not fill a last sequence goes to sequences of falling powers of two."""
    full, rest = divmod(total, length)
    tail = [full * length]
    for bit in range(rest.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            tail.append(tail[-1] + (1 << bit))
    tail = np.array(tail)

    def sequence(x):
        late = np.searchsorted(tail, x, "right") - 1
        return np.where(x < tail[0], x // length, full + late), np.where(x < tail[0], x // length * length, tail[np.maximum(late, 0)])

    def run(batches):
        for batch in slices(batches, "ids"):
            parts = batch.column("parts")
            doc = np.repeat(np.arange(batch.num_rows), np.diff(parts.offsets.to_numpy()))
            skip, at, n, window = (x.to_numpy(zero_copy_only=False) for x in parts.flatten().flatten())
            first, last = sequence(at)[0], sequence(at + n - 1)[0]
            many = last - first + 1
            row = np.repeat(np.arange(len(at)), many)
            seq = np.repeat(first, many) + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            edge = np.where(seq <= full, seq * length, tail[np.minimum(np.maximum(seq - full, 0), len(tail) - 1)])
            begin = np.maximum(edge, at[row])
            stop = np.append(begin[1:], 0)
            final = np.append(row[1:] != row[:-1], True)
            stop[final] = (at + n)[row[final]]
            size, start = stop - begin, begin - at[row] + skip[row]
            crc, own = [], doc[row]
            widths, ids = batch.column("width").to_pylist(), batch.column("ids").to_pylist()
            whole, seen = None, -1
            for r, a, m in zip(own.tolist(), start.tolist(), size.tolist()):
                if r != seen:
                    whole, seen = np.frombuffer(ids[r], f"<u{widths[r]}").astype("<u4").tobytes(), r
                crc.append(zlib.crc32(whole[4 * a : 4 * (a + m)]))
            take = pa.array(own)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(take), batch.column("queue").take(take), pa.array(window[row]), pa.array(start), pa.array(size),
                 pa.array(crc, pa.int64()), batch.column("n").take(take), pa.array(seq), pa.array(begin - edge)],
                ["id", "queue", "window", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def _running(rows: DataFrame, value: str, group: list[str], order: list[str], part: Column, out: str) -> DataFrame:
    """Exclusive running sum of ``value`` per group; ``part`` cuts a group in bounded parts that follow its order.

    One row per part is summed across parts, rows only inside a part.
    """
    rows = rows.withColumn("__part", part)
    sums = rows.groupBy(*group, "__part").agg(F.sum(value).alias("__sum"))
    ahead = Window.orderBy("__part") if not group else Window.partitionBy(*group).orderBy("__part")
    before = F.coalesce(F.sum("__sum").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = Window.partitionBy(*group, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(sums.select(*group, "__part", before.alias("__before")), [*group, "__part"])
    return joined.withColumn(out, F.col("__before") + F.col("__inside")).drop("__part", "__inside", "__before")


def schedule(tokens: DataFrame, weights: dict[str, float] | None, window_tokens: int, part_rows: int = 5000) -> tuple[DataFrame, int]:
    """Deficit round-robin over queues: ``row, parts`` with each document's parts ``(skip, at, n, window)``, and the number of ids.

    ``tokens`` has ``row, id, queue, n``.  In each window a queue's credit grows by its share of
    ``window_tokens``; it sends the whole ids its credit covers, cutting a document where
    the credit ends, and the fraction left is the deficit that it carries on.  Credit after ``w`` windows
    is a function of ``w`` alone, so deficits carry across windows and partitions without a pass in order: with
    ``g(t) = sum over queues of min(total, weight * t)`` ids sent by time ``t``, window ``w`` begins at ``t = g^-1(w * window_tokens)``
    and the queue has then sent ``min(total, floor(weight * t))``.  A queue that ran dry leaves its share to the others.
    """
    count, total = tokens.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    spread = F.pmod(F.xxhash64("row"), F.lit(max(1, -(-count // part_rows))))
    sums = tokens.groupBy("queue").agg(F.sum("n").alias("queue_tokens"))
    placed = _running(tokens, "n", ["queue"], ["id", "row"], spread, "before").join(sums, "queue")
    if weights is None:  # every queue lasts to the end: one stretch of time, from 0 to 1
        placed = placed.withColumn("weight", F.col("queue_tokens").cast("double"))
        stretches = [(0.0, 0.0, float(max(total, 1)))]
    else:
        known = {r.queue: r.queue_tokens for r in sums.collect()}  # one row per weight, one for all other sources
        scale = {q: float(weights.get(q) or n / max(total, 1)) for q, n in known.items()}
        placed = placed.withColumn("weight", F.create_map(*[F.lit(x) for q in sorted(known) for x in (q, scale[q])])[F.col("queue")]) if known else placed.withColumn("weight", F.lit(1.0))
        stretches, sent, now, speed = [], 0.0, 0.0, sum(scale.values()) or 1.0
        for q in sorted(known, key=lambda q: known[q] / scale[q]):
            stretches.append((now, sent, max(speed, 1e-300)))
            then = known[q] / scale[q]
            now, sent, speed = then, sent + speed * (then - now), speed - scale[q]
        stretches = stretches or [(0.0, 0.0, 1.0)]
    table = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(g).alias("g"), F.lit(v).alias("v")) for t, g, v in stretches])
    timed = placed.withColumn("table", table)

    def window_of(place: str) -> Column:
        return F.expr(f"""cast(floor(transform(array(({place}) / weight), t ->
            transform(array(element_at(filter(table, q -> q.t <= t), -1)), q -> q.g + q.v * (t - q.t))[0])[0] / {window_tokens}) as long)""")

    def sent_by(window: str) -> Column:
        return F.expr(f"""least(queue_tokens, cast(floor(weight * transform(array(double({window}) * {window_tokens}), g ->
            transform(array(element_at(filter(table, q -> q.g <= g), -1)), q -> q.t + (g - q.g) / q.v)[0])[0]) as long))""")

    wide = timed.withColumn("window", F.explode(F.sequence(F.greatest(window_of("before") - 1, F.lit(0)), window_of("before + n") + 1)))
    wide = wide.withColumn("low", F.greatest("before", sent_by("window"))).withColumn("high", F.least(F.col("before") + F.col("n"), sent_by("window + 1")))
    cut = wide.where("low < high").select("row", "queue", "window", "before", "low", (F.col("low") - F.col("before")).alias("skip"), (F.col("high") - F.col("low")).alias("m"))
    per_window = cut.groupBy("window").agg(F.sum("m").alias("window_n"))
    offsets = _running(per_window, "window_n", [], ["window"], F.floor(F.col("window") / 4096), "window_at").select("window", "window_at")
    inside = Window.partitionBy("window").orderBy("queue", "low", "row").rowsBetween(Window.unboundedPreceding, -1)
    laid = cut.withColumn("__in", F.coalesce(F.sum("m").over(inside), F.lit(0))).join(offsets, "window")
    part = F.struct("skip", (F.col("window_at") + F.col("__in")).alias("at"), F.col("m").alias("n"), "window")
    return laid.groupBy("row").agg(F.sort_array(F.collect_list(part)).alias("parts")), int(total)


def pack(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: dict[str, float] | None = None, length: int = 1024,
    window_sequences: int = 256, tokenizer: str | None = None, end_id: int = 0,
) -> DataFrame:
    """One row per piece: ``id, queue, window, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Documents become ids by ``tokenizer`` and ``end_id``.  Every window of
    ``window_sequences * length`` ids is filled by deficit round-robin over the sources (see ``schedule``): in
    proportion to ``weights``, sources without a weight forming one queue; or without ``weights`` in proportion to each source's
    ids, so that all sources last to the end.  The stream is cut every ``length`` ids; its end goes to
    sequences of falling powers of two, so no sequence needs padding.

    Null texts count as empty (one id).  A null source is a queue ``''``.  Null ids and repeated rows are documents of their own.
    An empty table gives an empty result.  Ids are kept once in the checkpoint folder, since counts are needed before cuts.
    """
    queue = F.coalesce(F.col(f"`{source}`").cast("string"), F.lit(""))
    if weights is not None:
        queue = F.when(queue.isin(list(weights)), queue).otherwise(F.lit(""))
    src = docs.select(F.col(f"`{key}`").cast("long").alias("id"), queue.alias("queue"), F.col(f"`{text}`").alias("text"))
    ids = src.mapInArrow(_encode(tokenizer or default_tokenizer(), end_id), "id long, queue string, n long, width long, ids binary")
    kept = written(ids.withColumn("row", F.monotonically_increasing_id()))
    plan, total = schedule(kept.select("row", "id", "queue", "n"), weights, window_sequences * length)
    return kept.join(plan, "row").select("id", "queue", "n", "width", "ids", "parts").mapInArrow(
        _pieces(length, total),
        "id long, queue string, window long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def mixture(pieces: DataFrame) -> DataFrame:
    """Ids per ``window`` and ``queue`` of packed pieces: what each window was filled with."""
    return pieces.groupBy("window", "queue").agg(F.sum("length").alias("tokens"))
