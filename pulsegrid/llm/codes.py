"""Vector codes from codebooks of vector parts, fitted by Lloyd rounds whose members stay where they are (operator 13).

Every vector is cut into parts.  A part resides in the partition of its (position, entry, salt), as an item of one
packed block, and the owner of a partition updates entries from its residents: a round sends sums of residents, not parts.
After an update each owner assigns its residents anew, and only parts whose entry changed are packed and sent on in the
next shuffle; the others don't move, as both sides of the union share one partitioner.  The salt deals the parts of
one entry over all partitions, so an entry that holds a third of all parts is spread.

The driver holds the codebooks, ``parts * entries`` rows, and nothing that grows with the table.  Residents are kept in
memory or on disk of executors; what a lost one held is computed again from the table below the checkpoint folder.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.operators.ordered import salted_join

from .store import written

#: Components are whole numbers below this, so that squared distances fit 64 bits.
LIMIT = 1 << 27
#: Below this products are exact in doubles too, and one matrix product gives all distances.
_EXACT = 1 << 21
_ROWS = 4096


def kept_rows(vectors: DataFrame, id: str, vector: str, label: str, scale: int) -> DataFrame:
    """``row, id, label, v`` of rows whose vector is whole; ``v`` holds ``floor(scale * x)``."""
    c = F.col(vector)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    whole = vectors.where(c.isNotNull() & ~F.coalesce(F.exists(c, bad), F.lit(False)))
    small = lambda x: F.when(F.abs(x.cast("double")) * scale < LIMIT, F.floor(x.cast("double") * scale).cast("int")).otherwise(
        F.raise_error(F.lit(f"components must be below {LIMIT} / {scale}")).cast("int"))
    return written(whole.select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("id"), F.col(label).alias("label"), F.transform(c, small).alias("v")))


def _nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest row of ``book`` (the lower one of ties) and the squared distance, exact."""
    at, dist = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    small = max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)) < _EXACT and x.shape[1] <= 256
    for i in range(0, len(x), _ROWS):
        part = x[i : i + _ROWS].astype(np.float64 if small else np.int64)
        if small:
            b = book.astype(np.float64)
            d = (part * part).sum(1)[:, None] - 2.0 * (part @ b.T) + (b * b).sum(1)[None, :]
        else:
            d = np.stack([((part - row) ** 2).sum(1) for row in book.astype(np.int64)], 1)
        best = d.argmin(1)
        at[i : i + _ROWS], dist[i : i + _ROWS] = best, d[np.arange(len(best)), best]
    return at, dist


class _Block:
    """Parts of one position as arrays: row numbers, entries and components."""

    @staticmethod
    def pack(position: int, rows: np.ndarray, entries: np.ndarray, x: np.ndarray) -> tuple:
        return position, rows.astype("<i8").tobytes(), entries.astype("<i4").tobytes(), x.astype("<i4").tobytes()

    @staticmethod
    def open(block: tuple) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        position, rows, entries, x = block
        rows = np.frombuffer(rows, "<i8")
        return position, rows, np.frombuffer(entries, "<i4"), np.frombuffer(x, "<i4").reshape(len(rows), -1)


def _homes(position: int, entries: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Partition of each part: entries start somewhere, salts (from the row) follow one after another."""
    salt = ((rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % n
    return (entries.astype(np.int64) * 40503 + position * 977 + salt) % n


def _sent(position: int, rows, entries, x, n: int):
    """One packed block for each partition that parts go to."""
    home = _homes(position, entries, rows, n)
    order = np.argsort(home, kind="stable")
    cuts = np.flatnonzero(np.diff(home[order])) + 1
    for own in np.split(order, cuts) if len(order) else ():
        yield int(home[own[0]]), _Block.pack(position, rows[own], entries[own], x[own])


def _placed(parts: int, books, n: int):
    """First assignment: batches of whole vectors become blocks for their homes."""

    def run(batches):
        for batch in batches:
            rows = np.array(batch.column("row"), np.int64)
            v = batch.column("v")
            x = np.array(v.flatten(), np.int32).reshape(len(rows), -1)
            for p, part in enumerate(np.split(x, parts, axis=1)):
                at, _ = _nearest(part, books.value[p])
                for home, block in _sent(p, rows, at, part, n):
                    yield pa.RecordBatch.from_pylist([{"home": home, "block": dict(zip("prex", block))}], schema=_SENT)

    return run


_SENT = pa.schema([("home", pa.int32()), ("block", pa.struct([("p", pa.int32()), ("r", pa.binary()), ("e", pa.binary()), ("x", pa.binary())]))])


def _assigned(books, n: int):
    """Residents by the new codebooks: ``(home, stays, block)``."""

    def run(residents):
        for home, block in residents:
            p, rows, old, x = _Block.open(block)
            at, _ = _nearest(x, books.value[p])
            same = at == old
            if same.any():
                yield home, True, _Block.pack(p, rows[same], at[same], x[same])
            moved = ~same
            for to, parcel in _sent(p, rows[moved], at[moved], x[moved], n):
                yield to, False, parcel

    return run


def _merged(residents):
    """One block a position: what stayed and what came in."""
    held: dict[int, list] = {}
    for home, block in residents:
        p, *arrays = _Block.open(block)
        held.setdefault(p, []).append((home, *arrays))
    for p, blocks in held.items():
        yield blocks[0][0], _Block.pack(p, *(np.concatenate([b[i] for b in blocks]) for i in (1, 2, 3)))


def _sums(residents):
    """Per position and entry of this partition the residents' sum and count."""
    total: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for _, block in residents:
        p, _, entries, x = _Block.open(block)
        for e in np.unique(entries):
            own = x[entries == e]
            key = (p, int(e))
            s, c = total.get(key, (0, 0))
            total[key] = (s + own.sum(0, dtype=np.int64), c + len(own))
    for key, (s, c) in total.items():
        yield key, (s.tolist(), c)


def _added(a, b):
    return [x + y for x, y in zip(a[0], b[0])], a[1] + b[1]


def _home(key) -> int:
    return key


def _first_books(kept: DataFrame, parts: int, entries: int) -> list[np.ndarray]:
    """The parts of the vectors with the smallest ids (nulls last, ties by components)."""
    first = kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    return list(np.split(np.array([r[0] for r in first], np.int64), parts, axis=1))


def _residents(kept: DataFrame, books: list[np.ndarray], rounds: int, n: int):
    """Run the rounds; the last codebooks, and the residents as their owners hold them."""
    sc = kept.sparkSession.sparkContext
    shared = sc.broadcast(books)
    placed = kept.select("row", "v").mapInArrow(_placed(len(books), shared, n), "home int, block struct<p int, r binary, e binary, x binary>")
    arriving = placed.rdd.map(lambda r: (r[0], (r[1][0], bytes(r[1][1]), bytes(r[1][2]), bytes(r[1][3]))))
    held = arriving.partitionBy(n, _home).mapPartitions(_merged, preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)
    old = []
    for k in range(rounds):
        for (p, e), (s, c) in held.mapPartitions(_sums).reduceByKey(_added, max(1, min(n, 32))).collect():
            books[p][e] = [x // c for x in s]
        for done in old:
            done.unpersist()
        shared = sc.broadcast([b.copy() for b in books])
        if k < rounds - 1:
            dealt = held.mapPartitions(_assigned(shared, n), preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)
            stays = dealt.filter(lambda r: r[1]).mapPartitions(_bare, preservesPartitioning=True)
            moves = dealt.filter(lambda r: not r[1]).mapPartitions(_bare).partitionBy(n, _home)
            old = [held, dealt]
            held = stays.union(moves).mapPartitions(_merged, preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)
    return shared, held


def _bare(rows):
    for home, _, block in rows:
        yield home, block


def _closest(shared):
    """The last assignment of the residents, unpacked: ``row, p, e, d``."""

    def run(batches):
        for batch in batches:
            for block in batch.to_pylist():
                p, rows, _, x = _Block.open((block["p"], block["r"], block["e"], block["x"]))
                at, dist = _nearest(x, shared.value[p])
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.full(len(rows), p, np.int32)), pa.array(at.astype(np.int32)), pa.array(dist)], ["row", "p", "e", "d"])

    return run


def _digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for row in book.tolist() for x in row).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, partitions: int | None = None,
             id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``id, code, error, label_error, codebooks_sha256`` of every row with a whole vector.

    Components become ``floor(scale * x)``; vectors are cut into ``parts`` equal parts, each with a codebook that starts as
    those parts of the ``entries`` smallest ids.  A round assigns each part to the nearest entry and replaces entries by
    the floored mean of their parts; unused entries stay.  ``code`` has two hex digits a part (``entries`` is 256 at most).

    Rows whose vector is null or holds nulls, NaN or infinities are dropped; repeated ids each keep their own row, ties among
    the first ids go by components.  An empty table gives no rows; fewer rows than ``entries`` give smaller codebooks.
    Vectors of different or indivisible length and components of 2**27 / ``scale`` or more raise an error.
    """
    spark = vectors.sparkSession
    kept = kept_rows(vectors, id, vector, label, scale)
    n, low, high = kept.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v"))).first()
    types = {f.name: f.dataType.simpleString() for f in kept.schema}
    shape = f"id {types['id']}, code string, error long, label_error long, codebooks_sha256 string"
    if not n:
        return spark.createDataFrame([], shape)
    if low != high or low % parts or not low or entries > 256:
        raise ValueError(f"vectors of {low} to {high} components can't be cut into {parts} parts of 256 entries at most")
    if partitions is None:
        partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // (1 << 18)))
    books = _first_books(kept, parts, entries)
    shared, held = _residents(kept, books, rounds, partitions)
    blocks = spark.createDataFrame(held.mapPartitions(_values), "p int, r binary, e binary, x binary")
    found = written(blocks.mapInArrow(_closest(shared), "row long, p int, e int, d long"))
    held.unpersist()
    codes = found.groupBy("row").agg(
        F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "e"))), lambda s: F.lpad(F.hex(s["e"]), 2, "0")), "")).alias("code"),
        F.sum("d").alias("error"))
    rows = written(codes.join(kept.select("row", "id", "label"), "row"))
    none = F.col("label").isNull()
    keyed = rows.withColumns({"no_label": none, "key": F.coalesce(F.col("label").cast("string"), F.lit(""))})
    totals = keyed.groupBy("no_label", "key").agg(F.sum("error").alias("label_error"))
    out = salted_join(keyed, totals, ["no_label", "key"])
    return out.select("id", "code", "error", "label_error", F.lit(_digest(books)).alias("codebooks_sha256"))


def _values(residents):
    for _, block in residents:
        yield block
