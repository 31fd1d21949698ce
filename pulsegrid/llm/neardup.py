"""Near-duplicate documents by min-max hashing (operator 9)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .store import written
from .textbytes import SLICE_BYTES, grams, mix, raw, slices, words_of

_BITS = np.uint64(51)
_LOW = np.uint64((1 << 51) - 1)
#: A bucket of so many members is searched in one part; of larger ones the members are looked up by their rare shingles.
SMALL = 512
#: Leaders of a round, and shingles of members that meet them in one part, in what is left of rare shingles' buckets.
LEADERS, SLICE_SHINGLES = 2048, 1 << 19
#: Counts that order shingles by how common they are; sent to every task, so of fixed number.
COUNTERS = 1 << 16
SIGNED = "id long, n long, h1 long, h2 long, bands array<long>, sig binary"


def shingle_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text (51-bit hashes, sorted per text) and where each text's start.

    A text with fewer than ``size`` words has its whole sequence as its one shingle.
    """
    _, _, _, hashes, owner = words_of(texts, lower=True)
    g, first = grams(hashes, owner, size)
    values, owners = [g], [owner[first]]
    per_text = np.bincount(owner, minlength=len(texts))
    for few in range(1, size):
        if (per_text == few).any():
            g, first = grams(hashes, owner, few)
            pick = per_text[owner[first]] == few
            values.append(g[pick])
            owners.append(owner[first][pick])
    value, own = np.concatenate(values), np.concatenate(owners).astype(np.uint64)
    keys = np.unique((own << _BITS) | (value & _LOW))
    return keys & _LOW, np.searchsorted(keys, np.arange(len(texts) + 1, dtype=np.uint64) << _BITS)


def signatures(sets: np.ndarray, starts: np.ndarray, permutations: int) -> np.ndarray:
    """Minimum and maximum of each set under each permutation; one row per non-empty set."""
    full = starts[:-1][np.diff(starts) > 0]
    draw = np.random.default_rng(20240501)
    out = np.empty((len(full), 2 * permutations), np.uint32)
    spread = (mix(sets) >> np.uint64(32)).astype(np.uint32)
    x, y = np.empty_like(spread), np.empty_like(spread)
    for i, (a, b) in enumerate(draw.integers(0, 1 << 32, (permutations, 2), dtype=np.uint32)):
        np.bitwise_xor(spread, b, out=x)
        x *= a | np.uint32(1)
        np.right_shift(x, np.uint32(15), out=y)
        x ^= y
        out[:, 2 * i] = np.minimum.reduceat(x, full)
        out[:, 2 * i + 1] = np.maximum.reduceat(x, full)
    return out


def _sign(size: int, permutations: int, rows: int):
    def run(batches):
        for batch in slices(batches, "text"):
            sets, starts = shingle_sets(raw(batch.column("text")), size)
            counts = np.diff(starts)
            full = counts > 0
            h1, h2 = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
            bands, sigs = [None] * len(counts), [None] * len(counts)
            if full.any():
                at = starts[:-1][full]
                h1[full] = np.add.reduceat(mix(sets + np.uint64(1)), at).view(np.int64)
                h2[full] = np.add.reduceat(mix(sets * np.uint64(0x9E3779B97F4A7C15) + np.uint64(7)), at).view(np.int64)
                sig = signatures(sets, starts, permutations).astype(np.uint64)
                count = 2 * permutations // rows
                band = np.zeros((len(at), count), np.uint64)
                for j in range(rows):
                    band = mix(band + sig[:, j * count : (j + 1) * count])
                band = mix(band + np.arange(band.shape[1], dtype=np.uint64)).view(np.int64)
                small = (mix(sig) & np.uint64(255)).astype(np.uint8)
                for k, i in enumerate(np.flatnonzero(full).tolist()):
                    bands[i], sigs[i] = band[k], small[k].tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(counts.astype(np.int64)), pa.array(h1, mask=~full), pa.array(h2, mask=~full),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                ["id", "n", "h1", "h2", "bands", "sig"])

    return run


def _likely(least: float):
    """Pairs whose signatures agree in at least ``least`` of their places."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in ("sa", "sb"))
                near = (x == y).mean(1) >= least
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(near))

    return run


def _shingle_counts(size: int):
    """How many shingles of these texts fall in each counter."""

    def run(batches):
        total = np.zeros(COUNTERS, np.int64)
        for batch in slices(batches, "text"):
            sets, _ = shingle_sets(raw(batch.column("text")), size)
            total += np.bincount((mix(sets) >> np.uint64(48)).astype(np.int64), minlength=COUNTERS)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["counter", "n"])

    return run


def _rare_shingles(size: int, percent: int, common: np.ndarray):
    """``(band, id, n)``: the rarest shingles of each text, as many as a linked text can't all lack.

    Texts with ``100 * |A & B| >= percent * |A | B|`` share ``percent`` in 100 of either's shingles.  In any one order of
    all shingles the first ``n - ceil(percent * n / 100) + 1`` of the two then meet.
    """

    def run(batches):
        for batch in slices(batches, "text"):
            sets, starts = shingle_sets(raw(batch.column("text")), size)
            n = np.diff(starts)
            own = np.repeat(np.arange(len(n)), n)
            hashes = mix(sets)
            order = np.lexsort((hashes, common[(hashes >> np.uint64(48)).astype(np.int64)], own))
            place = np.arange(len(sets)) - np.repeat(starts[:-1], n)
            first = place < np.repeat(n - -(-percent * n // 100) + 1, n)
            pick, own = order[first], own[first]
            yield pa.RecordBatch.from_arrays([pa.array(hashes[pick].view(np.int64)), batch.column("id").take(pa.array(own)), pa.array(n[own].astype(np.int64))], ["band", "id", "n"])

    return run


def _parts(batches, columns: list[str]):
    """Rows of each ``(band, slice)``; they come sorted by both."""
    key, rows = None, []
    for batch in batches:
        for now, part, *row in zip(*(batch.column(c).to_pylist() for c in ("band", "slice", *columns))):
            if (now, part) != key:
                if rows:
                    yield key, rows
                key, rows = (now, part), []
            rows.append(row)
    if rows:
        yield key, rows


def _pairs(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b)], ["a", "b"])


def _likely_inside(least: float, percent: int):
    """Likely pairs from different components in a small bucket; each from the first band that the two share."""

    def run(batches):
        for (band, _), rows in _parts(batches, ["id", "n", "comp", "sig", "bands"]):
            ids, n, comp = (np.array([r[i] for r in rows], np.int64) for i in range(3))
            sig = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(len(rows), -1)
            bands = np.array([r[4] for r in rows], np.int64)
            a, b = [], []
            for i in range(len(rows)):
                fit = np.flatnonzero((comp != comp[i]) & (ids > ids[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])))
                fit = fit[(sig[fit] == sig[i]).sum(1) >= least * sig.shape[1]]
                if len(fit):
                    fit = fit[bands[i][(bands[fit] == bands[i]).argmax(1)] == band]
                a += [ids[i]] * len(fit)
                b += ids[fit].tolist()
            yield _pairs(a, b)

    return run


def _sets(size: int):
    """``(id, shingles)`` as packed numbers."""

    def run(batches):
        for batch in slices(batches, "text"):
            sets, starts = shingle_sets(raw(batch.column("text")), size)
            packed = [sets[x:y].tobytes() for x, y in zip(starts[:-1], starts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(packed, pa.binary())], ["id", "shingles"])

    return run


def _links_inside(percent: int):
    """Links that join components of one part, by full sets: one link for each two components that meet.

    A part has the leaders of its bucket and a bounded slice of its other members; leaders meet each other in slice 0.
    What a leader joins counts as one component from then on, so a part writes fewer links than it has members.
    """

    def run(batches):
        for (_, part), rows in _parts(batches, ["id", "comp", "rank", "shingles"]):
            ids, comp, rank = (np.array([r[i] for r in rows], np.int64) for i in range(3))
            sets = [np.frombuffer(r[3], np.uint64) for r in rows]
            n = np.array([len(x) for x in sets], np.int64)
            words, code = np.unique(np.concatenate(sets), return_inverse=True)
            starts = np.cumsum(n) - n
            a, b = [], []
            met = (rank == 0) | (part == 0)  # rank 0: not a leader
            for i in sorted(np.flatnonzero(rank).tolist(), key=rank.__getitem__):
                other = met & (comp != comp[i]) & ((rank == 0) | (rank > rank[i])) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
                if not other.any():
                    continue
                own = np.zeros(len(words), bool)
                own[code[starts[i] : starts[i] + n[i]]] = True
                common = np.add.reduceat(own[code].astype(np.int64), starts)
                linked = np.flatnonzero(other & (100 * common >= percent * (n + n[i] - common)))
                for k in linked.tolist():
                    if comp[k] != comp[i]:
                        a.append(ids[i])
                        b.append(ids[k])
                        comp[comp == comp[k]] = comp[i]
            yield _pairs(a, b)

    return run


def _confirm(size: int, percent: int):
    """Pairs with ``100 * |A & B| >= percent * |A | B|`` on the full sets."""

    def run(batches):
        for batch in slices(batches, "ta", SLICE_BYTES // 2):
            k = batch.num_rows
            if not k:
                continue
            sets, starts = shingle_sets(raw(batch.column("ta")), size)
            more, ends = shingle_sets(raw(batch.column("tb")), size)
            pair = lambda at: np.repeat(np.arange(k, dtype=np.uint64), np.diff(at)) << _BITS
            both = np.intersect1d(sets | pair(starts), more | pair(ends), assume_unique=True)
            common = np.bincount((both >> _BITS).astype(np.int64), minlength=k)
            union = np.diff(starts) + np.diff(ends) - common
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(
                pa.array((100 * common >= percent * union) & (common > 0)))

    return run


def components(links: DataFrame) -> DataFrame:
    """``(id, comp)``: the smallest id reachable over ``links(a, b)``, for every id that has a link.

    Each round hangs every node on its smallest neighbour, follows that once
    more and contracts the links; what is left shrinks until none remains.
    """
    edges = written(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct())
    where = edges.select(F.col("a").alias("id"), F.col("a").alias("comp")).distinct()
    while not edges.isEmpty():
        up = edges.groupBy("a").agg(F.least("a", F.min("b")).alias("up"))
        top = up.select(F.col("a").alias("up"), F.col("up").alias("top"))
        step = written(up.join(top, "up").select(F.col("a").alias("comp"), "top"))
        where = written(where.join(step, "comp", "left").select("id", F.coalesce("top", "comp").alias("comp")))
        for side in ("a", "b"):
            edges = edges.join(step.withColumnRenamed("comp", side), side).drop(side).withColumnRenamed("top", side)
        edges = written(edges.where("a != b").select("a", "b").distinct())
    return where


class _Search:
    """Links found so far among representatives, their components, and the steps that look for more."""

    def __init__(self, src: DataFrame, reps: DataFrame, words: int, percent: int, least: float):
        self.src, self.reps, self.words, self.percent, self.least = src, reps, words, percent, least
        self.links = self.linked = self.tried = self.texts = None

    def _note(self, pairs: DataFrame) -> None:
        """Confirm pairs on full sets; new links join components."""
        pairs = pairs.distinct()
        pairs = written(pairs.join(self.tried, ["a", "b"], "left_anti") if self.tried is not None else pairs)
        side = lambda to: self.texts.select(F.col("id").alias(to), F.col("text").alias(f"t{to}"))
        found = written(pairs.join(side("b"), "b").join(side("a"), "a").mapInArrow(_confirm(self.words, self.percent), "a long, b long"))
        self.tried = pairs if self.tried is None else self.tried.unionByName(pairs)
        if self.links is None or not found.isEmpty():
            self.links = found if self.links is None else self.links.unionByName(found)
            self.linked = components(self.links)

    def first(self, banded: DataFrame) -> DataFrame | None:
        """Compare every member of a bucket with its smallest one; the other members, with ``lead``."""
        shared = banded.groupBy("band").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead < last").drop("last")
        members = written(banded.join(shared, "band"))
        if members.isEmpty():
            return None
        if self.texts is None:
            self.texts = written(self.src.join(members.select("id").distinct(), "id", "left_semi"))
        size = self.reps.select(F.col("id").alias("lead"), F.col("n").alias("na")).distinct()
        leads = members.where("id != lead").select("lead", "id", "n").distinct().join(size, "lead")
        leads = leads.where(f"100 * least(n, na) >= {self.percent} * greatest(n, na)").select(F.col("lead").alias("a"), F.col("id").alias("b"))
        sig = lambda to: self.reps.select(F.col("id").alias(to), F.col("sig").alias(f"s{to}"))
        self._note(leads.join(sig("b"), "b").join(sig("a"), "a").mapInArrow(_likely(self.least), "a long, b long"))
        return members.where("id != lead").drop("lead")

    def mixed(self, members: DataFrame) -> DataFrame:
        """Members of buckets that still hold several components: with ``comp`` and the bucket's ``size``."""
        now = members.join(self.linked, "id", "left").select("band", "id", "n", F.coalesce("comp", "id").alias("comp"))
        several = now.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("size")).where("low < high")
        return written(now.join(several.select("band", "size"), "band"))

    def inside(self, small: DataFrame) -> None:
        """Compare all members of small buckets."""
        full = small.join(self.reps.select("id", "sig", "bands"), "id").select("band", F.lit(0).alias("slice"), "id", "n", "comp", "sig", "bands")
        full = full.repartition("band").sortWithinPartitions("band")
        self._note(full.mapInArrow(_likely_inside(self.least, self.percent), "a long, b long"))

    def rare(self, hot: DataFrame) -> None:
        """All links among ``hot`` ids, by shingles that few texts share.

        Unlinked texts that share a common passage don't meet here, as its shingles are common and come last in the order.
        """
        texts = written(self.texts.join(hot, "id", "left_semi"))
        common = np.zeros(COUNTERS, np.int64)
        for r in texts.mapInArrow(_shingle_counts(self.words), "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).collect():
            common[r.counter] = r.n
        rest = self.first(texts.mapInArrow(_rare_shingles(self.words, self.percent, common), "band long, id long, n long"))
        if rest is None:
            return
        sets = written(texts.mapInArrow(_sets(self.words), "id long, shingles binary"))
        while not (now := self.mixed(rest)).isEmpty():
            # members of the components that have fewest members here lead; what the largest one holds need not
            share = now.groupBy("band", "comp").agg(F.count("*").alias("many"))
            order = Window.partitionBy("band").orderBy("many", "comp", "id")
            leaders = now.join(share, ["band", "comp"]).select("band", "id", F.row_number().over(order).alias("rank")).where(F.col("rank") <= LEADERS)
            now = written(now.join(leaders, ["band", "id"], "left").withColumn("rank", F.coalesce("rank", F.lit(0))))
            parts = now.groupBy("band").agg((F.floor(F.sum("n") / SLICE_SHINGLES) + 1).alias("slices"))
            own = F.when(F.col("rank") > 0, F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), F.col("slices"))))
            full = now.join(parts, "band").withColumn("slice", F.explode(own)).join(sets, "id").select("band", "slice", "id", "comp", "rank", "shingles")
            full = full.repartition("band", "slice").sortWithinPartitions("band", "slice")
            found = written(full.mapInArrow(_links_inside(self.percent), "a long, b long").distinct())
            if not found.isEmpty():
                self.links = self.links.unionByName(found)
                self.linked = components(self.links)
            rest = now.where("rank = 0").select("band", "id", "n")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80,
    permutations: int = 128, rows: int = 6, least: float = 0.67,
) -> DataFrame:
    """One row per document: ``id, n_shingles, component_id, kept``.

    Documents are linked when their sets of distinct ``words``-word shingles
    (A-Z lowered) have a Jaccard similarity of at least ``percent`` / 100; a component is
    everything linked directly or through others.

    Min-max hashing keeps the minimum and the maximum under each of
    ``permutations`` permutations, so 128 hash evaluations give 256 signature
    places in 42 bands of ``rows``.  A pair at 0.8 misses all bands with
    probability 3e-6, a pair at 0.3 meets with 0.03.  Pairs whose set sizes rule a link out, and
    signatures below ``least`` agreement (5 standard deviations under 0.8), are
    not read further; all others are confirmed on full sets.

    Equal sets are merged before banding, so any number of copies is one entry.  In a
    bucket every entry is compared with the smallest one first; members that
    ended in one component need no more comparison.  Buckets of up to ``SMALL`` members that still hold several
    components are then searched in one part, by signature, so that only likely pairs are written.  Members of larger
    ones are texts that share much without being linked, such as a common passage.  They are looked up by their rarest
    shingles, of which linked texts share one for certain; there too the smallest member comes first, and in what is
    left members of the smaller components lead: they are compared on full sets inside bounded parts, which write
    one link for two components that meet.  This ends when no pair from different components is untried: no cap, no pair list of a whole group.

    Null or wordless texts have ``n_shingles`` 0, are linked with nothing and kept.  A row
    with null id is kept, with null component.  Repeated rows get equal results.  Only
    ``key`` and ``text`` are read from ``docs``.  An empty table gives an empty result.
    """
    src = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    signed = written(src.mapInArrow(_sign(words, permutations, rows), SIGNED))
    groups = signed.where("n > 0 and id is not null").groupBy("h1", "h2").agg(F.min("id").alias("rep"))
    reps = written(signed.join(groups.withColumnRenamed("rep", "id"), ["h1", "h2", "id"], "left_semi").select("id", "n", "bands", "sig"))
    search = _Search(src, reps, words, percent, least)
    members = search.first(reps.select(F.explode("bands").alias("band"), "id", "n"))
    linked = None
    if members is not None:
        mixed = search.mixed(members)
        search.inside(mixed.where(F.col("size") <= SMALL))
        hot = written(mixed.where(F.col("size") > SMALL).select("id").distinct())
        if not hot.isEmpty():
            search.rare(hot)
        linked = search.linked
    if linked is not None:
        groups = groups.join(linked.withColumnRenamed("id", "rep"), "rep", "left").select("h1", "h2", F.coalesce("comp", "rep").alias("comp"))
    else:
        groups = groups.withColumnRenamed("rep", "comp")
    known = signed.select("id", "n", "h1", "h2").join(groups, ["h1", "h2"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("comp", "id"))
    return known.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the one with the smallest id."""
    gone = near_duplicates(docs, key, text, **options).where(~F.col("kept")).select(F.col("id").alias("__gone")).distinct()
    return docs.join(gone, docs[f"`{key}`"].cast("long") == gone["__gone"], "left_anti")
