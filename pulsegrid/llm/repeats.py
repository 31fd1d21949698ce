"""Removal of passages that documents share, with suffix automata of reference shards (operator 6)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .automaton import SuffixAutomaton
from .store import row_key, written
from .textbytes import grams, mix, raw, slices, words_of

ANCHOR_WORDS = 5
#: Windows in a run at most, and the bits that a run's windows take in a code.
_RUN = _BITS = 24


def _anchored(texts: list[bytes], least: int):
    """Every window of ``least`` words: its first word, its anchor's place and hash (62 bits).

    The anchor is the smallest hash among the 5-word sequences inside, so equal windows have equal anchors.
    """
    buf, s, e, hashes, owner = words_of(texts)
    size = min(ANCHOR_WORDS, least)
    g, first = grams(hashes, owner, size)
    span = least - size + 1
    if len(g) < span:
        none = np.empty(0, np.int64)
        return (buf, s, e, hashes, owner), none, none, none
    at = np.lib.stride_tricks.sliding_window_view(g, span).argmin(1) + np.arange(len(g) - span + 1)
    whole = np.flatnonzero(owner[first[: len(at)]] == owner[first[span - 1 :]])
    at = at[whole]
    return (buf, s, e, hashes, owner), first[whole], first[at], (g[at] >> np.uint64(2)).astype(np.int64)


def _anchors(least: int):
    """Distinct ``(anchor, id)`` of each document."""

    def run(batches):
        for batch in slices(batches, "text"):
            (_, _, _, _, owner), start, _, anchor = _anchored(raw(batch.column("text")), least)
            own = owner[start]
            _, pick = np.unique(mix(anchor.astype(np.uint64) ^ mix(own.astype(np.uint64))), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(anchor[pick]), batch.column("id").take(pa.array(own[pick]))], ["anchor", "id"])

    return run


def _segments(least: int):
    """Runs of windows around shared anchors: the words of a run, and where it starts.

    Marks are ``2 * anchor + hot``.  Windows around a hot anchor go out one by one, keyed by all their words.
    """

    def run(batches):
        for batch in slices(batches, "text"):
            texts = raw(batch.column("text"))
            (buf, s, e, hashes, owner), start, place, anchor = _anchored(texts, least)
            marks = batch.column("marks")
            sizes = np.diff(marks.offsets.to_numpy())
            values = marks.flatten().to_numpy()
            pair = lambda a, o: mix(a.astype(np.uint64) ^ mix(o.astype(np.uint64)))
            held = pair(values >> 1, np.repeat(np.arange(len(sizes)), sizes))
            order = np.argsort(held)
            want = pair(anchor, owner[start])
            found = np.searchsorted(held[order], want)
            found[found == len(held)] = 0
            hit = held[order][found] == want if len(held) else np.zeros(len(want), bool)
            start, place, anchor, hot = (x[hit] for x in (start, place, anchor, (values[order][found] & 1).astype(bool)))
            if not len(start):
                continue
            fresh = np.ones(len(start), bool)
            fresh[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1) | hot[1:]
            head = np.flatnonzero(fresh)
            fresh |= (np.arange(len(start)) - head[np.cumsum(fresh) - 1]) % _RUN == 0
            head = np.flatnonzero(fresh)
            count = np.diff(np.append(head, len(start)))
            first, many = start[head], count + least - 1
            content = np.zeros(len(head), np.uint64)
            for i in range(int(many.max())):
                inside = many > i
                content[inside] = (content[inside] + hashes[first[inside] + i]) * np.uint64(0xD1342543DE82EF95)
            content = mix(content ^ many.astype(np.uint64)).view(np.int64)
            group = np.where(hot[head], content, anchor[head])
            data = buf.tobytes()
            words = [b" ".join(data[a:b].split()) for a, b in zip(s[first].tolist(), e[first + many - 1].tolist())]
            base = np.searchsorted(owner, np.arange(len(texts)))
            own = owner[first]
            take = pa.array(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(group), pa.array(content), pa.array(words, pa.binary()), batch.column("id").take(take), batch.column("rid").take(take),
                 pa.array(first - base[own]), pa.array(count.astype(np.int64))],
                ["anchor", "content", "words", "id", "rid", "start", "windows"])

    return run


def _first_owners(least: int):
    """Smallest owner of every window of each distinct run; rows come sorted by anchor.

    Runs that share an anchor make up a reference shard.  If there is more than one,
    their automaton is built and each run is streamed through it.
    """

    def judged(shard):
        if len(shard) == 1:
            content, _, low, windows = shard[0]
            return [(content, [low] * windows)]
        sam, split = SuffixAutomaton(), [words.split() for _, words, _, _ in shard]
        for tokens, (_, _, low, _) in zip(split, shard):
            sam.add(tokens, low)
        return [(c, [o for _, o in sam.stream(tokens, least)][least - 1 :]) for tokens, (c, _, _, _) in zip(split, shard)]

    def run(batches):
        anchor, shard, out = None, [], ([], [], [])

        def flush():
            for content, owners in judged(shard):
                out[0].append(anchor)
                out[1].append(content)
                out[2].append(owners)

        def table():
            return pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int64()))], ["anchor", "content", "owners"])

        for batch in batches:
            for a, *row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "content", "words", "low", "windows"))):
                if a != anchor:
                    if shard:
                        flush()
                    anchor, shard = a, []
                shard.append(row)
            yield table()
            for x in out:
                x.clear()
        if shard:
            flush()
            yield table()

    return run


def _cut(least: int, rejoin: bool):
    """Text without the covered words."""

    def run(batches):
        for batch in slices(batches, "text"):
            texts = raw(batch.column("text"))
            buf, s, e, _, owner = words_of(texts)
            base = np.searchsorted(owner, np.arange(len(texts) + 1))
            covered = np.zeros(len(s) + 1, np.int64)
            for i, (rid, rids, codes) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("rid", "rids", "codes")))):
                if codes:
                    codes = np.array(codes, np.int64)[np.array(rids, np.int64) == rid]
                    for bit in range(_BITS):
                        at = (codes >> _BITS)[(codes >> bit & 1) == 1] + base[i] + bit
                        np.add.at(covered, at, 1)
                        np.add.at(covered, at + least, -1)
            gone = np.cumsum(covered)[:-1] > 0
            removed = np.add.reduceat(np.append(gone, False).astype(np.int64), base[:-1]) * (np.diff(base) > 0)
            out = []
            for i, text in enumerate(texts):
                low, high = int(base[i]), int(base[i + 1])
                if rejoin:
                    ws = text.split()
                    out.append(b" ".join(w for w, g in zip(ws, gone[low:high].tolist()) if not g) if removed[i] else b" ".join(ws))
                elif not removed[i]:
                    out.append(text)
                else:
                    offset = int(s[low]) - (len(text) - len(text.lstrip(b" \t\n\r\v\f")))
                    edge = np.append(s[low:high], offset + len(text))
                    keep = np.repeat(~gone[low:high], np.diff(edge))
                    out.append(text[: int(s[low]) - offset] + buf[s[low] : offset + len(text)][keep].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("rest"), pa.array(out, pa.binary()).cast(pa.string()), pa.array(np.diff(base)), pa.array(removed)],
                ["rest", "text", "n_words", "n_removed"])

    return run


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 13, hot: int = 1000, rejoin: bool = False,
) -> DataFrame:
    """``docs`` with every word gone that lies in a window of ``words`` words that also starts in a document with a smaller id.

    Windows are judged on the input texts.  Columns are those of ``docs`` with the new text, then
    ``__n_words`` and ``__n_removed``.  Kept words keep the white space that follows them, or with
    ``rejoin`` are joined by one blank.

    1. Each window has an anchor, the smallest hash of a 5-word sequence inside; about a fifth of all
       words start one.  Anchors that occur in one document only need no further look.
    2. Around shared anchors, the runs of windows with that anchor are cut out.  Equal runs are merged with their
       smallest id, so thousands of copies of a passage are one row.
    3. The distinct runs of one anchor are a reference shard: its suffix automaton carries the smallest
       owner of every substring, and the runs are streamed through it for their matching statistics.
       An anchor in more than ``hot`` documents would make a large shard; its windows are keyed by all
       their words instead and spread out.  The result is the same either way.
    4. Owners return to the documents by (anchor, run), and covered words are removed.

    A null text stays null, with no words.  A row with null id keeps its text and is nobody's
    source.  Rows with one id are one document as regards ids, yet each is judged on its own text.
    An empty table gives an empty result.
    """
    names = [c for c in docs.columns if c != text]
    src = docs.select(
        F.col(f"`{key}`").cast("long").alias("id"), row_key(f"`{text}`").alias("rid"), F.col(f"`{text}`").alias("text"),
        F.struct(F.lit(0).alias("__"), F.col(f"`{text}`").isNull().alias("__null"), *[F.col(f"`{c}`") for c in names]).alias("rest"),
    )
    plain = src.select("id", "text").where("id is not null")
    anchors = plain.mapInArrow(_anchors(words), "anchor long, id long")
    shared = written(
        anchors.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n"))
        .where("low < high").select("anchor", (F.col("n") > hot).cast("long").alias("hot")),
        release=True,
    )
    marks = anchors.join(shared, "anchor").groupBy("id").agg(F.collect_list(F.col("anchor") * 2 + F.col("hot")).alias("marks"))
    runs = written(src.join(marks, "id").select("id", "rid", "text", "marks").mapInArrow(
        _segments(words), "anchor long, content long, words binary, id long, rid long, start long, windows long"), release=True)
    distinct = runs.groupBy("anchor", "content").agg(F.min("id").alias("low"), F.max("windows").alias("windows"), F.first("words").alias("words"))
    shards = distinct.repartition("anchor").sortWithinPartitions("anchor").select("anchor", "content", "words", "low", "windows")
    owners = shards.mapInArrow(_first_owners(words), "anchor long, content long, owners array<long>")
    bits = F.expr("aggregate(transform(owners, (x, i) -> if(x < id, shiftleft(1L, i), 0L)), 0L, (a, x) -> a + x)")
    codes = written(
        runs.select("anchor", "content", "id", "rid", "start").join(owners, ["anchor", "content"])
        .select("id", "rid", "start", bits.alias("bits")).where("bits > 0")
        .groupBy("id").agg(F.collect_list("rid").alias("rids"), F.collect_list(F.col("start") * (1 << _BITS) + F.col("bits")).alias("codes")),
        release=True,
    )
    kinds = {f.name: f.dataType.simpleString() for f in src.schema.fields}
    cut = src.join(codes, "id", "left").select("rid", "text", "rest", "rids", "codes").mapInArrow(
        _cut(words, rejoin), f"rest {kinds['rest']}, text string, n_words long, n_removed long")
    new = F.when(~F.col("rest.__null"), F.col("text"))
    return cut.select(*[new.alias(c) if c == text else F.col(f"rest.`{c}`") for c in docs.columns], F.col("n_words").alias("__n_words"), F.col("n_removed").alias("__n_removed"))
