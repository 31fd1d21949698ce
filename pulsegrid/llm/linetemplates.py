"""Recurring lines by a tree of line templates (operator 5)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .store import row_key, written
from .textbytes import joined, mix, raw, slices, span_hashes, word_spans

LEADING = 3
#: Told apart from hashes of lines with masked tokens.
_VERBATIM = np.uint64(0x5851F42D4C957F2D)
#: Stands for each token of a masked field; hashes are odd, that of a variable token is 0.
_FIELD = 2
_HIGH = ((1 << 64) - 1) ^ 0xFFFFFFFF
#: A key with more than one in ``HOT`` of all rows is joined by broadcast; there are fewer than ``HOT`` of them.
HOT = 1000


def _tokens(texts: list[bytes]):
    """Per line with tokens: its text, number in the text, first token, token count; all tokens' 32-bit hashes, and their full hashes.

    A token with a digit, an ``@`` or ``://`` is variable and gets the 32-bit hash 0.
    """
    buf, starts = joined(texts)
    s, e = word_spans(buf)
    whole = span_hashes(buf, s, e)
    hashes = (whole >> np.uint64(33)).astype(np.int32) | 1
    odd = ((buf >= 48) & (buf <= 57)) | (buf == 64)
    odd[:-2] |= (buf[:-2] == 58) & (buf[1:-1] == 47) & (buf[2:] == 47)
    seen = np.concatenate([[0], np.cumsum(odd)])
    hashes[seen[e] > seen[s]] = 0
    breaks = np.concatenate([[0], np.cumsum(buf == 10)])
    line = breaks[s]
    first = np.flatnonzero(np.diff(line, prepend=-1))
    count = np.diff(np.append(first, len(s)))
    own = np.searchsorted(starts, s[first], "right") - 1
    return hashes, own, line[first] - breaks[starts[own]], first, count, whole


def _each(hashes, first, count):
    place = (np.arange(len(hashes)) - np.repeat(first, count)).astype(np.uint64)
    return mix(hashes.astype(np.uint64) + mix(place + np.uint64(1)))


def _kinds(hashes, first, count, least_tokens: int, similarity: float):
    """Which lines are compared verbatim, which by masks and which in the tree; and the number of constant tokens of each.

    Verbatim: fewer than ``least_tokens`` tokens, or none of them constant.  By masks: so short that one other token is less than ``similarity``.
    """
    constant = np.add.reduceat((hashes != 0).astype(np.int64), first) if len(first) else np.empty(0, np.int64)
    plain = (count < least_tokens) | (constant == 0)
    short = ~plain & (count - 1 < similarity * count)
    return plain, short, ~plain & ~short, constant


def _masked(hashes, first, count, short, constant):
    """``(line, key)`` of the short lines: the line with its variable tokens masked, and with each constant token masked in turn if others are left."""
    pick = np.flatnonzero(short)
    if not len(pick):
        return pick, np.empty(0, np.int64)
    each = _each(hashes, first, count)
    blank = _each(np.zeros_like(hashes), first, count)
    total = np.add.reduceat(each, first) + count.astype(np.uint64)
    owner = np.repeat(np.arange(len(first)), count)
    at = np.flatnonzero(short[owner] & (constant[owner] > 1) & (hashes != 0))
    keys = np.concatenate([total[pick], total[owner[at]] - each[at] + blank[at]])
    return np.concatenate([pick, owner[at]]), mix(keys).view(np.int64)


def _fielded(hashes, first, count, tree, constant, similarity: float):
    """``(line, key)`` of the lines of the tree: the line with one field masked, for each place where the field may lie.

    A field is a run of tokens after the leading ones, as long as ``similarity`` lets differ; places are half a field apart.
    A field that holds all constant tokens is not masked.
    """
    pick = np.flatnonzero(tree)
    if not len(pick):
        return pick, np.empty(0, np.int64)
    each = _each(hashes, first, count)
    blank = _each(np.full_like(hashes, _FIELD), first, count)
    total = np.add.reduceat(each, first) + count.astype(np.uint64)
    swap = np.concatenate([np.zeros(1, np.uint64), np.cumsum(blank - each)])
    held = np.concatenate([[0], np.cumsum(hashes != 0)])
    room = np.maximum(count[pick] - LEADING, 0)
    width = np.minimum((count[pick] * (1 - similarity) + 1e-9).astype(np.int64), room)
    step = np.maximum((width + 1) // 2, 1)
    places = 1 + -(-(room - width) // step)
    of = np.repeat(np.arange(len(pick)), places)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(places) - places, places)
    start = (first[pick] + count[pick] - room)[of] + np.minimum(nth * step[of], (room - width)[of])
    end = start + width[of]
    rest = constant[pick][of] - (held[end] - held[start])
    keys = total[pick][of] + np.where(rest > 0, swap[end] - swap[start], np.uint64(0))
    return pick[of], mix(keys).view(np.int64)


def _line_rows(least_tokens: int, verbatim_tokens: int, similarity: float):
    """Every line that may recur, with the keys of its templates, and where it stands."""

    def run(batches):
        for batch in slices(batches, "text"):
            hashes, own, place, first, count, whole = _tokens(raw(batch.column("text")))
            plain, short, tree, constant = _kinds(hashes, first, count, least_tokens, similarity)
            exact = np.flatnonzero(plain & (count >= verbatim_tokens))
            verbatim = np.add.reduceat(_each(whole, first, count), first) + count.astype(np.uint64) + _VERBATIM if len(first) else np.empty(0, np.uint64)
            parts = [(exact, mix(verbatim[exact]).view(np.int64)), _masked(hashes, first, count, short, constant), _fielded(hashes, first, count, tree, constant, similarity)]
            line, keys = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(line, kind="stable")
            pick, sizes = np.unique(line, return_counts=True)
            take = pa.array(own[pick])
            rid = batch.column("rid").take(take).to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(keys[order])),
                 batch.column("id").take(take), pa.array((rid << 32) | place[pick])],
                ["keys", "id", "spot"])

    return run


def _without():
    """Texts without the listed lines."""

    def run(batches):
        for batch in slices(batches, "text"):
            out, total, gone = [], [], []
            for text, rid, spots in zip(raw(batch.column("text")), *(batch.column(c).to_pylist() for c in ("rid", "spots"))):
                drop = {x & 0xFFFFFFFF for x in spots if (x ^ (rid << 32)) & _HIGH == 0} if spots else ()
                lines = text.split(b"\n")
                total.append(len(lines) if text else 0)
                gone.append(len(drop))
                out.append(b"\n".join(x for i, x in enumerate(lines) if i not in drop) if drop else text)
            yield pa.RecordBatch.from_arrays(
                [batch.column("rest"), pa.array(out, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())],
                ["rest", "text", "n_lines", "n_dropped"])

    return run


def _later(rows: DataFrame, table: DataFrame, total: int) -> DataFrame:
    """Rows with an id above the ``first`` of their ``key`` in ``table``, each at most once; ``n`` is the count of a key's rows.

    Fewer than ``HOT`` keys can have more than ``total / HOT`` rows each: those are broadcast, all others meet by shuffle.
    """
    table = table.withColumnRenamed("key", "__key")
    hot = F.col("n") * HOT > total
    wide, narrow = (table.where(x).select("__key", "first") for x in (hot, ~hot))
    same = F.col("key") == F.col("__key")
    cold = rows.join(F.broadcast(wide.select("__key")), same, "left_anti")
    return rows.join(F.broadcast(wide), same & (F.col("id") > F.col("first")), "left_semi").unionByName(
        cold.join(narrow, same & (F.col("id") > F.col("first")), "left_semi"))


def recurring_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = 0.8, min_docs: int = 2, min_tokens: int = 3, min_verbatim: int = 3,
) -> DataFrame:
    """``id, spot`` of each line with a template that ``min_docs`` documents have, one with a smaller id among them.

    The path of a line in the tree is its token count and three leading tokens; its templates are the line with one field masked
    (see ``_fielded``), and variable tokens masked everywhere.  So two lines share a template if they differ in no more than
    ``1 - similarity`` of their tokens and those lie in one field.  Which lines meet depends on those two lines alone, not on their
    order or on the size of the table.

    The template of a line of less than ``min_tokens`` tokens or without constant tokens is the line itself (from ``min_verbatim`` tokens
    on); a line too short for ``similarity`` to let a token differ has the template with variable tokens masked, and one for each
    further masked token.  The low 32 bits of ``spot`` are the line's number, the high ones tell rows of one id apart.
    """
    src = docs.select(F.col(f"`{key}`").cast("long").alias("id"), row_key(f"`{text}`").alias("rid"), F.col(f"`{text}`").alias("text")).where("id is not null")
    rows = written(src.mapInArrow(_line_rows(min_tokens, min_verbatim, similarity), "keys array<long>, id long, spot long"))
    total = rows.agg(F.sum(F.size("keys"))).first()[0] or 0
    each = rows.select(F.explode("keys").alias("key"), "id", "spot")
    if min_docs > 2:
        known = each.groupBy("key", "id").agg(F.count("*").alias("m")).groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("docs"), F.sum("m").alias("n"))
    else:  # two documents or more: the largest id is not the smallest
        known = each.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n"))
        known = known.select("key", "first", F.when(F.col("last") > F.col("first"), 2).otherwise(1).alias("docs"), "n")
    wide = F.col("n") * HOT > total
    # a key of many rows is kept even if it does not recur, so that its rows are not shuffled
    first = F.when(F.col("docs") >= min_docs, F.col("first")).otherwise(F.lit((1 << 63) - 1))
    known = written(known.where((F.col("docs") >= max(min_docs, 2)) | wide).select("key", first.alias("first"), "n"), release=True)
    return _later(each, known, total).select("id", "spot")


def drop_recurring_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = 0.8, min_docs: int = 2, min_tokens: int = 3, **options,
) -> DataFrame:
    """``docs`` without lines whose template (see ``recurring_lines``) recurs in ``min_docs`` documents or more; then ``__n_lines``, ``__n_dropped``.

    The document with the smallest id keeps its lines of a template.  A template
    counts if at least one of its tokens is constant.  Lines of fewer than ``min_tokens`` tokens and lines of variable
    tokens only recur if they are equal in every byte of their tokens, and only from ``min_verbatim`` (3) tokens on.  A line too short
    for ``similarity`` to let a token differ recurs if it equals others up to one token.

    A null text stays null and has no lines; a row with null id keeps its text and counts nowhere.  Rows with one id are one
    document in the counts.  An empty table gives an empty result.  Only hashes and ids are grouped.
    """
    names = [c for c in docs.columns if c != text]
    src = docs.select(
        F.col(f"`{key}`").cast("long").alias("id"), row_key(f"`{text}`").alias("rid"), F.col(f"`{text}`").alias("text"),
        F.struct(F.lit(0).alias("__"), F.col(f"`{text}`").isNull().alias("__null"), *[F.col(f"`{c}`") for c in names]).alias("rest"),
    )
    drops = recurring_lines(docs, key, text, similarity, min_docs, min_tokens, **options).groupBy("id").agg(F.collect_set("spot").alias("spots"))
    kinds = {f.name: f.dataType.simpleString() for f in src.schema.fields}
    cut = src.join(drops, "id", "left").select("rid", "text", "rest", "spots").mapInArrow(
        _without(), f"rest {kinds['rest']}, text string, n_lines long, n_dropped long")
    new = F.when(~F.col("rest.__null"), F.col("text"))
    return cut.select(*[new.alias(c) if c == text else F.col(f"rest.`{c}`") for c in docs.columns], F.col("n_lines").alias("__n_lines"), F.col("n_dropped").alias("__n_dropped"))
