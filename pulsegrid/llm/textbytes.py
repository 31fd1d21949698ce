"""Whole-batch byte work shared by the text operators: words, chunks and their hashes in numpy.

All functions run inside tasks on one slice of a batch.  A slice holds a few
megabytes of text, or one document if that is longer, and hashing walks a long
document in parts, so memory follows the longest text and not the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
SLICE_ROWS = 8192
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_LETTER, _STOP = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_STOP[list(b".,;:!?")] = True
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def slices(batches, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each piece has at most ``limit`` bytes in ``column`` (one row at least)."""
    for batch in batches:
        sizes = np.array([0 if x is None else x for x in _lengths(batch.column(column))], np.int64)
        at = 0
        while at < len(sizes):
            stop = at + max(1, int(np.searchsorted(np.cumsum(sizes[at : at + SLICE_ROWS]), limit, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def _lengths(column: pa.Array) -> list:
    import pyarrow.compute as pc

    return pc.binary_length(column).to_pylist()


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one buffer, a line feed after each, and where each starts (with the end last)."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return np.frombuffer(b"\n".join([*texts, b""]), np.uint8), starts


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE_BYTES + (1 << 16)), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= SLICE_BYTES * 2:
            _powers[base] = have
    return have[:n]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span; spans are disjoint and ascending."""
    out, at, n = np.empty(len(starts), np.uint64), 0, len(starts)
    while at < n:
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + SLICE_BYTES, "right")))
        low, high = int(starts[at]), int(ends[stop - 1])
        part = buf[low:high]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(part)), out=sums[1:])
        s, e = starts[at:stop] - low, ends[at:stop] - low
        h = (sums[e] - sums[s]) * _power(_INVERSE, len(part) + 1)[s]
        out[at:stop] = mix(h ^ mix((e - s).astype(np.uint64)))
        at = stop
    return out


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of bytes other than 09-0D and 20."""
    inside = np.zeros(len(buf) + 2, bool)
    np.logical_not(SPACE[buf], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def words_of(texts: list[bytes], lower: bool = False):
    """``(buffer, word starts, word ends, word hashes, document of each word)`` of a slice."""
    buf, starts = joined(texts)
    if lower:
        buf = LOWER[buf]
    s, e = word_spans(buf)
    return buf, s, e, span_hashes(buf, s, e), np.searchsorted(starts, s, "right") - 1


def grams(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every ``n`` consecutive words of one document, and the index of its first word."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.zeros(m, np.uint64)
    for i in range(n):
        h = (h + hashes[i : i + m]) * np.uint64(0xD1342543DE82EF95)
    first = np.flatnonzero(owner[:m] == owner[n - 1 :])
    return mix(h[first]), first


def chunk_starts(buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where chunks start: at each text, at each blank before a byte that surely is no white space, and between a letter and a stop.

    A byte-level pre-tokenizer always breaks there, so the pieces of a text are
    the pieces of its chunks one after another.
    """
    nxt = buf[1:]
    sure = ((nxt > 0x20) & (nxt < 0x7F)) | ((nxt > 0xC2) & (nxt < 0xE0)) | ((nxt > 0xE3) & (nxt < 0xF5))
    cut = np.zeros(len(buf) + 1, bool)
    cut[:-2] = (buf[:-1] == 0x20) & sure
    cut[1:-1] |= _LETTER[buf[:-1]] & _STOP[nxt]
    cut[starts] = True
    return np.flatnonzero(cut[:-1]) if len(buf) else np.empty(0, np.int64)


def distinct_spans(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct byte strings among the spans and, for each span, which it is.

    Equal hashes are confirmed byte by byte against the first span with that
    hash; should two strings ever share a hash, a dictionary takes over.
    """
    if not len(s):
        return [], np.empty(0, np.int64)
    _, first, back = np.unique(span_hashes(buf, s, e), return_index=True, return_inverse=True)
    size = e - s
    same = bool((size == size[first][back]).all())
    if same:
        shift = np.repeat(s[first][back] - s, size)
        at = np.arange(int(size.sum())) + np.repeat(s - (np.cumsum(size) - size), size)
        same = bool((buf[at] == buf[at + shift]).all())
    data = buf.tobytes()
    if same:
        return [data[a:b] for a, b in zip(s[first].tolist(), e[first].tolist())], back
    known: dict[bytes, int] = {}
    back = np.array([known.setdefault(data[a:b], len(known)) for a, b in zip(s.tolist(), e.tolist())], np.int64)
    return list(known), back
