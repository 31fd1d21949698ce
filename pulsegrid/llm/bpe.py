"""Token ids of whole texts through their distinct chunks; shared by packing and the word-table codec."""

from __future__ import annotations

import os
from array import array

import numpy as np

from .textbytes import chunk_starts, distinct_spans, joined

#: Chunks that a worker remembers, twice over: when so many are new, those not met since go.
CACHED_CHUNKS = 250_000
_loaded: dict[str, tuple] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def load(path: str):
    """The tokenizer of a file and this worker's chunks; one tokenizer stays loaded per file."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _loaded[path] = tokenizer, [{}, {}]
    return _loaded[path]


def encode_chunks(path: str, chunks: list[bytes], cached: int = CACHED_CHUNKS) -> list[bytes]:
    """Ids of each chunk as little-endian unsigned 32-bit integers; the worker remembers ``cached`` to twice as many."""
    tokenizer, cache = load(path)
    if len(cache[0]) > cached:
        cache[:] = {}, cache[0]
    recent, older = cache
    fresh = []
    for c in chunks:
        if c not in recent:
            if (ids := older.get(c)) is None:
                fresh.append(c)
            else:
                recent[c] = ids
    for c, ids in zip(fresh, tokenizer.encode_batch_fast([c.decode() for c in fresh], add_special_tokens=False)):
        recent[c] = array("I", ids.ids).tobytes()
    return [recent[c] for c in chunks]


def text_chunks(texts: list[bytes]):
    """``(distinct chunks, which chunk each place holds, text of each place)``; places run through the texts in order."""
    buf, starts = joined(texts)
    s = chunk_starts(buf, starts[:-1])
    e = np.append(s[1:], len(buf))
    own = np.searchsorted(starts, s, "right") - 1
    e[np.append(own[1:] != own[:-1], True)] -= 1  # the line feed that joins texts
    full = e > s
    s, e, own = s[full], e[full], own[full]
    chunks, which = distinct_spans(buf, s, e)
    return chunks, which, own


def encode_texts(path: str, texts: list[bytes], cached: int = CACHED_CHUNKS) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in one array, and where each text's start (with the end last)."""
    chunks, which, own = text_chunks(texts)
    ids = encode_chunks(path, chunks, cached)
    flat = np.frombuffer(b"".join(ids), "<u4")
    size = np.array([len(x) // 4 for x in ids], np.int64)
    begin = np.cumsum(size) - size
    many = size[which]
    shift = np.repeat(begin[which] - (np.cumsum(many) - many), many)
    counts = np.bincount(own, many, len(texts)).astype(np.int64)
    return flat[shift + np.arange(len(shift))], np.concatenate([[0], np.cumsum(counts)])
