"""Byte-level BPE through a table of distinct words (operator 7)."""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from .bpe import default_tokenizer, encode_chunks, text_chunks
from .store import blocks
from .textbytes import SLICE_BYTES, joined, mix, raw, span_hashes


def byte_letters() -> dict[str, int]:
    """The letter by which a byte-level vocabulary writes each byte: itself where printable, else the next from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def pieces_of(path: str) -> list[bytes]:
    """Bytes of each id of a byte-level tokenizer file; added tokens stand for their own text."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters, size = byte_letters(), 1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
    out = [b""] * size
    for piece, i in spec["model"]["vocab"].items():
        out[i] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
    for t in spec["added_tokens"]:
        out[t["id"]] = t["content"].encode()
    return out


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """``token, piece`` of a tokenizer file; as large as its vocabulary."""
    return spark.createDataFrame(list(enumerate(map(bytearray, pieces_of(path)))), "token int, piece binary")


def decode(encoded: DataFrame, path: str | None = None, key: str = "id", ids: str = "ids") -> DataFrame:
    """``key, text``: ids to text by a join with the vocabulary, pieces put back in order of position.

    The vocabulary is broadcast; its size is that of the tokenizer file.  Null id lists give null, empty ones "".  Bytes that
    are no UTF-8 become U+FFFD.  An id outside the vocabulary adds nothing.  ``key`` must tell rows apart.
    """
    path = path or default_tokenizer()
    places = encoded.select(F.col(f"`{key}`").alias(key), F.posexplode(F.col(f"`{ids}`")).alias("position", "token"))
    found = places.join(F.broadcast(vocabulary(encoded.sparkSession, path)), "token")
    whole = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("position", F.hex("piece").alias("piece")))).alias("parts"))
    text = F.decode(F.unhex(F.array_join(F.col("parts.piece"), "")), "UTF-8")
    rows = encoded.select(F.col(f"`{key}`").alias(key), F.col(f"`{ids}`").isNull().alias("none")).join(whole.select(key, text.alias("text")), key, "left")
    return rows.select(key, F.when(~F.col("none"), F.coalesce("text", F.lit(""))).alias("text"))


def _sliced(texts: list[bytes]):
    at = 0
    sizes = np.cumsum([len(t) for t in texts])
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE_BYTES, "right")))
        yield at, texts[at:stop]
        at = stop


def _block_words(texts: list[bytes]):
    """Distinct words of a block in byte order with their hashes, and per slice ``(first text, texts, word of each place, text of each place)``."""
    known: dict[bytes, int] = {}
    parts = []
    for at, some in _sliced(texts):
        words, which, own = text_chunks(some)
        index = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
        parts.append((at, len(some), index[which] if len(words) else which, own))
    words = list(known)
    if not words:
        return [], np.empty(0, np.uint64), parts
    order = pc.sort_indices(pa.array(words, pa.binary())).to_numpy().astype(np.int64)
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    words = [words[i] for i in order.tolist()]
    buf, starts = joined(words)
    return words, span_hashes(buf, starts[:-1], starts[1:] - 1), [(a, n, place[w], o) for a, n, w, o in parts]


def _packed(words: list[bytes]) -> bytes:
    """Sorted words in one compressed string: their number, their lengths, then all bytes."""
    sizes = np.array([len(words), *map(len, words)], "<u4")
    return zlib.compress(sizes.tobytes() + b"".join(words))


def _unpacked(data: bytes) -> list[bytes]:
    data = zlib.decompress(data)
    many = int.from_bytes(data[:4], "little")
    ends = (np.cumsum(np.frombuffer(data, "<u4", many, 4)) + 4 * (many + 1)).tolist()
    return [data[a:b] for a, b in zip([4 * (many + 1), *ends], ends)]


def _packed_numbers(values: np.ndarray) -> bytes:
    """Numbers in one, two or four bytes each, compressed; the first byte tells which."""
    width = 1 if not len(values) or values.max() < 1 << 8 else 2 if values.max() < 1 << 16 else 4
    return bytes([width]) + zlib.compress(values.astype(f"<u{width}").tobytes())


def _unpacked_numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), f"<u{data[0]}").astype(np.int64)


def _distinct(buckets: int):
    """The distinct words of a block, one row per bucket of the word table."""

    def run(table: pa.Table) -> pa.Table:
        words, h, _ = _block_words(raw(table.column("text").combine_chunks()))
        bucket = (mix(h) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable").tolist()
        found, many = np.unique(bucket, return_counts=True)
        ends = np.cumsum(many).tolist()
        packed = [_packed([words[i] for i in order[a:b]]) for a, b in zip([0, *ends], ends)]
        block = table.column("block")[0].as_py()
        return pa.table({"block": pa.array(np.full(len(found), block)), "bucket": pa.array(found), "words": pa.array(packed, pa.binary())})

    return run


def _encode_bucket(path: str):
    """Encode each distinct word of a bucket once; answer every block with the ids of its words in their order."""

    def run(table: pa.Table) -> pa.Table:
        lists = [_unpacked(x) for x in table.column("words").to_pylist()]
        index: dict[bytes, int] = {}
        which = [[index.setdefault(w, len(index)) for w in words] for words in lists]
        ids = encode_chunks(path, list(index))
        length = np.array([len(x) // 4 for x in ids], "<u4")
        packed = [_packed_numbers(np.frombuffer(b"".join([ids[i] for i in mine]), "<u4")) for mine in which]
        counts = [_packed_numbers(length[mine]) for mine in which]
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "ids": pa.array(packed, pa.binary()), "counts": pa.array(counts, pa.binary())})

    return run


def _gather(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Concatenation of ``values[begin : begin + size]`` of all entries."""
    shift = np.repeat(begin - (np.cumsum(size) - size), size)
    return values[shift + np.arange(len(shift))]


def _join_back(pieces: list[bytes], buckets: int):
    """Ids of the block's words back to the places of the words; then ids to pieces."""
    buffer = np.frombuffer(b"".join(pieces), np.uint8)
    width = np.array([len(p) for p in pieces], np.int64)
    piece_at = np.cumsum(width) - width

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        texts = raw(docs.column("text").combine_chunks())
        words, h, parts = _block_words(texts)
        answered = answers.sort_by("bucket")
        none = [np.empty(0, np.int64)]
        ids, counts = (np.concatenate(none + [_unpacked_numbers(x) for x in answered.column(c).to_pylist()]) for c in ("ids", "counts"))
        order = np.argsort((mix(h) % np.uint64(buckets)).astype(np.int64), kind="stable")
        begin, size = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        begin[order], size[order] = np.cumsum(counts) - counts, counts
        of_docs, out, text = [], [], []
        for _, n, which, own in parts:
            many = size[which]
            flat = _gather(ids, begin[which], many)
            per_doc = np.bincount(own, many, n).astype(np.int64)
            of_docs.append(per_doc)
            out.append(flat.astype(np.int32))
            data = _gather(buffer, piece_at[flat], width[flat]).tobytes()
            edge = np.concatenate([[0], np.cumsum(width[flat])])[np.concatenate([[0], np.cumsum(per_doc)])].tolist()
            text.extend(data[a:b].decode("utf-8", "replace") for a, b in zip(edge[:-1], edge[1:]))
        offsets = np.concatenate([[0], np.cumsum(np.concatenate([[], *of_docs]))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int32), *out])))
        return pa.table({"id": docs.column("id"), "ids": lists, "decoded": pa.array(text, pa.string())})

    return run


def encode(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", block_bytes: int = 16 << 20) -> DataFrame:
    """``id, ids, decoded`` of every row: the ids that the tokenizers library gives for the whole text without added specials, and their text.

    Texts are grouped in blocks of about ``block_bytes`` by a hash, so they cross the network once.  A text's words are
    cut at blanks before characters that surely are no white space, where a byte-level pre-tokenizer always breaks.  Each block sends
    its distinct words to the word table, one row per bucket; a bucket encodes each distinct word
    once, however many blocks have it, and answers each block; a block joins the ids back by position, and joins ids to
    pieces for the decoded text.  A frequent word is one entry per block.

    Null texts count as empty: no ids, "".  Null ids and repeated rows are rows like others.  An empty table gives an empty result.
    A task holds one block, or one text if that is longer.
    """
    path = path or default_tokenizer()
    many = blocks(docs, text, block_bytes)
    spot = F.pmod(F.xxhash64(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(-1)), F.octet_length(F.coalesce(F.col(f"`{text}`"), F.lit("")))), F.lit(many))
    placed = docs.select(spot.cast("long").alias("block"), F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    words = placed.groupBy("block").applyInArrow(_distinct(many), "block long, bucket long, words binary")
    answers = words.groupBy("bucket").applyInArrow(_encode_bucket(path), "block long, bucket long, ids binary, counts binary")
    return placed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_join_back(pieces_of(path), many), "id long, ids array<int>, decoded string")
