"""Interleaved sequences of text and media references, resolved by digest (operator 8)."""

from __future__ import annotations

import hashlib
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .textbytes import raw, slices

ITEM = "struct<position: int, kind: string, text: string, digest: string, caption: string>"
_ITEM = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())])
WIDTH = 64
_MEDIA = {"img": "image", "video": "video", "audio": "audio", "embed": "object", "object": "object"}
_HIDDEN = {"script", "style", "template", "noscript"}
_BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "br", "dd", "div", "dl", "dt", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "title", "tr", "ul",
}


class _Reader(HTMLParser):
    """Collects text blocks and media references in document order; a figure's caption goes to all its media."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.hidden = self.figure = 0
        self.caption: list[str] | None = None
        self.in_figure: list[dict] = []

    def _block(self) -> None:
        text = " ".join("".join(self.words).split())
        if text:
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None})
        self.words = []

    def handle_starttag(self, tag, attrs):
        got = dict(attrs)
        if tag in _HIDDEN:
            self.hidden += 1
        elif tag == "figure":
            self._block()
            self.figure, self.in_figure = self.figure + 1, []
        elif tag == "figcaption" and self.figure:
            self.caption = []
        elif tag in _MEDIA or tag == "source" and got.get("src"):
            self._block()
            source = got.get("src") or got.get("data") or ""
            kind = _MEDIA.get(tag) or (got.get("type") or "media").split("/")[0]
            item = {"kind": kind, "text": None, "digest": source.removeprefix("sha256:") if source.startswith("sha256:") else hashlib.sha256(source.encode()).hexdigest(),
                    "caption": " ".join((got.get("alt") or "").split()) or None}
            self.items.append(item)
            if self.figure:
                self.in_figure.append(item)
        elif tag in _BLOCKS:
            self._block()

    def handle_endtag(self, tag):
        if tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            for item in self.in_figure:
                item["caption"] = text or item["caption"]
            self.caption = None
        elif tag == "figure":
            self._block()
            self.figure = max(0, self.figure - 1)
            self.caption = None
        elif tag in _BLOCKS:
            self._block()

    def handle_data(self, data):
        if not self.hidden:
            (self.words if self.caption is None else self.caption).append(data)

    def close(self):
        super().close()
        self._block()


def read_html(html: str) -> list[dict]:
    """Items of one page, numbered from 0."""
    reader = _Reader()
    reader.feed(html)
    reader.close()
    return [{"position": i, **item} for i, item in enumerate(reader.items)]


def interleave(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``id, items``: each page as its ordered text blocks and media references.

    A reference ``sha256:<hex>`` holds the digest of the payload.  Any other address has the digest of the
    address, for media tables keyed that way.  Null and empty pages have no items; broken HTML is
    read as far as it goes.  Columns other than ``key`` and ``html`` are not read.
    """

    def run(batches):
        for batch in slices(batches, "html"):
            items = pa.array([read_html(t.decode()) for t in raw(batch.column("html"))], pa.list_(_ITEM))
            yield pa.RecordBatch.from_arrays([batch.column("id"), items], ["id", "items"])

    src = pages.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{html}`").alias("html"))
    return src.mapInArrow(run, f"id long, items array<{ITEM}>")


def payload(text: str = "text") -> Column:
    """UTF-8 bytes of a text with bytes 0 up to a positive multiple of 64."""
    data = F.encode(F.coalesce(F.col(f"`{text}`"), F.lit("")), "UTF-8")
    size = F.greatest(F.lit(WIDTH), F.ceil(F.octet_length(data) / WIDTH) * WIDTH).cast("int")
    return F.when(F.octet_length(data) == size, data).otherwise(F.concat(data, F.encode(F.repeat(F.lit("\0"), size - F.octet_length(data)), "UTF-8")))


def to_image(data: bytes) -> bytes:
    """A grey image in the portable graymap format, one byte a pixel and 64 pixels a line."""
    return b"P5\n%d %d\n255\n" % (WIDTH, len(data) // WIDTH) + data


def from_image(stored: bytes) -> bytes:
    """The pixels of a stored image; raises ValueError if it isn't one."""
    kind, shape, top, pixels = stored.split(b"\n", 3)
    wide, high = map(int, shape.split())
    if kind != b"P5" or top != b"255" or len(pixels) != wide * high:
        raise ValueError("not an 8-bit graymap")
    return pixels


def feature_of(pixels: bytes) -> str:
    """Shares of 16 grey levels in 1/255 and, as 64 bits, which of 64 equal stretches are brighter than the whole."""
    grey = np.frombuffer(pixels, np.uint8)
    levels = np.bincount(grey >> 4, minlength=16) * 255 // len(grey)
    sums = grey.reshape(64, -1).sum(1, dtype=np.int64)
    return levels.astype(np.uint8).tobytes().hex() + "-" + np.packbits(sums * 64 > sums.sum()).tobytes().hex()


def store(payloads: DataFrame) -> DataFrame:
    """``digest, media``: payloads (``digest, payload``) in stored form, each digest once per task at least and in one place.

    Copies are dropped inside a task before they are sent, so a payload that a third of all rows have is sent once per task.
    """

    def run(batches):
        sent: set[str] = set()
        for batch in slices(batches, "payload"):
            digests, media, out = batch.column("digest").to_pylist(), batch.column("payload").to_pylist(), ([], [])
            for d, m in zip(digests, media):
                if d not in sent:
                    if len(sent) > 100_000:
                        sent.clear()
                    sent.add(d)
                    out[0].append(d)
                    out[1].append(to_image(m))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.binary())], ["digest", "media"])

    return payloads.select("digest", "payload").mapInArrow(run, "digest string, media binary").repartition("digest").sortWithinPartitions("digest")


def read_back(media: DataFrame) -> DataFrame:
    """One row per stored medium: its pixels' size, digest and checksum, its stored size and digest, and its feature."""

    def run(batches):
        last = None
        for batch in slices(batches, "media"):
            rows = []
            for digest, stored in zip(batch.column("digest").to_pylist(), batch.column("media").to_pylist()):
                if digest != last:
                    last, pixels = digest, from_image(stored)
                    rows.append((digest, len(pixels), hashlib.sha256(pixels).hexdigest(), zlib.crc32(pixels[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature_of(pixels)))
            names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 7, kinds)], names)

    return media.mapInArrow(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def resolve(sequences: DataFrame, media: DataFrame) -> DataFrame:
    """Items as rows ``id, position, kind, text, digest, caption`` with the columns of ``media`` for their digest.

    Text items and references without a medium have nulls there.  Positions and captions are those of the page.
    """
    rows = sequences.select("id", F.inline("items"))
    return rows.join(media, "digest", "left")


def page_of(key: str, digest: Column) -> Column:
    """A page that holds one medium, captioned with its key."""
    name = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    return F.concat(F.lit('<article><figure><img src="sha256:'), digest, F.lit('"><figcaption>'), name, F.lit("</figcaption></figure></article>"))


def text_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text as a medium on a page of its own: pages are parsed, payloads stored once per digest, read back and joined by digest.

    Gives ``id, n_bytes, caption`` and the columns of ``read_back``.  A null text counts as empty, 64 bytes 0.  Null ids
    keep their row.  Repeated rows give repeated rows with equal values.  An empty table gives an empty result.
    """
    held = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.octet_length(F.coalesce(F.col(f"`{text}`"), F.lit(""))).cast("long").alias("n_bytes"), payload(text).alias("payload"))
    held = held.withColumn("digest", F.sha2("payload", 256))
    pages = held.select("id", F.concat(page_of("id", F.col("digest")), F.lit("<p>"), F.col("n_bytes"), F.lit("</p>")).alias("html"))
    parsed = interleave(pages, "id", "html")
    note = F.expr("filter(items, x -> x.kind = 'text')[0].text").cast("long")
    sizes = parsed.select("id", note.alias("n_bytes"), F.expr("filter(items, x -> x.kind != 'text')").alias("items"))
    rows = sizes.select("id", "n_bytes", F.inline("items")).select("id", "n_bytes", "caption", "digest")
    return rows.join(read_back(store(held)), "digest").drop("digest")
