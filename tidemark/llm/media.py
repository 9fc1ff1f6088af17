"""Media columns: interleaved sequences of text and media references, resolved by digest."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, keyed, materialize, slices

#: Samples in a raster row; payloads are padded to whole rows.
WIDTH = 64
SCHEME = "media:sha256/"

_PNG = b"\x89PNG\r\n\x1a\n"
PART = "struct<position:int,kind:string,text:string,digest:string,caption:string,n_bytes:bigint>"


def padded(data: bytes) -> bytes:
    """data with bytes 0 up to a positive multiple of WIDTH."""
    return data.ljust(max(1, -(-len(data) // WIDTH)) * WIDTH, b"\0")


def to_png(payload: bytes) -> bytes:
    """An 8-bit grey PNG, WIDTH samples wide, whose samples are the payload's bytes."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each row is led by its filter, 0: none
    raw[:, 1:] = rows
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _PNG + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 1)) + chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of a PNG that to_png wrote; checks every chunk."""
    if media[:8] != _PNG:
        raise ValueError("not a PNG")
    at, shape, data = 8, (0, 0), b""
    while at < len(media):
        (n,) = struct.unpack(">I", media[at : at + 4])
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            shape = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            data += body
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(shape[1], shape[0] + 1)
    if raw[:, 0].any():
        raise ValueError("only rows without a filter are written here")
    return raw[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Of the samples: mean and standard deviation, and a hash of 64 bits, one for each cell of an 8 by 8 grid
    (columns by rows, the last rows joining the last cells) that is brighter than the median cell."""
    x = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    bands = np.array_split(x, 8) if len(x) >= 8 else [x[min(k, len(x) - 1) : min(k, len(x) - 1) + 1] for k in range(8)]
    cells = np.array([b.reshape(len(b), 8, WIDTH // 8).mean(axis=(0, 2)) for b in bands]).ravel()
    bits = np.packbits(cells > np.median(cells))
    return f"{x.mean():.4f}:{x.std():.4f}:{bits.tobytes().hex()}"


class _Parts(HTMLParser):
    """Text and media in the order of the page; a figure's caption goes to the media in it.

    Broken pages have a defined result: a caption left open ends with its figure or at the next block, silent elements left open end with the
    page, an unclosed title is read as text, unknown markup declarations are left out.
    """

    SILENT = {"script", "style", "template", "noscript", "title"}
    BREAKS = {"p", "div", "br", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "td", "th", "article", "section", "pre", "blockquote", "table", "ul", "ol"}
    MEDIA = {"img", "audio", "video", "source", "embed"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[dict] = []
        self.buffer: list[str] = []
        self.quiet = 0
        self.figure: list[int] | None = None
        self.caption: list[str] | None = None

    def parse_marked_section(self, i, report=1):
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else -1

    def flush(self) -> None:
        text = "".join(self.buffer)
        self.buffer = []
        if text.strip():
            self.parts.append({"kind": "text", "text": text, "digest": None, "caption": None, "n_bytes": None})

    def end_caption(self) -> None:
        if self.caption is not None:
            for k in self.figure or []:
                self.parts[k]["caption"] = "".join(self.caption)
            self.caption = None

    def handle_starttag(self, tag, attrs):
        if tag in self.SILENT:
            self.quiet += 1
        elif self.quiet:
            return
        elif tag == "figure":
            self.end_caption()
            self.flush()
            self.figure = []
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in self.MEDIA:
            named = dict(attrs)
            src = named.get("src") or ""
            if src:
                self.flush()
                size = named.get("data-bytes") or ""
                digest = src[len(SCHEME) :] if src.startswith(SCHEME) else None
                known = re.fullmatch("[0-9]{1,18}", size)  # what a long column holds
                self.parts.append({"kind": "media", "text": src, "digest": digest, "caption": named.get("alt"), "n_bytes": int(size) if known else None})
                if self.figure is not None:
                    self.figure.append(len(self.parts) - 1)
        elif tag in self.BREAKS:
            self.end_caption()
            self.flush()

    def handle_endtag(self, tag):
        if tag in self.SILENT:
            self.quiet = max(0, self.quiet - 1)
        elif self.quiet:
            return
        elif tag == "figcaption":
            self.end_caption()
        elif tag == "figure":
            self.end_caption()
            self.figure = None
        elif tag in self.BREAKS:
            self.flush()

    def handle_data(self, data):
        if not self.quiet:
            (self.buffer if self.caption is None else self.caption).append(data)


_TITLE = re.compile(r"<title\b[^>]*>", re.I)


def parse_html(html: str | None) -> list[dict]:
    """Parts of a page in order, positions from 0. Null and empty pages have none."""
    p = _Parts()
    page = html or ""
    if "</title" not in page.lower():
        page = _TITLE.sub(" ", page)
    p.feed(page)
    p.close()
    p.end_caption()
    p.flush()
    return [{"position": k, **x} for k, x in enumerate(p.parts)]


def interleave(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key and parts: the ordered text and media structs of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string()), ("n_bytes", pa.int64())]))
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for a, b in slices(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([parse_html(x) for x in texts[a:b]], kind)], ["key", "parts"])

    schema = keyed(pages.schema[key].dataType, f"parts array<{PART}>")
    return pages.select(F.col(key).alias("key"), F.col(html).alias("html")).mapInArrow(run, schema).withColumnRenamed("key", key)


def payload(text: Column) -> Column:
    """A text's UTF-8 bytes, padded as padded() does."""
    data = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    n = F.octet_length(data)
    gap = F.greatest(F.ceil(n / WIDTH) * WIDTH, F.lit(WIDTH)) - n
    return F.concat(data, F.expr(f"unhex(repeat('00', {WIDTH}))").substr(F.lit(1), gap.cast("int")))


def store(docs: DataFrame, text: str = "text") -> DataFrame:
    """digest and media (PNG) of every row's payload, written to the shared folder and read from there.

    Copies are stored once a row, under one digest: a store needs no shuffle of its payloads to be addressed by content.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(0).to_pylist()]
            for a, b in slices(texts):
                data = [padded(x.encode()) for x in texts[a:b]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([hashlib.sha256(x).hexdigest() for x in data], pa.string()), pa.array([to_png(x) for x in data], pa.binary())], ["digest", "media"]
                )

    return materialize(docs.select(F.col(text).alias("text")).mapInArrow(run, "digest string, media binary"), "media")


FEATURES = ("payload_bytes long", "payload_sha256 string", "tail_crc32 long", "media_bytes long", "media_sha256 string", "feature string")


def features(media: DataFrame) -> DataFrame:
    """One row per digest: what the stored bytes hold when read back. A payload that is not its digest's is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                stored = data.as_py()
                back = from_png(stored)
                if (sha := hashlib.sha256(back).hexdigest()) != digest:
                    raise ValueError(f"stored payload of {digest} has digest {sha}")
                rows.append((digest, len(back), sha, zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(back)))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["digest", *[f.split(" ")[0] for f in FEATURES]])

    each = media.mapInArrow(run, f"digest string, {', '.join(FEATURES)}")
    names = [f.split(" ")[0] for f in FEATURES]
    return each.groupBy("digest").agg(*[F.first(c).alias(c) for c in names])


def resolve(parts: DataFrame, resolved: DataFrame, key: str) -> DataFrame:
    """One row per media reference of interleave()'s rows, in order: key, position, caption and, where the digest is
    known, the columns of `resolved`. Unknown digests keep their row with nulls."""
    refs = parts.select(key, F.explode(F.filter("parts", lambda p: p["kind"] == "media")).alias("part"))
    refs = refs.select(key, "part.position", "part.caption", "part.digest", "part.n_bytes")
    return refs.join(resolved, "digest", "left")


def as_page(text: Column) -> Column:
    """A page whose figure refers to the text's own payload, followed by the text in a paragraph."""
    t = F.coalesce(text, F.lit(""))
    safe = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    line = F.element_at(F.split(t, "\n", 2), 1)
    return F.concat(
        F.lit(f'<article><figure><img src="{SCHEME}'), F.sha2(payload(text), 256), F.lit('" data-bytes="'), F.octet_length(t).cast("string"),
        F.lit('" alt=""><figcaption>'), safe(line), F.lit("</figcaption></figure><p>"), safe(t), F.lit("</p></article>"),
    )


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a page whose figure refers to its own payload: stored, read back and resolved by digest, with the reference's position and
    caption (the text's first line). A row per document, repeated rows too; null and empty texts are one row of 64 bytes 0."""
    docs = documents(spark, sf_dir)
    resolved = materialize(features(store(docs)), "media_features")
    parts = interleave(docs.select("doc_id", as_page(F.col("text")).alias("html")), "doc_id", "html")
    out = resolve(parts, resolved, "doc_id")
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
