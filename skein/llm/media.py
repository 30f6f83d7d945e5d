"""Interleaved document sequences: HTML with media references, resolved from a content-addressed store.

``parse`` turns HTML into ordered structs of text and media references with captions;
``resolve`` joins the references' digests with a store of payloads, each element keeping its place.
``store`` writes payloads losslessly as images of 8-bit RGB samples, ``features`` reads the stored
bytes back. The store may hold a digest more than once (copies are equal by construction);
readers reduce it by digest before they join.

Nulls and edge cases: null HTML gives an empty sequence; a null text is empty; a reference that
is not in the store resolves to null; broken HTML is read as far as the parser gets; repeated rows
stay repeated; a null ``doc_id`` is carried through; empty tables give empty results; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import text_bytes

#: Bytes of one line of the image: 64 samples each of red, green and blue.
LINE = 192
SEQUENCE = "array<struct<position:int,kind:string,text:string,ref:string,caption:string>>"
SIGN = b"\x89PNG\r\n\x1a\n"
BLOCKS = {"p", "div", "li", "ul", "ol", "tr", "td", "th", "table", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "blockquote", "pre", "figure", "figcaption", "br", "header", "footer", "nav", "body", "title"}
HIDDEN = {"script", "style", "template", "noscript"}
MEDIA = {"img", "video", "audio", "source", "embed"}


class Sequence(HTMLParser):
    """Collects text runs and media references in reading order; a figure's caption goes to its media."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.words: list[str] = []
        self.hidden = 0
        self.figure: list[dict] | None = None
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.add("text", text=text)

    def add(self, kind: str, text: str | None = None, ref: str | None = None, caption: str | None = None) -> dict:
        self.out.append(x := {"position": len(self.out), "kind": kind, "text": text, "ref": ref, "caption": caption})
        return x

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in HIDDEN:
            self.hidden += 1
        elif tag in MEDIA and not self.hidden:
            a = dict(attrs)
            if a.get("src"):
                self.flush()
                x = self.add("media", ref=a["src"], caption=a.get("alt") or None)
                if self.figure is not None:
                    self.figure.append(x)
        elif tag in BLOCKS:
            self.flush()
            if tag == "figure":
                self.figure = []
            elif tag == "figcaption" and self.figure is not None:
                self.caption = []

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            said = " ".join("".join(self.caption).split())
            for x in self.figure or ():
                x["caption"] = said or x["caption"]
            if not self.figure and said:
                self.add("text", text=said)
            self.caption = None
        elif tag in BLOCKS:
            self.flush()
            if tag == "figure":
                self.figure = None

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            (self.words if self.caption is None else self.caption).append(data)


def sequence(source: str | None) -> list[dict]:
    p = Sequence()
    p.feed(source or "")
    p.close()
    p.flush()
    return p.out


def parse(pages: DataFrame, key: str, source: str) -> DataFrame:
    """``key`` and ``elements``: the ordered sequence of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("position", pa.int32()), *((x, pa.string()) for x in ("kind", "text", "ref", "caption"))]))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sequence(x) for x in b.column(1).to_pylist()], kind)], [key, "elements"])

    rows = pages.select(key, F.col(source).cast("string"))
    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, elements {SEQUENCE}")


def resolve(sequences: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """A row for each element, with the columns of ``known`` (one row a digest) where it refers to one."""
    rows = sequences.select(key, F.explode("elements").alias("e")).select(key, "e.*").withColumn("digest", F.regexp_extract(F.coalesce("ref", F.lit("")), "^sha256:([0-9a-f]{64})$", 1))
    return rows.join(known, "digest", "left")


def payload(data: bytes) -> bytes:
    """Blanks are appended up to a positive multiple of a line."""
    return data.ljust(max(LINE, -(-len(data) // LINE) * LINE), b" ")


def encode(data: bytes) -> bytes:
    """A PNG of 8-bit RGB samples, 64 to a line."""
    lines = np.frombuffer(data, np.uint8).reshape(-1, LINE)
    raw = np.zeros((len(lines), LINE + 1), np.uint8)
    raw[:, 1:] = lines
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return SIGN + chunk(b"IHDR", struct.pack(">IIBBBBB", LINE // 3, len(lines), 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 6)) + chunk(b"IEND", b"")


def decode(media: bytes) -> np.ndarray:
    """The samples of an image that ``encode`` made, a line a row; checks every chunk."""
    if media[:8] != SIGN:
        raise ValueError("not a PNG")
    at, body, high = 8, b"", 0
    while at < len(media):
        (n,), kind = struct.unpack(">I", media[at : at + 4]), media[at + 4 : at + 8]
        data = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + data) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("broken chunk")
        if kind == b"IHDR":
            high = struct.unpack(">II", data[:8])[1]
        elif kind == b"IDAT":
            body += data
        at += 12 + n
    return np.frombuffer(zlib.decompress(body), np.uint8).reshape(high, LINE + 1)[:, 1:]


def documents_as_media(docs: DataFrame) -> DataFrame:
    """doc_id, html (a figure that refers to the text's payload by digest), digest, n_bytes and media."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                b = batch.slice(at, 128)
                out = []
                for text, source in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    data = text_bytes(text)
                    full = payload(data)
                    # The digest covers the unpadded length too: texts that differ in final blanks stay apart.
                    digest = hashlib.sha256(full + struct.pack("<Q", len(data))).hexdigest()
                    page = f'<article><p>{html.escape(source or "")}</p><figure><img src="sha256:{digest}" alt="text"><figcaption>{len(data)} bytes</figcaption></figure></article>'
                    out.append((page, digest, len(data), encode(full)))
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x) for x in zip(*out, strict=True))], ["doc_id", "html", "digest", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("source").cast("string")).mapInArrow(run, "doc_id long, html string, digest string, n_bytes long, media binary")


def features(store: DataFrame) -> DataFrame:
    """What is read from the stored bytes, one row a digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                b = batch.slice(at, 128)
                out = []
                for media in b.column(2).to_pylist():
                    samples = np.ascontiguousarray(decode(media))
                    data = samples.tobytes()
                    count = np.bincount(samples.ravel(), minlength=256)
                    share = count[count > 0] / len(data)
                    entropy = float(-(share * np.log2(share)).sum())
                    feature = f"64x{len(samples)};sum={int((count * np.arange(256)).sum())};distinct={int((count > 0).sum())};blank={int(count[32])};entropy={entropy:.4f}"
                    out.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x) for x in zip(*out, strict=True))], ["digest", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    read = store.select("digest", "n_bytes", "media").mapInArrow(run, "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    names = read.columns
    return read.groupBy("digest").agg(F.min(F.struct(*names[1:])).alias("x")).select("digest", "x.*")
