"""Media columns as interleaved document sequences.

A document is HTML whose text and media references keep their order; a reference names its payload by digest, and the
payloads lie in a table of their own. Parsing gives ordered structs, and a join by digest resolves what they refer to.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from .common import free_name, lookup_join, small_batches, whole_row, written

WIDTH = 64
SEQUENCE = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"
HIDDEN = {"script", "style", "template", "noscript"}


class Interleaved(HTMLParser):
    """Collects text and media references in document order; a figure's caption goes to the last reference within it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.caption: list[str] | None = None
        self.hidden = 0
        self.figure: int | None = None

    def close_text(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in HIDDEN:
            self.hidden += 1
        elif tag == "figure":
            self.close_text()
            self.figure = len(self.items)
        elif tag == "figcaption":
            self.close_text()
            self.caption = []
        elif tag in ("img", "audio", "video", "source"):
            source = dict(attrs).get("src") or ""
            self.close_text()
            self.items.append({"kind": "media", "text": None, "digest": source.removeprefix("sha256:") if source.startswith("sha256:") else None, "caption": dict(attrs).get("alt")})
        elif tag in ("p", "div", "h1", "h2", "h3", "li", "br", "article"):
            self.close_text()

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            text, self.caption = " ".join("".join(self.caption).split()), None
            for item in reversed(self.items[self.figure or 0 :]):
                if item["kind"] == "media":
                    item["caption"] = text
                    break
        elif tag == "figure":
            self.figure = None
        elif tag in ("p", "div", "h1", "h2", "h3", "li", "article"):
            self.close_text()

    def handle_data(self, data: str) -> None:
        if self.caption is not None:
            self.caption.append(data)
        elif not self.hidden:
            self.words.append(data)


def parse(html: str | None) -> list[dict]:
    parser = Interleaved()
    parser.feed(html or "")
    parser.close()
    parser.close_text()
    return [item | {"position": i} for i, item in enumerate(parser.items)]


def sequences(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds items, the ordered text and media structs of each page. A null or empty html gives no items. Other columns stay, whatever their names."""
    small_batches(pages.sparkSession)
    pages = pages.drop("items")
    rows = pages.select(whole_row(pages).alias("_row"))
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = pa.array([parse(x) for x in pa.StructArray.field(batch.column("_row"), html).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([batch.column("_row"), items], names=["_row", "items"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("items", DataType.fromDDL(SEQUENCE))])).select("_row.*", "items")


def references(pages: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each media item of sequences(): keys, position, caption, digest."""
    return pages.select(*keys, F.explode("items").alias("item")).filter("item.kind = 'media'").select(*keys, "item.position", "item.caption", "item.digest")


def resolve(refs: DataFrame, media: DataFrame) -> DataFrame:
    """References with the columns of media, a written table that may have several equal rows for a digest.

    Every reference is kept; the columns are null where no payload has the digest. Positions and captions stay as they are.
    """
    others = [c for c in media.columns if c != "digest"]
    n = free_name(refs, "_copies")
    one = media.groupBy("digest").agg(*[F.first(c).alias(c) for c in others], F.count("*").alias(n))
    return lookup_join(refs, written(one, "media-by-digest"), "digest", [c for c in refs.columns if c != "digest"], n).drop(n)


def encode(payload: bytes) -> bytes:
    """A grey image of 8-bit samples, 64 to a row (binary PGM)."""
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def decode(stored: bytes) -> memoryview:
    magic, size, depth, _ = stored[:64].split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P5" or depth != b"255":
        raise ValueError("not an 8-bit grey image")
    begin = len(magic) + len(size) + len(depth) + 3
    if len(stored) - begin != width * height:
        raise ValueError("samples are missing")
    return memoryview(stored)[begin:]


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


def feature(samples: memoryview) -> str:
    """Size, mean, share of zero samples, and a bit for each column that is brighter than the mean."""
    image = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    columns = image.sum(0, dtype=np.int64)
    total = int(columns.sum())
    bits = int("".join("1" if b else "0" for b in columns * WIDTH > total), 2)
    return f"{WIDTH}x{len(image)} mean={total / image.size:.4f} zero={(image == 0).sum() / image.size:.4f} columns={bits:016x}"


def store(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text as an image in a table of the shared folder, beside the small HTML document that refers to it.

    row (unique), doc_id, n_bytes, html, digest, stored. A null text is empty.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict = {"doc_id": batch.column(0), "n_bytes": [], "html": [], "digest": [], "stored": []}
            for whole in batch.column(1):
                n, payload = padded(whole.as_py())
                image = encode(payload)
                digest = hashlib.sha256(image).hexdigest()
                out["n_bytes"].append(n)
                out["html"].append(f'<article><p>text of {n} bytes</p><figure><img src="sha256:{digest}"><figcaption>{escape(f"{len(payload)} samples")}</figcaption></figure></article>')
                out["digest"].append(digest)
                out["stored"].append(image)
            yield pa.RecordBatch.from_pydict(out)

    made = docs.select(F.col(doc_id).alias("doc_id"), text).mapInArrow(run, "doc_id long, n_bytes long, html string, digest string, stored binary")
    return written(made.withColumn("row", F.monotonically_increasing_id()), "media")


FEATURES = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_back(media: DataFrame) -> DataFrame:
    """Features of the stored bytes: digests of payload and stored form, crc32 of the last 64 samples, feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, stored in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                stored = stored.as_py()
                samples = decode(stored)
                rows.append((digest, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-WIDTH:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(samples)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=[x.split()[0] for x in FEATURES.split(", ")])

    return media.select("digest", "stored").mapInArrow(run, FEATURES)


def media_columns(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores every text as media, reads it back through its HTML document's reference, and gives a row for each document.

    A null text counts as empty, and an empty one is 64 zero samples; equal texts give equal values; a null doc_id stays
    null; repeated rows stay apart. Extra columns are not carried.
    """
    kept = store(docs, doc_id, text)
    pages = sequences(kept.select("row", "doc_id", "n_bytes", "html"))
    refs = written(references(pages, ["row", "doc_id", "n_bytes"]), "media-references")
    return resolve(refs, read_back(kept)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
