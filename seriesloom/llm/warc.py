"""WARC archives as chunked record tables.

Archives are written by tasks into the shared folder, each under a name of its own attempt; a manifest table lists the
files of the attempts that succeeded. Reading streams each file and gives rows (record, chunk number, digest so far), so
that no record is held whole beyond the row it came from.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_table, lookup_join, scratch, small_batches, with_bit, written

CHUNK = 1 << 16
FILE_BYTES = 512 << 20
MANIFEST = "file string, records long, bytes long"


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def record_id(kind: str, page_id: int | None) -> str:
    """A page's record id, the same in every run: what a revisit refers to is found by it. Pages that repeat an id share it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}:{page_id}')}>"


def header(lines: list[tuple[str, object]]) -> bytes:
    clean = lambda v: str(v).replace("\r", "%0D").replace("\n", "%0A")
    return ("WARC/1.1\r\n" + "".join(f"{k}: {clean(v)}\r\n" for k, v in lines if v is not None) + "\r\n").encode()


def revisits(pages: DataFrame, least: int = 100) -> DataFrame:
    """pages with digest, n_bytes, refers_to: of equal payloads of at least so many bytes, all but the smallest page_id refer to it.

    A null html is an empty payload. Rows that repeat the smallest page_id are all responses; a null page_id is never the
    smallest unless all of the group are null, and then all are responses. The html of revisits is left out (null), as their
    records have no payload.

    Groups are found on rows without html. A bit table of the revisits tells most responses at the scan, where their html stays; a second
    one, of the few rows that the first is wrong about, leaves only rows in both tables to an exact join, and no other html is shuffled.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    digest = F.sha2(payload, 256).alias("digest")
    marked = pages.select("page_id", "url", "html", digest, F.octet_length(payload).cast("long").alias("n_bytes")).withColumn("_key", F.xxhash64("digest", "page_id"))
    long = written(marked.filter(F.col("n_bytes") >= least).drop("html"), "warc-rows")
    groups = written(long.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies")).filter("copies > 1"), "warc-groups")
    known = lookup_join(long, groups, "digest", "page_id", "copies")
    again = written(known.filter(F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))).withColumnRenamed("first_id", "refers_to"), "warc-revisits")
    bits = bit_table(again, "_key")
    exact = again.select(F.col("digest").alias("_of"), F.col("page_id").alias("_id")).distinct()
    same = F.col("digest").eqNullSafe(F.col("_of")) & F.col("page_id").eqNullSafe(F.col("_id"))
    # Short rows are never revisits, whatever the table says.
    asked = with_bit(marked, bits, "_key", "_may").withColumn("_may", F.col("_may") & (F.col("n_bytes") >= least))
    wrong = with_bit(long, bits, "_key", "_may").filter("_may").join(exact, same, "left_anti")
    both = with_bit(asked.filter("_may"), bit_table(written(wrong.select("_key"), "warc-wrong"), "_key"), "_key", "_wrong").filter("_wrong").join(exact, same, "left_anti")
    columns = ["page_id", "url", "html", "digest", "n_bytes"]
    responses = asked.filter("not _may").select(columns).unionByName(both.select(columns)).withColumn("refers_to", F.lit(None).cast(pages.schema["page_id"].dataType))
    return responses.unionByName(again.select("page_id", "url", F.lit(None).cast("string").alias("html"), "digest", "n_bytes", "refers_to"))


def write_archives(pages: DataFrame, uri: str | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes a record for each row of revisits(); gives the manifest, a written table of the files that count."""
    spark = pages.sparkSession
    small_batches(spark)
    uri = uri or scratch(spark, "warc")
    parent, folder = filesystem(uri)
    parent.create_dir(folder, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = filesystem(uri)
        out = name = None
        records = size = 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"file": [name], "records": [records], "bytes": [size]})

        for batch in batches:
            cols = [batch.column(c) for c in ("page_id", "url", "html", "digest", "n_bytes", "refers_to")]
            for page_id, url, html, digest, n, refers in zip(*cols, strict=True):
                if out is None:
                    name, records, size = f"{top}/{uuid.uuid4().hex}.warc", 0, 0
                    out = store.open_output_stream(name)
                refers, page_id = refers.as_py(), page_id.as_py()
                body = memoryview(html.as_buffer()) if html.is_valid and refers is None else memoryview(b"")
                http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
                head = header(
                    [
                        ("WARC-Type", "response" if refers is None else "revisit"),
                        ("WARC-Record-ID", record_id("response" if refers is None else "revisit", page_id)),
                        ("WARC-Target-URI", url.as_py()),
                        ("WARC-Date", "1970-01-01T00:00:00Z"),
                        ("X-Page-Id", page_id),
                        ("X-Refers-To-Page-Id", refers),
                        ("WARC-Payload-Digest", f"sha256:{digest.as_py()}"),
                        ("X-Payload-Length", n.as_py()),
                        ("WARC-Refers-To", None if refers is None else record_id("response", refers)),
                        ("WARC-Profile", None if refers is None else "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                        ("Content-Type", "application/http;msgtype=response"),
                        ("Content-Length", len(http) + len(body)),
                    ]
                )
                out.write(head + http)
                for at in range(0, len(body), CHUNK):
                    out.write(body[at : at + CHUNK])
                out.write(b"\r\n\r\n")
                records, size = records + 1, size + len(head) + len(http) + len(body) + 4
                if size >= file_bytes:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return written(pages.mapInArrow(write, MANIFEST), "warc-manifest")


CHUNKS = "page_id long, record_type string, refers_to long, stated_digest string, chunk_no int, last boolean, payload_bytes long, payload_digest string, data binary"


def records_of(stream, chunk: int, with_data: bool) -> Iterator[tuple]:
    """Chunk rows of one archive, from a stream that is read once and forwards."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no record begins here")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            key, _, value = line.decode("utf-8", "replace").rstrip("\r\n").partition(": ")
            fields[key.lower()] = value
        left = int(fields["content-length"])
        while left > 0:  # the headers of the HTTP message
            line = stream.readline()
            left -= len(line)
            if line in (b"\r\n", b"\n", b""):
                break
        page = int(fields["x-page-id"]) if "x-page-id" in fields else None
        kind, refers = fields["warc-type"], fields.get("x-refers-to-page-id")
        stated = fields.get("warc-payload-digest", "").removeprefix("sha256:")
        refers = None if refers is None else int(refers)
        if kind == "revisit":
            yield page, kind, refers, stated, 0, True, int(fields["x-payload-length"]), stated, None
        else:
            so_far, seen, number = hashlib.sha256(), 0, 0
            while True:
                data = stream.read(min(chunk, left))
                if left and not data:
                    raise ValueError("an archive ends within a record")
                left -= len(data)
                seen += len(data)
                so_far.update(data)
                yield page, kind, refers, stated, number, left <= 0, seen, so_far.copy().hexdigest(), data if with_data else None
                number += 1
                if left <= 0:
                    break
        stream.read(max(left, 0))


def read_archives(manifest: DataFrame, chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """The chunked record table: a row for each record and chunk number, with bytes and digest of the payload so far."""
    spark = manifest.sparkSession
    uri = scratch(spark, "warc")
    names = CHUNKS.split(", ")
    schema = pa.schema([(c.split()[0], {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}[c.split()[1]]) for c in names])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = filesystem(uri)
        flush = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows, held = [], 0
                with store.open_input_file(name) as raw, pa.BufferedInputStream(raw, CHUNK) as stream:
                    for row in records_of(Lines(stream), chunk, with_data):
                        rows.append(row)
                        held += len(row[-1] or b"") + 200
                        if held >= 4 << 20:
                            yield flush(rows)
                            rows, held = [], 0
                if rows:
                    yield flush(rows)

    files = max(1, manifest.count())
    return manifest.select("file").repartition(files, "file").mapInArrow(read, CHUNKS)


class Lines:
    """readline and read over a stream that has only read; it holds one block at a time."""

    def __init__(self, raw) -> None:
        self.raw, self.block, self.at = raw, b"", 0

    def read(self, n: int) -> bytes:
        if self.at >= len(self.block) and n:
            self.block, self.at = self.raw.read(CHUNK), 0
        out = self.block[self.at : self.at + n]
        self.at += len(out)
        while len(out) < n and (more := self.raw.read(n - len(out))):
            out += more
        return out

    def readline(self) -> bytes:
        parts = []
        while True:
            end = self.block.find(b"\n", self.at)
            if end >= 0:
                parts.append(self.block[self.at : end + 1])
                self.at = end + 1
                return b"".join(parts)
            parts.append(self.block[self.at :])
            self.block, self.at = self.raw.read(CHUNK), 0
            if not self.block:
                return b"".join(parts)


def archived(pages: DataFrame, uri: str | None = None) -> DataFrame:
    """Writes all pages to archives, reads them back, and gives what was read: a row for each page.

    page_id, payload_bytes, payload_digest, record_type, refers_to, chunks (0 for revisits), intact: the digest computed
    from the bytes read equals the one stated when writing. Extra columns are not carried.
    """
    chunks = read_archives(write_archives(revisits(pages), uri), with_data=False)
    last = chunks.filter("last")
    return last.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.when(F.col("record_type") == "response", F.col("chunk_no") + 1).otherwise(0).cast("long").alias("chunks"), (F.col("payload_digest") == F.col("stated_digest")).alias("intact")
    )
