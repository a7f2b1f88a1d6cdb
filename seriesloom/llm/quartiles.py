"""Document fingerprints: a quartile digest of hashed byte triplets, and how alike two digests are."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

BUCKETS = 512
#: Bytes that are counted at a time, so that a long text needs no more memory than itself.
SLICE = 1 << 20
#: Digests whose buckets differ by so many quartiles on average, or more, are not alike at all.
APART = 1.25
#: What a difference of one step of length (a tenth of a natural logarithm) counts, in quartiles of one bucket.
LENGTH_STEP = 8
FINGERPRINTS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
TYPES = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())


def triplet_counts(raw: bytes) -> np.ndarray:
    """How many of the byte triplets of raw fall into each bucket."""
    seen, shift = np.zeros(BUCKETS, np.int64), np.uint32(33 - BUCKETS.bit_length())
    for at in range(0, max(0, len(raw) - 2), SLICE):
        b = np.frombuffer(raw, np.uint8, min(SLICE + 2, len(raw) - at), at).astype(np.uint32)
        code = b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]
        seen += np.bincount(code * np.uint32(0x9E3779B1) >> shift, minlength=BUCKETS)
    return seen


def digest(raw: bytes) -> np.ndarray:
    """Of each bucket, how many of the three quartiles of all buckets its count is above (0 to 3); last, the length in steps of a tenth of a logarithm."""
    seen = triplet_counts(raw)
    quartiles = np.sort(seen)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    return np.append((seen[:, None] > quartiles).sum(1), min(255, round(10 * math.log1p(len(raw))))).astype(np.uint8)


def as_text(d: np.ndarray) -> str:
    """Length as two hexadecimal digits, then four buckets to a byte."""
    four = d[:-1].reshape(-1, 4)
    return d[-1:].tobytes().hex() + (four[:, 0] << 6 | four[:, 1] << 4 | four[:, 2] << 2 | four[:, 3]).astype(np.uint8).tobytes().hex()


def from_text(text: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(text), np.uint8)
    return np.append((raw[1:, None] >> np.array([6, 4, 2, 0], np.uint8) & 3).reshape(-1), raw[0])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 for equal digests, down to 0 where the differences of buckets and lengths reach their bound."""
    far = np.abs(a.astype(np.int64) - b)
    return max(0.0, 1.0 - (int(far[:-1].sum()) + LENGTH_STEP * int(far[-1])) / (APART * BUCKETS))


class Follower:
    """Takes documents in order; each next one completes the row of the one before."""

    def __init__(self) -> None:
        self.held: tuple | None = None

    def add(self, doc_id: int | None, text: str, only_next: bool) -> Iterator[tuple]:
        own = digest(text.encode())
        if self.held is not None:
            before, head, was = self.held
            k = len(head) // 3
            edited = (head[: len(head) - k] + text[:k]).encode()
            new = digest(edited)
            yield before, len(head), hashlib.sha256(edited).hexdigest(), as_text(was), as_text(new), likeness(was, new), likeness(was, own)
        self.held = None if only_next else (doc_id, text, own)


def fingerprint_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint, that of its edited text (the last third of its code points replaced by the first as many, or all, of the next
    document), and how alike its fingerprint is to the edited text's and to the next document's.

    Documents follow each other by descending doc_id, null ones last, equal ones by text; after the last comes the first (a lone document follows
    itself). A null text is empty. Repeated rows give a row each. Extra columns are not carried. An empty table gives no rows. Texts of less than
    three bytes have no triplets: their fingerprints differ by length only.

    Texts are shuffled once, by ranges of doc_id between approximate quantiles; the first document of each range (so as many as there are shuffle
    partitions) goes to the end of the range before it as well. Every range is read in order, one document at a time.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)] or [0.5], 10_000)).first()[0]
    cuts = np.unique(np.array(cuts or [], np.int64))

    @F.arrow_udf("int")
    def range_of(ids: pa.Array) -> pa.Array:  # the highest ids come first, null ones last
        return pa.array(len(cuts) - np.searchsorted(cuts, ids.to_numpy(zero_copy_only=False), "left"), pa.int32())

    ranged = rows.withColumn("part", range_of(F.coalesce("doc_id", F.lit(-(1 << 63)))))
    heads = sorted((r["part"], r["first"]) for r in ranged.groupBy("part").agg(F.max("doc_id").alias("first")).collect())  # a row for each range
    ends = spark.createDataFrame([(part, first, heads[i - 1][0]) for i, (part, first) in enumerate(heads)], "part int, first long, before int")
    firsts = ranged.join(F.broadcast(ends), "part").filter(F.col("doc_id").eqNullSafe(F.col("first"))).groupBy("before", "doc_id").agg(F.min("text").alias("text"))
    both = ranged.withColumn("only_next", F.lit(False)).unionByName(firsts.select("doc_id", "text", F.col("before").alias("part"), F.lit(True).alias("only_next")))
    dealt = both.repartitionById(n, "part").sortWithinPartitions("part", "only_next", F.desc_nulls_last("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        follower, names = Follower(), [c.split()[0] for c in FINGERPRINTS.split(", ")]
        for batch in batches:
            out = [row for doc, words, last in zip(*(batch.column(c) for c in ("doc_id", "text", "only_next")), strict=True) for row in follower.add(doc.as_py(), words.as_py(), last.as_py())]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), TYPES, strict=True)], names=names)

    return dealt.mapInArrow(run, FINGERPRINTS)
