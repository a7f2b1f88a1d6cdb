"""Chunking, embedding and retrieval of documents."""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 4
SENTENCE_END = re.compile(r"(?<=[.!?])\s+")
BLANK_LINE = re.compile(r"\n\s*\n")
#: Blocks of so many queries meet blocks of so many vectors.
QUERY_BLOCK, VECTOR_BLOCK = 4_096, 32_768


def size_of(text: str) -> int:
    return max(1, -(-len(text) // CHARS_PER_TOKEN))


def units_of(text: str, most: int) -> Iterator[str]:
    """Paragraphs, and the sentences of those that are too long (of a single paragraph in any case)."""
    paragraphs = [p for p in map(str.strip, BLANK_LINE.split(text)) if p]
    for p in paragraphs:
        if len(paragraphs) > 1 and size_of(p) <= most:
            yield p
        else:
            yield from (s for s in map(str.strip, SENTENCE_END.split(p)) if s)


def ranges_of(sizes: list[int], most: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Ranges of units, each as long as fits into most (a first unit that is too long stands alone).

    A range that took more than overlap units hands its last ones on, and what follows them is taken whatever its size.
    """
    upto = [0, *itertools.accumulate(sizes)]
    start = carried = 0
    while start + carried < len(sizes):
        end = max(start + carried + 1, bisect.bisect_right(upto, upto[start] + most) - 1)
        yield start, end
        carried = overlap if 0 < overlap < end - start else 0
        start = end - carried


def chunks_of(text: str | None, most: int = 200, overlap: int = 1) -> list[str]:
    """The text whole if it has at most most tokens, else its units joined by ranges_of(); a blank text has none."""
    text = (text or "").strip()
    if size_of(text) <= most:
        return [text] if text else []
    units = list(units_of(text, most))
    return [" ".join(units[a:b]) for a, b in ranges_of([size_of(u) for u in units], most, overlap)]


def chunk_documents(docs: DataFrame, max_tokens: int = 200, overlap: int = 1) -> DataFrame:
    """doc_id, chunk_index, text"""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunks_of(t, max_tokens, overlap))

    return docs.select("doc_id", F.posexplode(cut(F.col("text"))).alias("chunk_index", "text"))


def hashed_encoder(texts: list[str], size: int = 64) -> np.ndarray:
    """A stand-in for a model: counts of hashed words, of length 1."""
    out = np.zeros((len(texts), size), np.float32)
    for i, text in enumerate(texts):
        for word in text.lower().split():
            out[i, int(hashlib.md5(word.encode()).hexdigest()[:6], 16) % size] += 1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embed_chunks(chunks: DataFrame, encoder: Callable[[list[str]], np.ndarray] = hashed_encoder) -> DataFrame:
    """chunk_id (doc_id::chunk_index), doc_id, embedding"""

    @F.pandas_udf("array<float>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(list(encoder(list(texts))))

    return chunks.select(F.concat_ws("::", "doc_id", "chunk_index").alias("chunk_id"), "doc_id", embed(F.col("text")).alias("embedding"))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def blocks_for(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def knn_retrieve(vectors: DataFrame, queries: DataFrame, k: int = 5, hint_col: str | None = None, metric: str = "cosine") -> DataFrame:
    """query_id, doc_id, rank, distance: the k nearest vectors (doc_id, embedding) of each query (query_id, embedding[, hint]).

    With hint_col a query with a hint only meets vectors of that value; if there is none it meets all. Blocks of queries meet
    blocks of vectors, each pair of blocks in a group of its own, which keeps k rows for each query; so neither the driver nor a
    task holds more than a block of either side.
    """
    n_q, n_v = blocks_for(queries.count(), QUERY_BLOCK), blocks_for(vectors.count(), VECTOR_BLOCK)
    hint = F.lit(None).cast("string").alias("_hint")
    if hint_col:
        known = vectors.select(F.col(hint_col).cast("string").alias("_hint")).filter("_hint is not null").distinct().withColumn("_known", F.lit(True))
        queries = queries.withColumn("_hint", F.col("hint").cast("string")).join(known, "_hint", "left")
        hint = F.when(F.col("_known"), F.col("_hint")).alias("_hint")
    block = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(F.col("query_id").alias("query_id"), F.col("embedding").alias("x"), hint, block("query_id", n_q).alias("_q"), each(n_v).alias("_v"))
    of = (F.col(hint_col).cast("string") if hint_col else F.lit(None).cast("string")).alias("_of")
    right = vectors.select(F.col("doc_id").alias("doc_id"), F.col("embedding").alias("y"), of, each(n_q).alias("_q"), block("doc_id", n_v).alias("_v"))
    near = left.groupBy("_q", "_v").cogroup(right.groupBy("_q", "_v")).applyInArrow(lambda q, v: nearest_in(q, v, k, metric), "query_id long, doc_id long, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "doc_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "doc_id", "rank", "distance")


def nearest_in(queries: pa.Table, vectors: pa.Table, k: int, metric: str) -> pa.Table:
    """The k nearest of a block of vectors to each of a block of queries, ties to the smaller id."""
    out: list[tuple] = []
    if len(queries) and len(vectors):
        q, v, doc = matrix(queries["x"]), matrix(vectors["y"]), vectors["doc_id"].to_numpy()
        of = np.array(vectors["_of"].to_pylist(), object)
        lengths = np.linalg.norm(v, axis=1), (v * v).sum(1)
        for query_id, hint, x in zip(queries["query_id"].to_pylist(), queries["_hint"].to_pylist(), q):
            if metric == "cosine":
                d = 1 - (v @ x) / (np.linalg.norm(x) * lengths[0] + 1e-300)
            else:
                d = np.sqrt(np.maximum(x @ x + lengths[1] - 2 * (v @ x), 0))
            d = np.where(np.isfinite(d) & ((of == hint) if hint is not None else True), d, np.inf)
            few = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > k else np.arange(len(d))
            few = few[np.lexsort((doc[few], d[few]))][:k]
            out += [(query_id, int(doc[j]), float(d[j])) for j in few if np.isfinite(d[j])]
    names, kinds = ("query_id", "doc_id", "distance"), (pa.int64(), pa.int64(), pa.float64())
    return pa.Table.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=list(names))


def retrieve_with_floor(hits: DataFrame, pool: DataFrame, min_class: int = 3, class_prefix: str = "scholarly", excluded: tuple[str, ...] = ("series_notes", "release_info", "category_path")) -> DataFrame:
    """hits (query_id, doc_id, doc_type, rank, distance) with more documents of a class from the pool where they hold fewer than min_class.

    The pool's first 5 * min_class rows that are of no excluded type count; documents seen already are skipped. Added rows
    come after the hits, so there can be more than k.
    """
    if min_class <= 0:
        return hits
    of_class = F.col("doc_type").startswith(class_prefix)
    have = hits.groupBy("query_id").agg(F.count_distinct(F.when(of_class, F.col("doc_id"))).alias("_have"), F.max("rank").alias("_last"))
    w = Window.partitionBy("query_id").orderBy("rank")
    first = pool.filter(~F.col("doc_type").isin(*excluded)).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= 5 * min_class).filter(of_class)
    unseen = first.join(hits.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    one = unseen.withColumn("_d", F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("rank"))).filter("_d = 1")
    more = one.withColumn("_k", F.row_number().over(w)).join(have, "query_id").filter(F.col("_k") <= min_class - F.col("_have"))
    return hits.unionByName(more.select("query_id", "doc_id", "doc_type", (F.col("_last") + F.col("_k")).cast("int").alias("rank"), "distance").select(hits.columns))


def reference_context(hits: DataFrame, chunks: DataFrame, snippet: int = 150) -> DataFrame:
    """query_id, context: a numbered line for each document, in order of its best rank."""
    best = hits.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    text = F.when(F.length("text") > snippet, F.concat(F.substring("text", 1, snippet), F.lit("..."))).otherwise(F.col("text"))
    lines = best.join(chunks.select("doc_id", text.alias("line")), "doc_id").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id", "line"))).alias("x"))
    return lines.select("query_id", F.array_join(F.transform("x", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". [ref:"), x["doc_id"].cast("string"), F.lit("] "), x["line"])), "\n").alias("context"))
