"""Word vectors learnt from the texts at hand: a table of associations, its leading eigenvectors, and chunks as weighted means of words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import kept
from .retrieval import embed_chunks
from .topics import tokens_of

ROW = "row int, cols array<int>, weights array<double>"


def vocabulary(tokens: DataFrame, min_df: int = 3, max_terms: int = 10_000) -> DataFrame:
    """idx, term, df, idf of the max_terms terms (ties to the smaller one) that most texts hold, of those in min_df texts at least.

    tokens: doc_id, tokens. The bound is that of a vocabulary: the table goes to every task.
    """
    texts_too = F.when(F.size("tokens") > 0, F.array_append(F.array_distinct("tokens"), F.lit(None).cast("string")))  # a null term counts texts
    held = kept(tokens.select(F.explode(texts_too).alias("term")).groupBy("term").agg(F.count("*").alias("df")).filter((F.col("df") >= min_df) | F.col("term").isNull()), "vector-terms")
    n = held.filter("term is null").select(F.col("df").alias("_n"))
    terms = held.filter("term is not null").orderBy(F.desc("df"), "term").limit(max_terms)
    terms = kept(terms.crossJoin(F.broadcast(n)).select("term", "df", F.log((1 + F.col("_n")) / F.col("df")).alias("idf")).coalesce(1), "vector-terms")
    named = sorted((r["term"] for r in terms.select("term").collect()), key=lambda t: t.encode())
    return F.broadcast(tokens.sparkSession.createDataFrame(list(enumerate(named)), "idx int, term string")).join(terms, "term").select("idx", "term", "df", "idf")


def pair_counts(tokens: DataFrame, terms: list[str], window: int = 5, at_once: int = 400_000) -> DataFrame:
    """i, j, n: how often terms i and j (i <= j) lie less than window + 1 places apart in a text. Other words keep their places.

    A word makes at most window pairs, so the work grows with the text and not with its square; so many words
    of a batch as at_once says are counted at a time, before the shuffle.
    """
    size, place = len(terms), {t: i for i, t in enumerate(terms)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            flat, owner = lists.flatten(), np.repeat(np.arange(len(lists), dtype=np.int32), np.asarray(lists.value_lengths().fill_null(0)))
            for start in range(0, len(flat), at_once):
                words = flat.slice(start, at_once + window).dictionary_encode()
                known = np.array([place.get(w, -1) for w in words.dictionary.to_pylist()], np.int64)
                ids, of = known[np.asarray(words.indices)], owner[start : start + at_once + window]
                codes = []
                for step in range(1, window + 1):
                    end = max(0, min(at_once, len(ids) - step))
                    a, b = ids[:end], ids[step : end + step]
                    near = (of[:end] == of[step : end + step]) & (a >= 0) & (b >= 0)
                    codes.append(np.minimum(a, b)[near] * size + np.maximum(a, b)[near])
                code, n = np.unique(np.concatenate(codes), return_counts=True)
                yield pa.RecordBatch.from_pydict({"code": code, "n": n.astype(np.int64)})

    counts = tokens.select("tokens").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return counts.select(F.expr(f"cast(code div {max(1, size)} as int)").alias("i"), (F.col("code") % max(1, size)).cast("int").alias("j"), "n")


def associations(pairs: DataFrame) -> DataFrame:
    """row, col, n, weight: the positive pointwise mutual information of pairs (i, j, n), in both directions; weights of 0 are left out."""
    pairs = kept(pairs, "vector-pairs")
    both = pairs.select(F.col("i").alias("row"), F.col("j").alias("col"), F.when(F.col("i") == F.col("j"), 2 * F.col("n")).otherwise(F.col("n")).alias("n"))
    both = both.unionByName(pairs.filter("i != j").select(F.col("j").alias("row"), F.col("i").alias("col"), "n"))
    sums = kept(both.groupBy("row").agg(F.sum("n").cast("double").alias("_row")).coalesce(1), "vector-sums")  # a row for each term
    other, whole = sums.select(F.col("row").alias("col"), F.col("_row").alias("_col")), sums.agg(F.sum("_row").alias("_all"))
    joined = both.join(F.broadcast(sums), "row").join(F.broadcast(other), "col").crossJoin(F.broadcast(whole))
    return joined.select("row", "col", "n", F.log(F.col("n") * F.col("_all") / (F.col("_row") * F.col("_col"))).alias("weight")).filter("weight > 0")


def product(rows: DataFrame, x: np.ndarray) -> np.ndarray:
    """The symmetric table times x. Each row is one product of its own, so the numbers do not depend on how rows are dealt."""
    width, shared = x.shape[1], rows.sparkSession.sparkContext.broadcast(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = shared.value
        for batch in batches:
            cols, weights = batch.column("cols"), batch.column("weights")
            out = [np.asarray(w.values) @ x[np.asarray(c.values)] for c, w in zip(cols, weights, strict=True)]
            flat = pa.array(np.concatenate(out) if out else np.zeros(0))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * width), flat)], names=["row", "y"])

    got = rows.mapInArrow(run, "row int, y array<double>").toArrow().combine_chunks()
    shared.destroy()  # executors keep its bytes on disk until then
    y = np.zeros_like(x)
    if len(got):
        y[got["row"].to_numpy()] = got["y"].combine_chunks().flatten().to_numpy().reshape(-1, width)
    return y


def leading(rows: DataFrame, n: int, size: int, extra: int = 16, rounds: int = 8, tol: float = 1e-3, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues (at most size, positive ones only) of a written symmetric table of n rows (see ROW), and their vectors.

    Randomised block Krylov method: size + extra random columns are multiplied by the table, one job a round; what a product adds to the
    columns so far is multiplied next, and the answer is the best within their span. The rounds end when no wanted value moves by more
    than tol of the largest, or nothing is added. The driver holds 2 x rounds x n x (size + extra) numbers, no table.
    """
    columns = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, min(n, size + extra))))[0]
    basis = images = np.zeros((n, 0))
    before = None
    for _ in range(rounds):
        y = product(rows, columns)
        basis, images = np.hstack([basis, columns]), np.hstack([images, y])
        small = basis.T @ images
        values, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-values, kind="stable")[:size]
        values, most = values[order], np.abs(values).max(initial=0)
        if before is not None and len(before) == len(values) and np.abs(values - before).max(initial=0) <= tol * most:
            break
        before, rest = values, y
        for _ in range(2):  # once more, against round-off
            rest = rest - basis @ (basis.T @ rest)
        u, s, _ = np.linalg.svd(rest, full_matrices=False)
        columns = u[:, s > 1e-9 * most]
        if not columns.shape[1]:
            break
    vectors = basis @ turn[:, order]
    some = values > 1e-9
    values, vectors = values[some], vectors[:, some]
    top = np.abs(vectors).argmax(0) if vectors.size else np.zeros(0, int)
    return values, vectors * np.sign(vectors[top, np.arange(len(values))])


def learn_vectors(tokens: DataFrame, size: int = 64, window: int = 5, min_df: int = 3, max_terms: int = 10_000) -> DataFrame:
    """term, df, idf, vector of each vocabulary term, from texts (doc_id, tokens): eigenvectors of the associations by the roots of their values.

    Vectors have size places, zeros where the table has fewer positive values. The same for any order and partitions of the texts; a
    vocabulary without terms gives no rows. Null lists count as empty.
    """
    spark = tokens.sparkSession
    tokens = tokens.select("doc_id", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))
    vocab = kept(vocabulary(tokens, min_df, max_terms).coalesce(1), "vector-vocabulary")
    terms = [r["term"] for r in vocab.orderBy("idx").select("term").collect()]
    table = associations(pair_counts(tokens, terms, window))
    ordered = F.sort_array(F.collect_list(F.struct("col", "weight")))
    rows = kept(table.groupBy("row").agg(ordered.alias("x")).select("row", F.col("x.col").alias("cols"), F.col("x.weight").alias("weights")), "vector-rows")
    found = np.zeros((len(terms), size))
    if terms:
        values, vectors = leading(rows, len(terms), size)
        found[:, : len(values)] = vectors * np.sqrt(values)
    learnt = spark.createDataFrame(pa.table({"idx": pa.array(range(len(terms)), pa.int32()), "vector": pa.array(list(found.astype(np.float32)), pa.list_(pa.float32()))}))
    return vocab.join(F.broadcast(learnt), "idx").select("term", "df", "idf", "vector")


def encoder_of(learnt: DataFrame) -> Callable[[list[str]], np.ndarray]:
    """An encoder for embed_chunks() of texts whose words are told apart by blanks: idf-weighted means of their vectors, of length 1.

    A text without a known word gets zeros. learnt: see learn_vectors(); of its bounded size, it goes to each task.
    """
    got = learnt.orderBy("term").toArrow()
    place = {t: i for i, t in enumerate(got["term"].to_pylist())}
    idf, width = got["idf"].to_numpy(), max(map(len, got["vector"].to_pylist()), default=1)
    vectors = np.concatenate([np.array(got["vector"].to_pylist(), np.float64).reshape(len(place), width) * idf[:, None], np.zeros((1, width))])

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), width))
        for k, text in enumerate(texts):
            ids, n = np.unique([place.get(w, len(place)) for w in (text or "").split()] or [len(place)], return_counts=True)
            out[k] = n @ vectors[ids]
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).astype(np.float32)

    return encode


def embed_learnt(chunks: DataFrame, learnt: DataFrame, stop_words: list[str] | None = None) -> DataFrame:
    """chunk_id, doc_id, embedding of chunks (doc_id, chunk_index, text), in words as learnt."""
    words = F.array_join(tokens_of(F.col("text"), stop_words or []), " ")
    return embed_chunks(chunks.select("doc_id", "chunk_index", words.alias("text")), encoder_of(learnt))
