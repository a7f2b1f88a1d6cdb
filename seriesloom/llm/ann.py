"""Approximate nearest neighbours: a tree of k-means centres, searched best bin first, as wide as calibrated recall needs."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, written

#: The tree is fitted on at most about so many vectors, whatever the size of the table; every vector is indexed.
SAMPLE = 20_000
BRANCHES, LEAF = 8, 64
#: Calibration: so many queries are compared with all vectors; leaf visits widen until so much of their neighbours is found.
CALIBRATION, TARGET = 128, 0.96
#: A task compares at most about so many vectors with as many queries.
BLOCK = 4096


@dataclass
class Tree:
    """Unit centres by node; children of inner nodes; leaf numbers of the others."""

    centres: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    leaves: int = 0

    def add(self, x: np.ndarray, rng: np.random.Generator, depth: int = 0) -> int:
        node = len(self.children)
        self.children.append([])
        self.leaf.append(-1)
        self.centres.append(np.zeros((0, x.shape[1])))
        parts = split(x, rng) if len(x) > LEAF and depth < 12 else None
        if parts is None:
            self.leaf[node] = self.leaves
            self.leaves += 1
            return node
        centres, label = parts
        for k in range(len(centres)):
            self.children[node].append(self.add(x[label == k], rng, depth + 1))
        self.centres[node] = centres
        return node

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each unit vector, by the nearest child at each node."""
        out = np.zeros(len(x), np.int64)
        stack = [(0, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
            elif len(rows):
                best = (x[rows] @ self.centres[node].T).argmax(1)
                stack += [(child, rows[best == k]) for k, child in enumerate(self.children[node])]
        return out

    def visits(self, q: np.ndarray) -> Iterator[int]:
        """All leaves, the most promising first: a queue of nodes by their centres' similarity."""
        queue = [(-1.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                yield self.leaf[node]
            else:
                for s, child in zip(self.centres[node] @ q, self.children[node], strict=True):
                    heapq.heappush(queue, (-float(s), child))


def split(x: np.ndarray, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray] | None:
    """Spherical k-means into up to BRANCHES parts; None if the vectors can't be told apart."""
    centres = x[rng.choice(len(x), BRANCHES, replace=False)]
    for _ in range(rounds):
        label = (x @ centres.T).argmax(1)
        used, label = np.unique(label, return_inverse=True)
        centres = np.stack([x[label == k].sum(0) for k in range(len(used))])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    label = (x @ centres.T).argmax(1)
    used, label = np.unique(label, return_inverse=True)
    return (centres[used], label) if len(used) > 1 else None


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


def distinct_vectors(vectors: DataFrame, k: int) -> DataFrame:
    """vid, ids, vector: each different vector once, with its k + 1 smallest ids (a query among k + 1 copies needs no more)."""
    order = Window.partitionBy("vector").orderBy("vec_id")
    few = vectors.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k + 1)
    return few.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("vid"), "ids", "vector")


def best(scores: np.ndarray, vid: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row its k largest scores' columns, ties to the smaller vid."""
    for i, row in enumerate(scores):
        if len(row) > k:
            floor = np.partition(row, len(row) - k)[len(row) - k]
            some = np.flatnonzero(row >= floor)
        else:
            some = np.arange(len(row))
        yield i, some[np.lexsort((vid[some], -row[some]))][:k]


def exact(classes: DataFrame, queries: list[tuple[int, np.ndarray]], k: int) -> DataFrame:
    """query, vid, leaf, score: each query's k nearest of all distinct vectors, by comparing it with every block of them."""
    names, q = np.array([v for v, _ in queries]), unit(np.stack([x for _, x in queries]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vid, leaf = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            scores = q @ unit(matrix(batch.column(2))).T if len(vid) else np.zeros((0, 0))
            rows = [(names[i], vid[j], leaf[j], scores[i, j]) for i, some in best(scores, vid, k) for j in some]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["query", "vid", "leaf", "score"])

    found = classes.select("vid", "leaf", "vector").mapInArrow(run, "query long, vid long, leaf long, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vid")
    return found.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k)


def calibrated(classes: DataFrame, asked: DataFrame, tree: Tree, k: int) -> int:
    """How many leaves to visit so that TARGET of the true neighbours of a sample of queries lie in them."""
    some = asked.orderBy(F.xxhash64("vid"), "vid").limit(CALIBRATION).collect()
    if not some:
        return 1
    queries = [(r["vid"], np.array(r["vector"], float)) for r in some]
    truth = exact(classes, queries, k + 1).filter("query != vid").select("query", "leaf").collect()
    if not truth:
        return 1
    place = {v: {leaf: n for n, leaf in enumerate(tree.visits(x / np.linalg.norm(x)))} for v, x in queries}
    ranks = np.sort([place[r["query"]][r["leaf"]] for r in truth])
    return int(ranks[min(len(ranks) - 1, int(np.ceil(TARGET * len(ranks))) - 1)]) + 1


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found, by cosine, for each row whose id is divisible by every.

    Candidates are all rows with another id. A vector that is null, empty, zero or has a null or non-finite component takes no
    part, nor a null id, nor a vector of another length than most. Equal vectors are indexed once with their smallest ids,
    which loses nothing; repeated rows count once. Ties go to the smaller id. Extra columns are not carried.
    """
    spark = vectors.sparkSession
    clean = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")).filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    sizes = clean.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    clean = clean.filter(F.size("vector") == (sizes[0]["n"] if sizes else 0)).dropDuplicates(["vec_id", "vector"])
    raw = written(distinct_vectors(clean, k), "ann-vectors")
    n = raw.count()
    drawn = raw.filter(F.pmod(F.xxhash64("vid"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / max(n, 1)))).select("vid", "vector").limit(2 * SAMPLE)
    points = sorted((r["vid"], r["vector"]) for r in drawn.collect())
    tree = Tree()
    tree.add(unit(np.array([v for _, v in points])) if points else np.zeros((0, 1)), np.random.default_rng(3))
    shared = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = shared.value.place(unit(matrix(batch.column("vector")))) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int64())], names=[*batch.schema.names, "leaf"])

    classes = written(raw.mapInArrow(place, "vid long, ids array<long>, vector array<double>, leaf long"), "ann-index")
    is_query = F.col("vec_id") % every == 0
    asked = written(clean.filter(is_query).groupBy("vector").agg(F.min("vec_id").alias("vid")), "ann-queries")
    width = calibrated(classes, asked, tree, k)
    # At most one row for each leaf of a tree over a bounded sample: small enough to send anywhere.
    counts = classes.groupBy("leaf").agg(F.count("*").alias("rows"), F.sum(F.size("ids")).alias("held"))
    held = {r["leaf"]: (r["rows"], r["held"]) for r in counts.collect()}

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, leaves = [], []
            for i, q in enumerate(unit(matrix(batch.column("vector"))) if batch.num_rows else []):
                seen = found = 0
                for leaf in shared.value.visits(q):
                    seen += 1
                    if leaf in held:
                        found += held[leaf][1]
                        take.append(i)
                        leaves.append(leaf)
                    if seen >= width and found > k:
                        break
            rows = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vid").take(rows), batch.column("vector").take(rows), pa.array(leaves, pa.int64())], names=["query", "q", "leaf"])

    probes = written(asked.select("vid", "vector").mapInArrow(traverse, "query long, q array<double>, leaf long"), "ann-probes")
    per_leaf = probes.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("q_blocks"))
    blocks = classes.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("v_blocks")).join(per_leaf, "leaf")
    blocks = F.broadcast(blocks)
    every_block = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = classes.join(blocks, "leaf").withColumn("vb", F.pmod(F.xxhash64("vid"), "v_blocks").cast("int")).withColumn("qb", every_block("q_blocks")).select("leaf", "vb", "qb", "vid", "ids", "vector")
    right = probes.join(blocks, "leaf").withColumn("qb", F.pmod(F.xxhash64("query"), "q_blocks").cast("int")).withColumn("vb", every_block("v_blocks")).select("leaf", "vb", "qb", "query", "q")

    def compare(vs: pa.Table, qs: pa.Table) -> pa.Table:
        if not vs.num_rows or not qs.num_rows:
            return pa.table({"query": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())), "score": pa.array([], pa.float64())})
        vid, ids = vs.column("vid").to_numpy(), vs.column("ids").combine_chunks()
        v, q, name = matrix(vs.column("vector")), matrix(qs.column("q")), qs.column("query").to_numpy()
        length = np.linalg.norm(v, axis=1)
        out: tuple[list, list, list] = ([], [], [])
        for a in range(0, len(q), 256):
            scores = (q[a : a + 256] @ v.T) / (np.linalg.norm(q[a : a + 256], axis=1)[:, None] * length)
            for i, some in best(scores, vid, k + 1):
                out[0].append(np.full(len(some), name[a + i]))
                out[1].append(some)
                out[2].append(scores[i, some])
        return pa.table({"query": np.concatenate(out[0]), "ids": ids.take(pa.array(np.concatenate(out[1]))), "score": np.concatenate(out[2])})

    found = left.groupBy("leaf", "vb", "qb").cogroup(right.groupBy("leaf", "vb", "qb")).applyInArrow(compare, "query long, ids array<long>, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "candidate")
    of_class = found.select("query", "score", F.explode("ids").alias("candidate")).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k + 1).drop("_n")
    of_class = written(of_class, "ann-found")
    rows = clean.filter(is_query).join(asked.select("vector", F.col("vid").alias("query")), "vector").select(F.col("vec_id").alias("query_id"), "query")
    small = asked.limit(BROADCAST_ROWS // (k + 1) + 1).count() <= BROADCAST_ROWS // (k + 1)
    hits = rows.join(F.broadcast(of_class) if small else of_class, "query").filter(F.col("candidate") != F.col("query_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "candidate")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("candidate").alias("vec_id"), "score")
