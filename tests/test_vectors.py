"""Learnt vectors against a dense computation, planted neighbours, partitions, and odd texts."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from seriesloom.operators import retrieval as R
from seriesloom.operators import topics as T
from seriesloom.operators import vectors as V

TOPICS = [[f"w{t}x{i}" for i in range(24)] for t in range(8)]


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(7)
    return [(i, [draw.choice(TOPICS[i % 8]) if draw.random() < 0.8 else f"common{draw.randrange(12)}" for _ in range(draw.randrange(5, 60))]) for i in range(240)]


@pytest.fixture(scope="module")
def tokens(spark, texts):
    return spark.createDataFrame([*texts, (1000, []), (1001, None)], "doc_id long, tokens array<string>")


def dense(texts, terms, window=5):
    at, n = {t: i for i, t in enumerate(terms)}, Counter()
    for _, words in texts:
        for p, a in enumerate(words):
            for b in words[p + 1 : p + 1 + window]:
                if a in at and b in at:
                    n[at[a], at[b]] += 1
                    n[at[b], at[a]] += 1
    sums = Counter()
    for (i, _), k in n.items():
        sums[i] += k
    out = np.zeros((len(terms), len(terms)))
    for (i, j), k in n.items():
        out[i, j] = max(0.0, math.log(k * sum(sums.values()) / (sums[i] * sums[j])))
    return out


def test_associations_and_eigenvectors_equal_a_dense_computation(tokens, texts):
    terms = sorted({w for _, words in texts for w in words})
    whole = dense(texts, terms)
    table = V.associations(V.pair_counts(tokens.filter("tokens is not null"), terms))
    few = V.pair_counts(tokens.filter("tokens is not null").coalesce(1), terms, at_once=7)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, V.pair_counts(tokens.filter("tokens is not null"), terms).collect()))
    got = np.zeros_like(whole)
    for r in table.collect():
        got[r.row, r.col] = r.weight
    assert np.allclose(got, whole)
    rows = table.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("col", "weight"))).alias("x")).select("row", F.col("x.col").alias("cols"), F.col("x.weight").alias("weights"))
    values, vectors = V.leading(rows.cache(), len(terms), 6, rounds=40, tol=1e-9)
    assert np.allclose(values, np.sort(np.linalg.eigvalsh(whole))[::-1][:6], rtol=1e-5)
    assert np.abs(whole @ vectors - vectors * values).max() < 1e-2 * values[0]


def test_same_vectors_after_a_repartition(tokens):
    some = V.learn_vectors(tokens, size=8).orderBy("term").collect()
    assert some == V.learn_vectors(tokens.repartition(7, F.rand(1)), size=8).orderBy("term").collect() and len(some) > 100


def test_planted_neighbours_are_found_by_other_words(spark, tokens):
    """Texts that share no word with what they are near to: a query has the even words of a topic, documents the odd ones."""
    learnt = V.learn_vectors(tokens, size=16)
    draw = random.Random(3)
    docs = [(i, 0, " ".join(draw.choices(TOPICS[i % 8][1::2], k=20))) for i in range(80)]
    asked = [(i, 0, " ".join(draw.choices(TOPICS[i % 8][::2], k=20))) for i in range(40)]
    schema = "doc_id long, chunk_index int, text string"

    def recall(embed):
        vectors, queries = (embed(spark.createDataFrame(x, schema)) for x in (docs, asked))
        hits = R.knn_retrieve(vectors, queries.select(F.col("doc_id").alias("query_id"), "embedding"), k=5).collect()
        return sum(h.query_id % 8 == h.doc_id % 8 for h in hits) / len(hits)

    assert recall(lambda c: V.embed_learnt(c, learnt)) >= 0.95
    assert recall(R.embed_chunks) < 0.5  # hashed words do not tell


def test_near_texts_of_the_documents_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) >= 100").select("doc_id", F.lit(0).alias("chunk_index"), "text")
    learnt = V.learn_vectors(T.tokenize(docs, []))
    words = F.split("text", r"\s+")
    edited = docs.withColumn("text", F.array_join(F.filter(words, lambda w, i: i % 3 != 2), " "))
    queries = V.embed_learnt(edited, learnt).select(F.col("doc_id").alias("query_id"), "embedding")
    own = R.knn_retrieve(V.embed_learnt(docs, learnt), queries, k=5).filter("query_id = doc_id").count()
    assert own >= 0.9 * docs.count()


def test_no_known_words(spark, tokens):
    learnt = V.learn_vectors(tokens, size=4)
    chunks = spark.createDataFrame([(1, 0, "nobody knows"), (2, 0, ""), (3, 0, None), (4, 0, " ".join(["w1x1"] * 50_000))], "doc_id long, chunk_index int, text string")
    got = {r.doc_id: r.embedding for r in V.embed_learnt(chunks, learnt).collect()}
    assert [got[i] for i in (1, 2, 3)] == [[0.0] * 4] * 3 and np.linalg.norm(got[4]) == pytest.approx(1)
    none = V.learn_vectors(tokens.filter("false"))
    assert none.count() == 0 and V.embed_learnt(chunks, none).count() == 4
