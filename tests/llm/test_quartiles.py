import hashlib
import random

import numpy as np
import pytest
from seriesloom.llm import quartiles as Q


def brute(docs):
    """(doc_id, text) rows in any order; the rows of the operator, one text at a time."""
    rows = sorted(((i, t or "") for i, t in docs), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        n = len(text)
        edited = text[: n - n // 3] + after[: n // 3]
        a, b, c = (Q.digest(x.encode()) for x in (text, edited, after))
        out.append((i, n, hashlib.sha256(edited.encode()).hexdigest(), Q.as_text(a), Q.as_text(b), Q.likeness(a, b), Q.likeness(a, c)))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_counts_and_quartiles_of_one_text_at_a_time():
    raw = random.Random(1).randbytes(5000) + "naïve – ok".encode() * 20
    want = np.zeros(Q.BUCKETS, int)
    for i in range(len(raw) - 2):
        want[((int.from_bytes(raw[i : i + 3], "big") * 0x9E3779B1) % 2**32) >> (33 - Q.BUCKETS.bit_length())] += 1
    assert (Q.triplet_counts(raw) == want).all()
    d = Q.digest(raw)
    ranks = sorted(want)
    assert [sum(c > ranks[k * Q.BUCKETS // 4 - 1] for k in (1, 2, 3)) for c in want] == list(d[:-1])
    assert (Q.from_text(Q.as_text(d)) == d).all()


def test_slices_change_nothing(monkeypatch):
    raw = random.Random(2).randbytes(1003)
    whole = Q.triplet_counts(raw)
    monkeypatch.setattr(Q, "SLICE", 10)
    assert (Q.triplet_counts(raw) == whole).all() and whole.sum() == 1001


@pytest.mark.parametrize("n", [1, 2, 7, 300])
def test_same_as_one_at_a_time(spark, n):
    rng = random.Random(n)
    word = lambda: rng.choice(["alpha", "béta", "\U0001f600", "x" * 90, "\n", "of", "the"])
    docs = [(rng.choice((i, i * 1000, -i)), " ".join(word() for _ in range(rng.choice((0, 1, 5, 200))))) for i in range(n)]
    docs[0] = docs[0][0], "long text " * 30_000
    if n > 2:
        docs += [docs[1], docs[1], (None, "no id"), (None, None), (None, "no id"), (7, None), (7, "")] + [(3, "hot")] * n
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert got(Q.fingerprint_edits(frame)) == brute(docs)


def test_clashing_columns_and_empty_tables(spark):
    docs = [(i, f"text {i}" * 9, "x", 1) for i in range(9)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, part string, `only.next` int")
    assert got(Q.fingerprint_edits(frame)) == brute([d[:2] for d in docs])
    assert Q.fingerprint_edits(frame.limit(0)).count() == 0
    assert got(Q.fingerprint_edits(frame.select("doc_id", "text").filter("doc_id = 1"))) == brute([(1, docs[1][1])])


def test_edited_texts_are_nearer_than_the_next(spark):
    rows = Q.fingerprint_edits(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("n_chars > 200").collect()
    assert sum(r.near_edited > r.near_next for r in rows) > 0.97 * len(rows)
    assert all(0 <= r[c] <= 1 for r in rows for c in ("near_edited", "near_next"))
