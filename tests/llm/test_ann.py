import numpy as np
import pytest
from seriesloom.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label string, score string"


def brute(rows, k=5, every=50):
    ok = {}
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i] = np.array(v, np.float32).astype(float)
    ids = np.array(sorted(ok))
    x = np.stack([ok[i] for i in ids])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for n, i in enumerate(ids):
        if i % every == 0:
            s = x @ x[n]
            out[int(i)] = [(int(ids[j]), s[j]) for j in np.lexsort((ids, -np.round(s, 12))) if j != n][:k]
    return out


def clustered(n=1500, d=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, d)) * 2
    return [(i, [float(v) for v in centres[i % 12] + rng.standard_normal(d)], "x", "clash") for i in range(n)]


def test_recall_and_scores(spark):
    rows = clustered()
    got = ann.nearest(spark.createDataFrame(rows, SCHEMA)).collect()
    want = brute(rows)
    assert len(got) == 5 * len(want)
    hits = 0
    for r in got:
        truth = dict(want[r.query_id])
        hits += r.vec_id in truth
        if r.vec_id in truth:
            assert abs(truth[r.vec_id] - r.score) < 1e-12
        assert r.vec_id != r.query_id
    assert hits / len(got) >= 0.9


def test_copies_ties_and_bad_vectors(spark):
    same = [1.0, 2.0, 3.0]
    rows = [(i, same, None, None) for i in range(0, 120)] + [(1000, [3.0, 2.0, 1.0], None, None), (1001, None, None, None), (1002, [0.0] * 3, None, None), (1050, [1.0, None, 2.0], None, None), (1100, [1.0, float("nan"), 2.0], None, None), (1150, [float("inf"), 1.0, 2.0], None, None), (1200, [1.0, 2.0], None, None), (None, same, None, None), (0, same, None, None)]
    got = sorted((r.query_id, r.rank, r.vec_id) for r in ann.nearest(spark.createDataFrame(rows, SCHEMA)).collect())
    first = lambda q: [i for i in range(7) if i != q][:5]
    assert got == [(q, n + 1, v) for q in (0, 50, 100, 1000) for n, v in enumerate(first(q))]


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_rows(spark, n):
    rows = [(50 * i, [1.0, float(i)], None, None) for i in range(n)]
    assert ann.nearest(spark.createDataFrame(rows, SCHEMA)).count() == n * (n - 1)


def test_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 7)
    rows = clustered(400, seed=2)
    want = brute(rows)
    got = ann.nearest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 5 * len(want)
    assert sum(r.vec_id in dict(want[r.query_id]) for r in got) / len(got) >= 0.9


def test_best_first_reaches_every_leaf_once():
    x = ann.unit(np.random.default_rng(1).standard_normal((900, 8)))
    tree = ann.Tree()
    tree.add(x, np.random.default_rng(1))
    assert sorted(tree.visits(x[0])) == list(range(tree.leaves))
    assert len(set(tree.place(x))) == tree.leaves
