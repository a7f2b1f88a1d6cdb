import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from seriesloom.llm import minhash

SCHEMA = "doc_id long, text string, lang string, source string, size string"


def bag(text):
    words = (text or "").split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def brute(docs, least=0.8):
    """The smallest doc_id of each document's group, by all pairs."""
    parent = {d: d for d, _ in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bags = [(d, bag(t)) for d, t in docs]
    for (a, x), (b, y) in combinations(bags, 2):
        if x and y and (x & y).total() >= least * (x | y).total():
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return {d: root(d) for d, _ in docs}


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    docs, base = [], [[word() for _ in range(rng.choice((30, 120, 500)))] for _ in range(15)]
    passage = [word() for _ in range(60)]
    for words in base:
        docs += [" ".join(words)] * rng.choice((1, 1, 3))
        for share in (0.01, 0.02, 0.05, 0.2):
            docs.append(" ".join(word() if rng.random() < share else w for w in words))
        docs.append(" ".join(words[:20] + passage + words[20:40]))
    docs += ["same words here", "same words here", "one", "x y " * 300, "x y " * 330, "x y " * 900]
    star = [word() for _ in range(400)]
    for _ in range(40):  # each is like the first, and less so like the others
        docs.append(" ".join(word() if rng.random() < 0.012 else w for w in star))
    return list(enumerate(docs))


@pytest.mark.parametrize("most", [1, 30])
def test_signatures_estimate_weighted_similarity(most):
    rng = np.random.default_rng(most)
    v = minhash.mixed(np.arange(200, dtype=np.uint64))
    a = rng.integers(0, most + 1, 200)
    b = np.where(rng.random(200) < 0.8, a, rng.integers(0, most + 1, 200))
    marks = minhash.bag_minhash(np.concatenate((v[a > 0], v[b > 0])), np.concatenate((a[a > 0], b[b > 0])), np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()]), 2, 20_000)
    assert abs((marks[0] == marks[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.015


def test_groups_equal_brute_force(spark):
    docs = corpus()
    frame = spark.createDataFrame([(d, t, "en", "s", "clash") for d, t in docs], SCHEMA).repartition(3)
    rows = minhash.near_duplicates(frame).collect()
    assert {r.doc_id: r.group_id for r in rows} == brute(docs)
    assert Counter(r.group_id for r in rows if r.first) == Counter(set(brute(docs).values()))


def test_large_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(minhash, "LARGE", 3)
    docs = corpus(5)
    rows = minhash.near_duplicates(spark.createDataFrame([(d, t, "en", "s", None) for d, t in docs], SCHEMA)).collect()
    assert {r.doc_id: r.group_id for r in rows} == brute(docs)


def marks_of(spark, rows):
    """bucket_pairs' tables of rows (signature, size, prefix), all in one bucket and each a component of its own."""
    members = spark.createDataFrame([(1, i, i, len(rows)) for i in range(len(rows))], "key long, number long, root long, n long")
    marks = [(i, s.astype(np.uint16).tobytes(), n, np.array(p, np.uint32).tobytes()) for i, (s, n, p) in enumerate(rows)]
    return members, spark.createDataFrame(marks, "number long, signature binary, size long, prefix binary")


def test_large_buckets_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(minhash, "LARGE", 1)
    # 60 samples of 8 registers as keys: some 30 registers that differ (similarity 0.8) spoil them all.
    picks = np.random.default_rng(17).permuted(np.tile(np.arange(150), (60, 1)), axis=1)[:, :8]
    first, second = np.arange(150), np.arange(150)
    while len(left := picks[(first == second)[picks].all(1)]):
        second[np.bincount(left.ravel()).argmax()] += 1000
    assert (first == second).mean() >= 0.8
    rows = [(first, 100, range(21)), (second, 100, range(5, 26)), (first, 100, range(50, 71)), (first, 300, range(61))]
    assert [tuple(r) for r in minhash.bucket_pairs(*marks_of(spark, rows)).collect()] == [(0, 1)]


def test_no_group_of_a_common_token_is_large(spark, monkeypatch):
    monkeypatch.setattr(minhash, "LARGE", 1)
    monkeypatch.setattr(minhash, "BLOCK", 20)
    rows = [(np.arange(150), 100, [7, *range(100 + 20 * i, 120 + 20 * i)]) for i in range(60)]
    members, marks = marks_of(spark, rows)
    got = [tuple(r) for r in minhash.bucket_pairs(members, marks).collect()]
    assert sorted(got) == list(combinations(range(60), 2))
    held = minhash.blocked(spark.createDataFrame([(7, i, i) for i in range(600)], "token long, number long, root long"))
    groups = defaultdict(list)
    for r in held.collect():
        groups[tuple(r.low), tuple(r.high)].append(r.number)
    assert max(map(len, groups.values())) <= 2 * minhash.BLOCK + 10
    assert {p for g in groups.values() for p in combinations(sorted(g), 2)} == set(combinations(range(600), 2))


def test_one_of_each_group_stays(spark):
    docs = [*corpus(7)[:40], (900, None), (901, ""), (902, " \n"), (903, "only this one here twice"), (903, "only this one here twice")]
    frame = spark.createDataFrame([(d, t, "en", "s", None) for d, t in docs], SCHEMA)
    out = minhash.keep_one(frame)
    assert out.columns == frame.columns
    kept = [r.doc_id for r in out.collect()]
    groups = brute(dict(docs).items())
    assert len(kept) == len(set(kept)) and {900, 901, 902, 903} <= set(kept)
    assert Counter(groups[d] for d in kept) == Counter(set(groups.values()))


def test_of_repeated_rows_the_first_by_its_other_columns_stays(spark):
    from odd_columns import as_rows, with_odd_columns

    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, c) for c in "dbca"] + [(2, text + " eleven", "z"), (3, "quite another text of some more words here", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string")
    for parts in (1, 4):
        out = minhash.keep_one(docs.repartition(parts, "`a.b`")).collect()
        assert sorted((r.doc_id, r["a.b"]) for r in out) == [(1, "a"), (3, "y")]
    odd = with_odd_columns(docs.filter("doc_id = 3").drop("`a.b`"))
    assert as_rows(minhash.keep_one(odd)) == as_rows(odd)


def test_chains_join_up(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 51)], "a long, b long")
    got = defaultdict(set)
    for r in minhash.components(links).collect():
        got[r.root].add(r.number)
    assert got == {0: set(range(31)), 50: {50, 51}}


def test_empty(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = minhash.near_duplicates(spark.createDataFrame([(None, None, None, None, None), (1, "", None, None, None)], SCHEMA)).collect()
    assert sorted((r.doc_id is None, r.group_id) for r in rows) == [(False, 1), (True, None)]
