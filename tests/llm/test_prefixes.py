import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from seriesloom.llm import prefixes as P

SCHEMA = "conv_id long, turn long, role string, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """All prefixes of all rebuilt conversations in one dictionary."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(turns)] for c, turns in convs.items()}
    whole = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 * (1 if c > 0 else -1))
        whole[c] = tuple(convs.get(base, [])[:h] + turns[h:])
    members, children = defaultdict(list), defaultdict(set)
    for c, turns in sorted(whole.items()):
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
            if d:
                children[turns[: d - 1]].add(turns[:d])
    out = {}
    for v in sorted(members, key=len, reverse=True):
        saved = (len(members[v]) - 1) * (len(WORD.findall(v[-1][1])) if v else 0) + sum(out[c][6] for c in children[v])
        leaves = sum(out[c][5] for c in children[v]) or 1
        ends = ",".join(str(c) for c in members[v] if len(whole[c]) == len(v))
        out[v] = (members[v][0], len(v), members[v[:-1]][0] if v else None, len(members[v]), len(children[v]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=str)


def check(spark, rows, parts=3, bits=None):
    got = P.trie(spark.createDataFrame(rows, SCHEMA).repartition(parts), bits).collect()
    want = brute(rows)
    got = sorted(map(tuple, got), key=str)
    assert got == want, next((g, w) for g, w in zip(got, want) if g != w)


def conversations(seed, n, most=6, kinds=3):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-45, n * 2), n):
        for t in range(rng.choice((1, 2, 3, most))):
            rows.append((c, t, rng.choice(("user", "assistant")) if kinds > 3 else "user", " ".join(rng.choice("abc") for _ in range(rng.randrange(kinds)))))
    return rows


def test_digests_of_parts_join():
    turns = [P.turn_digest(b"user", bytes([i])) for i in range(9)]
    value = P.ROOT
    for t in turns:
        value = P.joined(P.number(value), 1, t)
    head, tail = P.ROOT, P.ROOT
    for t in turns[:4]:
        head = P.joined(P.number(head), 1, t)
    for t in turns[4:]:
        tail = P.joined(P.number(tail), 1, t)
    assert P.joined(P.number(head), 5, P.number(tail)) == value
    assert P.turn_digest(b"a", b"bc") != P.turn_digest(b"ab", b"c")


@pytest.mark.parametrize(("seed", "n", "kinds", "bits"), [(1, 5, 3, None), (2, 80, 3, None), (3, 80, 6, 10), (4, 60, 2, 4), (5, 150, 30, None)])
def test_same_as_brute_force(spark, seed, n, kinds, bits):
    check(spark, conversations(seed, n, kinds=kinds), bits=bits)


def test_nulls_ties_repeats_and_ids_without_turns(spark):
    rows = [(None, 1, "user", "x"), (20, None, None, None), (20, None, "user", "b"), (20, None, "user", "a"), (20, 3, "user", "a"), (20, 3, "user", "a"), (21, 0, "user", ""), (39, 1, None, "a  b\n c d"), (41, 0, "u", "x"), (59, 0, "u", "x"), (42, 5, "u", "y z"), (-3, 1, "u", "x")]
    check(spark, rows)
    check(spark, [(c, 0, "u", "x") for c in range(20, 60)])  # many end at the same node, some have no turn left


def test_a_conversation_with_a_third_of_all_rows_and_a_common_one(spark, monkeypatch):
    monkeypatch.setattr(P, "JOINED_IDS", 7)
    rng = random.Random(9)
    long_ = [(t, "user", f"w{rng.randrange(50)} a b") for t in range(700)]
    rows = [(100, *t) for t in long_] + [(101, *t) for t in long_[:650]] + [(200 + i, t, "user", f"same {t}") for i in range(300) for t in range(3)] + [(1000 + i, 0, "user", f"own {i}") for i in range(50)]
    check(spark, rows, 5)


def test_empty_and_clashing_columns(spark):
    assert P.trie(spark.createDataFrame([], SCHEMA)).count() == 0
    frame = spark.createDataFrame([(7, 1, "u", "a b", 1, "x")], SCHEMA + ", depth int, `node.x y` string")
    assert sorted(map(tuple, P.trie(frame).collect()), key=str) == brute([(7, 1, "u", "a b")])
    check(spark, [(None, 1, "u", "x")])
