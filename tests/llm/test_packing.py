import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from seriesloom.llm import packing
from tokenizers import Tokenizer

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


@pytest.mark.parametrize("seed", range(20))
def test_queue_finds_the_least_cost(seed):
    rng = random.Random(seed)
    at = [0, *sorted(rng.sample(range(1, 120), 40))]
    if max(b - a for a, b in zip(at, at[1:])) > 16:
        at = sorted({*at, *range(0, 120, 8)})
    cost = [rng.choice((0, 2, 9)) for _ in at]
    best = [0.0]
    for j in range(1, len(at)):
        best.append(min(best[i] + 16 - (at[j] - at[i]) + cost[j] for i in range(j) if at[j] - at[i] <= 16))
    cuts = packing.best_cuts(at, cost, 16)
    edges = [0, *cuts]
    assert all(at[b] - at[a] <= 16 for a, b in zip(edges, edges[1:]))
    assert sum(16 - (at[b] - at[a]) + cost[b] for a, b in zip(edges, edges[1:])) == best[-1]


def check(docs, pieces, size):
    tok = Tokenizer.from_file(PATH)
    want = defaultdict(list)
    for d, t in docs:
        want[d].append([*tok.encode(t or "", add_special_tokens=False).ids, 2])
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    for d, (ids,) in want.items():
        at = 0
        for p in sorted(by_doc[d], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    padding = total = 0
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
        total += at
    return padding / total


def test_every_id_lies_in_one_piece(spark):
    rng = random.Random(1)
    word = lambda: rng.choice(["alpha", "beta.", "gamma", "délta", "x" * 200, "\x1c!", " two", "<|endoftext|>", "<|ENDOFTEXT|>", "don't", "Éclair,", "naïve.", "e\u0301te\u0301.", "ÿ", "it's,", "a.,b.", "Ærø", "ß.", "Σας"])
    docs = [(i, " ".join(word() for _ in range(rng.choice((0, 3, 40, 900, 9000))))) for i in range(60)] + [(100, None), (101, ""), (102, "no stop " * 9000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    assert check(docs, packing.pack(frame, PATH).collect(), 4096) < 0.01


def test_blocks_and_small_sequences():
    ends = np.zeros(60_000, bool)
    ends[7] = True
    packer = packing.Packer(ends, 0, size=64, block=256)
    docs = [np.array([random.Random(i).choice((1, 2, 3, 7)) for _ in range(n)], "<u4") for i, n in enumerate((5, 1000, 64, 1, 300, 2000))]
    rows = [r for i, d in enumerate(docs) for r in packer.add(i, d)] + list(packer.close())
    got = defaultdict(int)
    for doc, start, length, crc, total, seq, offset in rows:
        assert start == got[doc] and crc == zlib.crc32(docs[doc][start : start + length].tobytes())
        got[doc] += length
    assert [got[i] for i in range(6)] == [len(d) for d in docs]


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
    twice = packing.pack(spark.createDataFrame([(None, None)] * 2, "doc_id long, text string").coalesce(1), PATH).collect()
    assert [(p.doc_id, p.length, p.doc_tokens) for p in twice] == [(None, 1, 1)] * 2


def test_latin_words_with_marks_need_no_splitter():
    """Their ids are those of the whole tokenizer, which is not asked for the word."""
    tok, words = Tokenizer.from_file(PATH), packing.WordIds(PATH)
    asked = []

    class Spy:
        def encode(self, text, **kwargs):
            asked.append(text)
            return tok.encode(text, **kwargs)

    words.tokenizer = Spy()
    for word in ("Éourément", "ß", "straße***", "réré,", "ÀÐÞ!?", "plain", "stone&&&", "ÿ.", "don't", "x1", "a×b", "**a", "<|endoftext|>", "<|", "\u212a", "\u0130i"):
        assert np.frombuffer(words[word.encode()], "<u4").tolist() == tok.encode(word, add_special_tokens=False).ids
    assert set(asked) == {"***", ",", "!?", "&&&", ".", "don't", "x1", "a×b", "**a", "<|endoftext|>", "<|", "\u212a", "\u0130i"}


def test_cache_is_bounded_and_keeps_frequent_words(monkeypatch):
    """What a worker keeps of words stays small, a word in use is not tokenised again, and ids are the tokenizer's."""
    from seriesloom.llm.packing import WordIds
    from seriesloom.llm.queries import tokenizer

    assert WordIds.LIMIT <= 150_000  # a worker's tables stay for the next stages
    monkeypatch.setattr(WordIds, "LIMIT", 8)
    words = WordIds(tokenizer("word_bpe_49k.json"))
    for k in range(100):
        text = f"often w{k} Été, x{k}y"
        assert words.encode(text).tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids
        assert len(words) <= 8 and len(words.old) <= 8 and (b"often" in words or b"often" in words.old)
