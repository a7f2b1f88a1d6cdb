import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from seriesloom.llm import alignment as A
from tokenizers import Tokenizer

PATHS = (str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN, str(public_tokenizers.path("piece_bpe_32k.model")))
FIRST = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
FIRST.encode_special_tokens = True
SECOND = sentencepiece.SentencePieceProcessor(model_file=PATHS[2])


def byte_alphabet():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    # The byte that each letter of the byte-level alphabet stands for.
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


LETTERS = byte_alphabet()


def tokens(text):
    """(id, bytes) of both tokenizers over the whole text at once; None if the text has no tokens."""
    if not text:
        return None
    raw = (" " + text).encode()
    a = [(i, bytes(LETTERS[c] for c in FIRST.id_to_token(i))) for i in FIRST.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(SECOND.id_to_piece(i)[3:5], 16)]) if SECOND.is_byte(i) else SECOND.id_to_piece(i).replace("▁", " ").encode()) for i in SECOND.encode(text)]
    return (a, b) if b"".join(x for _, x in a) == raw == b"".join(x for _, x in b) else None


def ends(tokens):
    at, out = 0, []
    for _, raw in tokens:
        out.append(at := at + len(raw))
    return out


def brute(docs):
    """All pairs of tokens of a text are compared."""
    each, counts = [], Counter()
    for doc, text in docs:
        both = tokens(text)
        if both is None:
            each.append((doc, 0, 0, [], ""))
            continue
        a, b = both
        ends_a, ends_b = ends(a), ends(b)
        links = [(x, y) for (x, _), p in zip(a, ends_a) for (y, _), q in zip(b, ends_b) if p == q] if len(a) < 3000 else [(a[ends_a.index(e)][0], b[ends_b.index(e)][0]) for e in sorted(set(ends_a) & set(ends_b))]
        cuts = sorted(set(ends_a) & set(ends_b))
        group = lambda ids, at: [",".join(str(i) for (i, _), e in zip(ids, at) if low < e <= high) for low, high in zip([0, *cuts], cuts)]
        text_of = ";".join(f"{x}|{y}" for x, y in zip(group(a, ends_a), group(b, ends_b))) if len(a) < 3000 else None
        each.append((doc, len(a), len(b), links, text_of))
        counts.update(links)
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [(doc, n_a, n_b, len(links), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), text_of and hashlib.sha256(text_of.encode()).hexdigest()) for doc, n_a, n_b, links, text_of in each]


def check(spark, docs, parts=3):
    got = A.align(spark.createDataFrame(docs, "doc_id long, text string").repartition(parts), *PATHS).collect()
    key = lambda r: (str(r[0]), *r[1:7])
    got, want = sorted(map(tuple, got), key=key), sorted(brute(docs), key=key)
    assert [g[:7] for g in got] == [w[:7] for w in want]
    assert all(w[7] is None or g[7] == w[7] for g, w in zip(got, want))


WORDS = ["alpha", "béta", "\U0001f600", "the", "of", "don't", "x" * 60, "\n", "\n\n", "", "", "\t", "\r\n", ";\r", "a;\r\n", "  ", "　", "\x1c", "\x85", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x0A>", "ﬁ", "é", "123456", "\x00", "{\r\n  }", " q", "naïve."]


@pytest.mark.parametrize("size", [1, 9, 1 << 16])
def test_pieces_by_themselves_are_as_within_the_text(monkeypatch, size):
    monkeypatch.setattr(A.Aligner, "PIECE", size)
    tool, rng = A.Aligner(*PATHS), random.Random(3)
    assert tool.cuts
    for _ in range(1500):
        text = rng.choice((" ", "", "\n")).join(rng.choice(WORDS) for _ in range(rng.choice((1, 3, 12)))) + rng.choice(("", " ", "\n"))
        both, found = tokens(text), tool.align(text)
        assert (both is None) == (found is None), text
        if both:
            ids = lambda k: [int(i) for c in found for g in c.groups.split(";") for i in g.split("|")[k].split(",")]
            assert (ids(0), ids(1)) == ([i for i, _ in both[0]], [i for i, _ in both[1]]), text


def test_both_files_of_the_first_tokenizer_agree():
    assert [raw.decode("latin1") for raw in A.aligner(*PATHS).bytes_a] == [bytes(LETTERS[c] for c in FIRST.id_to_token(i)).decode("latin1") for i in range(len(A.aligner(*PATHS).bytes_a))]


@pytest.mark.parametrize("links", [1 << 21, 40])
def test_same_as_all_pairs(spark, monkeypatch, links):
    monkeypatch.setattr(A, "BLOCK_LINKS", links)
    rng = random.Random(links)
    docs = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.choice((1, 4, 30))))) for i in range(60)]
    docs += [(100 + i, "hot text of the many") for i in range(40)] + [docs[3], docs[3], (None, "no id"), (200, None), (201, ""), (202, "▁x"), (203, " "), (204, "the  of " * 3000)]
    check(spark, docs)


def test_no_tokens_at_all_and_clashing_columns(spark):
    assert A.align(spark.createDataFrame([], "doc_id long, text string"), *PATHS).count() == 0
    check(spark, [(1, None), (2, ""), (3, "▁")])
    frame = spark.createDataFrame([(5, "one text", 1, "x")], "doc_id long, text string, times int, `a.b` string")
    assert [tuple(r) for r in A.align(frame, *PATHS).collect()] == brute([(5, "one text")])
