import random

import public_tokenizers
import pytest
from seriesloom.llm import pieces

PATH = str(public_tokenizers.path("piece_bpe_32k.model"))


def least(model, text):
    """Cost of the cheapest path, by the whole table."""
    best = [0.0]
    for end in range(1, len(text) + 1):
        ways = []
        for begin in range(max(0, end - model.longest), end):
            p = text[begin:end]
            if p in model.cost and pieces.BLANK not in p:
                ways.append(best[begin] + model.cost[p][0])
            elif end - begin == 1:
                ways.append(best[begin] + model.byte_cost * len(p.encode()))
        best.append(min(ways))
    return best[-1]


@pytest.mark.parametrize("text", ["", " ", "a  b ", "été 😀 ▁x\n\n", "word " * 50, "x" * 500, "".join(random.Random(1).choice("abc de\n") for _ in range(700))])
def test_streaming_is_cheapest_and_lossless(text):
    model = pieces.pieces(PATH)
    ids = model.encode(text)
    assert model.decode(ids) == text
    cost = sum(model.byte_cost if i in model.byte_of else model.cost[model.text[i].replace("▁", " ")][0] for i in ids.tolist())
    assert abs(cost - least(model, text)) < 1e-6


def test_whole_table(spark):
    rows = spark.createDataFrame([(1, "a b", "x"), (2, None, None), (None, "", None), (1, "a b", "x")], "doc_id long, text string, n_ids string")
    assert all(r.same for r in pieces.round_trip(rows, PATH).collect()) and pieces.round_trip(rows.limit(0), PATH).count() == 0


def test_long_text_is_given_out_in_windows(monkeypatch):
    """A million characters without a blank: no stretch of back-pointers is ever long, and the text comes back."""
    model, longest = pieces.Pieces(PATH), []
    path = model.path
    monkeypatch.setattr(model, "path", lambda text, back, begin, end: longest.append(len(back)) or path(text, back, begin, end))
    rng = random.Random(2)
    for text in ("".join(rng.choice("abcdefghij.") for _ in range(1_000_000)), "-" * 100_000):
        longest.clear()
        ids = list(model.viterbi(text))
        assert b"".join(model.spelled[i] for i in ids).decode() == text
        assert max(longest) <= 8 * model.longest or len(set(text)) == 1
