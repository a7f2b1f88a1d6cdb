import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from seriesloom.llm import lm

PATH, PATTERN = str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, lang string, score string"


def corpus():
    rng = np.random.default_rng(0)
    words = ["the", "House", "river", "réading", "Stone,", "quiet", "of", "and", "to", "walking."]
    texts = [" ".join(rng.choice(words, rng.integers(1, 200))) for _ in range(80)]
    return list(enumerate([*texts, "", None, "one\x0btwo three ZEBRA", "x" * 5000, "a " * 5000])) + [(None, "the the")]


def test_gradients_equal_differences():
    rng = np.random.default_rng(1)
    m = lm.fresh(classes=5)
    inputs = rng.integers(0, lm.SYMBOLS + 1, (3, lm.CONTEXT + lm.STRIDE))
    m.out[:] = rng.standard_normal(m.out.shape) * 0.2
    begins, prior = rng.integers(0, 2, (3, lm.STRIDE)), rng.standard_normal((3, lm.STRIDE, 5)).astype(np.float32)
    targets, valid = rng.integers(0, 5, (3, lm.STRIDE)), rng.random((3, lm.STRIDE)) < 0.8
    args = inputs, begins, prior, targets, valid
    _, grads = lm.gradients(m, *args)
    for w, g in zip(m.weights(), grads, strict=True):
        i = np.abs(g).argmax()
        old = w.flat[i]
        w.flat[i] = old + 1e-2
        above, _ = lm.gradients(m, *args)
        w.flat[i] = old - 1e-2
        below, _ = lm.gradients(m, *args)
        w.flat[i] = old
        assert abs((above - below) / 2e-2 - g.flat[i]) < 2e-3


def test_base_scores_equal_brute_force(spark):
    docs = corpus()
    got = {r.doc_id: r for r in lm.score_documents(spark.createDataFrame([(i, t, "en", "clash") for i, t in docs], SCHEMA).repartition(3), PATH, PATTERN).collect()}
    assert len(got) == len(docs)
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in docs}
    tokens = {i: [*(t or "").encode().lower().split(), "end"] for i, t in docs}
    c = Counter(t for i, ts in tokens.items() if not held[i] for t in ts)
    n, v = c.total(), len(c)
    for i, ts in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ts), sum(c[t] > 0 for t in ts), n)
        assert math.isclose(r.base_score, sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts), rel_tol=1e-9)
        assert r.score < 0


def test_rare_words_meet_by_the_join(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t, "en", None) for i, t in corpus()], SCHEMA)
    all_top = {r.doc_id: r.base_score for r in lm.score_documents(docs, PATH, PATTERN).collect()}
    monkeypatch.setattr(lm, "TOP_WORDS", 2)
    few_top = {r.doc_id: r.base_score for r in lm.score_documents(docs, PATH, PATTERN).collect()}
    assert all(math.isclose(all_top[i], few_top[i], rel_tol=1e-9) for i in all_top)


def model():
    rng = np.random.default_rng(3)
    symbol = np.minimum(rng.permutation(lm.VOCABULARY), lm.OTHER)
    counts, pairs = rng.integers(0, 50, lm.VOCABULARY).astype(float), rng.integers(0, 9, (lm.SYMBOLS + 1, lm.SYMBOLS)).astype(float)
    base = np.bincount(symbol, counts, lm.SYMBOLS) + 0.1
    out = lm.combined(symbol, pairs, base / base.sum(), counts)
    out.attention.out[:] = rng.standard_normal(out.attention.out.shape)
    return out


def test_probabilities_of_all_ids_add_up():
    m = model()
    ids = np.random.default_rng(4).integers(0, lm.VOCABULARY, 70)
    begins = np.arange(70) % 3 == 0
    total = 0.0
    for part in np.array_split(np.arange(lm.VOCABULARY), 200):  # each id in turn at position 50
        texts = np.tile(ids[:51], (len(part), 1))
        texts[:, 50] = part
        logs = m.logs(texts.ravel(), np.tile(begins[:51], len(part)), np.full(len(part), 51))
        total += (10.0 ** logs.reshape(len(part), 51)[:, 50]).sum()
    assert abs(total - 1) < 1e-4


def test_attention_beats_the_counts_alone():
    rng = np.random.default_rng(6)
    texts = [[bytes(w, "ascii") for w in rng.choice(["alpha", "beta", "gamma"] if i % 2 else ["uno", "dos", "tres"], 60)] for i in range(60)]
    pieces = lm.word_pieces(PATH, PATTERN)
    symbol = np.full(lm.VOCABULARY, lm.OTHER)
    used = np.unique(np.frombuffer(b"".join(pieces[w] for t in texts for w in t), "<i4"))
    symbol[[*used, lm.END]] = np.arange(len(used) + 1)
    single, pairs = np.zeros(lm.VOCABULARY), np.zeros((lm.SYMBOLS + 1, lm.SYMBOLS))
    m = lm.combined(symbol, pairs, np.full(lm.SYMBOLS, 1 / lm.SYMBOLS), single)
    ids, begins, sizes = m.encode(pieces, texts)
    np.add.at(pairs, (m.before(ids, begins), symbol[ids]), 1)
    m = lm.combined(symbol, pairs, np.full(lm.SYMBOLS, 1 / lm.SYMBOLS), single)
    alone = m.logs(ids, begins, sizes).sum()
    m.attention = lm.train(m.attention, m.examples(*m.encode(pieces, texts[:40])), 8, 0.01)
    held = m.encode(pieces, texts[40:])
    m.attention, trained = lm.fresh(), m.attention
    before = m.logs(*held).sum()
    m.attention = trained
    assert alone < 0 and m.logs(*held).sum() > before * 0.8


def test_words_have_the_ids_of_their_text():
    pieces = lm.word_pieces(PATH, PATTERN)
    for word in ("stone,", "it's.", "a.,", "x.", "été.", "ñ,", "42.", "don't", "b,,"):
        assert np.frombuffer(pieces[word.encode()], "<i4").tolist() == pieces.encoding.encode_ordinary(" " + word)


def test_scoring_equals_the_training_pass():
    m, rng = model(), np.random.default_rng(8)
    n, width = 5, lm.CONTEXT + lm.STRIDE
    inputs, before, targets = rng.integers(0, lm.SYMBOLS + 1, (n, width)), rng.integers(0, lm.SYMBOLS + 1, (n, lm.STRIDE)), rng.integers(0, lm.CLASSES, (n, lm.STRIDE))
    p = lm.forward(m.attention, inputs, (before == lm.START).astype(int), m.prior[before])[-1]
    i, j = np.indices(targets.shape)
    assert np.allclose(lm.class_logs(m.attention, inputs, before, m.prior, targets), np.log10(p[i, j, targets]), atol=1e-4)


def test_no_position_sees_what_follows():
    m = model()
    rng = np.random.default_rng(5)
    ids = rng.integers(0, lm.VOCABULARY, 150)
    other = ids.copy()
    other[100:] = rng.integers(0, lm.VOCABULARY, 50)
    begins, size = np.zeros(150, bool), np.array([150])
    assert np.allclose(m.logs(ids, begins, size)[:100], m.logs(other, begins, size)[:100])
    both = m.logs(np.concatenate((ids, other)), np.zeros(300, bool), np.array([150, 150]))
    assert np.allclose(both[1:150], m.logs(ids, begins, size)[1:]) and np.allclose(both[151:], m.logs(other, begins, size)[1:])


def test_empty_table(spark):
    assert lm.score_documents(spark.createDataFrame([], SCHEMA), PATH, PATTERN).count() == 0


def test_all_training_documents_train_the_attention(spark, monkeypatch):
    reached, averaged = [], lm.averaged

    def spy(docs, *rest):
        reached.extend(r.text for r in docs.select("text").collect())
        return averaged(docs, *rest)

    monkeypatch.setattr(lm, "averaged", spy)
    docs = [(d, t) for d, t in corpus() if zlib.crc32(str("" if d is None else d).encode()) % 10]
    lm.score_documents(spark.createDataFrame([(d, t, "en", None) for d, t in corpus()], SCHEMA), PATH, PATTERN).collect()
    assert Counter(reached) == Counter(t for _, t in docs)


def test_scores_do_not_depend_on_the_layout(spark, monkeypatch):
    """Several shards, over other files and partitions in another order: the same scores."""
    monkeypatch.setattr(lm, "SHARD", 20)
    docs = spark.createDataFrame([(i, t, "en", None) for i, t in corpus()], SCHEMA)
    of = lambda frame: {r.doc_id: r.score for r in lm.score_documents(frame, PATH, PATTERN).collect()}
    one, other = of(docs.coalesce(1)), of(docs.repartition(7, "lang", "text"))
    assert one.keys() == other.keys() and all(math.isclose(one[i], other[i], rel_tol=1e-6) for i in one)


def test_long_texts_are_scored_whole(spark):
    long = "the quiet river " * 40_000
    docs = spark.createDataFrame([(1, long, "en", None), (2, "the quiet river", "en", None), (10, long + "zebra", "en", None)], SCHEMA)
    got = {r.doc_id: r for r in lm.score_documents(docs, PATH, PATTERN).collect()}
    assert (got[1].n_tokens, got[10].n_tokens) == (120_001, 120_002) and got[10].score < got[1].score < got[2].score


def test_gradients_over_training_windows_equal_differences():
    """All positions of a window are scored: the first ones see less than the last."""
    rng, width = np.random.default_rng(2), lm.CONTEXT + lm.STRIDE
    m = lm.fresh(classes=5)
    inputs = rng.integers(0, lm.SYMBOLS + 1, (3, width))
    m.out[:] = rng.standard_normal(m.out.shape) * 0.2
    begins, prior = rng.integers(0, 2, (3, width)), rng.standard_normal((3, width, 5)).astype(np.float32)
    args = inputs, begins, prior, rng.integers(0, 5, (3, width)), rng.random((3, width)) < 0.8
    _, grads = lm.gradients(m, *args)
    for w, g in zip(m.weights(), grads, strict=True):
        i = np.abs(g).argmax()
        old = w.flat[i]
        w.flat[i] = old + 1e-2
        above, _ = lm.gradients(m, *args)
        w.flat[i] = old - 1e-2
        below, _ = lm.gradients(m, *args)
        w.flat[i] = old
        assert abs((above - below) / 2e-2 - g.flat[i]) < 2e-3


def test_new_words_go_to_the_encoder_in_one_call(monkeypatch):
    """A call for each word took most of the time of words that are seen once."""
    pieces, calls = lm.WordPieces(PATH, PATTERN), []

    class Counted:
        def __init__(self, encoding):
            self.encoding = encoding

        def encode_ordinary(self, text):
            calls.append(text)
            return self.encoding.encode_ordinary(text)

    texts = [[b"word%d," % (i * j) for j in range(100)] for i in range(20)]
    m, plain = model(), pieces.encoding
    monkeypatch.setattr(pieces, "encoding", Counted(plain))
    ids, begins, sizes = m.encode(pieces, texts)
    assert len(calls) == 1
    each = [[plain.encode_ordinary(" " + w.decode()) for w in t] for t in texts]
    assert ids.tolist() == [i for t in each for i in [*(x for w in t for x in w), lm.END]]
    assert begins.tolist() == [b for t in each for b in [*(not k for w in t for k in range(len(w))), True]]
    assert sizes.tolist() == [sum(map(len, t)) + 1 for t in each]
    m.encode(pieces, texts)
    assert len(calls) == 1


def test_words_with_other_white_space_keep_their_ids():
    pieces = lm.WordPieces(PATH, PATTERN)
    words = [w.encode() for w in ("stone", "a\xa0b", "\xa0", "\u2003x", "y\u3000", "\xe9t\xe9", "it's", "z\x1c", "\xa0\xa0", "'s", "\u0301", "end")]
    ids, sizes = pieces.all_of(words)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [pieces.encoding.encode_ordinary(" " + w.decode()) for w in words]
    assert [len(x) for x in pieces.all_of([])] == [0, 0]


def test_words_may_be_forgotten_at_any_time(monkeypatch):
    texts, m = [lm.words_of(t) for _, t in corpus()], model()
    whole = m.encode(lm.WordPieces(PATH, PATTERN), texts)
    monkeypatch.setattr(lm.Words, "LIMIT", 3)
    pieces = lm.WordPieces(PATH, PATTERN)
    parts = [m.encode(pieces, texts[a : a + 7]) for a in range(0, len(texts), 7)]
    assert all(np.array_equal(x, np.concatenate(y)) for x, y in zip(whole, zip(*parts, strict=True), strict=True))


def test_sums_of_tables_equal_products():
    """Attention and prior that scoring reads from tables are those of the training pass, at places, beginnings and capped scores."""
    m, rng = model(), np.random.default_rng(9)
    m.attention.begin[:] = rng.standard_normal(m.attention.begin.shape)
    m.attention.bias[:] = rng.standard_normal(m.attention.bias.shape)
    m.attention.query *= 30
    tables = lm.Tables.of(m.attention, m.prior)
    inputs, before, targets = rng.integers(0, lm.SYMBOLS + 1, (4, lm.CONTEXT + lm.STRIDE)), rng.integers(lm.START - 1, lm.START + 1, (4, lm.STRIDE)), rng.integers(0, lm.CLASSES, (4, lm.STRIDE))
    p = lm.forward(m.attention, inputs, (before == lm.START).astype(int), m.prior[before])[-1]
    i, j = np.indices(targets.shape)
    assert np.allclose(lm.class_logs(m.attention, inputs, before, m.prior, targets, tables), np.log10(p[i, j, targets]), atol=1e-3)
