"""Language-model scores: causal self-attention over subword ids, with corpus-wide subword statistics beside it.

Every text is scored whole, in overlapping windows that score each token once. What is counted (words, subwords, pairs of
subwords) covers all training documents; the attention weights are trained on all of them, in shards, and averaged.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, small_batches, written

#: So many of the most frequent words are looked up in each task (at most LONG bytes each); the others meet by a join.
TOP_WORDS, LONG = 100_000, 64
#: Symbols: the most frequent subwords, one for all others, and one that stands before a text.
SYMBOLS, CLASSES = 512, 64
OTHER, START = SYMBOLS - 1, SYMBOLS
#: Symbols that are classes of their own.
ALONE = 32
#: Context of a window, and positions that it scores.
CONTEXT, STRIDE = 32, 32
WIDTH = 16
#: A bounded sample starts the attention weights, which all training documents then train.
FIRST_DOCUMENTS, FIRST_CHARS = 600, 3000
#: Documents of a shard that trains by itself, and of one call of the training.
SHARD, TOGETHER = 1_024, 64
VOCABULARY, END = 50_257, 50_256
ADD = 0.1


class WordPieces(dict):
    """Subword ids of a word and the blank before it, as bytes of 32-bit numbers; words: the same for whole texts."""

    def __init__(self, path: str, pattern: str) -> None:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        # Words hold no blank and are looked up with one before them: so their first ids, and no others, begin with one.
        self.begins = np.zeros(VOCABULARY, bool)
        self.begins[[i for piece, i in ranks.items() if piece[:1] == b" "] + [END]] = True
        self.encoding = tiktoken.Encoding("subwords", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.words = Words(self)

    def __missing__(self, word: bytes) -> bytes:
        return self.all_of([word])[0].tobytes()

    def all_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in their order, and the number of ids of each.

        Words go to the encoder in one text, which its pattern splits before each blank; those that hold other white space go alone.
        """
        texts, ids, begin = [w.decode() for w in words], [], 0
        for at in [*(i for i, t in enumerate(texts) if t.split() != [t]), len(texts)]:
            for part in (texts[begin:at], texts[at : at + 1]):
                if part:
                    ids += self.encoding.encode_ordinary(" " + " ".join(part))
            begin = at + 1
        ids = np.array(ids, "<i4")
        return ids, np.diff(np.append(np.flatnonzero(self.begins[ids]), len(ids)))


def put(array: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """The array with more behind its used part; twice as long if it is full."""
    if used + len(more) > len(array):
        array = np.concatenate((array, np.empty(max(len(array), len(more)), array.dtype)))
    array[used : used + len(more)] = more
    return array


class Words(dict):
    """Numbers of words by first sight, and by number their subword ids and value (NaN: none); the empty word is a text's end.

    All is forgotten when it is too much.
    """

    LIMIT, IDS = 400_000, 4_000_000

    def __init__(self, pieces: WordPieces) -> None:
        self.pieces = pieces
        self.forget(None)

    def forget(self, values: dict[bytes, float] | None) -> None:
        self.clear()
        self[b""], self.names, self.values, self.used = 0, [b""], values, 1
        self.ids, self.start, self.size = np.array([END], "<i4"), np.zeros(1, int), np.ones(1, int)
        self.value = np.array([(values or {}).get(b"", np.nan)])

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.names)
        self.names.append(word)
        return number

    def look(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words and the end of each text, one text after the other, and how many each has."""
        if len(self) > self.LIMIT or self.used > self.IDS:
            self.forget(self.values)
        had = len(self.names)
        counts = np.array([len(words) + 1 for words in texts])
        at = np.fromiter(map(self.__getitem__, chain.from_iterable((*words, b"") for words in texts)), int, counts.sum())
        if new := self.names[had:]:
            ids, size = self.pieces.all_of(new)
            self.start = put(self.start, had, self.used + np.cumsum(size) - size)
            self.size, self.ids = put(self.size, had, size), put(self.ids, self.used, ids)
            self.used += len(ids)
            if self.values is not None:
                self.value = put(self.value, had, np.array([self.values.get(w, np.nan) for w in new]))
        return at, counts

    def encoded(self, at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of what look() gave: ids of all texts; which of them begin a word; number of ids of each text."""
        size = self.size[at]
        last = np.cumsum(size)
        ids = self.ids[np.arange(last[-1]) + np.repeat(self.start[at] - last + size, size)]
        return ids, self.pieces.begins[ids], np.add.reduceat(size, np.cumsum(counts) - counts)


def keep_memory() -> None:
    """Has a worker keep the memory of freed arrays: the C library does so up to the largest block that was freed, at most 32 MB.

    Otherwise it gives arrays back, and the kernel clears the pages of each anew.
    """
    np.empty((32 << 20) - (64 << 10), np.uint8)


@functools.cache
def word_pieces(path: str, pattern: str) -> WordPieces:
    return WordPieces(path, pattern)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space."""
    return (text or "").encode().lower().split()


@dataclass
class Attention:
    """One head: embeddings of symbols, places and word beginnings, projections, and the output layer over classes."""

    symbol: np.ndarray
    place: np.ndarray
    begin: np.ndarray
    query: np.ndarray
    key: np.ndarray
    value: np.ndarray
    skip: np.ndarray
    mix: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def weights(self) -> list[np.ndarray]:
        return [self.symbol, self.place, self.begin, self.query, self.key, self.value, self.skip, self.mix, self.out, self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.weights()])

    def over(self, flat: np.ndarray) -> Attention:
        """Weights that are views of flat."""
        ends = np.cumsum([w.size for w in self.weights()])
        return Attention(*(x.reshape(w.shape) for x, w in zip(np.split(flat, ends[:-1]), self.weights(), strict=True)))

    def filled(self, flat: np.ndarray) -> Attention:
        return self.over(flat.astype(np.float32))


def fresh(classes: int = CLASSES, seed: int = 5) -> Attention:
    rng = np.random.default_rng(seed)
    f = lambda *s, by: (rng.standard_normal(s) * by).astype(np.float32)
    d = WIDTH
    return Attention(f(SYMBOLS + 1, d, by=0.5), f(CONTEXT + STRIDE, d, by=0.1), f(2, d, by=0.1), *(f(d, d, by=d**-0.5) for _ in range(5)), np.zeros((d, classes), np.float32), np.zeros(classes, np.float32))


#: What each place of a window may see; windows for scoring score the last STRIDE places, those for training all.
CAUSAL = np.where(np.tri(CONTEXT + STRIDE, dtype=bool), 0, -1e9).astype(np.float32)
#: The same as a cap of scores, beyond which exp() would no longer be finite.
CAP = np.where(CAUSAL < 0, CAUSAL, 60).astype(np.float32)
SCALE = np.float32(WIDTH**-0.5)


def tanh(x: np.ndarray) -> np.ndarray:
    """In place, by exp(), which numpy computes faster than tanh()."""
    x += x
    np.exp(np.minimum(x, 80, out=x), out=x)
    x += 1
    np.divide(-2, x, out=x)
    x += 1
    return x


def attend(m: Attention, inputs: np.ndarray, begins: np.ndarray) -> tuple:
    """What forward() and gradients() share, up to the hidden layer, t. Shares of attention stay undivided: a's rows add up to 1 / share.

    Arrays that meet the same factor lie side by side, and a column of ones stands where a sum or a bias is wanted, so that wide
    arrays are passed over as seldom as can be. a has an array for each STRIDE positions, over what the last of them may see.
    """
    n, d, size = len(inputs), WIDTH, begins.shape[1]
    first = inputs.shape[1] - size
    e = np.take(m.symbol, inputs, axis=0)
    e += m.place
    eq = e[:, first:] + np.take(m.begin, begins, axis=0)
    qs = (eq.reshape(-1, d) @ np.hstack((m.query * SCALE, m.skip))).reshape(n, -1, 2 * d)
    kv = np.ones((n, inputs.shape[1], 2 * d + 1), np.float32)
    np.matmul(e.reshape(-1, d), np.hstack((m.key, m.value)), out=kv.reshape(-1, 2 * d + 1)[:, : 2 * d])
    a, o = {}, np.empty((n, size, d + 1), np.float32)
    for at in range(0, size, STRIDE):
        seen = first + at + STRIDE
        x = a[at] = qs[:, at : at + STRIDE, :d] @ kv[:, :seen, :d].transpose(0, 2, 1)
        np.minimum(x, CAP[first + at : seen, :seen], out=x)
        np.exp(x, out=x)
        np.matmul(x, kv[:, :seen, d:], out=o[:, at : at + STRIDE])
    share = 1 / (o[:, :, d:] + np.float32(1e-30))
    o = o[:, :, :d] * share
    hidden = o.reshape(-1, d) @ m.mix
    hidden += qs.reshape(-1, 2 * d)[:, d:]
    t = np.ones((len(hidden), d + 1), np.float32)
    t[:, :d] = tanh(hidden)
    return e, qs, kv, a, o, share, t


def odds(m: Attention, t: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """exp() of the classes' logits, for each row of t (with its column of ones) and of prior."""
    if np.abs(m.out).sum(0).max() > 40:
        p = t[:, :-1] @ m.out
        np.clip(p, -40, 40, out=p)
        p += m.bias
    else:
        p = t @ np.vstack((m.out, m.bias))
    p += prior.reshape(p.shape)
    return np.exp(p, out=p)


def forward(m: Attention, inputs: np.ndarray, begins: np.ndarray, prior: np.ndarray) -> tuple:
    """inputs: (windows, CONTEXT + STRIDE) of the symbols before each position; of the scored (last) positions, begins: 1 where a word
    begins, and prior: logarithms of the classes' probabilities by the pair statistics. The last item: class probabilities.

    What attention gives is added to the prior's logarithms, so untrained weights leave the pair statistics as they are.
    """
    *held, t = attend(m, inputs, begins)
    p = odds(m, t, prior)
    p *= 1 / p.sum(-1, keepdims=True)
    return *held, t, p.reshape(len(inputs), -1, p.shape[-1])


@dataclass
class Tables:
    """For scoring, what symbols and places give by themselves: rows to add up in place of products at each position."""

    kv: np.ndarray
    place_kv: np.ndarray
    qs: np.ndarray
    place_qs: np.ndarray
    prior: np.ndarray

    @classmethod
    def of(cls, m: Attention, prior: np.ndarray) -> Tables:
        """kv: keys, values, and a one that sums up what each position gives out. qs, at 2 * symbol + begin: queries and skips."""
        one = np.zeros((WIDTH, 1), np.float32)
        kv, qs = np.hstack((m.key, m.value, one)), np.hstack((m.query * SCALE, m.skip))
        symbols = (m.symbol[:, None] + m.begin).reshape(-1, WIDTH)
        return cls(m.symbol @ kv + np.eye(2 * WIDTH + 1, dtype=np.float32)[-1], m.place @ kv, symbols @ qs, m.place[CONTEXT:] @ qs, prior + m.bias)


def class_logs(m: Attention, inputs: np.ndarray, before: np.ndarray, prior: np.ndarray, targets: np.ndarray, tables: Tables | None = None) -> np.ndarray:
    """log10 of the targets' probabilities: forward() for scoring, by sums of rows of tables and without what only training needs.

    before: the symbol before each scored position in its word; prior: the whole table of classes after each symbol.
    Scores are capped where exp() would no longer be finite.
    """
    n, d = len(inputs), WIDTH
    if tables is None:
        tables = Tables.of(m, prior)
    kv = np.take(tables.kv, inputs, axis=0)
    kv += tables.place_kv
    qs = np.take(tables.qs, 2 * inputs[:, CONTEXT:] + (before == START), axis=0)
    qs += tables.place_qs
    a = qs[:, :, :d] @ kv[:, :, :d].transpose(0, 2, 1)
    np.minimum(a, CAP[CONTEXT:], out=a)
    np.exp(a, out=a)
    o = (a @ kv[:, :, d:]).reshape(-1, d + 1)
    t = (o[:, :d] * (1 / o[:, d:])) @ m.mix
    t += qs.reshape(-1, 2 * d)[:, d:]
    x = tanh(t) @ m.out
    if np.abs(m.out).sum(0).max() > 40:
        np.clip(x, -40, 40, out=x)
    x += np.take(tables.prior, before.ravel(), axis=0)
    hit = x[np.arange(len(x)), targets.ravel()].astype(float)
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[-1], np.float32)
    return ((hit - np.log(total)) / np.log(10)).reshape(n, STRIDE)


def gradients(m: Attention, inputs: np.ndarray, begins: np.ndarray, prior: np.ndarray, targets: np.ndarray, valid: np.ndarray, with_loss: bool = True) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy of the scored positions that are valid (0 if it is not asked for), and its gradients."""
    e, qs, kv, a, o, share, t = attend(m, inputs, begins)
    p, d = odds(m, t, prior), WIDTH
    n = max(1, int(valid.sum()))
    two = lambda x: x.reshape(-1, x.shape[-1])
    total = p @ np.ones(p.shape[-1], np.float32)
    at, weight = (np.arange(targets.size), targets.ravel()), valid.ravel() / np.float32(n)
    loss = float((np.log(total / p[at] + 1e-30) * weight).sum()) if with_loss else 0.0
    p[at] -= total
    weight = (weight / total)[:, None]
    g_out = np.ascontiguousarray((t * weight).T) @ p
    t = t[:, :d]
    dz = p @ m.out.T
    dz *= weight * (1 - t * t)
    do = np.empty((*o.shape[:2], d + 1), np.float32)
    np.multiply((dz @ m.mix.T).reshape(o.shape), share, out=do[:, :, :d])
    np.negative(np.einsum("nsd,nsd->ns", do[:, :, :d], o), out=do[:, :, d])
    # Of keys, values, queries and skips, side by side.
    first = inputs.shape[1] - begins.shape[1]
    g = np.empty((*inputs.shape, 4 * d), np.float32)
    g[:, :first, 2 * d :] = 0
    g[:, first:, 3 * d :] = dz.reshape(o.shape)
    for at in sorted(a, reverse=True):  # the last may see all
        x, here = a[at], slice(at, at + STRIDE)
        seen = x.shape[2]
        ds = do[:, here] @ kv[:, :seen, d:].transpose(0, 2, 1)
        ds *= x
        np.matmul(ds, kv[:, :seen, :d], out=g[:, first + at : seen, 2 * d : 3 * d])
        if seen == e.shape[1]:
            np.matmul(ds.transpose(0, 2, 1), qs[:, here, :d], out=g[:, :, :d])
            np.matmul(x.transpose(0, 2, 1), do[:, here, :d], out=g[:, :, d : 2 * d])
        else:
            g[:, :seen, :d] += ds.transpose(0, 2, 1) @ qs[:, here, :d]
            g[:, :seen, d : 2 * d] += x.transpose(0, 2, 1) @ do[:, here, :d]
    by = np.hstack((m.key, m.value, m.query * SCALE, m.skip))
    begun = begins.ravel().astype(np.float32) @ g[:, first:, 2 * d :].reshape(-1, 2 * d)
    begun = np.stack((g[:, first:, 2 * d :].sum((0, 1)) - begun, begun))
    g_by = two(e).T @ two(g)
    g_by[:, 2 * d :] += m.begin.T @ begun
    de = (two(g) @ by.T).reshape(e.shape)
    return loss, [sums_by(inputs.ravel(), two(de)), de.sum(0), begun @ by[:, 2 * d :].T, g_by[:, 2 * d : 3 * d] * SCALE, g_by[:, :d], g_by[:, d : 2 * d], g_by[:, 3 * d :], two(o).T @ dz, g_out[:d], g_out[d]]


#: Cells of each symbol's row in a flat array.
CELLS = np.arange((SYMBOLS + 1) * WIDTH).reshape(-1, WIDTH)


def sums_by(symbols: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sum of the rows of each symbol."""
    return np.bincount(np.take(CELLS, symbols, axis=0).ravel(), rows.ravel(), CELLS.size).reshape(CELLS.shape).astype(np.float32)


def train(m: Attention, examples: Examples, passes: int, rate: float, batch: int = 32, seed: int = 5) -> Attention:
    """Adam, with a rate that falls to a tenth."""
    inputs = examples.inputs
    flat = m.flat()
    m = m.over(flat)
    rng = np.random.default_rng(seed)
    first, second = np.zeros_like(flat), np.zeros_like(flat)
    steps, step = passes * -(-len(inputs) // batch), 0
    for _ in range(passes):
        order = rng.permutation(len(inputs))
        for at in range(0, len(order), batch):
            _, grads = gradients(m, *examples.rows(order[at : at + batch]), with_loss=False)
            g = np.concatenate([x.ravel() for x in grads])
            step += 1
            now = rate * (1 - 0.9 * step / steps)
            first += np.float32(0.1) * (g - first)
            second += np.float32(0.01) * (g * g - second)
            flat -= np.float32(now / (1 - 0.9**step)) * first / (np.sqrt(second / np.float32(1 - 0.99**step)) + np.float32(1e-8))
    return m


@dataclass
class Examples:
    """Windows with what their scored positions need; prior rows are looked up when asked for, as they are wide."""

    inputs: np.ndarray
    before: np.ndarray
    targets: np.ndarray
    valid: np.ndarray
    prior: np.ndarray

    def rows(self, some) -> tuple:
        before = self.before[some]
        return self.inputs[some], (before == START).astype(int), np.take(self.prior, before, axis=0), self.targets[some], self.valid[some]


@dataclass
class Model:
    """Symbol and class of each subword id; by the pair statistics, natural logarithms of classes after each symbol and log10 of
    symbols within their class; log10 of rare ids' shares of their symbol; attention."""

    symbol: np.ndarray
    kind: np.ndarray
    prior: np.ndarray
    within: np.ndarray
    of_other: np.ndarray
    attention: Attention

    def encode(self, pieces: WordPieces, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids of all texts, each with its end; which of them begin a word; number of ids of each text."""
        return pieces.words.encoded(*pieces.words.look(texts))

    def windows(self, ids: np.ndarray, sizes: np.ndarray, context: int = CONTEXT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """inputs (windows, CONTEXT + STRIDE), and where each scored position lies in ids, with -1 past a text's end: all but the
        first context ones, so each id is scored once."""
        stride = CONTEXT + STRIDE - context
        counts = -(-sizes // stride)
        owner = np.repeat(np.arange(len(sizes)), counts)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        begin = (np.cumsum(sizes) - sizes)[owner]
        within = number[:, None] * stride + np.arange(-context, stride)  # the position that each input stands before
        before = within - 1
        symbols = self.symbol[ids]
        ok = (before >= 0) & (before < sizes[owner][:, None])
        inputs = np.where(ok, symbols[np.clip(begin[:, None] + before, 0, len(ids) - 1)], START)
        scored = within[:, context:]
        return inputs, np.where(scored < sizes[owner][:, None], begin[:, None] + scored, -1), owner

    def before(self, ids: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """The symbol before each id in its word; START where a word begins."""
        return np.where(begins, START, np.concatenate(([START], self.symbol[ids][:-1])))

    def examples(self, ids: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> Examples:
        inputs, where, _ = self.windows(ids, sizes, 0)
        at = np.maximum(where, 0)
        return Examples(inputs, self.before(ids, begins)[at], self.kind[ids[at]], where >= 0, self.prior)

    def logs(self, ids: np.ndarray, begins: np.ndarray, sizes: np.ndarray, block: int = 64, tables: Tables | None = None) -> np.ndarray:
        """log10 of each id's probability: its class by attention and pair statistics, and its share of the class by the latter."""
        inputs, where, _ = self.windows(ids, sizes)
        before, out = self.before(ids, begins), np.zeros(len(ids))
        kinds, tables = self.kind[ids], tables or Tables.of(self.attention, self.prior)
        for a in range(0, len(inputs), block):
            at = where[a : a + block]
            known = np.maximum(at, 0)
            logs = class_logs(self.attention, inputs[a : a + block], before[known], self.prior, kinds[known], tables)
            ok = at >= 0
            out[at[ok]] = logs[ok]
        return out + self.within[before, self.symbol[ids]] + self.of_other[ids]


def classes_of(pairs: np.ndarray, seed: int = 5, rounds: int = 15) -> np.ndarray:
    """The class of each symbol: the most frequent ones by themselves, the others by k-means over what comes after and before them."""
    ahead, back = pairs[:SYMBOLS], pairs.T
    x = np.hstack([np.sqrt(c / np.maximum(c.sum(1, keepdims=True), 1)) for c in (ahead, back)])[ALONE:]
    k = CLASSES - ALONE
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        label = (x @ centres.T - 0.5 * (centres * centres).sum(1)).argmax(1)
        centres = np.stack([x[label == i].mean(0) if (label == i).any() else centres[i] for i in range(k)])
    return np.concatenate((np.arange(ALONE), ALONE + label))


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """word, n over all documents: counted within each partition before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        give = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        for batch in batches:
            for whole in batch.column(0).to_pylist():
                held.update(words_of(whole))
            if len(held) > 400_000:
                yield give()
                held.clear()
        if held:
            yield give()

    return docs.select(text).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def subword_counts(counts: DataFrame, symbol: np.ndarray, path: str, pattern: str) -> np.ndarray:
    """Counts of subwords (VOCABULARY) and then of pairs (SYMBOLS + 1 by SYMBOLS) within words, from the counts of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, total = word_pieces(path, pattern), np.zeros(VOCABULARY + (SYMBOLS + 1) * SYMBOLS)
        for batch in batches:
            ids, lengths = pieces.all_of(batch.column(0).to_pylist())
            n = np.repeat(batch.column(1).to_numpy().astype(float), lengths)
            symbols = symbol[ids]
            before = np.where(pieces.begins[ids], START, np.concatenate(([START], symbols[:-1])))
            np.add.at(total, ids, n)
            np.add.at(total, VOCABULARY + before * SYMBOLS + symbols, n)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], names=["cell", "n"])

    out = np.zeros(VOCABULARY + (SYMBOLS + 1) * SYMBOLS)
    for r in counts.select("word", "n").mapInArrow(run, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # as many rows as the vocabulary and the pairs of symbols have
        out[r["cell"]] = r["n"]
    return out


def shares_of(group: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """log10 of each id's share of its group (of ids that are taken together), with a tenth added to each count; 0 for ids alone."""
    out = np.zeros(len(counts))
    out[group] = np.log10((counts[group] + ADD) / (counts[group].sum() + ADD * group.sum())) if group.any() else 0
    return out


def averaged(docs: DataFrame, model: Model, text: str, path: str, pattern: str, doc_id: str = "doc_id", n_docs: int | None = None, rate: float = 0.003, sums: int = 32) -> Attention:
    """Attention weights trained on from model's in each shard of about SHARD documents, and their mean by trained windows.

    The shard of a document is a hash of its id and text, and a shard is trained in the order of those: so the weights are a
    function of the table, whatever its files and partitions. A task sums the weights of its shards to one vector; these are
    summed again in a fixed number of groups before the driver gets them.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    n_docs = docs.count() if n_docs is None else n_docs
    shards = max(1, -(-n_docs // SHARD))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, pieces = shared.value, word_pieces(path, pattern)
        keep_memory()
        total, windows = np.zeros(m.attention.flat().size), 0
        shard, held, now, seen = None, [], m.attention, 0

        def learn() -> None:
            nonlocal held, now, seen
            if held:
                examples = m.examples(*m.encode(pieces, [words_of(t) for t in held]))
                now = train(now, examples, 1, rate)
                held, seen = [], seen + len(examples.inputs)

        for batch in batches:
            for number, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if number != shard:
                    learn()
                    total, windows = total + now.flat().astype(np.float64) * seen, windows + seen
                    shard, now, seen = number, m.attention, 0
                held.append(whole)
                if len(held) == TOGETHER:
                    learn()
        learn()
        total, windows = total + now.flat().astype(np.float64) * seen, windows + seen
        if windows:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % sums]), pa.array([windows]), pa.array([total], pa.list_(pa.float64()))], names=["shard", "n", "w"])

    def add(table: pa.Table) -> pa.Table:
        w = sum(np.asarray(x.values) for x in table.column("w"))
        return pa.table({"n": [sum(table.column("n").to_pylist())], "w": pa.array([w], pa.list_(pa.float64()))})

    dealt = docs.select(F.pmod(F.xxhash64(doc_id, text), F.lit(shards)).alias("_shard"), F.col(text).alias("_text"), F.col(doc_id).alias("_id"))
    # A partition for each shard or so: by size alone there would be few, and training is long.
    dealt = dealt.repartition(min(shards, 10_000), "_shard").sortWithinPartitions("_shard", "_id", "_text").select("_shard", "_text")
    rows = dealt.mapInArrow(run, "shard long, n long, w array<double>").groupBy("shard").applyInArrow(add, "n long, w array<double>").collect()
    if not rows:
        return model.attention
    return model.attention.filled(sum(np.array(r["w"]) for r in rows) / sum(r["n"] for r in rows))


def fit(train_docs: DataFrame, counts: DataFrame, top: list[tuple[bytes, int]], n_docs: int, text: str, doc_id: str, path: str, pattern: str) -> Model:
    pieces = word_pieces(path, pattern)
    frequent = np.zeros(VOCABULARY)
    ids, lengths = pieces.all_of([word for word, _ in top])
    np.add.at(frequent, ids, np.repeat(np.array([n for _, n in top], float), lengths))
    frequent[END] += n_docs
    order = np.lexsort((np.arange(VOCABULARY), -frequent))
    symbol = np.full(VOCABULARY, OTHER)
    symbol[order[:OTHER]] = np.arange(OTHER)
    total = subword_counts(counts, symbol, path, pattern)
    single, pairs = total[:VOCABULARY], total[VOCABULARY:].reshape(SYMBOLS + 1, SYMBOLS)
    single[END] += n_docs
    pairs[START, symbol[END]] += n_docs
    base = np.bincount(symbol, single, SYMBOLS) + ADD
    base /= base.sum()
    strength = 5.0
    model = combined(symbol, pairs, base, single)
    # A bounded sample starts the weights, so that the partitions' own ones can be averaged.
    share = min(1.0, FIRST_DOCUMENTS / max(1, n_docs))
    at = F.pmod(F.xxhash64(doc_id, F.lit(6)), F.greatest(F.length(text) - FIRST_CHARS, F.lit(1)).cast("long")).cast("int") + 1
    some = train_docs.filter(F.pmod(F.xxhash64(doc_id, F.lit(2)), F.lit(1 << 30)) < int((1 << 30) * share)).select(F.substring(F.col(text), at, F.lit(FIRST_CHARS)).alias("t")).limit(2 * FIRST_DOCUMENTS)
    texts = [words_of(t) for t in sorted(r["t"] or "" for r in some.collect())] or [[]]
    model.attention = train(model.attention, model.examples(*model.encode(pieces, texts)), 2, 0.01)
    model.attention = averaged(train_docs, model, text, path, pattern, doc_id, n_docs)
    return model


def combined(symbol: np.ndarray, pairs: np.ndarray, base: np.ndarray, single: np.ndarray, strength: float = 5.0) -> Model:
    """The model of the counts, with untrained attention; pairs are smoothed toward the single symbols' shares, base."""
    pair = (pairs + strength * base) / (pairs.sum(1, keepdims=True) + strength)
    label = classes_of(pairs)
    whole = np.stack([pair[:, label == k].sum(1) for k in range(CLASSES)], 1)
    prior = np.log(np.maximum(whole, 1e-30)).astype(np.float32)
    return Model(symbol, label[symbol], prior, np.log10(pair / np.maximum(whole[:, label], 1e-30)), shares_of(symbol == OTHER, single), fresh())


def score_documents(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document.

    A null text counts as empty: its end is its only token. A null doc_id counts as the text '' in the fold. Repeated rows are
    scored each. Without training documents all counts are 0. Extra columns are not carried.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), (fold(F.col(doc_id), 10) == 0).alias("held_out"))
    learn = docs.filter(~F.col("held_out"))
    n_docs = learn.count()
    counts = written(word_counts(learn, "text"), "lm-words")
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_tokens, n_kinds = whole["n"] + n_docs, whole["v"] + (n_docs > 0)
    rows = counts.filter(F.length("word") <= LONG).orderBy(F.desc("n"), "word").limit(TOP_WORDS).collect()
    top = [(bytes(r["word"]), r["n"]) for r in rows]
    model = fit(learn, counts, top, n_docs, "text", "doc_id", path, pattern)
    values = {w: float(np.log10(n + ADD)) for w, n in [*top, (b"", n_docs)]}
    shared = spark.sparkContext.broadcast((model, values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, values = shared.value
        keep_memory()
        tables, words = Tables.of(model.attention, model.prior), word_pieces(path, pattern).words
        if words.values is not values:
            words.forget(values)
        for batch in batches:
            for a in range(0, batch.num_rows, 32):
                part = batch.slice(a, 32)
                at, counts = words.look([words_of(t) for t in part.column("text").to_pylist()])
                begin = np.cumsum(counts) - counts
                ids, begins, sizes = words.encoded(at, counts)
                scores = np.add.reduceat(model.logs(ids, begins, sizes, tables=tables), np.cumsum(sizes) - sizes)
                value = words.value[at]
                rare = np.isnan(value)
                base = np.add.reduceat(np.where(rare, 0, value), begin)
                known = np.add.reduceat(~rare, begin, dtype=int) - (n_docs == 0)
                others, times = np.unique(np.repeat(np.arange(len(counts)) * len(words), counts)[rare] + at[rare], return_counts=True)
                names = pa.array([words.names[i] for i in (others % len(words)).tolist()], pa.binary())
                ends = pa.array(np.searchsorted(others, np.arange(len(counts) + 1) * len(words)), pa.int32())
                lists = (pa.ListArray.from_arrays(ends, x) for x in (names, pa.array(times, pa.int32())))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), *map(pa.array, (counts, known, base, scores)), *lists],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "words", "times"],
                )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, words array<binary>, times array<int>"
    scored = written(docs.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "lm-scored")
    rare = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    c = F.coalesce("n", F.lit(0))
    tails = rare.join(counts, "word", "left").groupBy("row").agg(F.sum(F.col("times") * F.log10(c + ADD)).alias("tail"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("found"))
    each = float(np.log10(n_tokens + ADD * (n_kinds + 1)))
    return scored.join(tails, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(n_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail", F.lit(0.0)) - F.col("n_tokens") * each).alias("base_score"),
        "score",
    )
