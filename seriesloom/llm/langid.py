"""Language identification by a bidirectional gated recurrent network over bytes.

Trained in numpy by backpropagation through time on a bounded sample; applied to every byte of every text in windows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import fold, small_batches, whole_row

UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
HIDDEN = 8
#: Positions of a window, and those before (for the forward pass) or after it (for the backward one) that only warm up.
WINDOW, WARM = 128, 16
PAD = 32


def squash(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), in place; gates are (1 + that) / 2."""
    d = np.abs(x)
    d += 1
    x /= d
    return x


@dataclass
class Network:
    """inputs: what each byte adds to update gate, reset gate and candidate, by direction (2, 3, 256, h);
    memory: the recurrent weights (2, 3, h, h); out, bias: from both directions' states to languages."""

    languages: list[str]
    inputs: np.ndarray
    memory: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def weights(self) -> list[np.ndarray]:
        return [self.inputs, self.memory, self.out, self.bias]


def fresh(languages: list[str], hidden: int = HIDDEN, seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    f = lambda *s, by: (rng.standard_normal(s) * by).astype(np.float32)
    return Network(languages, f(2, 3, 256, hidden, by=0.5), f(2, 3, hidden, hidden, by=hidden**-0.5), f(2 * hidden, len(languages), by=0.3), np.zeros(len(languages), np.float32))


def run_direction(net: Network, way: int, ids: np.ndarray, keep: int, trace: list | None = None) -> np.ndarray:
    """States (steps - keep, windows, h) after each step from keep on; ids: (steps, windows) in the order of the pass."""
    steps, n = ids.shape
    h = np.zeros((n, net.memory.shape[-1]), np.float32)
    states = np.empty((steps - keep, *h.shape), np.float32)
    (xz, xr, xc), (uz, ur, uc) = net.inputs[way], net.memory[way]
    z, r, c, m, d = (np.empty_like(h) for _ in range(5))
    for t in range(steps):
        i = ids[t]
        for gate, x, u in ((z, xz, uz), (r, xr, ur)):
            np.take(x, i, axis=0, out=gate, mode="clip")
            np.matmul(h, u, out=m)
            gate += m
            np.abs(gate, out=d)
            d += 1
            gate /= d
            gate += 1
            gate *= 0.5
        np.matmul(h, uc, out=m)
        np.take(xc, i, axis=0, out=c, mode="clip")
        if trace is not None:
            trace.append((h.copy(), z.copy(), r.copy(), m.copy()))
        np.multiply(r, m, out=d)
        c += d
        np.abs(c, out=d)
        d += 1
        c /= d
        if trace is not None:
            trace[-1] += (c.copy(), d.copy())
        h -= c
        h *= z
        h += c
        if t >= keep:
            states[t - keep] = h
    return states


def position_probabilities(net: Network, ids: np.ndarray, warm: int = WARM) -> np.ndarray:
    """(window positions, windows, languages), from ids of warm + window + warm steps by windows."""
    steps = len(ids)
    ahead = run_direction(net, 0, ids[: steps - warm], warm)
    back = run_direction(net, 1, ids[warm:][::-1], warm)[::-1]
    h = ahead.shape[-1]
    logits = ahead @ net.out[:h]
    logits += back @ net.out[h:]
    logits += net.bias
    logits -= logits.max(-1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(-1, keepdims=True)
    return logits


def gradients(net: Network, ids: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over all positions and its gradients; ids: (steps, windows), without warming up."""
    traces: tuple[list, list] = ([], [])
    orders = (ids, ids[::-1])
    states = [run_direction(net, way, orders[way], 0, traces[way]) for way in (0, 1)]
    both = np.concatenate((states[0], states[1][::-1]), -1)
    logits = both @ net.out + net.bias
    logits -= logits.max(-1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(-1, keepdims=True)
    n = p.shape[0] * p.shape[1]
    loss = float(-np.log(p[:, np.arange(p.shape[1]), labels] + 1e-9).mean())
    p[:, np.arange(p.shape[1]), labels] -= 1
    p /= n
    flat = p.reshape(-1, p.shape[-1])
    g_out, g_bias = both.reshape(-1, both.shape[-1]).T @ flat, flat.sum(0)
    g_both = p @ net.out.T
    hidden = net.memory.shape[-1]
    g_in, g_mem = np.zeros_like(net.inputs), np.zeros_like(net.memory)
    for way in (0, 1):
        from_out = g_both[..., :hidden] if way == 0 else g_both[::-1, :, hidden:]
        uz, ur, uc = net.memory[way]
        carry = np.zeros_like(from_out[0])
        sums = np.zeros((3, len(ids), ids.shape[1], hidden), np.float32)
        for t in range(len(ids) - 1, -1, -1):
            h, z, r, m, c, d = traces[way][t]
            g = from_out[t] + carry
            gc = g * (1 - z) / (d * d)  # the slope of x / (1 + |x|) is 1 / (1 + |x|) squared
            sz, sr = 1 - np.abs(2 * z - 1), 1 - np.abs(2 * r - 1)  # 1 / (1 + |x|), from the gates
            gz = g * (h - c) * 0.5 * sz * sz
            gr = gc * m * 0.5 * sr * sr
            gm = gc * r
            carry = g * z + gz @ uz.T + gr @ ur.T + gm @ uc.T
            g_mem[way, 0] += h.T @ gz
            g_mem[way, 1] += h.T @ gr
            g_mem[way, 2] += h.T @ gm
            sums[0, t], sums[1, t], sums[2, t] = gz, gr, gc
        where = orders[way].reshape(-1)
        for k in range(3):
            np.add.at(g_in[way, k], where, sums[k].reshape(-1, hidden))
    return loss, [g_in, g_mem, g_out, g_bias]


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], steps: int = 240, batch: int = 192, rate: float = 0.02, seed: int = 7) -> Network:
    """Adam over random batches in which the languages are equally frequent; windows: (n, positions) of bytes."""
    net, rng = fresh(languages, seed=seed), np.random.default_rng(seed)
    of = [np.flatnonzero(labels == k) for k in range(len(languages))]
    first, second = [np.zeros_like(w) for w in net.weights()], [np.zeros_like(w) for w in net.weights()]
    for step in range(1, steps + 1):
        kinds = rng.integers(len(languages), size=batch)
        rows = np.array([rng.choice(of[k]) for k in kinds])
        _, grads = gradients(net, np.ascontiguousarray(windows[rows].T), labels[rows])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        now = rate * (1 - 0.9 * step / steps)
        for w, g, a, b in zip(net.weights(), grads, first, second, strict=True):
            g = g * min(1.0, 1.0 / max(norm, 1e-9))
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w -= now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return net


def sample(docs: DataFrame, lang: str, text: str, doc_id: str, per_language: int, most_rows: int, chars: int = 256) -> list[tuple[str, str]]:
    """About per_language stretches of text of each language, drawn by a hash of the row; fewer of each where there are so many
    languages that most_rows would not hold them. No language is left out."""
    counts = docs.groupBy(F.col(lang).alias("_lang")).agg(F.count("*").alias("_n"))
    n = counts.count()
    each = max(1, min(per_language, most_rows // max(1, n)))
    shares = F.broadcast(counts.select("_lang", (F.lit(float(each)) / F.col("_n")).alias("_share")))  # a row for each language
    drawn = F.pmod(F.xxhash64(F.col(doc_id), F.length(text), F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    at = F.pmod(F.xxhash64(F.col(doc_id), F.lit(5)), F.greatest(F.length(text) - chars, F.lit(1)).cast("long")).cast("int") + 1
    rows = docs.select(F.col(lang).alias("_lang"), F.substring(F.col(text), at, F.lit(chars)).alias("_part"), drawn.alias("_drawn")).join(shares, "_lang").filter("_drawn < _share")
    return sorted((r[0], r[1]) for r in rows.select("_lang", "_part").collect() if r[1] and LETTER.search(r[1]))


def windows_of(parts: list[tuple[str, str]], size: int = 64) -> tuple[np.ndarray, np.ndarray, list[str]]:
    languages = sorted({k for k, _ in parts})
    rows, labels = [], []
    for lang, part in parts:
        raw = part.encode()
        for at in range(0, max(1, len(raw) - size // 2), size):
            piece = raw[at : at + size]
            rows.append(np.frombuffer(((piece + b" ") * (size // (len(piece) + 1) + 1))[:size], np.uint8))
            labels.append(languages.index(lang))
    return np.array(rows, np.uint8).reshape(-1, size), np.array(labels), languages


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 400, most_rows: int = 50_000) -> Network | None:
    """Learns from docs with a language and a text; from about per_language rows of each language, and about most_rows at most."""
    known = docs.filter(F.col(lang).isNotNull() & (F.length(text) > 0))
    rows, labels, languages = windows_of(sample(known, lang, text, doc_id, per_language, most_rows))
    return train(rows, labels, languages) if len(rows) else None


def pooled(net: Network, texts: list[bytes], windows: int = 2048) -> np.ndarray:
    """Mean over all positions of each text of the languages' probabilities."""
    total = np.zeros((len(texts), len(net.languages)))
    size, sizes = WINDOW + 2 * WARM, np.array([len(t) for t in texts])
    counts = -(-sizes // WINDOW)
    ends = np.cumsum(counts)
    n_windows = int(ends[-1]) if len(texts) else 0
    # All texts in one buffer, each filled up to whole windows and apart by blanks on both sides.
    room = counts * WINDOW + 2 * WARM
    starts = np.concatenate(([0], np.cumsum(room)))
    buffer = np.full(starts[-1], PAD, np.uint8)
    for begin, raw in zip(starts, texts, strict=False):
        buffer[begin + WARM : begin + WARM + len(raw)] = np.frombuffer(raw, np.uint8)
    owner = np.repeat(np.arange(len(texts)), counts)
    number = np.arange(n_windows) - np.repeat(ends - counts, counts)
    offsets = starts[owner] + number * WINDOW
    left = np.minimum(WINDOW, sizes[owner] - number * WINDOW)
    for a in range(0, n_windows, windows):
        b = min(n_windows, a + windows)
        ids = buffer[offsets[a:b][None, :] + np.arange(size)[:, None]].astype(np.intp)
        p = position_probabilities(net, ids)
        if (left[a:b] < WINDOW).any():
            p *= (np.arange(WINDOW)[:, None] < left[a:b])[..., None]
        np.add.at(total, owner[a:b], p.sum(0, dtype=np.float64))
    return total / np.maximum(sizes, 1)[:, None]


def identify(docs: DataFrame, net: Network | None, text: str = "text", pred: str = "lang_pred", score_name: str = "score", inside: str | None = None) -> DataFrame:
    """Adds pred and score_name, the pooled probability of the language; `und` and 0 where there is no letter or no model.

    Every byte of every text counts. Null and empty texts are `und`. docs must not have columns of these names.
    inside: the struct column whose field text is.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = (batch.column(text) if inside is None else pa.StructArray.field(batch.column(inside), text)).to_pylist()
            with_letter = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if model else []
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for a in range(0, len(with_letter), 64):
                some = with_letter[a : a + 64]
                p = pooled(model, [texts[i].encode() for i in some])
                for i, row in zip(some, p, strict=True):
                    best = int(row.argmax())
                    lang[i], score[i] = model.languages[best], min(1.0, float(row[best]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score)], names=[*batch.schema.names, pred, score_name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(pred, StringType()), StructField(score_name, DoubleType())]))


def predict_languages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document, learnt from those that are not held out."""
    held = fold(F.col(doc_id), 3) == 1
    net = fit(docs.filter(~held), doc_id, text, lang)
    return identify(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"), held.alias("held_out")), net, "_text").select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """The documents with a language: neither `und` nor of a pooled probability under least.

    Columns and texts stay as they are, whatever their names; doc_id, text and lang are read under these names.
    """
    net = fit(docs)
    found = identify(docs.select(whole_row(docs).alias("_row")), net, "text", inside="_row")
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("_row.*")
