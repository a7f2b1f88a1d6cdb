"""Order-preserving packing of token streams by dynamic programming with a monotone queue."""

from __future__ import annotations

import functools
import os
import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import small_batches

SIZE = 4096
#: What a cut costs, in tokens of padding: at the end of a document, of a sentence, elsewhere.
AT_DOCUMENT, AT_SENTENCE, ELSEWHERE = 0, 4, 16
#: Cuts elsewhere may lie at every so many tokens of a longer run without an end of sentence.
GRID = 32
#: The queue runs over blocks of so many tokens; what follows the best last cut is left for the next.
BLOCK = 64 * SIZE
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordIds(dict):
    """Token ids by chunk between ASCII white space, as bytes of unsigned 32-bit numbers. When there are LIMIT, they
    become the old ones, which are asked next and forgotten in turn; a worker keeps both from stage to stage, so they are few.

    The tokenizer drops white space and case before it splits, so the ids of a text are those of its lower-cased chunks in
    order; only the names of special tokens depend on case. It splits between letters and marks, so marks at the end of a
    word add their own ids. A word of Latin letters needs neither normaliser nor splitter: it goes to the BPE model at once.
    """

    LIMIT, LONGEST = 150_000, 64
    #: Latin letters, and ASCII marks after them, which are one piece.
    WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.old: dict[bytes, bytes] = {}
        letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {i: letters.pre_tokenize_str(chr(i))[0][0] for i in range(0xDF, 0x100)}
        words = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(words.values()) + 1, bool)
        self.ends[[i for w, i in words.items() if w.removesuffix("</w>")[-1:] in tuple(".!?")]] = True

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self.old.get(chunk)
        if ids is not None:
            pass
        elif chunk.isalpha():  # ASCII letters alone
            ids = array("I", [t.id for t in self.model.tokenize(chunk.lower().decode())]).tobytes()
        else:
            text = chunk.decode()
            parts = self.WORD.fullmatch(text)
            if not parts:
                ids = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
            elif parts[2]:
                ids = self[parts[1].encode()] + self[parts[2].encode()]
            else:
                ids = array("I", [t.id for t in self.model.tokenize(text.lower().translate(self.letters))]).tobytes()
        if len(chunk) <= self.LONGEST:
            if len(self) >= self.LIMIT:
                self.old = dict(self)
                self.clear()
            self[chunk] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        raw = text.encode()
        return np.frombuffer(b"".join(map(self.__getitem__, (raw if b"<|" in raw else raw.lower()).split())), "<u4")


@functools.cache
def word_ids(path: str) -> WordIds:
    """One for each Python worker; its tasks share what it has seen."""
    return WordIds(path)


def best_cuts(at: list[int], cost: list[int], size: int = SIZE, open_end: bool = False) -> list[int]:
    """Indices of the cuts that minimise padding plus costs of cuts, from at[0] to at[-1]; windows hold at most size tokens.

    With an open end, the last cut is wherever in the last size tokens the total is least, as more may follow.

    total[j] = min over i of total[i] + size - (at[j] - at[i]) + cost[j]; total[i] + at[i] is kept in a queue that rises,
    so each position enters and leaves it once.
    """
    n = len(at)
    before, value = [0] * n, [0] * n
    value[0] = at[0]
    queue = deque([0])
    for j in range(1, n):
        p = at[j]
        low = p - size
        while at[queue[0]] < low:
            queue.popleft()
        i = queue[0]
        before[j] = i
        v = value[i] + size + cost[j]  # total[j] + at[j]
        while queue and value[queue[-1]] > v:
            queue.pop()
        value[j] = v
        queue.append(j)
    cuts, j = [], n - 1
    if open_end:
        j = min((i for i in range(n) if at[i] > at[-1] - size), key=lambda i: (value[i] - at[i], -i))
    while j:
        cuts.append(j)
        j = before[j]
    return cuts[::-1]


def cut_points(ids: np.ndarray, ends: np.ndarray, grid: int = GRID) -> tuple[np.ndarray, np.ndarray]:
    """Positions in a document (1 to its length) where it may be cut, and what each costs."""
    n = len(ids)
    stops = np.flatnonzero(np.take(ends, ids, mode="clip")) + 1
    gaps = np.diff(np.concatenate(([0], stops, [n])))
    if (gaps > 2 * grid).any():
        steps = np.arange(grid, n, grid)
        edge = np.concatenate(([0], stops, [n]))
        k = np.searchsorted(edge, steps)
        far = (edge[k] - edge[k - 1] > 2 * grid) & (edge[k] != steps)
        at = np.concatenate((stops, steps[far]))
        cost = np.concatenate((np.full(len(stops), AT_SENTENCE), np.full(far.sum(), ELSEWHERE)))
        order = np.argsort(at, kind="stable")
        at, cost = at[order], cost[order]
    else:
        at, cost = stops, np.full(len(stops), AT_SENTENCE)
    keep = at < n
    return np.append(at[keep], n), np.append(cost[keep], AT_DOCUMENT)


class Packer:
    """Takes documents in order and gives the pieces of each window once it is final. It holds at most about a block and a document."""

    def __init__(self, ends: np.ndarray, first: int, size: int = SIZE, block: int = BLOCK) -> None:
        self.ends, self.next, self.size, self.block = ends, first, size, block
        self.parts: deque = deque()  # (doc_id, start in the document, ids, tokens of the document)
        self.at, self.cost, self.held = [0], [0], 0

    def add(self, doc_id, ids: np.ndarray) -> Iterator[tuple]:
        at, cost = cut_points(ids, self.ends)
        begun = 0
        while begun < len(ids):  # a long document comes in slices
            stop = len(ids) if len(ids) - begun <= self.block else int(at[np.searchsorted(at, begun + self.block, "right") - 1])
            here = slice(np.searchsorted(at, begun, "right"), np.searchsorted(at, stop, "right"))
            self.parts.append((doc_id, begun, ids[begun:stop], len(ids)))
            self.at += (at[here] - begun + self.held).tolist()
            self.cost += cost[here].tolist()
            self.held += stop - begun
            begun = stop
            if self.held >= self.block:
                yield from self.settle()

    def settle(self) -> Iterator[tuple]:
        """Cuts windows from what is held; less than a window stays."""
        done = 0
        cuts = best_cuts(self.at, self.cost, self.size, open_end=True)
        for c in cuts:
            yield from self.window(self.at[c] - done)
            done = self.at[c]
        if cuts:
            self.at, self.cost = [p - done for p in self.at[cuts[-1] :]], self.cost[cuts[-1] :]
            self.held -= done

    def close(self) -> Iterator[tuple]:
        """The last, shorter window is cut into powers of two, which need no padding."""
        yield from self.settle()
        for k in range(self.held.bit_length() - 1, -1, -1):
            if self.held >> k & 1:
                yield from self.window(1 << k)

    def window(self, length: int) -> Iterator[tuple]:
        offset = 0
        while offset < length:
            doc_id, start, ids, total = self.parts.popleft()
            take = min(length - offset, len(ids))
            if take < len(ids):
                self.parts.appendleft((doc_id, start + take, ids[take:], total))
            yield doc_id, start, take, zlib.crc32(ids[:take].tobytes()), total, self.next, offset
            offset += take
        self.next += 1


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Packs all documents, in the order of each partition, into sequences of at most size tokens: one row for each piece.

    Each partition is packed by itself, without a shuffle; sequence ids carry the partition's number in their upper bits. A
    null or empty text is the end id alone; a null doc_id stays null; repeated rows are packed once each.
    Extra columns are not carried. Sequences do not cross partitions, so a partition's last one may be short.
    """
    small_batches(docs.sparkSession)
    names = [c.split()[0] for c in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer)
        packer = Packer(words.ends, TaskContext.get().partitionId() << 33, size)
        end = np.array([end_id], "<u4")
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)
            rows.clear()
            return out

        for batch in batches:
            for doc, whole in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows += packer.add(doc, np.concatenate((words.encode(whole.as_py() or ""), end)))
            if len(rows) > 10_000:
                yield flush()
        rows += packer.close()
        if rows:
            yield flush()

    return docs.select(doc_id, text).mapInArrow(run, PIECES)
