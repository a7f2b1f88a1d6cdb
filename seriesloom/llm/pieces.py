"""Encoding to the pieces of a SentencePiece model and back, by a streaming Viterbi search."""

from __future__ import annotations

import functools
import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

BLANK = "▁"
CHUNK = re.compile(r" *[^ ]+| +")


class Pieces(dict):
    """Ids of chunks (blanks and what follows up to the next blank); no piece of the model has a blank behind another character,
    so all paths converge before each chunk. Forgotten when there are too many.

    The model file is of the BPE kind, whose scores are ranks; a piece costs the logarithm of its rank, a byte twice the most.
    """

    LIMIT, LONGEST = 500_000, 64

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.text = text = [model.id_to_piece(i) for i in range(n)]
        self.bytes = {int(text[i][3:-1], 16): i for i in range(n) if model.is_byte(i)}
        usable = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)) and BLANK not in text[i].lstrip(BLANK)]
        self.cost = {text[i].replace(BLANK, " "): (math.log(2 - model.get_score(i)), i) for i in usable}
        self.longest = max(map(len, self.cost))
        self.byte_cost = 2 * math.log(n)
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.spelled = [t.replace(BLANK, " ").encode() for t in text]
        for b, i in self.bytes.items():
            self.spelled[i] = bytes([b])
        # A node of the tree of pieces: what follows by character, and cost and id of the piece that ends here (or no id).
        self.tree: list = [{}, 0.0, -1]
        for piece, (cost, i) in self.cost.items():
            node = self.tree
            for c in piece:
                node = node[0].setdefault(c, [{}, 0.0, -1])
            node[1:] = cost, i

    def viterbi(self, text: str) -> Iterator[int]:
        """Ids of the cheapest path (of equally cheap ones, that with the longer last piece).

        Costs are kept for the ends of pieces that begin before the current position: a window of the longest piece. At every
        position at which no such piece ends further on, all surviving paths pass through it; where that has not happened for
        a whole window, the back-pointers of the open ends are followed to where they meet. What lies before is given out.
        """
        best, back = {0: 0.0}, {}
        done = reach = 0
        n, tree, longest = len(text), self.tree, self.longest
        again = 2 * longest  # where to follow the back-pointers next: twice as far each time that they do not meet
        for at in range(n):
            base = best.pop(at)
            if reach == at and at > done:
                yield from self.path(text, back, done, at)
                back, done, again = {}, at, at + 2 * longest
            elif at > again:
                live = {at, *best}
                while len(live) > 1 and max(live) > done:
                    top = max(live)
                    live = (live - {top}) | {back[top][0]}
                common, again = max(live), at + 2 * (at - done)
                if common > done:
                    yield from self.path(text, back, done, common)
                    back, done, again = {k: v for k, v in back.items() if k > common}, common, at + 2 * longest
            node, end, alone = tree, at, True
            for c in text[at : at + longest]:
                node = node[0].get(c)
                if node is None:
                    break
                end += 1
                if node[2] >= 0:
                    cost = base + node[1]
                    known = best.get(end)
                    if known is None or cost < known:
                        best[end] = cost
                        back[end] = at, node[2]
                    if end == at + 1:
                        alone = False
                    if end > reach:
                        reach = end
            if alone:  # no piece is this character: its bytes
                c = text[at]
                cost = base + self.byte_cost * len(c.encode())
                known = best.get(at + 1)
                if known is None or cost < known:
                    best[at + 1] = cost
                    back[at + 1] = at, -1
                if reach == at:
                    reach = at + 1
        yield from self.path(text, back, done, n)

    def path(self, text: str, back: dict[int, tuple[int, int]], begin: int, end: int) -> list[int]:
        """Ids between two boundaries, by following the back-pointers."""
        out: list[int] = []
        while end > begin:
            before, i = back[end]
            out += [i] if i >= 0 else [self.bytes[b] for b in reversed(text[before:end].encode())]
            end = before
        return out[::-1]

    def __missing__(self, chunk: str) -> bytes:
        ids = np.fromiter(self.viterbi(chunk), "<u4").tobytes()
        if len(chunk) <= self.LONGEST:
            if len(self) >= self.LIMIT:
                self.clear()
            self[chunk] = ids
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, CHUNK.findall(text or ""))), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.spelled.__getitem__, ids.tolist())).decode()


@functools.cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_ids, ids_crc32, text_sha256 (of the text decoded from the ids), same (is that the text) for every whole text.

    A null or empty text has no ids; repeated rows stay apart; extra columns are not carried.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            out: dict = {"doc_id": batch.column(0), "n_ids": [], "ids_crc32": [], "text_sha256": [], "same": []}
            for t in batch.column(1).to_pylist():
                ids = model.encode(t)
                back = model.decode(ids)
                for c, v in zip(("n_ids", "ids_crc32", "text_sha256", "same"), (len(ids), zlib.crc32(ids.tobytes()), hashlib.sha256(back.encode()).hexdigest(), back == (t or "")), strict=True):
                    out[c].append(v)
            yield pa.RecordBatch.from_pydict(out)

    return docs.select(F.col(doc_id).alias("doc_id"), text).mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, text_sha256 string, same boolean")
