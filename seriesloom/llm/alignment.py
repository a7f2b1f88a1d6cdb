"""Alignment of two tokenizers' tokens over each distinct text, and how often their ids end together over the corpus."""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_keys, salted_join, small_batches, written

BLANK = "▁"
#: A block of texts ends once it has so many links; a longer text has a block of its own.
BLOCK_LINKS = 1 << 21
#: Room for an id of the second tokenizer in the number of a pair.
SHIFT = 32
ALIGNED = "block long, digest binary, times long, n_a long, n_b long, n_groups long, groups_sha256 string, links array<int>, seen array<int>, pairs array<long>, pair_counts array<long>"
MEASURES = "digest binary, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


class Aligned(NamedTuple):
    """Of a piece of text: tokens of either kind, groups, links (pairs of ids whose tokens end together) and the groups as text."""

    n_a: int
    n_b: int
    n_groups: int
    links: np.ndarray
    groups: str


class Aligner:
    """Both tokenizers, and the alignment of their tokens of a text with a blank before it.

    A long text is cut into pieces before a blank behind a character that is no white space. Neither tokenizer has a token across
    that place (the pattern of the first starts a token at every run of white space; no piece of the second has a blank behind
    another character), so its alignment is that of its pieces in order, and memory follows the longest piece.
    """

    PIECE = 1 << 16

    def __init__(self, ranks: str, pattern: str, pieces: str) -> None:
        import sentencepiece
        import tiktoken

        with open(ranks, "rb") as f:
            entries = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.first = tiktoken.Encoding("first", pat_str=pattern, mergeable_ranks=entries, special_tokens={})
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for raw, i in entries.items():
            self.bytes_a[i] = raw
        self.second = model = sentencepiece.SentencePieceProcessor(model_file=pieces)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(names)]
        self.blank = model.piece_to_id(BLANK)
        #: Whether texts may be cut: no piece has a blank behind another character.
        self.cuts = not any(BLANK in p.lstrip(BLANK) for p in names)
        self.size_a, self.size_b = (np.array([len(b) for b in some], np.int64) for some in (self.bytes_a, self.bytes_b))
        #: Each id as text and what follows it: within a group and at its end, of the first tokenizer and then of the second.
        self.spelled = [f"{i}{mark}" for n, marks in ((len(self.bytes_a), ",|"), (len(names), ",;")) for i in range(n) for mark in marks]

    def piece(self, text: str) -> Aligned | None:
        a, b = self.first.encode_ordinary(" " + text), self.second.encode(text) or [self.blank]  # the model puts no blank before nothing
        raw = b" " + text.encode()
        if b"".join(map(self.bytes_b.__getitem__, b)) != raw:  # the first tokenizer splits bytes and changes none
            return None
        a, b = np.array(a), np.array(b)
        ends_a, ends_b = self.size_a[a].cumsum(), self.size_b[b].cumsum()
        if ends_a[-1] != len(raw):
            return None
        is_end = np.zeros((2, len(raw) + 1), bool)  # no token is empty, so the ends of either kind rise
        is_end[0, ends_a], is_end[1, ends_b] = True, True
        cut_a, cut_b = is_end[1, ends_a], is_end[0, ends_b]  # tokens that end a group
        at_a, at_b = np.flatnonzero(cut_a), np.flatnonzero(cut_b)
        # A group's tokens of the first kind stand before those of the second, behind all tokens of the groups before it.
        behind_a = np.append(0, at_b + 1)[np.cumsum(cut_a) - cut_a]
        behind_b = (at_a + 1)[np.cumsum(cut_b) - cut_b]
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + behind_a] = 2 * a + cut_a
        codes[np.arange(len(b)) + behind_b] = 2 * (b + len(self.bytes_a)) + cut_b
        groups = "".join(map(self.spelled.__getitem__, codes.tolist()))[:-1]
        return Aligned(len(a), len(b), len(at_a), a[at_a] << SHIFT | b[at_b], groups)

    def pieces(self, text: str) -> Iterator[str]:
        at = 0
        while self.cuts and len(text) - at > self.PIECE:
            k = text.find(" ", at + self.PIECE)
            while k > 0 and text[k - 1].isspace():
                k = text.find(" ", k + 1)
            if k < 0:
                break
            yield text[at:k]
            at = k + 1
        yield text[at:]

    def align(self, text: str) -> list[Aligned] | None:
        """The alignments of a text's pieces; None if it is empty or a tokenizer does not give back its bytes."""
        if not text or BLANK in text:
            return None
        found = [self.piece(p) for p in self.pieces(text)]
        return None if any(f is None for f in found) else found


@functools.cache
def aligner(ranks: str, pattern: str, pieces: str) -> Aligner:
    """One for each Python worker."""
    return Aligner(ranks, pattern, pieces)


class Block:
    """Rows of a block of texts: one for each text, whose links are places in the block's own list of pairs, and one for that list."""

    def __init__(self, number: int) -> None:
        self.number, self.rows, self.pairs, self.seen, self.size = number, [], [], [], 0

    def add(self, digest: bytes, times: int, found: list[Aligned]) -> None:
        pairs, seen = np.unique(np.concatenate([c.links for c in found]), return_counts=True)
        groups = hashlib.sha256(";".join([c.groups for c in found]).encode()).hexdigest()
        self.rows.append((digest, times, sum(c.n_a for c in found), sum(c.n_b for c in found), int(seen.sum()), groups))
        self.pairs.append(pairs)
        self.seen.append(seen)
        self.size += len(pairs)

    def batch(self) -> pa.RecordBatch:
        ends = np.cumsum([0, *map(len, self.pairs)])
        pairs, at = np.unique(np.concatenate(self.pairs), return_inverse=True)
        times = np.repeat([r[1] for r in self.rows], np.diff(ends))
        counts = np.bincount(at, weights=np.concatenate(self.seen) * times, minlength=len(pairs)).astype(np.int64) if len(pairs) else np.zeros(0, np.int64)
        n = len(self.rows)
        digest, rows_times, n_a, n_b, n_groups, groups = (list(c) for c in zip(*self.rows, strict=True))
        lists = lambda values, kind: pa.ListArray.from_arrays(pa.array(np.append(ends, ends[-1]), pa.int32()), pa.array(values, kind))
        last = lambda values: pa.ListArray.from_arrays(pa.array(np.append(np.zeros(n + 1), len(values)), pa.int32()), pa.array(values, pa.int64()))
        columns = [pa.array([self.number] * (n + 1), pa.int64()), pa.array([*digest, None], pa.binary()), *(pa.array([*c, None], pa.int64()) for c in (rows_times, n_a, n_b, n_groups)), pa.array([*groups, None], pa.string())]
        columns += [lists(at, pa.int32()), lists(np.concatenate(self.seen), pa.int32()), last(pairs), last(counts)]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in ALIGNED.split(", ")])


def aligned_texts(texts: DataFrame, ranks: str, pattern: str, pieces: str) -> DataFrame:
    """ALIGNED rows for texts (text, times; each distinct): one for each text that has tokens and one for each block's pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(ranks, pattern, pieces)
        number = TaskContext.get().partitionId() << 33
        block = Block(number)
        for batch in batches:
            for text, times in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py()
                found = tool.align(text)
                if found is not None:
                    block.add(hashlib.sha256(text.encode()).digest(), times.as_py(), found)
                if block.size >= BLOCK_LINKS:
                    yield block.batch()
                    block = Block(number := number + 1)
        if block.rows:
            yield block.batch()

    return texts.mapInArrow(run, ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """of_block, at (place in the block's list of pairs), count, best: how many links of the corpus hold the pair of ids there, and 1 if no pair of its second id has more.

    A block's pairs are shuffled once, by their second id; sums and the highest of them are taken over windows.
    """
    cells = aligned.filter(F.col("digest").isNull()).select("block", F.posexplode(F.arrays_zip("pairs", "pair_counts")).alias("at", "x"))
    second = F.col("x.pairs").bitwiseAND(F.lit((1 << SHIFT) - 1))
    keyed = cells.select(F.col("block").alias("of_block"), "at", F.col("x.pairs").alias("pair"), F.col("x.pair_counts").alias("n"), second.alias("second")).repartition("second")
    totals = keyed.withColumn("count", F.sum("n").over(Window.partitionBy("second", "pair")))
    return totals.select("of_block", "at", "count", (F.col("count") == F.max("count").over(Window.partitionBy("second"))).cast("long").alias("best"))


def measured(key: tuple, rows: pa.Table, lookup: pa.Table) -> pa.Table:
    """MEASURES of a block's texts. lookup: at (place in the block's list of pairs), count, best."""
    count, best = np.zeros(lookup.num_rows, np.int64), np.zeros(lookup.num_rows, np.int64)
    at = lookup.column("at").to_numpy()
    count[at], best[at] = lookup.column("count").to_numpy(), lookup.column("best").to_numpy()
    links, seen = (rows.column(c).combine_chunks() for c in ("links", "seen"))
    ends = np.cumsum([0, *(len(x) for x in links)])
    place, times = links.flatten().to_numpy(), seen.flatten().to_numpy().astype(np.int64)
    sums = [np.concatenate(([0], np.cumsum(values)))[ends] for values in (times, times * best[place], times * count[place])]
    found = [pa.array(np.diff(s), pa.int64()) for s in sums]
    return pa.table([*(rows.column(c) for c in ("digest", "n_a", "n_b", "n_groups")), *found, rows.column("groups_sha256")], names=[c.split()[0] for c in MEASURES.split(", ")])


def align(docs: DataFrame, ranks: str, pattern: str, pieces: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every document: its text, a blank before it, by two tokenizers.

    ranks: a file of byte-level entries and ranks, with the pattern that splits text before it; its special tokens are plain text. pieces: a
    SentencePiece model that puts a blank before the text. Texts that are null or empty, or that hold the model's sign for a blank or otherwise do
    not come back byte for byte, have no tokens: zeros, and an empty groups_sha256. Repeated rows give a row each; a null doc_id stays null; extra
    columns are not carried; an empty table gives no rows.

    Texts are grouped by their full text, so each distinct one is tokenised and aligned once, and its links weigh as often as it occurs. A block
    of texts (about BLOCK_LINKS links) keeps its own list of pairs, so the shuffles that count pairs and bring the counts back carry a pair once
    for each block, not for each text. Measures go back to documents by the text's SHA-256, hot ones dealt over tasks.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    texts = rows.filter(F.length("text") > 0).groupBy("text").agg(F.count("*").alias("times"))
    aligned = written(aligned_texts(texts, ranks, pattern, pieces), "aligned")
    each = aligned.filter(F.col("digest").isNotNull()).select("block", "digest", "n_a", "n_b", "n_groups", "groups_sha256", "links", "seen")
    measures = written(each.groupBy("block").cogroup(pair_counts(aligned).groupBy("of_block")).applyInArrow(measured, MEASURES), "measures")
    keyed = rows.select("doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))
    hot = hot_keys(aligned.filter(F.col("digest").isNotNull()).select("digest", F.col("times").alias("n")), "digest")
    joined = salted_join(keyed, measures, "digest", "doc_id", hot, "left")
    return joined.select("doc_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in COUNTS], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
