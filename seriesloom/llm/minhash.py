"""Near-duplicates by BagMinHash: weighted-Jaccard signatures of word shingles, banded, then verified by multiset overlap."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_table, hot_keys, salted_join, small_batches, whole_row, with_bit, written

SHINGLE = 5
LEAST = 0.8
#: bands * rows registers. A pair at similarity 0.8 misses all bands once in 150,000; one at 0.3 meets in one of 14.
BANDS, ROWS = 30, 5
#: The texts of a bucket of more representatives than this are not compared pair by pair but meet by the tokens of their prefixes.
LARGE = 200
#: Texts that share a token are compared in blocks: two at a time, of half so many texts each on average, so that a
#: group of the comparison has at most about twice so many.
BLOCK = 1_000
#: Counters of tokens, by which the order of prefixes goes.
CELLS = 1 << 22
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers (splitmix64's)."""
    x = x + GOLDEN
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words; forgotten when there are too many."""

    LIMIT, LONGEST = 300_000, 64

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word.encode())
        if len(word) <= self.LONGEST:
            if len(self) >= self.LIMIT:
                self.clear()
            self[word] = h
        return h


def shingles(text: str | None, words: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """A hash for each run of size words (white space apart); a shorter text is one shingle; one without words has none."""
    split = (text or "").split()
    if not split:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, split), np.uint64, len(split))
    n = max(1, len(h) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(size, len(h))):
        out = mixed(out ^ h[k : k + n])
    return out


def bag_minhash(values: np.ndarray, counts: np.ndarray, owner: np.ndarray, n: int, registers: int = BANDS * ROWS) -> np.ndarray:
    """Signatures (n, registers) of n multisets given as rows (value, count, owner).

    Weights are whole numbers. Their discretisation is a hierarchy of dyadic levels: level 0 is (0, 1], level j is
    (2**(j-1), 2**j]. Each value has a Poisson process for each level, at a rate of its width for each register; a point falls
    on a register and, within the level, on one unit of weight. A multiset takes the points on units up to its count. A
    register keeps the first point, so two signatures agree there with the probability of the weighted Jaccard similarity.
    Points are made only up to a time by which almost all registers of the owner are taken; owners with free ones go on.
    """
    first = np.full(n * registers, np.inf)
    mark = np.zeros(n * registers, np.uint64)
    mass = np.bincount(owner, counts, n)
    until = (np.log(registers) + 2.0) / np.maximum(mass, 1)
    top = int(counts.max(initial=1))
    levels = [(0, 1)] + [(1 << j, 1 << j) for j in range((top - 1).bit_length())]  # (lower bound, width)
    # The state of each process: its latest point, and how many there were.
    live = []
    for j, (low, width) in enumerate(levels):
        rows = np.flatnonzero(counts > low)
        live.append([rows, np.zeros(len(rows)), np.full(len(rows), 0, np.uint64), mixed(values[rows] ^ (np.array([j + 1], np.uint64) * GOLDEN)), low, width])
    open_ = mass > 0
    while open_.any():
        for state in live:
            rows, at, number, seed, low, width = state
            pending = np.flatnonzero(open_[owner[rows]])
            while len(pending):
                r, s = rows[pending], seed[pending]
                number[pending] += np.uint64(1)
                h = mixed(s ^ (number[pending] * GOLDEN))
                gap = -np.log1p(-((h >> np.uint64(11)).astype(np.float64) * 2.0**-53)) / (registers * width)
                t = at[pending] + gap
                inside = t <= until[owner[r]]
                number[pending[~inside]] -= np.uint64(1)  # to be made again in the next round, at the same time
                pending, t, r, h = pending[inside], t[inside], r[inside], h[inside]
                at[pending] = t
                where = mixed(h)
                register = (where % np.uint64(registers)).astype(np.int64)
                unit = low + ((where >> np.uint64(32)) % np.uint64(width)).astype(np.int64)
                take = unit < counts[r]
                cell = owner[r[take]] * registers + register[take]
                times, marks = t[take], h[take]
                np.minimum.at(first, cell, times)
                lead = times == first[cell]
                mark[cell[lead]] = marks[lead]
        open_ = open_ & np.isinf(first.reshape(n, registers)).any(1)
        until = np.where(open_, until * 1.5, until)
    return mark.reshape(n, registers)


def bags(texts: list[str | None], words: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (shingle, count, owner) of texts, sorted by owner and shingle."""
    each = [np.unique(shingles(t, words), return_counts=True) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(v) for v, _ in each])
    return np.concatenate([v for v, _ in each] or [np.zeros(0, np.uint64)]), np.concatenate([c for _, c in each] or [np.zeros(0, np.int64)]), owner


def by_length(batch: pa.RecordBatch, texts: pa.Array, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about most bytes each: enough rows at once, and long texts by themselves."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // most
    edges = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(sizes)]))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def signed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, digest (md5 of the text), size (the mass of its bag of shingles), bands (a hash for each), signature."""
    small_batches(docs.sparkSession)
    schema = "doc_id long, digest binary, size long, bands array<long>, signature binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            for part in by_length(batch, batch.column(1)):
                texts = part.column(1).to_pylist()
                values, counts, owner = bags(texts, words)
                marks = bag_minhash(values, counts, owner, len(texts))
                size = np.bincount(owner, counts, len(texts)).astype(np.int64)
                keys = np.zeros((len(texts), BANDS), np.uint64) + mixed(np.arange(BANDS, dtype=np.uint64))
                for k in range(ROWS):
                    keys = mixed(keys ^ marks.reshape(len(texts), BANDS, ROWS)[:, :, k])
                has = size > 0
                digest = [None if t is None else hashlib.md5(t.encode()).digest() for t in texts]
                low = marks.astype(np.uint16)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(digest, pa.binary()), pa.array(size), pa.array(list(keys.view(np.int64)), pa.list_(pa.int64())), pa.array([x.tobytes() if h else None for x, h in zip(low, has, strict=True)], pa.binary())],
                    names=[c.split()[0] for c in schema.split(", ")],
                )

    return docs.select(F.col(doc_id).alias("doc_id"), text).mapInArrow(run, schema)


def bag_tables(docs: DataFrame, needed: DataFrame, doc_id: str, text: str) -> DataFrame:
    """number, tokens: the bags of the needed texts as sorted sets, in which repeats of a shingle are told apart.

    needed: number, doc_id, digest of one row of each text. A bit table tells most other documents apart at the scan; only the
    rest (the needed ones, and a few that share their bits) are turned into bags and shuffled to the exact join.
    """
    key = F.xxhash64("doc_id", "_hex")
    named = written(needed.select("number", "doc_id", F.lower(F.hex("digest")).alias("_hex")).withColumn("_key", key), "near-needed")
    some = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("_hex", F.md5(F.col("text").cast("binary"))).withColumn("_key", key)
    some = with_bit(some, bit_table(named, "_key"), "_key", "_may").filter("_may")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            for part in by_length(batch, batch.column("text")):
                out = []
                for text in part.column("text").to_pylist():
                    s = np.sort(shingles(text, words))
                    first = np.maximum.accumulate(np.where(np.concatenate(([True], s[1:] != s[:-1])), np.arange(len(s)), 0)) if len(s) else s.astype(np.int64)
                    out.append(np.sort(mixed(s + (np.arange(len(s)) - first).astype(np.uint64) * GOLDEN).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("_hex"), pa.array(out, pa.list_(pa.int64()))], names=["_id", "_of", "tokens"])

    made = some.select("doc_id", "_hex", "text").mapInArrow(run, "_id long, _of string, tokens array<long>")
    found = named.join(made, named["doc_id"].eqNullSafe(made["_id"]) & (named["_hex"] == made["_of"]))
    # Rows that repeat doc_id and text are the same bag: any of them will do.
    return written(found.groupBy("number").agg(F.first("tokens").alias("tokens")), "near-bags")


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two bags as sorted sets."""
    if not len(a) or not len(b):
        return 0.0
    common = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return common / (len(a) + len(b) - common)


def verified(pairs: DataFrame, bags: DataFrame, least: float = LEAST) -> DataFrame:
    """The pairs (a, b) of numbers whose bags overlap by at least least; pairs: a written table.

    A number that many pairs share is dealt over tasks on either side.
    """
    shared = lambda side: hot_keys(pairs.groupBy(side).agg(F.count("*").alias("n")), side)
    both = salted_join(pairs.select("a", "b"), bags.select(F.col("number").alias("b"), F.col("tokens").alias("tokens_b")), "b", "a", shared("b"))
    both = salted_join(both, bags.select(F.col("number").alias("a"), F.col("tokens").alias("tokens_a")), "a", "b", shared("a"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(batch.column("tokens_a"), batch.column("tokens_b"), strict=True)
            mask = pa.array([overlap(np.asarray(x.values), np.asarray(y.values)) >= least for x, y in sides], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return both.select("a", "b", "tokens_a", "tokens_b").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """number, root: the smallest number of each number's connected component; links: a, b.

    Each round every number takes the smallest label among its neighbours, then that label's own label (pointer jumping),
    until nothing changes. A round is two grouped minima and joins on numbers, written to the shared folder.
    """
    both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "near-links")
    labels = written(both.groupBy(F.col("a").alias("number")).agg(F.least(F.min("b"), F.min("a")).alias("root")), "near-labels")
    hubs = hot_keys(both.groupBy("b").agg(F.count("*").alias("n")), "b")
    roots = None if hubs is None else hubs.withColumnRenamed("b", "next")  # what many are linked to soon is the label of many
    while True:
        near = salted_join(both, labels.select(F.col("number").alias("b"), "root"), "b", "a", hubs).groupBy(F.col("a").alias("number")).agg(F.min("root").alias("near"))
        lower = labels.join(near, "number").select("number", "root", F.least("root", "near").alias("next"))
        far = labels.select(F.col("number").alias("next"), F.col("root").alias("far"))
        jumped = salted_join(lower, far, "next", "number", roots, "left").select("number", F.coalesce(F.least("next", "far"), "next").alias("new"), "root")
        step = written(jumped, "near-labels")
        changed = step.filter("new < root").limit(1).count()
        labels = step.select("number", F.col("new").alias("root"))
        if not changed:
            return labels


def hub_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """Each number with its bucket's hub, the one with the most links so far, where that lies in another component.

    A hub has changed least from what the bucket's texts have in common, so it links most of those that are similar to any.
    members: key, number, root, n (rows of the key).
    """
    degree = links.select(F.explode(F.array("a", "b")).alias("number")).groupBy("number").agg(F.count("*").alias("degree"))
    known = members.join(degree, "number", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    hubs = written(known.groupBy("key").agg(F.max(F.struct("degree", (-F.col("number")).alias("n"), "root")).alias("hub"), F.count("*").alias("n")), "near-hubs-of")
    each = salted_join(known.drop("n"), hubs.drop("n"), "key", "number", hot_keys(hubs, "key")).filter(F.col("root") != F.col("hub.root"))
    return each.select(F.least(F.col("number"), -F.col("hub.n")).alias("a"), F.greatest(F.col("number"), -F.col("hub.n")).alias("b")).distinct()


def prefixes(sets: DataFrame, least: float = LEAST) -> DataFrame:
    """number, size, prefix: the rarest tokens of each set, one of which it must share with any set that is similar.

    Two sets of sizes m and n at similarity t or more have at least t / (1 + t) * (m + n) tokens in common. So in any order of
    all tokens, the first m + 1 less that many of one must meet the first n + 1 less that many of the other; prefix holds
    enough for partners of all sizes. The order is by counts of hashed tokens over all these texts, in CELLS counters (a
    fixed size, so they can be sent out): counts that fall together only make it a worse order, not a wrong one.
    """
    cell = F.pmod(F.col("t"), F.lit(CELLS))
    counts = sets.select(F.explode("tokens").alias("t")).groupBy(cell.cast("int").alias("cell")).agg(F.count("*").alias("n")).toArrow()
    table = np.zeros(CELLS, np.uint16)
    table[counts.column("cell").to_numpy()] = np.minimum(counts.column("n").to_numpy(), 65_535)
    shared = sets.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, out = [], []
            for tokens in batch.column("tokens"):
                t = np.asarray(tokens.values)
                k = len(t) - int(np.ceil(least * len(t) - 1e-9)) + 1
                order = np.lexsort((t, shared.value[t % CELLS]))[:k]
                sizes.append(len(t))
                out.append(mixed(t[order].view(np.uint64)).astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("number"), pa.array(sizes, pa.int64()), pa.array(out, pa.binary())], names=["number", "size", "prefix"])

    return sets.mapInArrow(run, "number long, size long, prefix binary")


def may_overlap(sizes: np.ndarray, prefix: np.ndarray, place: np.ndarray, i: int, others: np.ndarray, least: float) -> np.ndarray:
    """Which of others can be similar to i: do the two prefixes, at the lengths that their sizes call for, share a token?

    prefix: all prefixes one after the other; place: where each begins (and the last ends).
    """
    need = np.ceil(least / (1 + least) * (sizes[i] + sizes[others]) - 1e-9).astype(np.int64)
    mine = prefix[place[i] : place[i + 1]]
    order = np.argsort(mine, kind="stable")
    lengths = place[others + 1] - place[others]
    at = np.repeat(place[others], lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    theirs = prefix[at]
    hit = np.minimum(np.searchsorted(mine[order], theirs), len(mine) - 1)
    pair = np.repeat(np.arange(len(others)), lengths)
    rank = at - place[others][pair]
    ok = (mine[order][hit] == theirs) & (order[hit] < sizes[i] - need[pair] + 1) & (rank < sizes[others][pair] - need[pair] + 1)
    return np.bincount(pair[ok], minlength=len(others)) > 0


def blocked(tokens: DataFrame) -> DataFrame:
    """tokens (token, number, root, ...) once for each pair (low, high) of its token's blocks that the row's block is in.

    Only numbers of different components are to meet. A component with more than BLOCK / 2 rows of a token is dealt over
    blocks of its own of about so many rows by a hash of the number, and these do not meet each other; the rows of all
    smaller ones share mixed blocks, which meet all blocks. Tokens that one component holds are left out. Any two rows of a
    token and of different components meet in the group of their two blocks (or of their one mixed block).
    """
    half = BLOCK // 2
    each = tokens.groupBy("token", "root").agg(F.count("*").alias("n"))
    mixed_rows = F.sum(F.when(F.col("n") <= half, F.col("n")).otherwise(0))
    big = F.array_sort(F.collect_list(F.when(F.col("n") > half, F.struct("root", F.ceil(F.col("n") / half).cast("int").alias("blocks")))))
    shares = each.groupBy("token").agg(mixed_rows.alias("mixed"), F.count("*").alias("roots"), big.alias("big")).filter("roots > 1")
    shares = written(shares, "near-shares")
    hot = hot_keys(shares.select("token", (F.col("mixed") + F.aggregate("big", F.lit(0).cast("long"), lambda a, p: a + p["blocks"] * half)).alias("n")), "token")
    # Component -1 stands for the mixed blocks: one up to BLOCK rows, so that rare tokens are compared in one group.
    of_mixed = F.when(F.col("mixed") <= BLOCK, 1).otherwise(F.ceil(F.col("mixed") / half)).cast("int")
    shares = shares.select("token", F.when(F.col("mixed") > 0, F.array_insert("big", 1, F.struct(F.lit(-1).cast("long").alias("root"), of_mixed.alias("blocks")))).otherwise(F.col("big")).alias("parts"))
    dealt = salted_join(tokens, shares, "token", "number", hot)
    own = F.when(F.exists("parts", lambda p: p["root"] == F.col("root")), F.col("root")).otherwise(F.lit(-1).cast("long"))
    dealt = dealt.withColumn("part", own)
    dealt = dealt.withColumn("blocks", F.filter("parts", lambda p: p["root"] == F.col("part"))[0]["blocks"])
    dealt = dealt.withColumn("block", F.struct(F.col("part"), F.pmod(F.xxhash64("number"), F.col("blocks")).cast("int").alias("k")))
    met = F.filter("parts", lambda p: (p["root"] != F.col("part")) | (p["root"] == -1))
    blocks = F.flatten(F.transform(met, lambda p: F.transform(F.sequence(F.lit(0), p["blocks"] - 1), lambda k: F.struct(p["root"].alias("part"), k.alias("k")))))
    each = dealt.withColumn("other", F.explode(blocks))
    return each.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("parts", "part", "blocks", "other")


def prefix_pairs(members: DataFrame, least: float = LEAST) -> DataFrame:
    """Candidate pairs (a, b), once each, among members in different components that share a token of their prefixes.

    members: number, root, signature, size, prefix. Any two that are similar share a token at the prefix lengths that their
    sizes call for, so no pair is lost here; sizes, places and signatures rule out most others. Tokens held by one component
    only are dropped before signatures are joined; a token that many hold is dealt over blocks (see blocked).
    """
    floor = least - 6 * (least * (1 - least) / (BANDS * ROWS)) ** 0.5

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, root, size, prefix in zip(*(batch.column(c).to_pylist() for c in ("number", "root", "size", "prefix")), strict=True):
                tokens = np.frombuffer(prefix, np.uint32).astype(np.int64)
                n = len(tokens)
                columns = [tokens, np.full(n, number), np.full(n, root), np.full(n, size), np.arange(n)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["token", "number", "root", "size", "rank"])

    tokens = written(members.select("number", "root", "size", "prefix").mapInArrow(spread, "token long, number long, root long, size long, rank long"), "near-prefixes")
    rows = blocked(tokens).join(members.select("number", "signature"), "number")

    def compare(table: pa.Table) -> pa.Table:
        number, root, size, rank = (table.column(c).to_numpy() for c in ("number", "root", "size", "rank"))
        registers = np.array([np.frombuffer(x, np.uint16) for x in table.column("signature").to_pylist()])
        apart = table.column("low")[0].as_py() != table.column("high")[0].as_py()
        block = np.array([x == table.column("low")[0].as_py() for x in table.column("block").to_pylist()]) if apart else np.zeros(len(number), bool)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in range(len(number) - 1):
            some = np.flatnonzero((root[i + 1 :] != root[i]) & ~(apart & (block[i + 1 :] == block[i]))) + i + 1
            some = some[np.minimum(size[some], size[i]) >= least * np.maximum(size[some], size[i])]
            need = np.ceil(least / (1 + least) * (size[some] + size[i]) - 1e-9).astype(np.int64)
            some = some[(rank[i] <= size[i] - need) & (rank[some] <= size[some] - need)]
            some = some[(registers[some] == registers[i]).mean(1) >= floor]
            a.append(np.minimum(number[i], number[some]))
            b.append(np.maximum(number[i], number[some]))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return rows.groupBy("token", "low", "high").applyInArrow(compare, "a long, b long").distinct()


def bucket_pairs(members: DataFrame, marks: DataFrame, least: float = LEAST) -> DataFrame:
    """Candidate pairs of numbers that share a bucket and lie in different components.

    members: key, number, root, n (rows of the key) of buckets that hold several components; marks: number, signature, size, prefix.
    A pair is passed over if its sizes or prefixes rule it out, or if the share of registers that agree lies six standard
    errors under least. The numbers of buckets of more than LARGE are not compared bucket by bucket, but meet once by the
    tokens of their prefixes, which loses no pair that is similar.
    """
    floor = least - 6 * (least * (1 - least) / (BANDS * ROWS)) ** 0.5
    columns = ["key", "number", "root", "signature", "size", "prefix"]
    rest = members.filter(F.col("n") <= LARGE).join(marks, "number").select(columns)
    large = members.filter(F.col("n") > LARGE).groupBy("number").agg(F.min("root").alias("root"))
    large = written(large.join(marks, "number"), "near-large")

    def compare(table: pa.Table) -> pa.Table:
        number, root, size = (table.column(c).to_numpy() for c in ("number", "root", "size"))
        registers = np.array([np.frombuffer(x, np.uint16) for x in table.column("signature").to_pylist()])
        prefix = [np.frombuffer(x, np.uint32) for x in table.column("prefix").to_pylist()]
        place = np.concatenate(([0], np.cumsum([len(x) for x in prefix])))
        prefix = np.concatenate(prefix)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in range(len(number) - 1):
            some = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1
            some = some[np.minimum(size[some], size[i]) >= least * np.maximum(size[some], size[i])]
            some = some[(registers[some] == registers[i]).mean(1) >= floor]
            if len(some):
                some = some[may_overlap(size, prefix, place, i, some, least)]
            a.append(np.minimum(number[i], number[some]))
            b.append(np.maximum(number[i], number[some]))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return rest.groupBy("key").applyInArrow(compare, "a long, b long").union(prefix_pairs(large, least)).distinct()


def grouped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """A row for each document: doc_id, digest, size, row, number (of its text), root (the smallest number of its group).

    Groups are the connected components of the links between different texts; texts without words are alone.
    Equal texts count once from the first step on, so copies never meet as pairs. The bags of all texts that share a bucket
    with another are made once. First each text is verified against the smallest number of each of its buckets, then against their hubs; then, in buckets that still hold several components, all pairs between components that sizes, prefixes and
    signatures do not rule out.
    """
    rows = written(signed(docs, doc_id, text).withColumn("row", F.monotonically_increasing_id()), "near-signatures")
    reps = written(rows.filter("size > 0").groupBy("digest").agg(F.min("row").alias("number"), F.count("*").alias("n")), "near-texts")
    own = rows.join(reps.select(F.col("number").alias("row")), "row", "left_semi")
    keyed = written(own.select(F.explode("bands").alias("key"), F.col("row").alias("number"), "size"), "near-keys")
    stars = written(keyed.groupBy("key").agg(F.min(F.struct("number", "size")).alias("star"), F.count("*").alias("n")).filter("n > 1"), "near-stars")
    meets = written(salted_join(keyed, stars.drop("n"), "key", "number", hot_keys(stars, "key")).select("key", "number", "size", "star"), "near-buckets")
    bags = bag_tables(docs, own.join(meets.select(F.col("number").alias("row")).distinct(), "row").select(F.col("row").alias("number"), "doc_id", "digest"), doc_id, text)
    fits = F.least("size", "star.size") >= F.lit(least) * F.greatest("size", "star.size")  # else the overlap is too small at any rate
    pairs = written(meets.filter(F.col("star.number") != F.col("number")).filter(fits).select(F.col("star.number").alias("a"), F.col("number").alias("b")).distinct(), "near-pairs")

    links = written(verified(pairs, bags, least), "near-found")
    labels = components(links)

    def several(labels: DataFrame) -> DataFrame:
        """key, number, root, n of the buckets that still hold several components."""
        rooted = meets.select("key", "number").join(labels, "number", "left").select("key", "number", F.coalesce("root", "number").alias("root"))
        rooted = written(rooted, "near-rooted")
        keys = rooted.groupBy("key").agg((F.max("root") != F.min("root")).alias("several"), F.count("*").alias("n")).filter("several").select("key", "n")
        keys = written(keys, "near-several")
        return written(salted_join(rooted, keys, "key", "number", hot_keys(keys, "key")), "near-members")

    members = several(labels)
    new = written(hub_pairs(members, links).join(pairs, ["a", "b"], "left_anti"), "near-hubs")
    found = written(verified(new, bags, least), "near-found")
    if found.limit(1).count():
        links = links.union(found)
        labels = components(links)
        members = several(labels)
    rarest = prefixes(bags.join(members.select("number").distinct(), "number"), least)
    marks = written(own.select(F.col("row").alias("number"), "signature").join(rarest, "number"), "near-marks")
    more = written(bucket_pairs(members, marks, least).join(pairs.union(new), ["a", "b"], "left_anti"), "near-more")
    if more.limit(1).count():
        labels = components(links.union(written(verified(more, bags, least), "near-found")))
    out = salted_join(rows.filter("size > 0").drop("bands", "signature"), reps.drop("n"), "digest", "row", hot_keys(reps, "digest")).join(labels, "number", "left")
    out = out.select("doc_id", "digest", "size", "row", "number", F.coalesce("root", "number").alias("root"))
    blank = rows.filter("size = 0").select("doc_id", "digest", "size", "row", F.col("row").alias("number"), F.col("row").alias("root"))
    return out.unionByName(blank)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """A row for each document: doc_id, group_id (the smallest doc_id of its group), first (is it the row that would stay).

    Two documents are linked if their multisets of five-word shingles overlap by at least least (weighted Jaccard); a group
    is a connected component. Equal texts are in one group. A null or empty text, or one of white space, is a group of its
    own; a null doc_id is larger than any; repeated rows share a group. Extra columns are not carried.
    """
    rows = written(grouped(docs, doc_id, text, least), "near-groups")
    groups = rows.groupBy("root").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("members"))
    several = written(groups.filter("members > 1"), "near-several")
    hot = hot_keys(several.select("root", F.col("members").alias("n")), "root")
    out = salted_join(rows, several, "root", "row", hot, "left")
    return out.select("doc_id", F.when(F.col("members").isNull(), F.col("doc_id")).otherwise(F.col("group_id")).alias("group_id"), (F.col("row") == F.col("root")).alias("first"), F.coalesce("members", F.lit(1)).alias("members"))


def keep_one(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """One document of each group; columns and texts stay as they are. doc_id and text are read under these names.

    The first row of each group stays: it is found again by doc_id and digest. Rows whose text has no row that goes pass
    straight through, and of the others those that are no first row go at once, both by bit tables; only what is left (the first
    rows, and a few that share their bits) is shuffled to the exact join. Where rows repeat doc_id and text, the one
    stays whose other columns, as JSON, come first.
    """
    rows = written(grouped(docs, least=least).withColumn("_hex", F.lower(F.hex("digest"))), "near-groups")
    rows = rows.withColumns({"_text": F.xxhash64("_hex"), "_key": F.xxhash64("doc_id", "_hex"), "_stays": F.col("row") == F.col("root")})
    going = bit_table(rows.filter("not _stays").select("_text"), "_text")
    stays = with_bit(rows.filter("_stays"), going, "_text", "_may").filter("_may")
    stays = written(stays.select(F.col("doc_id").alias("_id"), F.col("_hex").alias("_of"), "_key", (F.coalesce("size", F.lit(0)) == 0).alias("_blank")), "near-kept")
    first = bit_table(stays, "_key")
    inner = docs.select(whole_row(docs).alias("_row"), F.col("doc_id").alias("_doc"), F.md5(F.col("text").cast("binary")).alias("_hex"))
    inner = inner.withColumns({"_text": F.xxhash64("_hex"), "_key": F.xxhash64("_doc", "_hex")})
    marked = with_bit(inner, going, "_text", "_may")
    at_once = marked.filter("not _may").select("_row.*")
    asked = with_bit(marked.filter("_may"), first, "_key", "_first").filter("_first")
    exact = stays.groupBy("_id", "_of").agg(F.max("_blank").alias("_blank"))
    same = asked["_hex"].eqNullSafe(exact["_of"]) & asked["_doc"].eqNullSafe(exact["_id"])
    found = asked.join(exact, same)
    # A row without words stays each time; of others with equal doc_id and text, one does.
    others = [F.col("_row")[c].alias(c) for c in docs.columns if c not in ("doc_id", "text")]
    order = F.to_json(F.struct(*others)) if others else F.lit("")
    once = found.filter("not _blank").groupBy("_doc", "_hex").agg(F.min_by("_row", order).alias("_row"))
    return at_once.unionByName(found.filter("_blank").select("_row.*")).unionByName(once.select("_row.*"))
