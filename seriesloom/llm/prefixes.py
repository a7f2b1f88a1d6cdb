"""The trie of conversation prefixes, with prefixes that a count-min sketch proves to be alone kept out of the shuffles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, salted_join, small_batches, written

#: Every conversation begins with the first turns (up to OPENING - 1) of the conversation at the multiple of FAMILY below it.
FAMILY, OPENING = 20, 4
#: Digests of prefixes are polynomials of the turns' digests modulo a prime, so parts of a conversation can be digested apart and joined.
PRIME, BASE, BYTES = (1 << 127) - 1, 0x5851F42D4C957F2D14057B7EF767814F, 16
ROOT = bytes(BYTES)
#: Rows of the sketch; cells of a row: eight for each prefix, but no more than the most (so 4 x 32 MB are the most that is broadcast).
SKETCH_ROWS, MOST_CELLS, CHUNK = 4, 1 << 25, 1 << 16
#: Ids that are joined at a time for the digest of a node's ends.
JOINED_IDS = 50_000
NUMBERED = "part int, conv_id long, k long, before binary, after binary, words long, total long"
PLACED = "conv_id long, k long, before binary, after binary, words long, total long"
NODES = "conv_id long, depth long, node binary, parent binary, words long, total long, all_words long, last boolean"


def number(raw: bytes) -> int:
    return int.from_bytes(raw, "big")


def joined(head: int, n: int, tail: int) -> bytes:
    """The digest of a sequence from that of its head and that of the n turns after it."""
    return ((head * pow(BASE, n, PRIME) + tail) % PRIME).to_bytes(BYTES, "big")


def turn_digest(role: bytes, text: bytes) -> int:
    return number(hashlib.sha256(len(role).to_bytes(8, "big") + role + text).digest()[:BYTES]) % PRIME


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(names))


def numbered(turns: DataFrame) -> DataFrame:
    """NUMBERED rows: turns dealt by ranges of (conv_id, turn, role, text), so a long conversation lies in several parts; places, digests and words within the part."""
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text"]
    dealt = turns.repartitionByRange(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, conv, k, value, total = TaskContext.get().partitionId(), None, 0, ROOT, 0
        for batch in batches:
            rows = []
            for c, role, text in zip(*(batch.column(name).to_pylist() for name in ("conv_id", "role", "text")), strict=True):
                if c != conv:
                    conv, k, value, total = c, 0, ROOT, 0
                before, raw = value, text.encode()
                value, k, words = joined(number(before), 1, turn_digest(role.encode(), raw)), k + 1, len(raw.split())
                total += words
                rows.append((part, c, k, before, value, words, total))
            if rows:
                yield batch_of(rows, NUMBERED)

    return dealt.mapInArrow(run, NUMBERED)


def placed(parts: DataFrame) -> DataFrame:
    """PLACED rows: places, digests and words within the whole conversation. The driver sees two rows of each part at most."""
    edges = sorted(map(tuple, parts.groupBy("part").agg(F.min("conv_id"), F.max("conv_id")).collect()))
    spread = sorted({a[2] for a, b in zip(edges, edges[1:], strict=False) if a[2] == b[1]})
    if not spread:
        return parts.drop("part")
    some = parts.join(F.broadcast(parts.sparkSession.createDataFrame([(c,) for c in spread], "conv_id long")), "conv_id")
    sums = some.groupBy("conv_id", "part").agg(F.max("k").alias("k"), F.max_by("after", "k").alias("after"), F.max("total").alias("total")).collect()
    offsets, conv = {}, None
    for r in sorted(sums):
        if r.conv_id != conv:
            conv, k, value, total = r.conv_id, 0, ROOT, 0
        offsets[r.part, conv] = k, number(value), total
        k, value, total = k + r.k, joined(number(value), r.k, number(r.after)), total + r.total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for part, conv, k, before, after, words, total in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                k0, head, total0 = offsets.get((part, conv), (0, 0, 0))
                if k0:
                    before, after = joined(head, k - 1, number(before)), joined(head, k, number(after))
                rows.append((conv, k + k0, before, after, words, total + total0))
            if rows:
                yield batch_of(rows, PLACED)

    return parts.select(*[c.split()[0] for c in NUMBERED.split(", ")]).mapInArrow(run, PLACED)


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations: conv_id, turns, words; NODES rows: a row for each turn of each rebuilt conversation). Both are written."""
    opening = lambda c: F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(OPENING))
    own = placed(written(numbered(turns), "numbered-turns"))
    first = F.collect_list(F.when(F.col("k") < OPENING, F.struct("k", "before", "after", "words", "total")))
    convs = written(own.groupBy("conv_id").agg(F.max("k").alias("n"), F.max("total").alias("total"), first.alias("first")).withColumn("opening", opening(F.col("conv_id"))), "conversations")
    bases = convs.select(F.col("conv_id").alias("base"), F.col("first").alias("of_base"))
    taken = lambda c: F.array_sort(F.filter(c, lambda x: x["k"] <= F.col("opening")))
    both = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).join(bases, "base", "left").select("conv_id", "n", "total", "opening", taken(F.coalesce("of_base", F.array().cast(convs.schema["first"].dataType))).alias("head"), taken(F.col("first")).alias("left"))
    at_end = lambda c, field, none: F.when(F.size(c) > 0, F.element_at(c, -1)[field]).otherwise(F.lit(none))
    starts = both.select(
        "conv_id", "opening", "head", F.size("head").cast("long").alias("n_head"), at_end("head", "after", ROOT).alias("head_digest"), at_end("head", "total", 0).alias("head_words"), at_end("left", "after", ROOT).alias("left_digest"), at_end("left", "total", 0).alias("left_words"),
        (F.size("head") + F.greatest(F.col("n") - F.col("opening"), F.lit(0))).cast("long").alias("turns"),
    ).withColumn("words", F.col("head_words") - F.col("left_words"))
    starts = written(starts.join(convs.select("conv_id", "total"), "conv_id").withColumn("words", F.col("words") + F.col("total")).drop("total"), "openings")
    heads = starts.select("conv_id", F.explode("head").alias("x"), "turns", F.col("words").alias("all_words")).select("conv_id", F.col("x.k").alias("depth"), F.lit(0).cast("long").alias("past"), "x.before", "x.after", F.lit(ROOT).alias("head_digest"), F.lit(ROOT).alias("left_digest"), "x.words", "x.total", "all_words", "turns")
    hot = hot_keys(convs, "conv_id")
    rest = salted_join(own.filter(F.col("k") > opening(F.col("conv_id"))), starts.drop("head").withColumnRenamed("words", "all_words"), "conv_id", "k", hot)
    rest = rest.withColumn("past", F.col("k") - F.col("opening")).select("conv_id", (F.col("n_head") + F.col("past")).alias("depth"), "past", "before", "after", "head_digest", "left_digest", "words", (F.col("head_words") + F.col("total") - F.col("left_words")).alias("total"), "all_words", "turns")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, depth, past, before, after, head, left, words, total, all_words, turns in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if past and head != left:  # the conversation's own first turns are exchanged for others
                    other = number(head) - number(left)
                    before, after = joined(other, past - 1, number(before)), joined(other, past, number(after))
                rows.append((conv, depth, after, before, words, total, all_words, depth == turns))
            if rows:
                yield batch_of(rows, NODES)

    return starts.select("conv_id", "turns", "words"), written(heads.unionByName(rest).mapInArrow(run, NODES), "prefixes")


def cells_of(digests: pa.Array, bits: int) -> np.ndarray:
    """The cell of each digest in each row of a sketch with 2 ** bits cells."""
    raw = np.frombuffer(b"".join(digests.to_pylist()), "<u8").reshape(-1, 2)
    return (raw[:, :1] + np.arange(SKETCH_ROWS, dtype=np.uint64) * (raw[:, 1:] | np.uint64(1)) >> np.uint64(64 - bits)).astype(np.int64).T


def sketch(nodes: DataFrame, bits: int) -> np.ndarray:
    """The count-min sketch of all prefixes, whose counters stop at 2: as that is all that is asked of it, a byte holds one.

    Each task fills a sketch and gives the chunks that are not empty; chunks are added up over tasks. Only its fixed size meets at the driver.
    """
    whole = SKETCH_ROWS << bits
    step = min(CHUNK, whole)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((SKETCH_ROWS, 1 << bits), np.uint8)
        for batch in batches:
            for row, cells in zip(seen, cells_of(batch.column(0), bits), strict=True):
                some, n = np.unique(cells, return_counts=True)
                row[some] = np.minimum(row[some] + n, 2)
        for chunk, values in enumerate(seen.reshape(-1, step)):
            if values.any():
                yield batch_of([(chunk, values.tobytes())], "chunk int, seen binary")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = None, np.zeros(step, np.uint8)
        for batch in batches:
            for chunk, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if chunk != held:
                    if held is not None:
                        yield batch_of([(held, total.tobytes())], "chunk int, seen binary")
                    held, total = chunk, np.zeros(step, np.uint8)
                total = np.minimum(total + np.frombuffer(values, np.uint8), 2)
        if held is not None:
            yield batch_of([(held, total.tobytes())], "chunk int, seen binary")

    filled = nodes.select("node").mapInArrow(fill, "chunk int, seen binary")
    out = np.zeros((whole // step, step), np.uint8)
    for r in filled.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(add, "chunk int, seen binary").toLocalIterator():
        out[r.chunk] = np.frombuffer(r.seen, np.uint8)
    return out.reshape(SKETCH_ROWS, 1 << bits)


def screened(nodes: DataFrame, bits: int | None = None) -> DataFrame:
    """nodes with alone (the sketch proves that no other conversation has the prefix) and parent_alone. Written."""
    if bits is None:
        bits = int(np.clip((8 * nodes.count()).bit_length(), 10, MOST_CELLS.bit_length() - 1))
    shared = nodes.sparkSession.sparkContext.broadcast(sketch(nodes, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                seen = shared.value
                once = lambda name: np.min([row[c] for row, c in zip(seen, cells_of(batch.column(name), bits), strict=True)], axis=0) == 1  # noqa: B023, E731
                above = once("parent") & (np.array(batch.column("depth")) > 1)
                # What follows a prefix that is alone is alone, whatever the sketch says of it.
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(once("node") | above), pa.array(above)], names=[*batch.schema.names, "alone", "parent_alone"])

    return written(nodes.mapInArrow(run, f"{NODES}, alone boolean, parent_alone boolean"), "screened-prefixes")


def ends_digests(ends: DataFrame) -> DataFrame:
    """node, ends_sha256 of ends (node, conv_id): the digest of each node's ids in ascending order, with commas between.

    Ids are dealt by ranges, so those of one node lie in several tasks, which join them to long strings; one task reads a node's strings in
    order and digests them as they come, as such a digest can only be computed in order. No node's ids are held at once.
    """
    dealt = ends.select("node", "conv_id").repartitionByRange(int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions")), "node", "conv_id").sortWithinPartitions("node", "conv_id")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []
        for batch in batches:
            for v, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if ids and (v != node or len(ids) >= JOINED_IDS):
                    yield batch_of([(node, ids[0], ",".join(map(str, ids)))], "node binary, first long, ids string")
                    ids = []
                node = v
                ids.append(c)
        if ids:
            yield batch_of([(node, ids[0], ",".join(map(str, ids)))], "node binary, first long, ids string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, value = None, hashlib.sha256()
        for batch in batches:
            rows = []
            for v, ids in zip(batch.column("node").to_pylist(), batch.column("ids"), strict=True):
                if v != node:
                    if node is not None:
                        rows.append((node, value.hexdigest()))
                    node, value = v, hashlib.sha256()
                else:
                    value.update(b",")
                value.update(ids.as_py().encode())
            if rows:
                yield batch_of(rows, "node binary, ends_sha256 string")
        if node is not None:
            yield batch_of([(node, value.hexdigest())], "node binary, ends_sha256 string")

    return dealt.mapInArrow(join, "node binary, first long, ids string").repartition("node").sortWithinPartitions("node", "first").mapInArrow(run, "node binary, ends_sha256 string")


def trie(conversations: DataFrame, bits: int | None = None) -> DataFrame:
    """The nodes of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn (null first), then role and text; null roles and texts are empty. Rows without a conv_id take no part. Repeated rows
    are turns of their own. A conversation is rebuilt from the first h turns of the one at the multiple of 20 below it (toward zero) and its own
    after the first h; h: crc32 of its id, modulo 4. Extra columns are not carried. An empty table gives no rows, not even a root.

    A count-min sketch of all prefixes tells most of those that only one conversation has; their rows are given out where they stand. The others
    are grouped exactly. A node belongs to its smallest member, so a conversation's own nodes are all from some depth on: sums over a subtree are
    sums over its members' own parts, and no node meets its descendants. Hot prefixes and conversations are dealt over tasks.
    """
    spark = conversations.sparkSession
    small_batches(spark)
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    convs, nodes = rebuilt(conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", empty("role"), empty("text")))
    whole = convs.agg(F.count("*").alias("n"), F.min("conv_id").alias("first"), F.sum("words").alias("words"), F.count_if(F.col("turns") == 0).alias("n_ends")).first()
    marked = screened(nodes, bits)
    shared, border = marked.filter("not alone"), F.col("alone") & ~F.col("parent_alone")
    of = lambda c: F.max(c).alias(c)
    groups = written(shared.groupBy("node").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("owner"), of("depth"), of("words"), of("total"), of("parent"), F.sum("all_words").alias("all_words"), F.count_if("last").alias("n_ends"), F.min(F.when(F.col("last"), F.col("conv_id"))).alias("first_end")), "shared-prefixes")
    children = written(groups.select("parent").unionAll(marked.filter(border).select("parent")).groupBy("parent").agg(F.count("*").alias("n_children")), "children")
    told = written(salted_join(shared.select("node", "conv_id", "depth", "total", "last"), groups.select("node", "owner", "n_ends"), "node", "conv_id", hot_keys(groups.select("node", F.col("n_convs").alias("n")), "node")), "owners")
    others = told.filter("owner != conv_id").groupBy("conv_id").agg(F.max("total").alias("others"))
    counted = groups.join(children.withColumnRenamed("parent", "node"), "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    leaves = counted.filter("n_children = 0").select(F.col("owner").alias("conv_id")).unionAll(marked.filter("alone and last").select("conv_id")).withColumn("leaf", F.lit(1).cast("long"))
    own = written(convs.join(others, "conv_id", "left").join(leaves, "conv_id", "left").select("conv_id", "words", (F.col("words") - F.coalesce("others", F.lit(0))).alias("own"), F.coalesce("leaf", F.lit(0).cast("long")).alias("leaf")), "own-parts")
    hot = hot_keys(told.groupBy("conv_id").agg(F.count("*").alias("n")), "conv_id")
    mine = lambda c: F.sum(F.when(F.col("owner") == F.col("conv_id"), F.col(c)))
    sums = salted_join(told, own, "conv_id", "depth", hot).groupBy("node").agg(F.sum("own").alias("own"), F.sum("leaf").alias("n_leaves"), mine("own").alias("owner_own"), mine("words").alias("owner_words"))
    above = F.col("total") - F.col("words")
    ends = ends_digests(told.filter("last and n_ends > 1").unionByName(convs.filter("turns = 0").select("conv_id", F.lit(ROOT).alias("node")), allowMissingColumns=True))
    sha = lambda c: F.sha2(c.cast("string").cast("binary"), 256)
    nothing = sha(F.lit(""))
    exact = counted.join(sums, "node").join(ends, "node", "left").select(
        "node", "parent", F.col("owner").alias("conv_id"), "depth", "n_convs", "n_children", "n_leaves",
        (F.col("all_words") - F.col("n_convs") * above - (F.col("own") - F.col("owner_own") + F.col("owner_words") - above)).alias("saved_tokens"),
        F.when(F.col("n_ends") == 0, nothing).when(F.col("n_ends") == 1, sha(F.col("first_end"))).otherwise(F.col("ends_sha256")).alias("ends_sha256"),
    )
    one = lambda n: F.lit(n).cast("long")
    tails = marked.filter("alone").select("node", "parent", "conv_id", "depth", one(1).alias("n_convs"), F.when(F.col("last"), one(0)).otherwise(one(1)).alias("n_children"), one(1).alias("n_leaves"), one(0).alias("saved_tokens"), F.when(F.col("last"), sha(F.col("conv_id"))).otherwise(nothing).alias("ends_sha256"), "parent_alone")
    asking = exact.withColumn("parent_alone", F.lit(False)).unionByName(tails.filter(~F.col("parent_alone")))
    parents = groups.select(F.col("node").alias("parent"), F.col("owner").alias("parent_owner"))
    deeper = salted_join(asking.filter("depth > 1"), parents, "parent", "node", hot_keys(children.select("parent", F.col("n_children").alias("n")), "parent"), "left").withColumn("parent_conv_id", F.coalesce("parent_owner", "conv_id"))
    top = asking.filter("depth = 1").withColumn("parent_conv_id", one(whole["first"]))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    below = tails.filter("parent_alone").withColumn("parent_conv_id", F.col("conv_id")).select(columns).unionByName(deeper.select(columns)).unionByName(top.select(columns))
    root = own.agg(F.sum("own").alias("own"), F.sum("leaf").alias("leaf")).filter("own is not null").withColumn("node", F.lit(ROOT)).join(F.broadcast(children.filter(F.col("parent") == ROOT)).withColumnRenamed("parent", "node"), "node", "left").join(ends, "node", "left")
    root = root.select(one(whole["first"]).alias("conv_id"), one(0).alias("depth"), one(None).alias("parent_conv_id"), one(whole["n"]).alias("n_convs"), F.coalesce("n_children", one(0)).alias("n_children"), F.greatest("leaf", one(1)).alias("n_leaves"), (one(whole["words"]) - F.col("own")).alias("saved_tokens"), F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
    return below.unionByName(root)
