"""What the operators of this subpackage share: scratch tables, joins that bear hot keys, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import kept as written
from ..sources.scratch import scratch_path as scratch

#: Rows of a lookup table that may be broadcast; its rows are narrow (under about 200 bytes), so this is at most 20 MB.
BROADCAST_ROWS = 100_000
#: A key is hot if it has at least one row in so many; so there are at most so many hot keys.
HOT_SHARE = 1_000
#: Rows of a table of bits, and 64-bit numbers of each.
BIT_CELLS, BIT_WORDS = 1 << 15, 64
#: Rows of a batch of texts for Python.
BATCH_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python workers in batches of few rows, so that long ones fit in memory.

    The setting is the session's, and plans read it when they run: so it is the same for all operators.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def free_name(df: DataFrame, name: str) -> str:
    """A column name like name that df does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole_row(df: DataFrame) -> Column:
    """A struct of all columns of df, whatever their names."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`").alias(c) for c in df.columns])


def hot_keys(counts: DataFrame, key: str) -> DataFrame | None:
    """key, _salts of the keys with more than one in HOT_SHARE of all rows (so fewer than HOT_SHARE keys); None if there are none.

    counts: key, n. _salts: over how many tasks to deal a key, one for each such share.
    """
    whole = counts.filter(F.col(key).isNotNull()).agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
    share = max(1, (whole["n"] or 0) // HOT_SHARE)
    if (whole["most"] or 0) <= share:
        return None
    some = counts.filter((F.col("n") > share) & F.col(key).isNotNull())
    return written(some.select(key, F.ceil(F.col("n") / share).cast("int").alias("_salts")).coalesce(1), "hot-keys")


def salted_join(rows: DataFrame, lookup: DataFrame, key: str, by: str | list[str], hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """rows with the columns of lookup, which has one row for each key, where any key may hold most of rows.

    The rows of a key of hot (see hot_keys) are dealt over as many tasks as it has salts, by a hash of by (columns that tell its rows apart), and its row of
    lookup is repeated for them (at most 2 * HOT_SHARE rows more).
    """
    if hot is None:
        return rows.join(lookup, key, how)
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", F.pmod(F.xxhash64(*([by] if isinstance(by, str) else by)), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    each = lookup.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return dealt.join(each, [key, "_salt"], how).drop("_salt")


def bit_table(hashes: DataFrame, name: str) -> DataFrame:
    """A bit for each hash in column name, in BIT_CELLS rows of BIT_WORDS numbers: of a fixed size (16 MB), so it can be broadcast.

    It may say of a few other hashes that they are in it; with more and more hashes, of all. What it is asked for only spares
    rows a shuffle to an exact join.
    """
    bit = F.pmod(F.shiftright(name, 20), F.lit(64 * BIT_WORDS)).cast("int")
    words = hashes.select(F.pmod(name, F.lit(BIT_CELLS)).alias("_cell"), F.floor(bit / 64).cast("int").alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit % 64).alias("_bits"))
    words = words.groupBy("_cell", "_word").agg(F.bit_or("_bits").alias("_bits"))
    cells = words.groupBy("_cell").agg(F.map_from_entries(F.collect_list(F.struct("_word", "_bits"))).alias("_bits"))
    return cells.select("_cell", F.transform(F.sequence(F.lit(0), F.lit(BIT_WORDS - 1)), lambda i: F.coalesce(F.element_at("_bits", i), F.lit(0).cast("long"))).alias("_bits"))


def with_bit(rows: DataFrame, bits: DataFrame, name: str, out: str) -> DataFrame:
    """Adds out: may the hash in column name be in the bit table?"""
    bit = F.pmod(F.shiftright(name, 20), F.lit(64 * BIT_WORDS)).cast("int")
    held = rows.withColumn("_cell", F.pmod(name, F.lit(BIT_CELLS))).join(F.broadcast(bits), "_cell", "left")
    word = F.element_at("_bits", F.floor(bit / 64).cast("int") + 1)
    return held.withColumn(out, F.coalesce(F.getbit(word, bit % 64), F.lit(0)) == 1).drop("_cell", "_bits")


def lookup_join(rows: DataFrame, lookup: DataFrame, key: str, by: str | list[str], n: str) -> DataFrame:
    """Left join to a written table with one row for each key, whose column n says how many rows have it.

    A table of up to BROADCAST_ROWS rows is broadcast; beyond that both are shuffled, with hot keys dealt over tasks.
    """
    if lookup.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(lookup), key, "left")
    return salted_join(rows, lookup, key, by, hot_keys(lookup.select(key, F.col(n).alias("n")), key), "left")


def fold(doc_id: Column, mod: int) -> Column:
    """crc32 of doc_id as text, modulo mod; a null doc_id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod
