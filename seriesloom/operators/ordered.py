"""Running sums and nearest values along an order, where one key may hold most of the rows, or all of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import kept

PART = "_part"


def running(df: DataFrame, keys: list[str], order: list[str], sums: tuple[str, ...] = (), last: tuple[str, ...] = (), following: tuple[str, ...] = ()) -> DataFrame:
    """df with, for each row, over the rows of its keys in the order of the columns order: c + "_sum" (of those up to it), c + "_last" (the nearest
    known value at it or before) and c + "_next" (at it or behind) for the named columns. Null sums count 0; keys may be null; no keys: one order of all rows.

    Rows are dealt over tasks by ranges of keys and order, so a key's rows lie in as many parts as they fill, and the parts are written, as they must
    not change between the steps. Sums and end values of each part and key are carried from part to part; only a key that a part shares
    with the one beside it has anything carried, so at most two rows for each part are broadcast. Equal rows stay in one part.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = kept(df.repartitionByRange(parts, *keys, *order).withColumn(PART, F.spark_partition_id()), "ranges")
    at = F.struct(*order)
    ends = [F.sum(c).alias(f"_sum_{c}") for c in sums] + [F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"_last_{c}") for c in last] + [F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"_next_{c}") for c in following]
    totals = dealt.groupBy(PART, *keys).agg(*ends)
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy(*keys).orderBy(F.desc(PART)).rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.sum(f"_sum_{c}").over(before).alias(f"_s_{c}") for c in sums] + [F.last(f"_last_{c}", True).over(before).alias(f"_l_{c}") for c in last] + [F.last(f"_next_{c}", True).over(behind).alias(f"_n_{c}") for c in following]
    names = [f"_s_{c}" for c in sums] + [f"_l_{c}" for c in last] + [f"_n_{c}" for c in following]
    known = reduce(Column.__or__, [F.col(n).isNotNull() for n in names])
    offsets = totals.select(F.col(PART).alias("_of"), *[F.col(k).alias(f"_k_{k}") for k in keys], *carried).filter(known)
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], F.col(PART) == F.col("_of"))
    joined = dealt.join(F.broadcast(offsets), same, "left")
    within = Window.partitionBy(PART, *keys)
    up, down = within.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0), within.orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = {f"{c}_sum": zero(F.sum(c).over(up)) + zero(F.col(f"_s_{c}")) for c in sums}
    out |= {f"{c}_last": F.coalesce(F.last(c, True).over(up), F.col(f"_l_{c}")) for c in last}
    out |= {f"{c}_next": F.coalesce(F.last(c, True).over(down), F.col(f"_n_{c}")) for c in following}
    return joined.withColumns(out).select(*df.columns, *out)
