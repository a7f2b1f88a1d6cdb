"""Columns of callers whose names need care."""

from pyspark.sql import functions as F


def with_odd_columns(df, key="doc_id"):
    """df with columns named with blanks, dots, hyphens, back-ticks, and with nested fields of such names."""
    n = F.col(key).cast("string")
    for name in ("my col", "a.b", "x-y", "lang_pred", "p_doc", "score_", "_row_", "back`tick"):
        df = df.withColumn(name, F.concat(F.lit(name), n))
    return df.withColumn("nest", F.struct(n.alias("in side"), F.struct(n.alias("d.e"), F.lit(1).alias("f-g")).alias("deep er")))


def as_rows(df):
    return sorted(str(r.asDict(True)) for r in df.collect())
