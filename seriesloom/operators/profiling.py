"""Profiling of long-format observation tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ordered


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count") for name, df in tables.items()])


def doc_family_counts(docs: DataFrame) -> DataFrame:
    """family (what stands before the colon of doc_type), n"""
    return docs.groupBy(F.substring_index("doc_type", ":", 1).alias("family")).agg(F.count("*").alias("n"))


def series_coverage(meta: DataFrame, obs: DataFrame) -> DataFrame:
    """Counts and date range of each series of meta, 0 for those without observations."""
    seen = obs.groupBy("series_id").agg(F.count("*").alias("n"), F.min("date").alias("earliest"), F.max("date").alias("latest"))
    return meta.join(seen, "series_id", "left").select("series_id", "name", "category", "frequency", F.coalesce("n", F.lit(0)).alias("obs_count"), "earliest", "latest")


def gap_report(meta: DataFrame, obs: DataFrame, frequency: str = "monthly", lo: int = 25, hi: int = 35) -> DataFrame:
    """Days between neighbouring observations of series of one frequency: extremes, mean (1 digit), and counts beyond lo and hi."""
    some = obs.join(meta.filter(F.col("frequency") == frequency).select("series_id"), "series_id")
    gap = F.datediff("date", F.lag("date").over(ordered(["series_id"], "date")))
    return some.select("series_id", gap.alias("gap")).groupBy("series_id").agg(F.count("*").alias("total_obs"), F.count_if(F.col("gap") > hi).alias("gaps_over"), F.count_if(F.col("gap") < lo).alias("gaps_under"), F.min("gap").alias("min_gap_days"), F.max("gap").alias("max_gap_days"), F.round(F.avg("gap"), 1).alias("avg_gap_days"))


def value_distribution(meta: DataFrame, obs: DataFrame, digits: int = 2, median: bool = False) -> DataFrame:
    extra = [F.percentile_approx("value", 0.5).alias("median_val")] if median else []
    seen = obs.groupBy("series_id").agg(F.count("*").alias("n"), F.min("value").alias("min_val"), F.max("value").alias("max_val"), F.round(F.avg("value"), digits).alias("mean_val"), *extra)
    return meta.select("series_id", "name", "units").join(seen, "series_id")


def yearly_counts(obs: DataFrame) -> DataFrame:
    return obs.groupBy("series_id", F.year("date").alias("year")).agg(F.count("*").alias("obs_count"))


def duplicate_check(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("dupes")).filter("dupes > 1")


def latest_n_per_series(meta: DataFrame, obs: DataFrame, n: int = 3) -> DataFrame:
    """The n latest observations of each series; the limit on the rank prunes each task's rows before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("date")))
    last = obs.withColumn("_n", rank).filter(F.col("_n") <= n)
    return last.join(meta.select("series_id", "name"), "series_id").select("series_id", "name", "date", "value")


def category_summary(meta: DataFrame, obs: DataFrame) -> DataFrame:
    """Series, observations and date range by category; observations are first summed up by series."""
    seen = obs.groupBy("series_id").agg(F.count("*").alias("n"), F.min("date").alias("a"), F.max("date").alias("b"))
    return meta.join(seen, "series_id").groupBy("category").agg(F.count("*").alias("series_count"), F.sum("n").alias("total_obs"), F.min("a").alias("earliest"), F.max("b").alias("latest"))
