"""Replacing a shock window of each series by a forecast, with a taper back to what was seen."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import month_of
from .arima import arima_forecasts

KEYS = ["panel", "series_id"]


def date_of(text: str) -> Column:
    return F.lit(text).cast("date")


def inside(start: str, end: str, on: str = "date") -> Column:
    return F.col(on).between(date_of(start), date_of(end))


def shock_adjust_binary(obs: DataFrame, ids: list[str], start: str, end: str) -> DataFrame:
    """0/1 series are 0 within the window."""
    return obs.withColumn("value_adj", F.when(F.col("series_id").isin(ids) & inside(start, end), 0.0).otherwise(F.col("value_adj")))


def shock_forecast(obs: DataFrame, start: str, end: str, method: str = "arima", min_obs: int = 8, season: int = 12, col: str = "value") -> DataFrame:
    """panel, series_id, date, forecast for the dates of each series within the window, from what lies before it.

    linear: the trend over row numbers; seasonal_naive: the value one season of rows before the window, again and again; arima:
    the seasonal models of arima_forecasts(), many series of a partition at a time, from values that are finite. Series with fewer than min_obs
    such rows before the window have no forecast.
    """
    rows = obs.filter(F.col("date") <= date_of(end)).select(*KEYS, "date", F.col(col).cast("double").alias("v"))
    if method == "arima":
        past = F.col("date") < date_of(start)
        known = past & F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf"))
        # A set number of partitions, as the work does not follow the bytes; each holds whole batches of series.
        dealt = rows.repartition(int(obs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *KEYS)
        series = dealt.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.when(known, F.struct("date", "v"))))["v"].alias("history"), F.sort_array(F.collect_list(F.when(~past, F.col("date")))).alias("dates"))
        asked = series.filter((F.size("history") >= min_obs) & (F.size("dates") > 0))

        def forecast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    ahead = [len(x) for x in batch.column("dates")]
                    values = arima_forecasts([np.array(x.values) for x in batch.column("history")], ahead, season)
                    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *ahead]), pa.int32()), pa.array(np.concatenate(values), pa.float64()))
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*KEYS, "dates")), lists], names=[*KEYS, "dates", "forecasts"])

        kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
        found = asked.mapInArrow(forecast, ", ".join(f"{k} {kinds[k]}" for k in KEYS) + ", dates array<date>, forecasts array<double>")
        return found.select(*KEYS, F.explode(F.arrays_zip("dates", "forecasts")).alias("x")).select(*KEYS, F.col("x.dates").alias("date"), F.col("x.forecasts").alias("forecast"))
    w = Window.partitionBy(*KEYS).orderBy("date")
    numbered = rows.withColumns({"n": F.row_number().over(w).cast("double"), "past": F.col("date") < date_of(start)})
    past, ahead = numbered.filter("past"), numbered.filter("not past")
    if method == "linear":
        line = past.groupBy(*KEYS).agg(F.count("*").alias("c"), F.regr_slope("v", "n").alias("slope"), F.regr_intercept("v", "n").alias("base")).filter(F.col("c") >= min_obs)
        return ahead.join(line, KEYS).select(*KEYS, "date", (F.col("base") + F.col("slope") * F.col("n")).alias("forecast"))
    size = past.groupBy(*KEYS).agg(F.count("*").alias("c")).filter(F.col("c") >= max(min_obs, season))
    last = past.join(size, KEYS).filter(F.col("n") > F.col("c") - season).select(*KEYS, (F.col("n") - F.col("c") + season - 1).cast("int").alias("phase"), F.col("v").alias("forecast"))
    phased = ahead.join(size, KEYS).withColumn("phase", F.pmod((F.col("n") - F.col("c") - 1).cast("int"), F.lit(season)))
    return phased.join(last, [*KEYS, "phase"]).select(*KEYS, "date", "forecast")


def taper_blend(date: Column, forecast: Column, actual: Column, end: str, taper_months: int = 3) -> Column:
    """The forecast, and from taper_months before end on more and more of what was seen; the share is (days + 1) / (all days + 1)."""
    first = F.add_months(date_of(end), -taper_months)
    share = F.least((F.datediff(date, first) + 1) / (F.datediff(F.add_months(date_of(end), 1), first) + 1), F.lit(1.0))
    return F.when(date < first, forecast).otherwise((1 - share) * forecast + share * actual)


def replaced(obs: DataFrame, forecasts: DataFrame, end: str) -> DataFrame:
    """obs with value_adj from forecasts where there are any."""
    both = obs.join(forecasts, [*KEYS, "date"], "left")
    new = taper_blend(F.col("date"), F.col("forecast"), F.col("value"), end)
    return both.withColumn("value_adj", F.when(F.col("forecast").isNotNull(), new).otherwise(F.col("value_adj"))).drop("forecast")


def shock_adjust_standard(obs: DataFrame, start: str, end: str, method: str = "arima", season: int = 12) -> DataFrame:
    return replaced(obs, shock_forecast(obs, start, end, method, 8, season), end)


def shock_adjust_daily(obs: DataFrame, start: str, end: str, method: str = "arima", min_months: int = 12) -> DataFrame:
    """Monthly means are forecast and tapered, and each day of a month (all of the end's month) takes its month's value."""
    monthly = obs.groupBy(*KEYS, month_of(F.col("date")).alias("date")).agg(F.avg("value").alias("value"))
    ahead = shock_forecast(monthly, start[:7] + "-01", end[:7] + "-01", method, min_months)
    new = monthly.join(ahead, [*KEYS, "date"]).select(*KEYS, F.col("date").alias("month"), taper_blend(F.col("date"), F.col("forecast"), F.col("value"), end).alias("new"))
    return obs.withColumn("month", month_of(F.col("date"))).join(new, [*KEYS, "month"], "left").withColumn("value_adj", F.coalesce("new", "value_adj")).drop("month", "new")


def shock_adjust_all(obs: DataFrame, meta: DataFrame, start: str = "2020-03-01", end: str = "2022-01-01", binary_ids: tuple[str, ...] = (), method: str = "arima") -> DataFrame:
    """Each series by its kind: binary, daily, quarterly, other. What lies outside the window stays as it is."""
    columns = obs.columns
    kind = F.when(F.col("series_id").isin(*binary_ids), "binary").otherwise(F.col("frequency")) if binary_ids else F.col("frequency")
    tagged = obs.join(meta.select("series_id", "frequency"), "series_id", "left").withColumn("_kind", F.coalesce(kind, F.lit("other"))).drop("frequency")
    of = lambda cond: tagged.filter(cond).drop("_kind")
    parts = [
        shock_adjust_binary(of("_kind = 'binary'"), list(binary_ids), start, end),
        shock_adjust_daily(of("_kind = 'daily'"), start, end, method),
        shock_adjust_standard(of("_kind = 'quarterly'"), start, end, method, 4),
        shock_adjust_standard(of("_kind not in ('binary', 'daily', 'quarterly')"), start, end, method, 12),
    ]
    return parts[0].select(columns).unionByName(parts[1].select(columns)).unionByName(parts[2].select(columns)).unionByName(parts[3].select(columns))


def shock_summary(obs: DataFrame, start: str, end: str, digits: int = 2) -> DataFrame:
    """Within the window, by series: rows, mean raw and adjusted value, mean absolute difference; outside it, rows that differ (by month)."""
    month = month_of(F.col("date"))
    within = month.between(F.trunc(date_of(start), "MM"), F.trunc(date_of(end), "MM"))
    mean = lambda c: F.round(F.avg(F.when(within, c)), digits)
    return obs.groupBy(*KEYS).agg(F.count_if(within).alias("n_adjusted"), mean(F.col("value")).alias("avg_raw"), mean(F.col("value_adj")).alias("avg_adjusted"), mean(F.abs(F.col("value") - F.col("value_adj"))).alias("avg_abs_diff"), F.count_if(~within & ~F.col("value").eqNullSafe(F.col("value_adj"))).alias("outside_changed"))
