"""Monthly feature matrices: one pivot of all series, then windows over panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import lagged, month_of, ordered, ratio

# The columns of the feature matrix.
SERIES_FEATURES = ("yield_spread", "yield_spread_3m_avg", "yield_inverted_months", "unrate", "unrate_12m_change", "u6_u3_gap", "gdp_growth_annualized", "cpi_yoy", "divergence_index", "info_employment_yoy", "electricity_yoy")
STORY_FEATURES = ("sentiment_3m_avg", "story_volume_yoy", "layoff_story_freq")
FEATURES = SERIES_FEATURES + STORY_FEATURES


def monthly_wide(obs: DataFrame, roles: dict[str, str], by: list[str], col: str = "value_adj") -> DataFrame:
    """One row for each month with a column of monthly means for each role; flag_raw has the unadjusted flag."""
    some = obs.filter(F.col("series_id").isin(list(roles.values())))
    # Rounded, so that a mean of nothing but noise about zero is zero whatever the order of its sum.
    means = [F.round(F.avg(F.when(F.col("series_id") == s, F.col(col))), 9).alias(r) for r, s in roles.items()]
    raw = F.avg(F.when(F.col("series_id") == roles["flag"], F.col("value"))).alias("flag_raw")
    return some.groupBy(*by, month_of(F.col("date")).alias("month")).agg(*means, raw)


def rolling_features(monthly: DataFrame, by: list[str], spread: str = "spread", rate: str = "rate3", wider: str = "rate6", price: str = "price") -> DataFrame:
    w = ordered(by, "month")
    return monthly.withColumns(
        {
            "yield_spread": F.col(spread),
            "yield_spread_3m_avg": F.avg(spread).over(w.rowsBetween(-2, 0)),
            "yield_inverted_months": F.count_if(F.col(spread) < 0).over(w.rowsBetween(-5, 0)).cast("double"),
            "unrate": F.col(rate),
            "unrate_12m_change": F.col(rate) - lagged(F.col(rate), 12, w),
            "u6_u3_gap": F.col(wider) - F.col(rate),
            "cpi_yoy": (ratio(F.col(price), lagged(F.col(price), 12, w)) - 1) * 100,
        }
    )


def forward_fill(frame: DataFrame, col: str, by: list[str]) -> DataFrame:
    """Each null takes the last value before it."""
    return frame.withColumn(col, F.last(col, ignorenulls=True).over(ordered(by, "month").rowsBetween(Window.unboundedPreceding, 0)))


def quarterly_growth(frame: DataFrame, level: str, by: list[str]) -> DataFrame:
    """gdp_growth_annualized: growth between the months that have a level, carried on to the others."""
    known = frame.filter(F.col(level).isNotNull()).select(*by, "month", ((ratio(F.col(level), lagged(F.col(level), 1, ordered(by, "month"))) - 1) * 400).alias("gdp_growth_annualized"))
    return forward_fill(frame.join(known, [*by, "month"], "left"), "gdp_growth_annualized", by)


def divergence_features(frame: DataFrame, by: list[str], pop: str = "pop", a: str = "sector_a", b: str = "sector_b") -> DataFrame:
    """Difference of two series per head, each as an index to the first month in which all three are known, and a's change over 12 such months."""
    known = frame.filter(F.col(pop).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull())
    w = ordered(by, "month")
    per = known.select(*by, "month", ratio(F.col(a), F.col(pop)).alias("pa"), ratio(F.col(b), F.col(pop)).alias("pb"))
    index = lambda c: ratio(F.col(c), F.first_value(c).over(w)) * 100
    return per.select(*by, "month", (index("pa") - index("pb")).alias("divergence_index"), ((ratio(F.col("pa"), lagged(F.col("pa"), 12, w)) - 1) * 100).alias("info_employment_yoy"))


def forward_label(frame: DataFrame, by: list[str], flag: str = "flag_raw", horizon: int = 12) -> DataFrame:
    """label: the largest flag of the next horizon rows; null where fewer follow."""
    w = ordered(by, "month")
    return frame.withColumn("label", F.when(F.lead(flag, horizon).over(w).isNotNull(), F.max(flag).over(w.rowsBetween(1, horizon))).cast("int"))


def story_features(spine: DataFrame, rollup: DataFrame, by: list[str]) -> DataFrame:
    """The spine's months with features of the monthly roll-up (month, mean_sentiment, story_count, tag_story_count), null where it has none."""
    w = ordered([c for c in by if c in rollup.columns] or ["_all"], "month")
    roll = rollup if set(by) & set(rollup.columns) else rollup.withColumn("_all", F.lit(0))  # one row for each month: small
    made = roll.select(
        *[c for c in by if c in rollup.columns],
        "month",
        F.avg("mean_sentiment").over(w.rowsBetween(-2, 0)).alias("sentiment_3m_avg"),
        (ratio(F.col("story_count"), lagged(F.col("story_count"), 12, w)) - 1).alias("story_volume_yoy"),
        F.coalesce(ratio(F.col("tag_story_count"), F.col("story_count")), F.lit(0.0)).alias("layoff_story_freq"),
    )
    return spine.join(made, [*[c for c in by if c in rollup.columns], "month"], "left")


def impute_train_median(df: DataFrame, cols: tuple[str, ...], cutoff: str = "2023-12", zero_cols: tuple[str, ...] = ()) -> DataFrame:
    """Nulls of zero_cols are 0; those of the other cols their exact median over rows up to cutoff (YYYY-MM), or 0 if there is none."""
    df = df.fillna(0.0, subset=list(zero_cols)) if zero_cols else df
    train = df.filter(F.date_format("month", "yyyy-MM") <= cutoff)
    medians = train.agg(*[F.median(c).alias(f"_{c}") for c in cols])  # one row
    return df.crossJoin(F.broadcast(medians)).withColumns({c: F.coalesce(F.col(c), F.col(f"_{c}"), F.lit(0.0)) for c in cols}).drop(*[f"_{c}" for c in cols])


def feature_matrix(obs: DataFrame, rollup: DataFrame, roles: dict[str, str], by: tuple[str, ...] = ("panel",), cutoff: str = "2023-12", power: str = "power") -> DataFrame:
    """by..., month, 14 features, label, flag_actual: months in which every feature is known.

    One grouping puts all series side by side, and the windows that follow share its partitioning by panel.
    """
    by = list(by)
    wide = monthly_wide(obs, roles, by)
    full = forward_label(quarterly_growth(rolling_features(wide, by), "level", by), by)
    w = ordered(by, "month")
    full = full.withColumn("electricity_yoy", (ratio(F.col(power), lagged(F.col(power), 12, w)) - 1) * 100)
    full = full.join(divergence_features(wide, by), [*by, "month"])
    full = story_features(full, rollup, by)
    full = impute_train_median(full, STORY_FEATURES, cutoff, ("story_volume_yoy",))
    return full.dropna(subset=list(FEATURES)).select(*by, "month", *FEATURES, "label", F.col("flag_raw").cast("int").alias("flag_actual"))


def time_split(df: DataFrame, cutoff: str) -> tuple[DataFrame, DataFrame]:
    labelled = df.filter("label is not null")
    key = F.date_format("month", "yyyy-MM")
    return labelled.filter(key <= cutoff), labelled.filter(key > cutoff)
