"""Re-graining, lags, indices and runs over panels of series.

Observations are rows (by..., series_id, date, value, value_adj). Every window is partitioned by the columns in `by`, and by
series_id where series are not put side by side, so no query needs all rows in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import change, lagged, month_of, ordered, pct_change, ratio, rounded

BY = ("panel",)


def between(df: DataFrame, on: str, low: str | None, high: str | None) -> DataFrame:
    if low:
        df = df.filter(F.col(on) >= F.lit(low).cast("date"))
    return df.filter(F.col(on) <= F.lit(high).cast("date")) if high else df


def side_by_side(obs: DataFrame, ids: list[str], by=BY, on: str = "date", col: str = "value") -> DataFrame:
    """One row for each date, a column for each series: one grouping instead of joins of the table with itself."""
    return obs.filter(F.col("series_id").isin(ids)).groupBy(*by, on).agg(*[F.max(F.when(F.col("series_id") == i, F.col(col))).alias(i) for i in ids])


def first_of(value: str, by, on: str = "date") -> Column:
    """The value on the earliest date: the default frame begins there, so nothing is buffered."""
    return F.first_value(value).over(ordered(list(by), on))


def monthly_mean(obs: DataFrame, col: str = "value_adj", by=BY) -> DataFrame:
    return obs.groupBy(*by, "series_id", month_of(F.col("date")).alias("month")).agg(F.avg(col).alias("value"))


def spread_vs_rate(obs: DataFrame, spread_id: str, rate_id: str, date_min=None, date_max=None, by=BY, digits: int = 3) -> DataFrame:
    """Monthly mean of a daily series beside a monthly one; the range is cut before the lag."""
    by = list(by)
    spread = obs.filter(F.col("series_id") == spread_id).groupBy(*by, month_of(F.col("date")).alias("month")).agg(F.round(F.avg("value"), digits).alias("avg_spread"))
    rate = obs.filter(F.col("series_id") == rate_id).select(*by, month_of(F.col("date")).alias("month"), F.col("value").alias("rate"))
    both = between(spread.join(rate, [*by, "month"], "left"), "month", date_min, date_max)
    return both.select(*by, "month", "avg_spread", (F.col("avg_spread") < 0).cast("int").alias("inverted"), "rate", rounded(change(F.col("rate"), 12, ordered(by, "month")), digits).alias("rate_yoy_change"))


def per_capita_index(obs: DataFrame, a: str, b: str, pop: str, date_min=None, date_max=None, by=BY, digits: int = 2) -> DataFrame:
    """Two series per 1000 of a third, each as an index to its first value; the range is cut after."""
    by = list(by)
    wide = side_by_side(obs, [a, b, pop], by).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(pop).isNotNull())
    wide = wide.select(*by, "date", (ratio(F.col(a), F.col(pop)) * 1000).alias("a_value"), (ratio(F.col(b), F.col(pop)) * 1000).alias("b_value"))
    index = lambda c: ratio(F.col(c), first_of(c, by)) * 100
    out = wide.withColumns({"ai": index("a_value"), "bi": index("b_value")})
    out = out.select(*by, "date", rounded(F.col("a_value"), digits).alias("a_value"), rounded(F.col("ai"), digits).alias("a_index"), rounded(F.col("b_value"), digits).alias("b_value"), rounded(F.col("bi"), digits).alias("b_index"), rounded(F.col("ai") - F.col("bi"), digits).alias("divergence_gap"))
    return between(out, "date", date_min, date_max)


def annualized_growth(obs: DataFrame, level_id: str, flag_id: str, periods: int = 4, date_min=None, date_max=None, by=BY, digits: int = 2) -> DataFrame:
    """Growth of a level at a yearly rate, whether it and the one before are negative, and the flag of its month."""
    by, w = list(by), ordered(list(by), "date")
    level = obs.filter(F.col("series_id") == level_id).select(*by, "date", F.col("value").alias("level"))
    grown = level.withColumn("growth_pct", rounded(pct_change(F.col("level"), 1, w, 100.0 * periods), digits)).filter("growth_pct is not null")
    before = lagged(F.col("growth_pct"), 1, w)
    grown = grown.withColumn("two_neg", F.coalesce(((F.col("growth_pct") < 0) & (before < 0)).cast("int"), F.lit(0)))
    flags = obs.filter(F.col("series_id") == flag_id).groupBy(*by, month_of(F.col("date")).alias("month")).agg(F.max(F.col("value").cast("int")).alias("flag"))
    out = grown.withColumn("month", month_of(F.col("date"))).join(flags, [*by, "month"], "left")
    return between(out.select(*by, "date", "level", "growth_pct", "two_neg", F.coalesce("flag", F.lit(0)).alias("flag")), "date", date_min, date_max)


def yoy_growth_per_capita(obs: DataFrame, ids: list[str], rate_ids: list[str], pop: str, lag: int = 12, date_min=None, date_max=None, by=BY, digits: int = 2) -> DataFrame:
    """Change over lag rows of each series; all but rates are first taken per head. Rows without an earlier one are left out."""
    by = list(by)
    people = obs.filter(F.col("series_id") == pop).select(*by, "date", F.col("value").alias("people"))
    some = obs.filter(F.col("series_id").isin(ids)).join(people, [*by, "date"], "left")
    rate = F.col("series_id").isin(rate_ids)
    adjusted = some.withColumn("adj", F.when(rate, F.col("value")).otherwise(ratio(F.col("value"), F.col("people"))))
    w = ordered([*by, "series_id"], "date")
    out = adjusted.withColumn("before", lagged(F.col("adj"), lag, w)).filter("before is not null")
    out = out.select(*by, "series_id", F.when(rate, "rate").otherwise("per head").alias("series_name"), "date", F.col("value").alias("raw_value"), rounded(F.col("adj"), digits + 2).alias("adj_value"), rounded(F.col("before"), digits + 2).alias("adj_lag"), rounded((ratio(F.col("adj"), F.col("before")) - 1) * 100, digits).alias("yoy_pct"))
    return between(out, "date", date_min, date_max)


def recovery_vs_baseline(obs: DataFrame, ids: list[str], baseline_date: str, start: str, date_max=None, by=BY, digits: int = 2) -> DataFrame:
    """Each series as a share of its value on one date, side by side from start on."""
    by = list(by)
    some = obs.filter(F.col("series_id").isin(ids))
    base = some.filter(F.col("date") == F.lit(baseline_date).cast("date")).select(*by, "series_id", F.col("value").alias("base"))
    share = between(some, "date", start, date_max).join(base, [*by, "series_id"]).withColumn("pct", rounded(ratio(F.col("value"), F.col("base")) * 100, digits))
    of = lambda i, c: F.max(F.when(F.col("series_id") == i, F.col(c)))
    return share.groupBy(*by, "date").agg(*[x for i in ids for x in (of(i, "value").alias(f"{i.lower()}_value"), of(i, "pct").alias(f"{i.lower()}_pct_of_peak"))])


def two_series_gap(obs: DataFrame, a: str, b: str, lag: int = 12, date_min=None, date_max=None, by=BY, digits: int = 2) -> DataFrame:
    """Dates that both series have: their difference, and the change of each over lag such rows within the range."""
    by, w = list(by), ordered(list(by), "date")
    both = between(side_by_side(obs, [a, b], by).filter(F.col(a).isNotNull() & F.col(b).isNotNull()), "date", date_min, date_max)
    return both.select(*by, "date", F.col(a).alias("a"), F.col(b).alias("b"), rounded(F.col(a) - F.col(b), digits).alias("gap"), rounded(change(F.col(a), lag, w), digits).alias("a_change"), rounded(change(F.col(b), lag, w), digits).alias("b_change"))


def index_to_first(obs: DataFrame, a: str, b: str, date_min=None, date_max=None, by=BY, digits: int = 2) -> DataFrame:
    """Two series, each as an index to the first value of its own history, on the dates that both have."""
    by = list(by)
    indexed = obs.filter(F.col("series_id").isin([a, b])).withColumn("i", ratio(F.col("value"), first_of("value", [*by, "series_id"])) * 100)
    of = lambda s, c: F.max(F.when(F.col("series_id") == s, F.col(c)))
    wide = indexed.groupBy(*by, "date").agg(of(a, "value").alias("a_raw"), of(a, "i").alias("ai"), of(b, "value").alias("b_raw"), of(b, "i").alias("bi")).filter("a_raw is not null and b_raw is not null")
    return between(wide.select(*by, "date", "a_raw", rounded(F.col("ai"), digits).alias("a_index"), "b_raw", rounded(F.col("bi"), digits).alias("b_index"), rounded(F.col("ai") - F.col("bi"), digits).alias("gap")), "date", date_min, date_max)


def mom_yoy_change(obs: DataFrame, ids: list[str], date_min=None, date_max=None, by=BY, digits: int = 2) -> DataFrame:
    by = list(by)
    w, value = ordered([*by, "series_id"], "date"), F.col("value")
    some = between(obs.filter(F.col("series_id").isin(ids)), "date", date_min, date_max)
    return some.select(*by, "series_id", "date", value.alias("level"), rounded(pct_change(value, 1, w), digits + 1).alias("mom_pct"), rounded(pct_change(value, 12, w), digits).alias("yoy_pct"))


def flag_runs(flags: DataFrame, by=("panel", "series_id")) -> DataFrame:
    """Runs of flag = 1 (by..., date, flag): start, and the first date after it, or the last date if it is still open."""
    by, w = list(by), ordered(list(by), "date")
    last = F.max("date").over(Window.partitionBy(*by))
    marked = flags.withColumns({"new": F.coalesce((F.col("flag") != F.lag("flag").over(w)).cast("int"), F.lit(1)), "next": F.lead("date").over(w), "last": last})
    runs = marked.withColumn("run", F.sum("new").over(w))
    return runs.filter("flag = 1").groupBy(*by, "run").agg(F.min("date").alias("run_start"), F.coalesce(F.max_by("next", "date"), F.max("last")).alias("run_end")).drop("run")


def longest_streak(monthly: DataFrame, threshold: float, op: str = "lt", calendar: bool = False, by=("panel", "series_id")) -> DataFrame:
    """The longest run of months under (or over) threshold: neighbouring rows, or neighbouring months of the calendar."""
    by, w = list(by), ordered(list(by), "month")
    hit = (F.col("value") < threshold) if op == "lt" else (F.col("value") > threshold)
    at = F.year("month") * 12 + F.month("month") if calendar else F.row_number().over(w)
    placed = monthly.withColumns({"hit": F.coalesce(hit, F.lit(False)), "at": at})
    runs = placed.filter("hit").withColumn("run", F.col("at") - F.row_number().over(w)).groupBy(*by, "run").count().groupBy(*by).agg(F.max("count").alias("longest"))
    return monthly.select(*by).distinct().join(runs, by, "left").select(*by, F.coalesce("longest", F.lit(0)).alias("longest"))


def latest_with_delta(obs: DataFrame, by=("panel", "series_id"), digits: int = 3) -> DataFrame:
    """The latest value, its difference from the one before (0 if there is none), and its date."""
    by = list(by)
    top = obs.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("date")))).filter("_n <= 2")
    of = lambda n, c: F.max(F.when(F.col("_n") == n, F.col(c)))
    return top.groupBy(*by).agg(of(1, "value").alias("latest"), rounded(F.coalesce(of(1, "value") - of(2, "value"), F.lit(0.0)), digits).alias("delta"), of(1, "date").alias("date"))


def latest_growth(obs: DataFrame, lag: int = 12, scale: float = 100.0, newest: int = 13, by=("panel", "series_id"), digits: int = 2) -> DataFrame:
    """The latest change over lag rows that is known, among the newest rows."""
    by = list(by)
    grown = obs.withColumns({"g": pct_change(F.col("value"), lag, ordered(by, "date"), scale), "_n": F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("date")))})
    return grown.filter(F.col("g").isNotNull() & (F.col("_n") <= newest)).groupBy(*by).agg(rounded(F.max_by("g", "date"), digits).alias("growth"), F.max("date").alias("date"))


def sparkline_tail(obs: DataFrame, n: int = 24, lag: int | None = None, scale: float = 100.0, by=("panel", "series_id"), digits: int | None = None) -> DataFrame:
    """points: the last n values (or changes over lag rows, nulls left out) in order of date."""
    by = list(by)
    if lag:
        obs = obs.withColumn("value", rounded(pct_change(F.col("value"), lag, ordered(by, "date"), scale), digits)).filter("value is not null")
    last = obs.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("date")))).filter(F.col("_n") <= n)
    return last.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("date", "value"))).alias("points"))


def date_bounds(obs: DataFrame, by=("panel", "series_id")) -> DataFrame:
    return obs.groupBy(*by).agg(F.date_format(F.min("date"), "yyyy-MM").alias("first_month"), F.date_format(F.max("date"), "yyyy-MM").alias("last_month"), F.count_distinct(month_of(F.col("date"))).alias("n_months"))


def slice_key(obs: DataFrame) -> DataFrame:
    return obs.agg(F.concat_ws("-", F.min(F.year("date")).cast("string"), F.max(F.year("date")).cast("string")).alias("slice_key"))


def window_change(obs: DataFrame, windows: DataFrame, pop: str | None = None, by=BY, digits: int = 2, col: str = "value") -> DataFrame:
    """Change between the first and last observation within each window (window_id, series_id, start, end); 0 from a zero or missing start.

    Windows are few and observations many: the windows are what a broadcast would carry, if small.
    """
    by = list(by)
    value = F.col(col)
    if pop:
        people = obs.filter(F.col("series_id") == pop).select(*by, month_of(F.col("date")).alias("month"), F.col("value").alias("people"))
        obs = obs.withColumn("month", month_of(F.col("date"))).join(people, [*by, "month"])
        value = ratio(F.col(col), F.col("people"))
    inside = obs.withColumn("v", value).join(windows, "series_id").filter(F.col("date").between(F.col("start"), F.col("end")))
    ends = inside.groupBy(*by, "window_id", "series_id").agg(F.min_by("v", "date").alias("start_val"), F.max_by("v", "date").alias("end_val"))
    pct = lambda x: F.coalesce(rounded(x * 100, digits), F.lit(0.0))
    return ends.select(*by, "window_id", "series_id", "start_val", "end_val", pct(ratio(F.col("end_val") - F.col("start_val"), F.col("start_val"))).alias("change_pct"), pct(ratio(F.col("end_val"), F.col("start_val"))).alias("pct_of_start"))


def change_by_kind(changes: DataFrame, kinds: DataFrame, digits: int = 2) -> DataFrame:
    """Rates change by points, with the relative change beside it; levels relatively, with the difference beside it."""
    diff, rel = rounded(F.col("end_val") - F.col("start_val"), digits), F.col("change_pct")
    rate = F.col("kind") == "rate"
    return changes.join(kinds, "series_id").select(*[c for c in changes.columns if c not in ("start_val", "end_val", "pct_of_start")], F.when(rate, diff).otherwise(rel).alias("main_change"), F.when(rate, rel).otherwise(diff).alias("beside"), F.when(rate, F.lit("pp")).otherwise(F.lit("%")).alias("unit"))


def trend_tail_stats(obs: DataFrame, lag: int = 1, scale: float = 400.0, n: int = 20, by=("panel", "series_id"), digits: int = 2) -> DataFrame:
    """Of the last n known changes: the latest, their mean, how many are negative, and the largest."""
    by = list(by)
    grown = obs.withColumn("g", pct_change(F.col("value"), lag, ordered(by, "date"), scale)).filter("g is not null")
    last = grown.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("date")))).filter(F.col("_n") <= n)
    return last.groupBy(*by).agg(rounded(F.max_by("g", "date"), digits).alias("latest"), rounded(F.avg("g"), digits).alias("avg_n"), F.count_if(F.col("g") < 0).alias("negative_n"), rounded(F.max("g"), digits).alias("peak"))


def faster_count(obs: DataFrame, a: str, b: str, n: int | None = 24, since: str | None = None, lag: int = 12, by=BY) -> DataFrame:
    """In how many of the last n rows (or of those since a date) with both changes a's is the larger one."""
    by, w = list(by), ordered(list(by), "date")
    both = side_by_side(obs, [a, b], by).filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    both = both.select(*by, "date", change(F.col(a), lag, w).alias("da"), change(F.col(b), lag, w).alias("db")).filter("da is not null and db is not null")
    if since:
        both = between(both, "date", since, None)
    else:
        both = both.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("date")))).filter(F.col("_n") <= n)
    return both.groupBy(*by).agg(F.count_if(F.col("da") > F.col("db")).alias("faster"), F.count("*").alias("total"))


def post_event_index_change(obs: DataFrame, a: str, b: str, event_month: str, by=BY, digits: int = 2) -> DataFrame:
    """How much each series' index to its first joined row moved since the event's month, and the difference."""
    by = list(by)
    both = side_by_side(obs, [a, b], by).filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    both = both.withColumns({"ai": ratio(F.col(a), first_of(a, by)) * 100, "bi": ratio(F.col(b), first_of(b, by)) * 100})
    ends = both.filter(F.col("date") >= F.lit(event_month).cast("date")).groupBy(*by).agg((F.max_by("ai", "date") - F.min_by("ai", "date")).alias("da"), (F.max_by("bi", "date") - F.min_by("bi", "date")).alias("db"))
    return ends.select(*by, rounded(F.col("da"), digits).alias("a_change"), rounded(F.col("db"), digits).alias("b_change"), rounded(F.col("da") - F.col("db"), digits).alias("divergence"))


def prediction_split(predictions: DataFrame, by=BY) -> DataFrame:
    """Rows up to the last one with actual = 1 are evaluated, those from it on are forward; so that row is in both."""
    by = list(by)
    edge = predictions.groupBy(*by).agg(F.max(F.when(F.col("actual") == 1, F.col("date"))).alias("edge"))
    rows = predictions.join(edge, by)
    parts = F.when(F.col("edge").isNull() | (F.col("date") < F.col("edge")), F.array(F.lit("evaluated"))).when(F.col("date") == F.col("edge"), F.array(F.lit("evaluated"), F.lit("forward"))).otherwise(F.array(F.lit("forward")))
    return rows.select(*by, "date", "probability", F.explode(parts).alias("part"))
