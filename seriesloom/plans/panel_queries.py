"""Registered queries over the panel of observations, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import panel as P
from ..operators import profiling as Q
from ..sources import loading as L
from ..sources import tables as B
from ..sources.scratch import scratch_path
from .stand_ins import META, OBS, metadata, observations, table

QUERIES: dict = {}
ORACLE: dict = {}
D = 6  # digits


def add(name: str, sql: str | None, ctes: str = OBS):
    def wrap(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = f"WITH {ctes} {sql}" if ctes else sql
        return f

    return wrap


def wide(*ids: str, where: str = "") -> str:
    cols = ", ".join(f"MAX(value) FILTER (series_id = '{i}') AS {i}" for i in ids)
    return f"(SELECT panel, date, {cols} FROM obs GROUP BY panel, date) AS w WHERE " + " AND ".join(f"w.{i} IS NOT NULL" for i in ids) + where


# ---- profiling ----
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")


@add("table_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, COUNT(*) AS row_count FROM {t}" for t in TABLES), "")
def table_counts(spark, d):
    return Q.table_counts({t: table(spark, d, t) for t in TABLES})


@add("doc_family_counts", "SELECT split_part(lang || ':' || source, ':', 1) AS family, COUNT(*) AS n FROM documents GROUP BY 1", "")
def doc_family_counts(spark, d):
    return Q.doc_family_counts(table(spark, d, "documents").select(F.concat_ws(":", "lang", "source").alias("doc_type")))


@add("series_coverage", "SELECT m.series_id, name, category, frequency, COUNT(o.date) AS obs_count, MIN(date) AS earliest, MAX(date) AS latest FROM meta m LEFT JOIN obs o USING (series_id) GROUP BY ALL", f"{META}, {OBS}")
def series_coverage(spark, d):
    return Q.series_coverage(metadata(spark), observations(spark, d))


GAPS = """SELECT series_id, COUNT(*) AS total_obs, COUNT(*) FILTER (gap > 35) AS gaps_over, COUNT(*) FILTER (gap < 25) AS gaps_under, CAST(MIN(gap) AS INTEGER) AS min_gap_days, CAST(MAX(gap) AS INTEGER) AS max_gap_days, round(AVG(gap), 1) AS avg_gap_days
FROM (SELECT series_id, date_diff('day', LAG(date) OVER (PARTITION BY series_id ORDER BY date), date) AS gap FROM whole JOIN every USING (series_id) WHERE frequency = 'monthly') GROUP BY series_id"""
# Every region's series under a name of its own.
WHOLE = f"{META}, {OBS}, every AS (SELECT r_name || '.' || series_id AS series_id, name, frequency FROM region, meta), whole AS (SELECT panel || '.' || series_id AS series_id, date, value FROM obs)"


def whole(spark, d):
    return observations(spark, d).withColumn("series_id", F.concat_ws(".", "panel", "series_id"))


def every(spark, d):
    """The metadata of each region's series: as many rows as regions times series."""
    names = table(spark, d, "region").select("r_name")
    return names.crossJoin(F.broadcast(metadata(spark))).withColumn("series_id", F.concat_ws(".", "r_name", "series_id")).drop("r_name")


@add("gap_report", GAPS, WHOLE)
def gap_report(spark, d):
    return Q.gap_report(every(spark, d), whole(spark, d))


@add("value_distribution", f"SELECT m.series_id, name, units, COUNT(*) AS n, MIN(value) AS min_val, MAX(value) AS max_val, round(AVG(value), {D}) AS mean_val FROM meta m JOIN obs USING (series_id) GROUP BY ALL", f"{META}, {OBS}")
def value_distribution(spark, d):
    return Q.value_distribution(metadata(spark), observations(spark, d), D)


@add("yearly_counts", "SELECT series_id, CAST(year(date) AS INTEGER) AS year, COUNT(*) AS obs_count FROM obs GROUP BY 1, 2")
def yearly_counts(spark, d):
    return Q.yearly_counts(observations(spark, d))


@add("duplicate_check", "SELECT series_id, date, COUNT(*) AS dupes FROM obs GROUP BY 1, 2 HAVING COUNT(*) > 1")
def duplicate_check(spark, d):
    return Q.duplicate_check(observations(spark, d), ["series_id", "date"])


@add("latest_n_per_series", "SELECT series_id, name, date, value FROM whole JOIN every USING (series_id) QUALIFY ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY date DESC) <= 3", WHOLE)
def latest_n_per_series(spark, d):
    return Q.latest_n_per_series(every(spark, d), whole(spark, d))


@add("category_summary", "SELECT category, COUNT(DISTINCT series_id) AS series_count, COUNT(*) AS total_obs, MIN(date) AS earliest, MAX(date) AS latest FROM meta JOIN obs USING (series_id) GROUP BY 1", f"{META}, {OBS}")
def category_summary(spark, d):
    return Q.category_summary(metadata(spark), observations(spark, d))


# ---- sources ----
@add("load_stats", "SELECT event_type AS series_id, COUNT(*) FILTER (ts >= TIMESTAMP '2024-01-10' AND value >= 50) AS inserted, COUNT(*) FILTER (ts >= TIMESTAMP '2024-01-10' AND (value < 50) IS NOT FALSE) AS skipped_null, COUNT(*) FILTER (ts < TIMESTAMP '2024-01-10') AS skipped_date FROM events GROUP BY 1", "")
def load_stats(spark, d):
    """Events as raw observations; values under 50 stand for missing ones."""
    return L.load_stats(raw_events(spark, d), "2024-01-10")


def raw_events(spark, d):
    value = F.when(F.col("value") >= 50, F.col("value").cast("string")).otherwise(".")
    return table(spark, d, "events").select(F.col("event_type").alias("series_id"), F.date_format("ts", "yyyy-MM-dd").alias("raw_date"), value.alias("raw_value"), F.col("event_id").alias("position"))


@add("load_series_json", "SELECT event_type AS series_id, CAST(ts AS DATE) AS date, arg_min(value, event_id) AS value, arg_min(value, event_id) AS value_adj FROM events WHERE value >= 50 AND ts >= TIMESTAMP '2024-01-10' GROUP BY 1, 2", "")
def load_series_json(spark, d):
    """The cleaning step on raw observations: typed, dated on or after the cutoff, the first of each series and date."""
    return L.clean_observations(raw_events(spark, d), "2024-01-10")


@add("history_cutoff", "SELECT panel, series_id, date, value, value_adj FROM obs WHERE date >= DATE '1998-06-15'")
def history_cutoff(spark, d):
    return L.history_cutoff(observations(spark, d), "2001-06-15", 3)


@add("load_stories_json", "SELECT doc_id AS story_id, n_chars AS score, CAST('2023-0' || (1 + doc_id % 9) || '-01' AS DATE) AS month FROM documents WHERE text IS NOT NULL", "")
def load_stories_json(spark, d):
    docs = table(spark, d, "documents")
    raw = docs.select(F.col("doc_id").alias("story_id"), F.concat(F.lit("2023-0"), 1 + F.col("doc_id") % 9, F.lit("-05T00:00:00Z")).alias("created_utc"), F.col("text").alias("title"), F.col("n_chars").alias("score"), F.lit(0.0).alias("sentiment_score"), F.lit("neutral").alias("sentiment_label"), F.col("doc_id").alias("position"))
    return L.complete_stories(raw).select("story_id", "score", "month")


@add("load_reference_docs", """SELECT p_partkey::VARCHAR AS series_id, k AS doc_type, p_name AS title, c AS content, CAST(NULL AS VARCHAR) AS source_url, '2024-01-01' AS fetched_at FROM (
SELECT *, unnest(['series_notes', 'release_info', 'category_path']) AS k, unnest([CASE WHEN p_size > 25 THEN p_type END, coalesce(CASE WHEN p_size < 10 THEN p_brand END, p_name), nullif(trim(CASE WHEN p_size % 2 = 0 THEN '  ' ELSE p_brand END), '')]) AS c FROM part) WHERE c IS NOT NULL""", "")
def load_reference_docs(spark, d):
    part = table(spark, d, "part")
    meta = part.select(F.col("p_partkey").cast("string").alias("series_id"), F.col("p_name").alias("name"), F.expr("CASE WHEN p_size > 25 THEN p_type ELSE ' ' END").alias("notes"), F.expr("CASE WHEN p_size < 10 THEN p_brand END").alias("release_notes"), F.col("p_name").alias("release_name"), F.expr("CASE WHEN p_size % 2 = 0 THEN '  ' ELSE p_brand END").alias("category_path"), F.lit(None).cast("string").alias("source_url"))
    return L.load_reference_docs(meta, "2024-01-01")


@add("load_curated_docs", "SELECT source AS series_id, 'scholarly:' || lang AS doc_type, doc_id AS title_id FROM documents WHERE lang IS NOT NULL AND source IN ('src0', 'src1', 'src2') AND trim(text) <> '' QUALIFY ROW_NUMBER() OVER (PARTITION BY lang ORDER BY doc_id) = 1", "")
def load_curated_docs(spark, d):
    docs = table(spark, d, "documents")
    raw = docs.select(F.col("lang").alias("id"), F.col("source").alias("series_id"), F.col("doc_id").cast("string").alias("title"), F.col("text").alias("content"), F.lit(None).cast("string").alias("source_url"), F.lpad(F.col("doc_id").cast("string"), 20, "0").alias("file"))
    known = spark.createDataFrame([("src0",), ("src1",), ("src2",)], "series_id string")
    return L.curated_docs(raw, known, "2024-01-01").select("series_id", "doc_type", F.col("title").cast("long").alias("title_id"))


@add("upsert", "SELECT c_custkey, c_name, c_mktsegment, CASE WHEN c_nationkey < 10 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer", "")
def upsert(spark, d):
    base = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal", "c_nationkey")
    new = base.filter("c_nationkey < 10").withColumns({"c_acctbal": F.col("c_acctbal") + 1, "c_mktsegment": F.lit("changed")})
    return L.upsert(base.drop("c_nationkey"), new.drop("c_nationkey"), ["c_custkey"], "replace", ("c_mktsegment",))


@add("prune_orphans", "SELECT p_partkey, p_brand FROM part WHERE p_brand NOT LIKE 'Brand#1%' OR p_brand IN (SELECT p_brand FROM part WHERE p_size > 49)", "")
def prune_orphans(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    return L.prune_orphans(part.drop("p_size"), part.filter("p_size > 49"), "p_brand", "Brand#1").select("p_partkey", "p_brand")


# ---- re-graining and windows ----
@add("monthly_mean", f"SELECT panel, series_id, CAST(date_trunc('month', date) AS DATE) AS month, round(AVG(value_adj), {D}) AS value FROM obs GROUP BY 1, 2, 3")
def monthly_mean(spark, d):
    return P.monthly_mean(observations(spark, d)).withColumn("value", F.round("value", D))


SPREAD = f"""SELECT panel, month, avg_spread, CAST(avg_spread < 0 AS INTEGER) AS inverted, rate, round(rate - LAG(rate, 12) OVER (PARTITION BY panel ORDER BY month), {D}) AS rate_yoy_change FROM (
SELECT a.panel, a.month, a.avg_spread, r.value AS rate FROM (SELECT panel, CAST(date_trunc('month', date) AS DATE) AS month, round(AVG(value), {D}) AS avg_spread FROM obs WHERE series_id = 'SPREAD' GROUP BY 1, 2) a
LEFT JOIN obs r ON r.series_id = 'RATE3' AND r.panel = a.panel AND r.date = a.month WHERE month >= DATE '1996-01-01' AND month <= DATE '2001-06-01')"""


@add("spread_vs_rate", SPREAD)
def spread_vs_rate(spark, d):
    return P.spread_vs_rate(observations(spark, d), "SPREAD", "RATE3", "1996-01-01", "2001-06-01", digits=D)


PC = f"""SELECT panel, date, round(a, {D}) AS a_value, round(ai, {D}) AS a_index, round(b, {D}) AS b_value, round(bi, {D}) AS b_index, round(ai - bi, {D}) AS divergence_gap FROM (
SELECT *, a / NULLIF(first_value(a) OVER p, 0) * 100 AS ai, b / NULLIF(first_value(b) OVER p, 0) * 100 AS bi FROM (SELECT panel, date, SECTOR_A / NULLIF(POP, 0) * 1000 AS a, SECTOR_B / NULLIF(POP, 0) * 1000 AS b FROM {wide("SECTOR_A", "SECTOR_B", "POP")}) WINDOW p AS (PARTITION BY panel ORDER BY date)) WHERE date >= DATE '1997-01-01'"""


@add("per_capita_index", PC)
def per_capita_index(spark, d):
    return P.per_capita_index(observations(spark, d), "SECTOR_A", "SECTOR_B", "POP", "1997-01-01", digits=D)


GROWTH = f"""SELECT panel, date, level, growth_pct, two_neg, coalesce(flag, 0) AS flag FROM (
SELECT *, CASE WHEN growth_pct < 0 AND LAG(growth_pct) OVER (PARTITION BY panel ORDER BY date) < 0 THEN 1 ELSE 0 END AS two_neg FROM (
SELECT panel, date, value AS level, round((value / NULLIF(LAG(value) OVER (PARTITION BY panel ORDER BY date), 0) - 1) * 400, {D}) AS growth_pct FROM obs WHERE series_id = 'LEVEL') WHERE growth_pct IS NOT NULL)
LEFT JOIN (SELECT panel, date, MAX(CAST(value AS INTEGER)) AS flag FROM obs WHERE series_id = 'FLAG' GROUP BY 1, 2) USING (panel, date) WHERE date >= DATE '1996-01-01'"""


@add("annualized_growth", GROWTH)
def annualized_growth(spark, d):
    return P.annualized_growth(observations(spark, d), "LEVEL", "FLAG", date_min="1996-01-01", digits=D)


YOY = f"""SELECT panel, series_id, CASE WHEN series_id = 'RATE3' THEN 'rate' ELSE 'per head' END AS series_name, date, raw_value, round(adj, {D + 2}) AS adj_value, round(before, {D + 2}) AS adj_lag, round((adj / NULLIF(before, 0) - 1) * 100, {D}) AS yoy_pct FROM (
SELECT *, LAG(adj, 12) OVER (PARTITION BY panel, series_id ORDER BY date) AS before FROM (SELECT o.panel, o.series_id, o.date, o.value AS raw_value, CASE WHEN o.series_id = 'RATE3' THEN o.value ELSE o.value / NULLIF(p.value, 0) END AS adj
FROM obs o LEFT JOIN obs p ON p.series_id = 'POP' AND p.panel = o.panel AND p.date = o.date WHERE o.series_id IN ('RATE3', 'SECTOR_A', 'POWER'))) WHERE before IS NOT NULL AND date <= DATE '2001-06-01'"""


@add("yoy_growth_per_capita", YOY)
def yoy_growth_per_capita(spark, d):
    return P.yoy_growth_per_capita(observations(spark, d), ["RATE3", "SECTOR_A", "POWER"], ["RATE3"], "POP", date_max="2001-06-01", digits=D)


REC = "SELECT panel, date, " + ", ".join(f"MAX(value) FILTER (series_id = '{i}') AS {i.lower()}_value, MAX(pct) FILTER (series_id = '{i}') AS {i.lower()}_pct_of_peak" for i in ("SECTOR_A", "POWER")) + f" FROM (SELECT o.*, round(o.value / NULLIF(b.value, 0) * 100, {D}) AS pct FROM obs o JOIN obs b ON b.date = DATE '1998-02-01' AND b.panel = o.panel AND b.series_id = o.series_id WHERE o.series_id IN ('SECTOR_A', 'POWER') AND o.date >= DATE '1998-01-01' AND o.date <= DATE '2001-01-01') GROUP BY 1, 2"


@add("recovery_vs_baseline", REC)
def recovery_vs_baseline(spark, d):
    return P.recovery_vs_baseline(observations(spark, d), ["SECTOR_A", "POWER"], "1998-02-01", "1998-01-01", "2001-01-01", digits=D)


@add("two_series_gap", f"SELECT panel, date, RATE6 AS a, RATE3 AS b, round(RATE6 - RATE3, {D}) AS gap, round(RATE6 - LAG(RATE6, 12) OVER p, {D}) AS a_change, round(RATE3 - LAG(RATE3, 12) OVER p, {D}) AS b_change FROM (SELECT * FROM {wide('RATE6', 'RATE3')}) WHERE date >= DATE '1996-01-01' WINDOW p AS (PARTITION BY panel ORDER BY date)")
def two_series_gap(spark, d):
    return P.two_series_gap(observations(spark, d), "RATE6", "RATE3", date_min="1996-01-01", digits=D)


ITF = f"""SELECT panel, date, a_raw, round(ai, {D}) AS a_index, b_raw, round(bi, {D}) AS b_index, round(ai - bi, {D}) AS gap FROM (
SELECT a.panel, a.date, a.value AS a_raw, a.i AS ai, b.value AS b_raw, b.i AS bi FROM ix a JOIN ix b ON a.series_id = 'INDEX' AND b.series_id = 'POWER' AND a.panel = b.panel AND a.date = b.date)"""


@add("index_to_first", ITF, f"{OBS}, ix AS (SELECT *, value / NULLIF(first_value(value) OVER (PARTITION BY panel, series_id ORDER BY date), 0) * 100 AS i FROM obs)")
def index_to_first(spark, d):
    return P.index_to_first(observations(spark, d), "INDEX", "POWER", digits=D)


@add("mom_yoy_change", f"SELECT panel, series_id, date, value AS level, round((value / NULLIF(LAG(value) OVER p, 0) - 1) * 100, {D + 1}) AS mom_pct, round((value / NULLIF(LAG(value, 12) OVER p, 0) - 1) * 100, {D}) AS yoy_pct FROM obs WHERE series_id IN ('INDEX', 'POWER') AND date >= DATE '1996-01-01' WINDOW p AS (PARTITION BY panel, series_id ORDER BY date)")
def mom_yoy_change(spark, d):
    return P.mom_yoy_change(observations(spark, d), ["INDEX", "POWER"], "1996-01-01", digits=D)


def flags(spark, d):
    return observations(spark, d).filter("series_id = 'FLAG'").select("panel", "series_id", "date", F.col("value").cast("int").alias("flag"))


RUNS = """SELECT panel, series_id, MIN(date) AS run_start, coalesce(arg_max(nxt, date) FILTER (nxt IS NOT NULL AND date = last_in_run), MAX(last)) AS run_end FROM (
SELECT *, MAX(date) OVER (PARTITION BY panel, series_id, run) AS last_in_run FROM (SELECT *, SUM(new) OVER (PARTITION BY panel, series_id ORDER BY date) AS run FROM (
SELECT panel, series_id, date, value, CASE WHEN value IS DISTINCT FROM LAG(value) OVER p THEN 1 ELSE 0 END AS new, LEAD(date) OVER p AS nxt, MAX(date) OVER (PARTITION BY panel, series_id) AS last FROM obs WHERE series_id = 'FLAG' WINDOW p AS (PARTITION BY panel, series_id ORDER BY date)))) WHERE value = 1 GROUP BY panel, series_id, run"""


@add("flag_runs", RUNS)
def flag_runs(spark, d):
    return P.flag_runs(flags(spark, d))


def streak_sql(at: str) -> str:
    return f"""SELECT panel, series_id, coalesce(longest, 0) AS longest FROM (SELECT DISTINCT panel, series_id FROM mon) LEFT JOIN (
SELECT panel, series_id, MAX(n) AS longest FROM (SELECT panel, series_id, g, COUNT(*) AS n FROM (SELECT panel, series_id, pos - ROW_NUMBER() OVER (PARTITION BY panel, series_id ORDER BY month) AS g FROM (SELECT *, {at} AS pos FROM mon) WHERE value < 0) GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (panel, series_id)"""


MON = f"{OBS}, mon AS (SELECT panel, series_id, CAST(date_trunc('month', date) AS DATE) AS month, AVG(value_adj) AS value FROM obs GROUP BY 1, 2, 3)"


@add("longest_streak", streak_sql("ROW_NUMBER() OVER (PARTITION BY panel, series_id ORDER BY month)"), MON)
def longest_streak(spark, d):
    return P.longest_streak(P.monthly_mean(observations(spark, d)), 0.0)


@add("longest_streak_calendar", streak_sql("year(month) * 12 + month(month)"), MON)
def longest_streak_calendar(spark, d):
    return P.longest_streak(P.monthly_mean(observations(spark, d)), 0.0, calendar=True)


@add("latest_with_delta", f"SELECT panel, series_id, arg_max(value, date) AS latest, round(coalesce(arg_max(value - before, date), 0), {D}) AS delta, MAX(date) AS date FROM (SELECT *, LAG(value) OVER (PARTITION BY panel, series_id ORDER BY date) AS before FROM obs) GROUP BY 1, 2")
def latest_with_delta(spark, d):
    return P.latest_with_delta(observations(spark, d), digits=D)


TAIL = "(SELECT panel, series_id, date, (value / NULLIF(LAG(value, {lag}) OVER (PARTITION BY panel, series_id ORDER BY date), 0) - 1) * {scale} AS g, ROW_NUMBER() OVER (PARTITION BY panel, series_id ORDER BY date DESC) AS rn FROM obs)"


@add("latest_growth", f"SELECT panel, series_id, round(arg_max(g, date), {D}) AS growth, MAX(date) AS date FROM {TAIL.format(lag=12, scale=100)} WHERE g IS NOT NULL AND rn <= 13 GROUP BY 1, 2")
def latest_growth(spark, d):
    return P.latest_growth(observations(spark, d), digits=D)


@add("sparkline_tail", f"SELECT panel, series_id, date, round(g, {D}) AS value FROM {TAIL.format(lag=1, scale=100)} WHERE g IS NOT NULL QUALIFY ROW_NUMBER() OVER (PARTITION BY panel, series_id ORDER BY date DESC) <= 24")
def sparkline_tail(spark, d):
    tails = P.sparkline_tail(observations(spark, d), lag=1, digits=D)
    return tails.select("panel", "series_id", F.explode("points").alias("p")).select("panel", "series_id", "p.date", "p.value")


@add("month_offset", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, strftime(date_trunc('month', o_orderdate) - INTERVAL 13 MONTH, '%Y-%m') AS before, year(o_orderdate)::VARCHAR || '-Q' || quarter(o_orderdate)::VARCHAR AS quarter FROM orders", "")
def month_offset(spark, d):
    o = table(spark, d, "orders")
    key = C.month_key(F.col("o_orderdate"))
    return o.select("o_orderkey", key.alias("month"), C.month_offset(key, -13).alias("before"), C.quarter_label(F.col("o_orderdate")).alias("quarter"))


@add("date_bounds", "SELECT panel, series_id, strftime(MIN(date), '%Y-%m') AS first_month, strftime(MAX(date), '%Y-%m') AS last_month, COUNT(DISTINCT date_trunc('month', date)) AS n_months FROM obs GROUP BY 1, 2")
def date_bounds(spark, d):
    return P.date_bounds(observations(spark, d))


@add("slice_key", "SELECT MIN(year(date))::VARCHAR || '-' || MAX(year(date))::VARCHAR AS slice_key FROM obs")
def slice_key(spark, d):
    return P.slice_key(observations(spark, d))


WINDOWS = [(1, "SECTOR_A", "1996-01-01", "1998-12-31"), (2, "RATE3", "1997-05-01", "2000-05-01"), (3, "POWER", "1999-01-01", "1999-06-30")]
WIN = "win AS (SELECT w.*, kind FROM (VALUES " + ", ".join(f"({i}, '{s}', DATE '{a}', DATE '{b}')" for i, s, a, b in WINDOWS) + ") AS w(window_id, series_id, \"start\", \"end\") JOIN meta USING (series_id))"
CHG = """chg AS (SELECT o.panel, window_id, series_id, kind, arg_min(v, date) AS start_val, arg_max(v, date) AS end_val FROM (SELECT o.*, {v} AS v FROM obs o {join}) o JOIN win USING (series_id) WHERE date BETWEEN "start" AND "end" GROUP BY 1, 2, 3, 4)"""


def windows(spark):
    return spark.createDataFrame(WINDOWS, "window_id int, series_id string, start string, end string").withColumns({"start": F.col("start").cast("date"), "end": F.col("end").cast("date")})


@add("window_change", f"SELECT panel, window_id, series_id, round(start_val, {D + 3}) AS start_val, round(end_val, {D + 3}) AS end_val, coalesce(round((end_val - start_val) / NULLIF(start_val, 0) * 100, {D}), 0) AS change_pct, coalesce(round(end_val / NULLIF(start_val, 0) * 100, {D}), 0) AS pct_of_start FROM chg", f"{META}, {OBS}, {WIN}, " + CHG.format(v="o.value / NULLIF(p.value, 0)", join="JOIN (SELECT panel, date_trunc('month', date) AS m, value FROM obs WHERE series_id = 'POP') p ON p.panel = o.panel AND p.m = date_trunc('month', o.date)"))
def window_change(spark, d):
    out = P.window_change(observations(spark, d), windows(spark), "POP", digits=D)
    return out.withColumns({c: F.round(c, D + 3) for c in ("start_val", "end_val")})


@add("change_by_kind", f"SELECT panel, window_id, series_id, CASE WHEN kind = 'rate' THEN df ELSE rel END AS main_change, CASE WHEN kind = 'rate' THEN rel ELSE df END AS beside, CASE WHEN kind = 'rate' THEN 'pp' ELSE '%' END AS unit, rel AS change_pct FROM (SELECT *, round(end_val - start_val, {D}) AS df, coalesce(round((end_val - start_val) / NULLIF(start_val, 0) * 100, {D}), 0) AS rel FROM chg)", f"{META}, {OBS}, {WIN}, " + CHG.format(v="o.value", join=""))
def change_by_kind(spark, d):
    return P.change_by_kind(P.window_change(observations(spark, d), windows(spark), digits=D), metadata(spark).select("series_id", "kind"), D)


@add("trend_tail_stats", f"SELECT panel, series_id, round(arg_max(g, date), {D}) AS latest, round(AVG(g), {D}) AS avg_n, COUNT(*) FILTER (g < 0) AS negative_n, round(MAX(g), {D}) AS peak FROM (SELECT * FROM {TAIL.format(lag=1, scale=400)} WHERE g IS NOT NULL QUALIFY ROW_NUMBER() OVER (PARTITION BY panel, series_id ORDER BY date DESC) <= 20) GROUP BY 1, 2")
def trend_tail_stats(spark, d):
    return P.trend_tail_stats(observations(spark, d), digits=D)


DIFFS = f"(SELECT panel, date, SECTOR_A - LAG(SECTOR_A, 12) OVER p AS da, SECTOR_B - LAG(SECTOR_B, 12) OVER p AS db FROM {wide('SECTOR_A', 'SECTOR_B')} WINDOW p AS (PARTITION BY panel ORDER BY date))"


@add("faster_count", f"SELECT panel, COUNT(*) FILTER (da > db) AS faster, COUNT(*) AS total FROM (SELECT * FROM {DIFFS} WHERE da IS NOT NULL AND db IS NOT NULL QUALIFY ROW_NUMBER() OVER (PARTITION BY panel ORDER BY date DESC) <= 24) GROUP BY 1")
def faster_count(spark, d):
    return P.faster_count(observations(spark, d), "SECTOR_A", "SECTOR_B")


@add("faster_count_since", f"SELECT panel, COUNT(*) FILTER (da > db) AS faster, COUNT(*) AS total FROM {DIFFS} WHERE da IS NOT NULL AND db IS NOT NULL AND date >= DATE '1999-01-01' GROUP BY 1")
def faster_count_since(spark, d):
    return P.faster_count(observations(spark, d), "SECTOR_A", "SECTOR_B", since="1999-01-01")


@add("post_event_index_change", f"SELECT panel, round(da, {D}) AS a_change, round(db, {D}) AS b_change, round(da - db, {D}) AS divergence FROM (SELECT panel, arg_max(ai, date) - arg_min(ai, date) AS da, arg_max(bi, date) - arg_min(bi, date) AS db FROM (SELECT panel, date, SECTOR_A / NULLIF(first_value(SECTOR_A) OVER p, 0) * 100 AS ai, SECTOR_B / NULLIF(first_value(SECTOR_B) OVER p, 0) * 100 AS bi FROM {wide('SECTOR_A', 'SECTOR_B')} WINDOW p AS (PARTITION BY panel ORDER BY date)) WHERE date >= DATE '1999-01-01' GROUP BY 1)")
def post_event_index_change(spark, d):
    return P.post_event_index_change(observations(spark, d), "SECTOR_A", "SECTOR_B", "1999-01-01", digits=D)


def predictions(spark, d):
    return predictions_of(observations(spark, d))


def predictions_of(obs):
    """Monthly shares as probabilities, the flag (up to 2000) as what happened."""
    wide_ = P.side_by_side(obs, ["RATE3", "FLAG"]).filter("RATE3 is not null and FLAG is not null")
    actual = F.when(F.col("date") <= F.lit("2000-01-01").cast("date"), F.col("FLAG").cast("int"))
    return wide_.select("panel", "date", (F.col("RATE3") / 100).alias("probability"), (F.col("RATE3") > 50).cast("int").alias("prediction"), actual.alias("actual"))


PRED = f"pred AS (SELECT panel, date, RATE3 / 100 AS probability, CAST(RATE3 > 50 AS INTEGER) AS prediction, CASE WHEN date <= DATE '2000-01-01' THEN CAST(FLAG AS INTEGER) END AS actual FROM {wide('RATE3', 'FLAG')})"
SPLIT = "SELECT p.panel, date, probability, part FROM pred p JOIN (SELECT panel, MAX(date) FILTER (actual = 1) AS edge FROM pred GROUP BY 1) e USING (panel) JOIN (VALUES ('evaluated'), ('forward')) AS k(part) ON (part = 'evaluated' AND (edge IS NULL OR date <= edge)) OR (part = 'forward' AND date >= edge)"


@add("prediction_split", SPLIT, f"{OBS}, {PRED}")
def prediction_split(spark, d):
    return P.prediction_split(predictions(spark, d))


# ---- a wide panel: one for each supplier ----
WIDE = """sup AS (SELECT l_suppkey AS panel, 'PIECES' AS series_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, SUM(CAST(l_quantity AS BIGINT))::DOUBLE AS value FROM lineitem GROUP BY 1, 3)"""


def by_supplier(spark, d):
    """panel (a supplier), series_id, date, value: pieces shipped a month."""
    lines = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("panel"), F.trunc("l_shipdate", "MM").alias("date"), F.col("l_quantity").cast("long").alias("n"))
    return lines.groupBy("panel", "date").agg(F.sum("n").cast("double").alias("value")).select("panel", F.lit("PIECES").alias("series_id"), "date", "value")


@add("mom_yoy_change_by_supplier", f"SELECT panel, series_id, date, value AS level, round((value / NULLIF(LAG(value) OVER p, 0) - 1) * 100, {D + 1}) AS mom_pct, round((value / NULLIF(LAG(value, 12) OVER p, 0) - 1) * 100, {D}) AS yoy_pct FROM sup WINDOW p AS (PARTITION BY panel, series_id ORDER BY date)", WIDE)
def mom_yoy_change_by_supplier(spark, d):
    return P.mom_yoy_change(by_supplier(spark, d), ["PIECES"], digits=D)


@add("longest_streak_by_supplier", "SELECT panel, series_id, coalesce(MAX(n), 0) AS longest FROM (SELECT DISTINCT panel, series_id FROM sup) LEFT JOIN (SELECT panel, series_id, COUNT(*) AS n FROM (SELECT *, k - ROW_NUMBER() OVER (PARTITION BY panel, series_id ORDER BY date) AS run FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY panel, series_id ORDER BY date) AS k FROM sup) WHERE value < 60) GROUP BY panel, series_id, run) USING (panel, series_id) GROUP BY ALL", WIDE)
def longest_streak_by_supplier(spark, d):
    return P.longest_streak(by_supplier(spark, d).withColumnRenamed("date", "month"), 60.0)


# ---- files ----
FILES = """SELECT panel || '.' || series_id AS series_id, m.name, COUNT(*) AS n, round(SUM(value), 4) AS total, MIN(date) AS first, 1 AS n_broken FROM obs JOIN meta m USING (series_id)
WHERE date >= DATE '1996-01-01' AND month(date) <> 2 AND NOT (panel = 'ASIA' AND series_id = 'FLAG') GROUP BY 1, 2"""


@add("load_series_files", FILES, f"{OBS}, {META}")
def load_series_files(spark, d):
    """The panel written as a JSON file for each series and read back: months without a number, and a file that is cut off."""
    rows = observations(spark, d).join(F.broadcast(metadata(spark).select("series_id", "name", "frequency")), "series_id")  # eleven rows
    value = F.when(F.month("date") == 2, ".").otherwise(F.col("value").cast("string"))
    each = rows.groupBy(F.concat_ws(".", "panel", "series_id").alias("id"), "name", "frequency").agg(F.sort_array(F.collect_list(F.struct(F.date_format("date", "yyyy-MM-dd").alias("date"), value.alias("value")))).alias("observations"))
    text = F.to_json(F.struct(F.col("id").alias("series_id"), "name", "frequency", "observations"))
    out = scratch_path(spark, "series-json")
    each.select("id", F.when(F.col("id") == "ASIA.FLAG", F.substring(text, 1, 200)).otherwise(text).alias("value")).repartition("id").write.partitionBy("id").text(out)
    raw = L.read_series_json(spark, out)
    found = L.clean_observations(raw, "1996-01-01").groupBy("series_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.min("date").alias("first"))
    broken = L.file_errors(raw).agg(F.sum("n_broken").alias("n_broken"))
    return found.join(L.series_metadata(raw).select("series_id", "name"), "series_id").crossJoin(F.broadcast(broken)).select("series_id", "name", "n", "total", "first", "n_broken")


@add("load_story_files", "SELECT doc_id AS story_id, n_chars AS score, length(text) AS length, CAST('2023-0' || (1 + doc_id % 9) || '-01' AS DATE) AS month, 1 AS n_broken FROM documents WHERE text IS NOT NULL", "")
def load_story_files(spark, d):
    """Documents written as stories, a JSON value on each line, and read back beside a line that is cut off."""
    docs = table(spark, d, "documents")
    rows = docs.select(F.col("doc_id").alias("story_id"), F.concat(F.lit("2023-0"), 1 + F.col("doc_id") % 9, F.lit("-05T00:00:00Z")).alias("created_utc"), F.col("text").alias("title"), F.col("n_chars").alias("score"), F.lit(0.0).alias("sentiment_score"), F.lit("neutral").alias("sentiment_label"))
    out = scratch_path(spark, "stories-json")
    rows.write.json(out)
    spark.createDataFrame([('{"story_id": 1, "title": "cut o',)], "value string").coalesce(1).write.mode("append").text(out)
    stories, counts = L.stories_and_counts(spark, out, lines=True)
    return stories.select("story_id", "score", F.char_length("title").alias("length"), "month", F.lit(counts["broken"]).alias("n_broken"))


CURATED = """SELECT source AS series_id, 'scholarly:' || doc_id AS doc_type, 'title ' || doc_id AS title, length(text) AS length FROM documents WHERE source IN (SELECT source FROM documents GROUP BY 1 HAVING COUNT(*) > 1) AND trim(text, ' ') <> ''
UNION ALL SELECT '_CROSS_SERIES', 'concept:item' || item_id, 'Item ' || item_id, length(text) + length(item_id::VARCHAR) + 8 FROM benchmark"""


@add("load_curated_files", CURATED, "")
def load_curated_files(spark, d):
    """Documents written as JSON and benchmark items as a Markdown file each, and read back; sources of a single document are unknown."""
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark")
    n = F.col("doc_id").cast("string")
    base = scratch_path(spark, "curated")
    docs.select(n.alias("id"), F.col("source").alias("series_id"), F.concat(F.lit("title "), n).alias("title"), F.col("text").alias("content")).write.json(f"{base}/json")
    k = F.col("item_id").cast("string")
    items.select(F.concat(F.lit("item"), k).alias("name"), F.concat(F.lit("# Item "), k, F.lit("\n"), "text").alias("value")).repartition("name").write.partitionBy("name").text(f"{base}/notes")
    known = docs.groupBy(F.col("source").alias("series_id")).count().filter("count > 1")
    out = L.load_curated_docs(spark, f"{base}/json", f"{base}/notes", known, "2024-01-01", lines=True)
    # The writer names files itself, so a note is known by its folder; it ends each value with a line end.
    note, title = F.col("series_id") == "_CROSS_SERIES", F.col("title")
    kind = F.when(note, F.concat(F.lit("concept:item"), F.regexp_extract(title, "([0-9]+)$", 1))).otherwise(F.col("doc_type"))
    return out.select("series_id", kind.alias("doc_type"), "title", (F.char_length("content") - note.cast("int")).alias("length"))


COMMITTED = """SELECT 'C' || c_custkey AS key, coalesce(t, round(c_acctbal, 2)) AS amount FROM customer LEFT JOIN (SELECT o_custkey, SUM(CAST(round(o_totalprice * 100) AS BIGINT))::DOUBLE / 100 AS t FROM orders GROUP BY 1) ON o_custkey = c_custkey
UNION ALL SELECT 'S' || s_suppkey, round(s_acctbal, 2) FROM supplier WHERE s_acctbal >= 0"""


@add("upsert_committed", COMMITTED, "")
def upsert_committed(spark, d):
    """A table by commits: balances of customers, then suppliers and sums of orders upserted (twice, which is once), then suppliers in debt pruned."""
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string")).alias("key")
    path = scratch_path(spark, "balances")
    customers = table(spark, d, "customer").select(name("C", "c_custkey"), F.round("c_acctbal", 2).alias("amount"))
    suppliers = table(spark, d, "supplier").select(name("S", "s_suppkey"), F.round("s_acctbal", 2).alias("amount"))
    sums = table(spark, d, "orders").groupBy("o_custkey").agg((F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).cast("double") / 100).alias("amount")).select(name("C", "o_custkey"), "amount")
    B.commit_upsert(spark, path, customers, ["key"], "customers")
    for _ in range(2):
        B.commit_upsert(spark, path, suppliers.unionByName(sums), ["key"], "suppliers and orders")
    B.commit_prune(spark, path, suppliers.filter("amount >= 0"), "key", "S", "pruned")
    return B.read_table(spark, path)


# ---- export ----
EXPORTED = "SELECT 'monthly_pieces' AS name, COUNT(*) AS written, COUNT(*) AS reread FROM sup UNION ALL SELECT 'events', COUNT(*), COUNT(*) FROM events UNION ALL SELECT 'regions', COUNT(*), COUNT(*) FROM region"


@add("export_queries_csv", EXPORTED, WIDE)
def export_queries_csv(spark, d):
    """Three frames written as CSV files: rows counted while they were written, and rows read back."""
    frames = {"monthly_pieces": by_supplier(spark, d), "events": table(spark, d, "events").select("event_id", "ts", "event_type", "value"), "regions": table(spark, d, "region").select("r_regionkey", "r_name")}
    out = scratch_path(spark, "csv")
    counts = L.export_queries_csv(frames, out)
    rows = [(name, n, spark.read.option("header", True).csv(f"{out}/{name}").count()) for name, n in counts.items()]
    return spark.createDataFrame(rows, "name string, written long, reread long")
