"""Registered queries over shock adjustment, features, models, scenarios and claims, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import within_tolerance
from ..operators import claims as K
from ..operators import features as X
from ..operators import model as M
from ..operators import panel as P
from ..operators import shock as H
from .panel_queries import PRED, by_supplier, predictions, predictions_of
from .stand_ins import OBS, metadata, observations, stories_sql, table
from ..sources.scratch import kept
from .story_queries import EARLY, rollup

QUERIES: dict = {}
ORACLE: dict = {}
D = 6
START, END = "1998-03-01", "2000-01-01"


def add(name: str, sql: str | None = None, ctes: str = OBS):
    def wrap(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = f"WITH {ctes} {sql}" if ctes else sql
        return f

    return wrap


# ---- shock window ----
FIRST = "DATE '1999-10-01'"
SHARE = f"least((date_diff('day', {FIRST}, date) + 1) / (date_diff('day', {FIRST}, DATE '2000-02-01') + 1), 1.0)::DOUBLE"
TAPER = f"CASE WHEN date < {FIRST} THEN forecast ELSE (1 - {SHARE}) * forecast + {SHARE} * value END"


def linear(source: str, least: int, tag: str) -> str:
    return f"""n{tag} AS (SELECT panel, series_id, date, value, ROW_NUMBER() OVER (PARTITION BY panel, series_id ORDER BY date)::DOUBLE AS n FROM {source} WHERE date <= DATE '{END}'),
l{tag} AS (SELECT panel, series_id, regr_slope(value, n) AS slope, regr_intercept(value, n) AS base FROM n{tag} WHERE date < DATE '{START}' GROUP BY 1, 2 HAVING COUNT(*) >= {least}),
f{tag} AS (SELECT panel, series_id, date, value, base + slope * n AS forecast FROM n{tag} JOIN l{tag} USING (panel, series_id) WHERE date >= DATE '{START}')"""


STD = f"{OBS}, " + linear("obs", 8, "s")
DAILY = f"{OBS}, mon AS (SELECT panel, series_id, CAST(date_trunc('month', date) AS DATE) AS date, AVG(value) AS value FROM obs WHERE series_id = 'SPREAD' GROUP BY 1, 2, 3), " + linear("mon", 12, "d")


MONTHLY = f"{OBS}, mall AS (SELECT panel, series_id, CAST(date_trunc('month', date) AS DATE) AS date, AVG(value) AS value FROM obs GROUP BY 1, 2, 3), " + linear("mall", 8, "m")


def panel_obs(spark, d):
    """The panel, written once for a query that reads it several times, with metric: panel and series."""
    return kept(observations(spark, d).withColumn("metric", F.concat_ws(".", "panel", "series_id")), "observations")


def some(spark, d, *ids):
    return observations(spark, d).filter(F.col("series_id").isin(*ids))


def by_month(spark, d):
    """All series; daily ones as monthly means."""
    return P.monthly_mean(observations(spark, d), col="value").select("panel", "series_id", F.col("month").alias("date"), "value")


def by_season(spark, d, method):
    """Quarterly series with a season of four rows, the others with one of twelve."""
    rows = by_month(spark, d)
    parts = [H.shock_forecast(rows.filter(cond), START, END, method, season=n) for cond, n in (("series_id = 'LEVEL'", 4), ("series_id <> 'LEVEL'", 12))]
    return parts[0].unionByName(parts[1]).withColumn("forecast", F.round("forecast", D))


@add("shock_adjust_binary", f"SELECT panel, series_id, date, CASE WHEN date BETWEEN DATE '{START}' AND DATE '{END}' THEN 0.0::DOUBLE ELSE value END AS value_adj FROM obs WHERE series_id = 'FLAG'")
def shock_adjust_binary(spark, d):
    return H.shock_adjust_binary(some(spark, d, "FLAG"), ["FLAG"], START, END).select("panel", "series_id", "date", "value_adj")


@add("shock_forecast", "SELECT panel, series_id, date, round(forecast, 4) AS forecast FROM fm", MONTHLY)
def shock_forecast(spark, d):
    return H.shock_forecast(by_month(spark, d), START, END, "linear").withColumn("forecast", F.round("forecast", 4))


SEASON = "CASE WHEN series_id = 'LEVEL' THEN 4 ELSE 12 END"
SEASONAL = f"""SELECT a.panel, a.series_id, a.date, round(b.value, {D}) AS forecast FROM nm a JOIN (SELECT panel, series_id, {SEASON} AS season, COUNT(*) AS c FROM nm WHERE date < DATE '{START}' GROUP BY 1, 2 HAVING COUNT(*) >= greatest(8, {SEASON})) k USING (panel, series_id)
JOIN nm b ON b.panel = a.panel AND b.series_id = a.series_id AND b.n = k.c - k.season + 1 + (a.n - k.c - 1) % k.season WHERE a.date >= DATE '{START}'"""


@add("shock_forecast_seasonal", SEASONAL, MONTHLY)
def shock_forecast_seasonal(spark, d):
    return by_season(spark, d, "seasonal_naive")


@add("shock_forecast_arima")
def shock_forecast_arima(spark, d):
    return by_season(spark, d, "arima")


@add("taper_blend", f"SELECT panel, series_id, date, round({TAPER}, 4) AS adjusted FROM fm", MONTHLY)
def taper_blend(spark, d):
    obs = by_month(spark, d)
    both = H.shock_forecast(obs, START, END, "linear").join(obs, ["panel", "series_id", "date"])
    return both.select("panel", "series_id", "date", F.round(H.taper_blend(F.col("date"), F.col("forecast"), F.col("value"), END), 4).alias("adjusted"))


DAILY_SQL = f"SELECT o.panel, o.series_id, o.date, round(coalesce(f.new, o.value_adj), 4) AS value_adj FROM obs o LEFT JOIN (SELECT panel, series_id, date AS month, {TAPER} AS new FROM fd) f ON f.panel = o.panel AND f.series_id = o.series_id AND f.month = date_trunc('month', o.date) WHERE o.series_id = 'SPREAD'"


@add("shock_adjust_daily", DAILY_SQL, DAILY)
def shock_adjust_daily(spark, d):
    return H.shock_adjust_daily(some(spark, d, "SPREAD"), START, END, "linear").select("panel", "series_id", "date", F.round("value_adj", 4).alias("value_adj"))


ALL = f"""adj AS (SELECT o.panel, o.series_id, o.date, o.value, CASE WHEN o.series_id = 'FLAG' THEN CASE WHEN o.date BETWEEN DATE '{START}' AND DATE '{END}' THEN 0.0 ELSE o.value END
WHEN o.series_id = 'SPREAD' THEN coalesce(f.new, o.value) ELSE coalesce(s.new, o.value) END AS value_adj FROM obs o
LEFT JOIN (SELECT panel, series_id, date AS month, {TAPER} AS new FROM fd) f ON f.panel = o.panel AND f.series_id = o.series_id AND f.month = date_trunc('month', o.date)
LEFT JOIN (SELECT panel, series_id, date, {TAPER} AS new FROM fs) s ON s.panel = o.panel AND s.series_id = o.series_id AND s.date = o.date)"""


def adjusted(spark, d, method="linear"):
    return H.shock_adjust_all(kept(observations(spark, d), "observations"), metadata(spark), START, END, ("FLAG",), method)


@add("shock_adjust_all", "SELECT panel, series_id, date, round(value_adj, 3) AS value_adj FROM adj", f"{DAILY}, {linear('obs', 8, 's')}, {ALL}")
def shock_adjust_all(spark, d):
    return adjusted(spark, d).select("panel", "series_id", "date", F.round("value_adj", 3).alias("value_adj"))


@add("shock_forecast_arima_by_supplier")
def shock_forecast_arima_by_supplier(spark, d):
    """Pieces shipped a month, a series for each supplier."""
    return H.shock_forecast(by_supplier(spark, d), START, END, "arima").select("panel", "series_id", "date", F.round("forecast", 3).alias("forecast"))


@add("shock_adjust_all_arima")
def shock_adjust_all_arima(spark, d):
    return adjusted(spark, d, "arima").select("panel", "series_id", "date", F.round("value_adj", 3).alias("value_adj"))


INSIDE = "date_trunc('month', date) BETWEEN DATE '1998-03-01' AND DATE '2000-01-01'"


@add("shock_summary", f"SELECT panel, series_id, COUNT(*) FILTER ({INSIDE}) AS n_adjusted, round(AVG(value) FILTER ({INSIDE}), 3) AS avg_raw, round(AVG(value_adj) FILTER ({INSIDE}), 3) AS avg_adjusted, round(AVG(abs(value - value_adj)) FILTER ({INSIDE}), 3) AS avg_abs_diff, COUNT(*) FILTER (NOT ({INSIDE}) AND value <> value_adj) AS outside_changed FROM adj GROUP BY 1, 2", f"{DAILY}, {linear('obs', 8, 's')}, {ALL}")
def shock_summary(spark, d):
    return H.shock_summary(adjusted(spark, d), START, END, 3)


# ---- features ----
ROLES = {"spread": "SPREAD", "rate3": "RATE3", "rate6": "RATE6", "price": "INDEX", "level": "LEVEL", "pop": "POP", "sector_a": "SECTOR_A", "sector_b": "SECTOR_B", "power": "POWER", "flag": "FLAG"}
BY = ["panel"]
CUTOFF = "1998-12"
WIDE = "wide AS (SELECT panel, CAST(date_trunc('month', date) AS DATE) AS month, " + ", ".join(f"round(AVG(value_adj) FILTER (series_id = '{s}'), 9) AS {r}" for r, s in ROLES.items()) + ", AVG(value) FILTER (series_id = 'FLAG') AS flag_raw FROM obs GROUP BY 1, 2)"
ROLLED = """rolled AS (SELECT *, spread AS yield_spread, AVG(spread) OVER (p ROWS 2 PRECEDING) AS yield_spread_3m_avg, (COUNT(*) FILTER (spread < 0) OVER (p ROWS 5 PRECEDING))::DOUBLE AS yield_inverted_months, rate3 AS unrate,
rate3 - LAG(rate3, 12) OVER p AS unrate_12m_change, rate6 - rate3 AS u6_u3_gap, (price / NULLIF(LAG(price, 12) OVER p, 0) - 1) * 100 AS cpi_yoy, (power / NULLIF(LAG(power, 12) OVER p, 0) - 1) * 100 AS electricity_yoy,
CASE WHEN LEAD(flag_raw, 12) OVER p IS NOT NULL THEN CAST(MAX(flag_raw) OVER (p ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING) AS INTEGER) END AS label FROM wide WINDOW p AS (PARTITION BY panel ORDER BY month))"""
GDP = """gdp AS (SELECT panel, month, last_value(g IGNORE NULLS) OVER (PARTITION BY panel ORDER BY month ROWS UNBOUNDED PRECEDING) AS gdp_growth_annualized FROM wide LEFT JOIN (SELECT panel, month, (level / NULLIF(LAG(level) OVER (PARTITION BY panel ORDER BY month), 0) - 1) * 400 AS g FROM wide WHERE level IS NOT NULL) USING (panel, month))"""
DIV = """div AS (SELECT panel, month, pa / NULLIF(first_value(pa) OVER p, 0) * 100 - pb / NULLIF(first_value(pb) OVER p, 0) * 100 AS divergence_index, (pa / NULLIF(LAG(pa, 12) OVER p, 0) - 1) * 100 AS info_employment_yoy
FROM (SELECT panel, month, sector_a / NULLIF(pop, 0) AS pa, sector_b / NULLIF(pop, 0) AS pb FROM wide WHERE pop IS NOT NULL AND sector_a IS NOT NULL AND sector_b IS NOT NULL) WINDOW p AS (PARTITION BY panel ORDER BY month))"""
STORY = """sfeat AS (SELECT month, AVG(mean_sentiment) OVER (ORDER BY month ROWS 2 PRECEDING) AS sentiment_3m_avg, story_count / NULLIF(LAG(story_count, 12) OVER (ORDER BY month), 0) - 1 AS story_volume_yoy, coalesce(tag_story_count / NULLIF(story_count, 0), 0) AS layoff_story_freq FROM roll)"""
MATRIX = f"""joined AS (SELECT * FROM rolled JOIN gdp USING (panel, month) JOIN div USING (panel, month) LEFT JOIN sfeat USING (month)),
med AS (SELECT median(sentiment_3m_avg) AS ms, median(coalesce(story_volume_yoy, 0)) AS mv, median(layoff_story_freq) AS mf FROM joined WHERE strftime(month, '%Y-%m') <= '{CUTOFF}'),
matrix AS (SELECT * REPLACE (coalesce(sentiment_3m_avg, ms, 0) AS sentiment_3m_avg, coalesce(story_volume_yoy, 0) AS story_volume_yoy, coalesce(layoff_story_freq, mf, 0) AS layoff_story_freq) FROM joined, med),
done AS (SELECT * FROM matrix WHERE """ + " AND ".join(f"{c} IS NOT NULL" for c in X.FEATURES) + ")"
FEATS = f"{OBS}, {stories_sql(EARLY)}, {WIDE}, {ROLLED}, {GDP}, {DIV}, {STORY}, {MATRIX}"


def wide(spark, d):
    return X.monthly_wide(observations(spark, d), ROLES, BY)


def r6(df, *cols):
    return df.withColumns({c: F.round(c, D) for c in cols})


def r6sql(*cols):
    return ", ".join(f"round({c}, {D}) AS {c}" for c in cols)


ROLL_COLS = ("yield_spread", "yield_spread_3m_avg", "yield_inverted_months", "unrate", "unrate_12m_change", "u6_u3_gap", "cpi_yoy")


@add("rolling_features", f"SELECT panel, month, {r6sql(*ROLL_COLS)} FROM rolled", FEATS)
def rolling_features(spark, d):
    return r6(X.rolling_features(wide(spark, d), BY).select("panel", "month", *ROLL_COLS), *ROLL_COLS)


@add("forward_fill", f"SELECT panel, month, {r6sql('gdp_growth_annualized')} FROM gdp", FEATS)
def forward_fill(spark, d):
    return r6(X.quarterly_growth(wide(spark, d), "level", BY).select("panel", "month", "gdp_growth_annualized"), "gdp_growth_annualized")


@add("divergence_features", f"SELECT panel, month, {r6sql('divergence_index', 'info_employment_yoy')} FROM div", FEATS)
def divergence_features(spark, d):
    return r6(X.divergence_features(wide(spark, d), BY), "divergence_index", "info_employment_yoy")


@add("forward_label", "SELECT panel, month, label FROM rolled", FEATS)
def forward_label(spark, d):
    return X.forward_label(wide(spark, d), BY).select("panel", "month", "label")


@add("story_features", f"SELECT panel, month, {r6sql(*X.STORY_FEATURES)} FROM wide LEFT JOIN sfeat USING (month)", FEATS)
def story_features(spark, d):
    spine = wide(spark, d).select("panel", "month")
    return r6(X.story_features(spine, rollup(spark, d, EARLY), BY), *X.STORY_FEATURES)


@add("impute_train_median", f"SELECT panel, month, {r6sql(*X.STORY_FEATURES)} FROM matrix", FEATS)
def impute_train_median(spark, d):
    have = X.divergence_features(wide(spark, d), BY).select("panel", "month")
    filled = X.impute_train_median(X.story_features(have, rollup(spark, d, EARLY), BY), X.STORY_FEATURES, CUTOFF, ("story_volume_yoy",))
    return r6(filled, *X.STORY_FEATURES)


def matrix(spark, d):
    return X.feature_matrix(kept(observations(spark, d), "observations"), rollup(spark, d, EARLY), ROLES, cutoff=CUTOFF)


@add("feature_matrix", f"SELECT panel, month, {r6sql(*X.FEATURES)}, label, CAST(flag_raw AS INTEGER) AS flag_actual FROM done", FEATS)
def feature_matrix(spark, d):
    return r6(matrix(spark, d), *X.FEATURES)


@add("time_split", f"SELECT CASE WHEN strftime(month, '%Y-%m') <= '{CUTOFF}' THEN 'train' ELSE 'test' END AS part, COUNT(*) AS n, CAST(SUM(label) AS BIGINT) AS positives FROM done WHERE label IS NOT NULL GROUP BY 1", FEATS)
def time_split(spark, d):
    train, test = X.time_split(matrix(spark, d), CUTOFF)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part").agg(F.count("*").alias("n"), F.sum("label").alias("positives"))


# ---- model ----
LABELLED = """lab AS (SELECT month(o_orderdate) AS m, CAST(o_totalprice > 2500 AS INTEGER) AS label, round(o_totalprice % 997 / 997, 2) AS probability FROM orders)"""
EVAL = """SELECT m, coalesce(tp / NULLIF(tp + fp, 0), 0) AS precision, coalesce(tp / NULLIF(tp + fn, 0), 0) AS recall, coalesce(2 * tp / NULLIF(2 * tp + fp + fn, 0), 0) AS f1, (rs - pos * (pos + 1) / 2) / NULLIF(pos * neg, 0) AS auc FROM (
SELECT m, COUNT(*) FILTER (label = 1 AND probability > 0.5) AS tp, COUNT(*) FILTER (label = 0 AND probability > 0.5) AS fp, COUNT(*) FILTER (label = 1 AND probability <= 0.5) AS fn, COUNT(*) FILTER (label = 1) AS pos, COUNT(*) FILTER (label = 0) AS neg, SUM(r) FILTER (label = 1) AS rs FROM (
SELECT *, RANK() OVER (PARTITION BY m ORDER BY probability) + (COUNT(*) OVER (PARTITION BY m, probability) - 1) / 2 AS r FROM lab) GROUP BY 1)"""


@add("evaluate_classifier", EVAL.replace("SELECT m, coalesce", f"SELECT m, round(precision, {D}) AS precision, round(recall, {D}) AS recall, round(f1, {D}) AS f1, round(auc, {D}) AS auc FROM (SELECT m, coalesce", 1) + ")", LABELLED)
def evaluate_classifier(spark, d):
    rows = table(spark, d, "orders").select(F.month("o_orderdate").cast("long").alias("m"), (F.col("o_totalprice") > 2500).cast("int").alias("label"), F.round(F.col("o_totalprice") % 997 / 997, 2).alias("probability"))
    scored = rows.withColumn("prediction", (F.col("probability") > 0.5).cast("int"))
    return r6(M.evaluate_classifier(scored, by=("m",)), "precision", "recall", "f1", "auc")


def logistic(spark, d):
    train, test = X.time_split(matrix(spark, d), CUTOFF)
    return M.train_logistic(kept(train, "train"), list(X.FEATURES)), test


@add("train_logistic")
def train_logistic(spark, d):
    model, _ = logistic(spark, d)
    return spark.createDataFrame(list(model.weights.items()), "feature string, weight double")


@add("train_forest")
def train_forest(spark, d):
    train, _ = X.time_split(matrix(spark, d), CUTOFF)
    model = M.train_forest(train, list(X.FEATURES))
    return spark.createDataFrame(list(model.weights.items()), "feature string, importance double")


@add("select_and_score")
def select_and_score(spark, d):
    rows = kept(matrix(spark, d), "matrix")
    train, test = X.time_split(rows, CUTOFF)
    models = [M.train_logistic(train, list(X.FEATURES)), M.train_forest(train, list(X.FEATURES))]
    aucs = [M.evaluate_classifier(m.score(test)).first()["auc"] for m in models]
    return M.select_and_score(models, aucs, rows)


@add("scenario_grid")
def scenario_grid(spark, d):
    model, _ = logistic(spark, d)
    latest = matrix(spark, d).orderBy(F.desc("month"), "panel").limit(1)
    return M.scenario_grid(spark, M.AXES, latest, model)


# Weights of a stated model, so that SQL can score the grid too.
STATED = {f: (-1) ** i * (i + 1) / 100 for i, f in enumerate(X.FEATURES)}
LINE = "-0.5" + "".join(f" + ({w}::DOUBLE * {'g' if f in M.AXES else 'x'}.{f})" for f, w in STATED.items())
PLACES = {"yield_spread": "i // 1170", "unrate": "i // 130 % 9", "gdp_growth_annualized": "i // 10 % 13", "cpi_yoy": "i % 10"}
CELLS = "g AS (SELECT i AS scenario_id, " + ", ".join(f"({low} + {step} * ({PLACES[a]})) / 100 AS {a}" for a, (low, step, _) in M.AXES.items()) + " FROM (SELECT unnest(range(11700)) AS i)), x AS (SELECT * FROM done ORDER BY month DESC, panel LIMIT 1)"


@add("scenario_grid_stated", f"SELECT scenario_id, {', '.join('g.' + a for a in M.AXES)}, round(1 / (1 + exp(-({LINE}))), {D}) AS probability FROM g, x", f"{FEATS}, {CELLS}")
def scenario_grid_stated(spark, d):
    """The whole grid under stated weights, with the other features of the latest row."""
    model = M.Scored("stated", list(X.FEATURES), M.line(-0.5, {f: (w, 0.0, 1.0) for f, w in STATED.items()}), STATED)
    latest = matrix(spark, d).orderBy(F.desc("month"), "panel").limit(1)
    return r6(M.scenario_grid(spark, M.AXES, latest, model).drop("model_name"), "probability")


AXES = {"yield_spread": (-150, 50, 10), "unrate": (3000, 500, 9)}
LEVELS = "mid AS (SELECT AVG(value) AS mid FROM obs WHERE series_id = 'RATE3'), grid AS (SELECT i * 9 + j AS scenario_id, (-150 + 50 * i) / 100 AS yield_spread, (3000 + 500 * j) / 100 AS unrate, 1 / (1 + exp(((-150 + 50 * i) / 100 - ((3000 + 500 * j) / 100 - mid)) / 10)) AS probability FROM mid, (SELECT unnest(range(10)) AS i), (SELECT unnest(range(9)) AS j))"


def grid_of(obs):
    mid = obs.filter("series_id = 'RATE3'").agg(F.avg("value").alias("mid"))
    return M.axis_levels(obs.sparkSession, AXES).crossJoin(F.broadcast(mid)).select("scenario_id", *AXES, (1 / (1 + F.exp((F.col("yield_spread") - (F.col("unrate") - F.col("mid"))) / 10))).alias("probability"))


def grid(spark, d):
    return grid_of(observations(spark, d))


NEAREST = "SELECT query_id, scenario_id, round(probability, 6) AS probability FROM (SELECT l.panel || '/' || l.date AS query_id, scenario_id, probability, ROW_NUMBER() OVER (PARTITION BY l.panel, l.date ORDER BY round(((s.value - yield_spread) / 4.5) ** 2 + ((l.value - unrate) / 40.0) ** 2, 12), scenario_id) AS k FROM obs l JOIN obs s ON s.series_id = 'SPREAD' AND s.panel = l.panel AND s.date = l.date JOIN grid ON true WHERE l.series_id = 'RATE3') WHERE k = 1"


@add("nearest_scenario", NEAREST, f"{OBS}, {LEVELS}")
def nearest_scenario(spark, d):
    both = P.side_by_side(observations(spark, d), ["SPREAD", "RATE3"]).filter("SPREAD is not null and RATE3 is not null")
    queries = both.select(F.concat_ws("/", "panel", "date").alias("query_id"), F.col("SPREAD").alias("yield_spread"), F.col("RATE3").alias("unrate"))
    return M.nearest_scenario(queries, grid(spark, d), AXES).select("query_id", "scenario_id", F.round("probability", D).alias("probability"))


@add("grid_sensitivity", "SELECT axis, round(MAX(r), 6) AS sensitivity FROM (SELECT 'yield_spread' AS axis, MAX(probability) - MIN(probability) AS r FROM grid GROUP BY yield_spread UNION ALL SELECT 'unrate', MAX(probability) - MIN(probability) FROM grid GROUP BY unrate) GROUP BY 1", f"{OBS}, {LEVELS}")
def grid_sensitivity(spark, d):
    return r6(M.grid_sensitivity(grid(spark, d), list(AXES)), "sensitivity")


JSON = "fj AS (SELECT panel, month, yield_spread, yield_inverted_months, unrate_12m_change, gdp_growth_annualized, info_employment_yoy, u6_u3_gap FROM done)"
RULES = (("yield_spread", "<"), ("yield_inverted_months", ">"), ("unrate_12m_change", ">"), ("gdp_growth_annualized", "<"), ("info_employment_yoy", "<"))
SIG = "sig AS (" + " UNION ALL ".join(f"SELECT panel, month, {i} AS i, '{f}' AS f, abs({f}) AS size, {f} {op} 0 AS red FROM fj" for i, (f, op) in enumerate(RULES)) + ")"


def with_json(spark, d):
    rows = matrix(spark, d)
    return rows.select("panel", "month", F.to_json(F.struct(*[f for f, _ in RULES], "u6_u3_gap")).alias("features_json"))


def pick(red: str) -> str:
    return f"coalesce(first(f ORDER BY size DESC, i) FILTER ({red} AND size > 0), '')"


@add("feature_signals", f"SELECT panel, month, CAST(COUNT(*) FILTER (red) AS INTEGER) AS red_count, {pick('red')} AS strongest_red, {pick('NOT red')} AS strongest_green FROM sig GROUP BY 1, 2", f"{FEATS}, {JSON}, {SIG}")
def feature_signals(spark, d):
    return M.feature_signals(with_json(spark, d), ["panel", "month"])


COLOR = " UNION ALL ".join(f"SELECT panel, month, '{f}' AS feature, CASE WHEN {f} {op} 0 THEN 'red' ELSE 'green' END AS color FROM fj" for f, op in RULES) + " UNION ALL SELECT panel, month, 'u6_u3_gap', CASE WHEN u6_u3_gap > (SELECT median(u6_u3_gap) FROM fj) THEN 'red' ELSE 'green' END FROM fj"


@add("feature_signal_color", COLOR, f"{FEATS}, {JSON}")
def feature_signal_color(spark, d):
    return M.feature_signal_color(with_json(spark, d), ["panel", "month"]).select("panel", "month", "feature", "color")


RISK = f"""SELECT panel, round(latest, {D}) AS latest, round(p12, {D}) AS prob_12m_ago, round(p6, {D}) AS prob_6m_ago, above_count, total, CAST(sign(latest - p6) AS INTEGER) AS trend FROM (SELECT panel, arg_max(probability, date) AS latest, arg_max(probability, date) FILTER (date <= last - INTERVAL 12 MONTH) AS p12,
arg_max(probability, date) FILTER (date <= last - INTERVAL 6 MONTH) AS p6, COUNT(*) FILTER (probability > 0.5) AS above_count, COUNT(*) AS total FROM (SELECT *, MAX(date) OVER (PARTITION BY panel) AS last FROM pred) GROUP BY 1)"""


@add("risk_timeline_stats", RISK, f"{OBS}, {PRED}")
def risk_timeline_stats(spark, d):
    return M.risk_timeline_stats(predictions(spark, d), digits=D)


# ---- claims ----
KINDS = ["latest", "change_pct", "pct_of_start", "direction", "average", "count_below", "count_above", "unheard_of"]
RANGES = [("1996-03", "1999-09"), ("1995-01", "2001-12"), ("1998-05", "1998-07"), ("2003-01", "2003-12")]
CLAIMS = """cl AS (SELECT CAST(ROW_NUMBER() OVER (ORDER BY metric, aggregation, period_start) AS BIGINT) AS claim_id, metric, aggregation, period_start, period_end, m AS threshold, aggregation = 'average' AND series_id = 'SECTOR_A' AS per_capita,
CASE WHEN aggregation = 'direction' THEN 1.0 WHEN aggregation LIKE 'count%' THEN 20.0 ELSE m END AS value
FROM (SELECT panel || '.' || series_id AS metric, series_id, round(AVG(value), 1) AS m FROM obs GROUP BY 1, 2) CROSS JOIN (SELECT unnest(['""" + "', '".join(KINDS) + """']) AS aggregation) CROSS JOIN (VALUES """ + ", ".join(map(str, RANGES)) + """) AS r(period_start, period_end))"""
PARTS = """parts AS (SELECT panel || '.' || series_id AS metric, panel, CAST(date_trunc('month', date) AS DATE) AS month, arg_min(value, date) AS f, arg_max(value, date) AS l, SUM(value) AS s, COUNT(*) AS n FROM obs GROUP BY 1, 2, 3),
ppl AS (SELECT panel, date AS month, value AS people FROM obs WHERE series_id = 'POP'),
scaled AS (SELECT metric, p.month, f / h AS f, l / h AS l, s / h AS s, n, claim_id, threshold FROM cl JOIN parts p USING (metric) LEFT JOIN ppl ON ppl.panel = p.panel AND ppl.month = p.month CROSS JOIN LATERAL (SELECT CASE WHEN per_capita THEN people ELSE 1.0 END AS h) WHERE strftime(p.month, '%Y-%m') BETWEEN period_start AND period_end AND f / h IS NOT NULL),
meas AS (SELECT claim_id, arg_min(f, month) AS a, arg_max(l, month) AS b, SUM(s) / SUM(n) AS mean, COUNT(*) FILTER (s / n < threshold) AS below, COUNT(*) FILTER (s / n > threshold) AS above FROM scaled GROUP BY 1),
act AS (SELECT cl.*, CASE aggregation WHEN 'latest' THEN b WHEN 'change_pct' THEN (b - a) / NULLIF(a, 0) * 100 WHEN 'pct_of_start' THEN b / NULLIF(a, 0) * 100 WHEN 'direction' THEN CASE WHEN b > a THEN 1 ELSE -1 END WHEN 'average' THEN mean WHEN 'count_below' THEN below WHEN 'count_above' THEN above END AS actual FROM cl LEFT JOIN meas USING (claim_id))"""
OK = "coalesce(CASE WHEN aggregation LIKE 'count%' THEN abs(value - actual) <= 2 WHEN aggregation = 'direction' THEN (value > 0) = (actual > 0) WHEN value = 0 THEN abs(actual) <= 0.5 ELSE abs(actual - value) <= 0.5 OR abs(actual - value) <= 0.05 * abs(value) END, false)"


def graded_sql(where: str) -> str:
    return f"SELECT claim_id, round(actual, 2) AS actual_value, {OK} AS passed FROM act WHERE {where}"


def claims(obs):
    """A claim for each metric, aggregation and range of months; values and thresholds are rounded means."""
    means = obs.groupBy("metric", "series_id").agg(F.round(F.avg("value"), 1).alias("threshold"))
    spans = F.array(*[F.struct(F.lit(a).alias("period_start"), F.lit(b).alias("period_end")) for a, b in RANGES])
    each = means.withColumn("aggregation", F.explode(F.array(*map(F.lit, KINDS)))).select("*", F.inline(spans))
    kind = F.col("aggregation")
    value = F.when(kind == "direction", 1.0).when(kind.startswith("count"), 20.0).otherwise(F.col("threshold"))
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("metric", "aggregation", "period_start")).cast("long")
    return each.select(number.alias("claim_id"), "metric", "aggregation", "period_start", "period_end", "threshold", ((kind == "average") & (F.col("series_id") == "SECTOR_A")).alias("per_capita"), (F.col("series_id") == "INDEX").alias("use_raw"), value.alias("value"))


def parts(obs):
    heads = obs.filter("series_id = 'POP'").select("panel", F.col("date").alias("month"), F.col("value").alias("people"))
    people = obs.select("panel", "metric").distinct().join(heads, "panel").select("metric", "month", "people")
    return K.monthly_parts(obs, people)


GRADED = f"{OBS}, {CLAIMS}, {PARTS}"


@add("verify_boundary_claims", graded_sql("aggregation IN ('latest', 'change_pct', 'pct_of_start', 'direction')"), GRADED)
def verify_boundary_claims(spark, d):
    obs = panel_obs(spark, d)
    return K.verify_boundary_claims(claims(obs), parts(obs)).drop("reason")


@add("verify_average_claims", graded_sql("aggregation = 'average'"), GRADED)
def verify_average_claims(spark, d):
    obs = panel_obs(spark, d)
    return K.verify_average_claims(claims(obs), parts(obs)).drop("reason")


@add("verify_count_claims", graded_sql("aggregation LIKE 'count%'"), GRADED)
def verify_count_claims(spark, d):
    obs = panel_obs(spark, d)
    return K.verify_count_claims(claims(obs), parts(obs)).drop("reason")


PCLAIMS = """pcl AS (SELECT CAST(ROW_NUMBER() OVER (ORDER BY panel, k) AS BIGINT) AS claim_id, panel AS metric, k AS aggregation, 0.4 AS value, '1999-05' AS period_start, 0.4 AS threshold FROM (SELECT DISTINCT panel FROM pred) CROSS JOIN (SELECT unnest(['prediction_latest', 'prediction_at_date', 'prediction_count_above', 'prediction_direction', 'scenario_min', 'scenario_max']) AS k)),
pact AS (SELECT pcl.*, CASE aggregation WHEN 'prediction_latest' THEN latest WHEN 'prediction_at_date' THEN as_of WHEN 'prediction_count_above' THEN n WHEN 'prediction_direction' THEN CASE WHEN latest > as_of THEN 1 ELSE -1 END WHEN 'scenario_min' THEN lo ELSE hi END AS actual FROM pcl JOIN (
SELECT panel AS metric, arg_max(probability, date) AS latest, arg_max(probability, date) FILTER (date <= DATE '1999-05-31') AS as_of, COUNT(*) FILTER (probability > 0.4) AS n FROM pred GROUP BY 1) USING (metric), (SELECT MIN(probability) AS lo, MAX(probability) AS hi FROM grid))"""
POK = "coalesce(CASE WHEN aggregation = 'prediction_count_above' THEN abs(value - actual) <= 2 WHEN aggregation = 'prediction_direction' THEN (value > 0) = (actual > 0) ELSE abs(actual - value) <= 0.5 OR abs(actual - value) <= 0.05 * abs(value) END, false)"


def prediction_claims(obs):
    kinds = ["prediction_latest", "prediction_at_date", "prediction_count_above", "prediction_direction", "scenario_min", "scenario_max"]
    each = predictions_of(obs).select("panel").distinct().withColumn("aggregation", F.explode(F.array(*map(F.lit, kinds))))
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("panel", "aggregation")).cast("long")
    return each.select(number.alias("claim_id"), F.col("panel").alias("metric"), "aggregation", F.lit(0.4).alias("value"), F.lit("1999-05").alias("period_start"), F.lit("1999-05").alias("period_end"), F.lit(0.4).alias("threshold"), F.lit(False).alias("per_capita"), F.lit(False).alias("use_raw"))


def prediction_rows(obs):
    return predictions_of(obs).select(F.col("panel").alias("metric"), "date", "probability")


def red_counts(obs):
    return predictions_of(obs).select(F.col("panel").alias("metric")).distinct().withColumn("red_count", F.lit(1))


@add("verify_prediction_claims", f"SELECT claim_id, round(actual, 4) AS actual_value, {POK} AS passed FROM pact", f"{OBS}, {PRED}, {LEVELS}, {PCLAIMS}")
def verify_prediction_claims(spark, d):
    obs = panel_obs(spark, d)
    return K.verify_prediction_claims(prediction_claims(obs), prediction_rows(obs), grid_of(obs), red_counts(obs)).drop("reason")


ALL_CLAIMS = f"SELECT claim_id, round(actual, 2) AS actual_value, aggregation <> 'unheard_of' AND {OK} AS passed FROM act UNION ALL SELECT claim_id + 10000, round(actual, 4), {POK} FROM pact"


@add("verify_claims", ALL_CLAIMS, f"{GRADED}, {PRED}, {LEVELS}, {PCLAIMS}")
def verify_claims(spark, d):
    obs = panel_obs(spark, d)
    both = claims(obs).unionByName(prediction_claims(obs).withColumn("claim_id", F.col("claim_id") + 10_000))
    return K.verify_claims(kept(both, "claims"), parts(obs), prediction_rows(obs), grid_of(obs), red_counts(obs)).drop("reason")


@add("within_tolerance", "SELECT l_orderkey, l_linenumber, abs(l_tax - l_discount) <= 0.02 OR (l_discount <> 0 AND abs(l_tax - l_discount) <= 0.5 * abs(l_discount)) AS near FROM lineitem", "")
def tolerance(spark, d):
    near = within_tolerance(F.col("l_discount"), F.col("l_tax"), 0.5, 0.02)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", near.alias("near"))


BUILT = """SELECT claim_id, metric, aggregation, period_start, period_end, round(CASE WHEN aggregation = 'average' THEN mean ELSE (b - a) / NULLIF(a, 0) * 100 END, 4) AS value FROM (
SELECT sp.claim_id, sp.metric, aggregation, strftime(f0, '%Y-%m') AS period_start, strftime(t0, '%Y-%m') AS period_end, arg_min(p.f, p.month) AS a, arg_max(p.l, p.month) AS b, SUM(p.s) / SUM(p.n) AS mean FROM (
SELECT metric || aggregation AS claim_id, metric, aggregation, CASE WHEN aggregation = 'average' THEN t0 - INTERVAL 23 MONTH ELSE DATE '1998-01-01' END AS f0, t0 FROM (SELECT metric, MAX(month) AS t0 FROM parts GROUP BY 1) CROSS JOIN (SELECT unnest(['average', 'change_pct']) AS aggregation)) sp JOIN parts p ON p.metric = sp.metric AND p.month BETWEEN f0 AND t0 GROUP BY ALL)"""


@add("build_claims", BUILT, f"{OBS}, parts AS (SELECT panel || '.' || series_id AS metric, CAST(date_trunc('month', date) AS DATE) AS month, arg_min(value, date) AS f, arg_max(value, date) AS l, SUM(value) AS s, COUNT(*) AS n FROM obs GROUP BY 1, 2)")
def build_claims(spark, d):
    kinds = F.array(F.struct(F.lit("average").alias("aggregation"), F.lit("trailing").alias("rule")), F.struct(F.lit("change_pct").alias("aggregation"), F.lit("since").alias("rule")))
    obs = panel_obs(spark, d)
    spec = obs.select("metric").distinct().select("metric", F.inline(kinds)).select(F.concat("metric", "aggregation").alias("spec_id"), "metric", "aggregation", "rule", F.lit(24).alias("months"), F.lit("1998-01").alias("since"), F.lit(0.0).alias("threshold"), F.lit(False).alias("per_capita"), F.lit(False).alias("use_raw"))
    return K.build_claims(spec, parts(obs), 4).select("claim_id", "metric", "aggregation", "period_start", "period_end", "value")


@add("insight_status", f"SELECT r_name AS insight_id, COUNT(p) AS total, COUNT(*) FILTER (p) AS passed_count, COUNT(p) = COUNT(*) FILTER (p) AS all_verified, CASE WHEN COUNT(p) = COUNT(*) FILTER (p) THEN 'Verified' WHEN COUNT(*) FILTER (p) > 0 THEN 'Partially Verified' ELSE 'Unverified' END AS status FROM region LEFT JOIN (SELECT split_part(metric, '.', 1) AS panel, aggregation <> 'unheard_of' AND {OK} AS p FROM act) ON panel = r_name GROUP BY 1", GRADED)
def insight_status(spark, d):
    obs = panel_obs(spark, d)
    rows = kept(claims(obs), "claims")
    results = K.verify_claims(rows, parts(obs), prediction_rows(obs), grid_of(obs), red_counts(obs)).join(rows.select("claim_id", "metric"), "claim_id")
    return K.insight_status(table(spark, d, "region").select(F.col("r_name").alias("insight_id")), results.withColumn("insight_id", F.substring_index("metric", ".", 1)))


CITE = """SELECT item_id, doc_id IS NOT NULL AS ref_exists, coalesce(p <> '' AND contains(trim(regexp_replace(lower(content), '\\s+', ' ', 'g')), p), false) AS excerpt_matches FROM (
SELECT item_id, d.doc_id, d.text AS content, trim(regexp_replace(lower(rtrim(substr(b.text, 1, 60), '. ' || chr(9) || chr(10))), '\\s+', ' ', 'g')) AS p FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id * 9)"""


@add("verify_citations", CITE, "")
def verify_citations(spark, d):
    cites = table(spark, d, "benchmark").select("item_id", (F.col("item_id") * 9).alias("ref_id"), F.col("text").alias("excerpt"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("ref_id"), F.col("text").alias("content"))
    return K.verify_citations(cites, docs).select("item_id", "ref_exists", "excerpt_matches")


def narrated(spark, d):
    """Documents that cite their own number and one that is not provided."""
    docs = table(spark, d, "documents").filter("text is not null")
    head = F.trim(F.regexp_replace("text", r"[\s\[\]$\\]+", " "))
    return docs.select(F.col("doc_id").alias("narrative_id"), F.concat(head, F.lit("  [ref:"), "doc_id", F.lit("] , end [ref:999999].")).alias("text"), F.col("text").alias("content"))


HEAD = "trim(regexp_replace(text, '[\\s\\[\\]$\\\\]+', ' ', 'g'))"


@add("extract_citations", f"SELECT doc_id AS narrative_id, trim(regexp_replace(regexp_replace({HEAD} || '   , end [ref:999999].', '[ \\t\\r\\f\\v]{{2,}}', ' ', 'g'), '[ \\t\\r\\f\\v]+([,.;:!?])', '\\1', 'g')) AS text, 1 AS records, 1 AS warnings FROM documents WHERE text IS NOT NULL", "")
def extract_citations(spark, d):
    rows = narrated(spark, d)
    provided = rows.select("narrative_id", F.col("narrative_id").alias("ref_id"), F.lit("t").alias("title"), "content")
    texts, records, warnings = K.extract_citations(rows.select("narrative_id", "text"), provided)
    count = lambda df, name: df.groupBy("narrative_id").agg(F.count("*").cast("int").alias(name))
    return texts.join(count(records, "records"), "narrative_id", "left").join(count(warnings, "warnings"), "narrative_id", "left")


@add("validate_narratives", "SELECT doc_id AS narrative_id, CASE WHEN doc_id % 4 = 1 THEN 'a causal verb' ELSE '' END || CASE WHEN doc_id % 4 = 2 THEN 'wording of methods without a citation' ELSE '' END || CASE WHEN doc_id % 4 = 3 THEN 'too many citations' ELSE '' END AS warnings FROM documents", "")
def validate_narratives(spark, d):
    k = F.col("doc_id") % 4
    said = F.when(k == 1, " rates are driving it").when(k == 2, " Seasonally adjusted figures").otherwise(" nothing")
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("narrative_id"), F.concat(F.coalesce("text", F.lit("")), said).alias("text"), F.when(k == 3, 3).otherwise(0).alias("citations"), F.lit(True).alias("had_refs"))
    return K.validate_narratives(rows).select("narrative_id", F.array_join("warnings", "; ").alias("warnings"))


RESP = """SELECT event_id AS id, 'about ' || event_type AS narrative, CAST(event_id % 4 <> 3 AS INTEGER) AS claims, CASE WHEN event_id % 4 <> 3 THEN round(value, 2) END AS expected FROM events"""


@add("parse_responses", RESP, "")
def parse_responses(spark, d):
    """Events as responses: plain JSON, fenced, with words around it, and with a claim that has no number."""
    k = F.col("event_id") % 4
    number = F.when(k == 3, '"many"').otherwise(F.round("value", 2).cast("string"))
    body = F.concat(F.lit('{"narrative": "about '), "event_type", F.lit('", "claims": [{"metric_type": "m", "series_id": "s", "expected_value": '), number, F.lit(', "date_range": ["a", "b"]}, {"metric_type": "m", "expected_value": 1}]}'))
    raw = table(spark, d, "events").select(F.col("event_id").alias("id"), F.when(k == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 2, F.concat(F.lit("so: "), body, F.lit(" ok"))).otherwise(body).alias("text"))
    narratives, found = K.parse_responses(raw)
    sums = found.groupBy("id").agg(F.count("*").cast("int").alias("claims"), F.max("expected_value").alias("expected"))
    return narratives.join(sums, "id", "left").select("id", "narrative", F.coalesce("claims", F.lit(0)).alias("claims"), F.round("expected", 2).alias("expected"))
