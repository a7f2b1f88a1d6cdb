"""Registered queries over the single insights, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import claims as K
from ..operators import insights as I
from ..operators import model as M
from ..sources.scratch import kept
from .panel_queries import PRED, predictions_of
from .risk_queries import FEATS, JSON, LEVELS, RULES, SIG, grid_of, panel_obs, parts, with_json
from .stand_ins import stories, table
from .story_queries import EARLY

QUERIES: dict = {}
ORACLE: dict = {}
NAMES = {"unrate": "RATE3", "u6": "RATE6", "spread": "SPREAD", "gdp": "LEVEL", "prices": "INDEX", "info": "SECTOR_A", "trades": "SECTOR_B", "power": "POWER"}
ROWS = I.spec_rows(events={"launch": "1997-01", "baseline": "1995-02"})


def literal(value) -> str:
    return "NULL" if value is None else str(value).upper() if isinstance(value, bool) else repr(value)


COLUMNS = list(ROWS[0])
TABLE = f"spec AS (SELECT * FROM (VALUES {', '.join('(' + ', '.join(literal(r[c]) for c in COLUMNS) + ')' for r in ROWS)}) AS s({', '.join('feature_of' if c == 'feature' else c for c in COLUMNS)}))"
ROLE_NAMES = "roles AS (SELECT * FROM (VALUES " + ", ".join(map(str, NAMES.items())) + ") AS r(role, series_id))"
VALUES = f"""mon AS (SELECT panel, series_id, CAST(date_trunc('month', date) AS DATE) AS month, arg_min(value, date) AS f, arg_max(value, date) AS l, SUM(value) AS s, COUNT(*) AS n FROM obs GROUP BY 1, 2, 3),
ppl AS (SELECT panel, date AS month, value AS people FROM obs WHERE series_id = 'POP'),
spans AS (SELECT panel, role, MIN(month) AS low, MAX(month) AS high FROM mon JOIN roles USING (series_id) GROUP BY ALL
UNION ALL SELECT panel, '{I.RISK}', CAST(date_trunc('month', MIN(date)) AS DATE), CAST(date_trunc('month', MAX(date)) AS DATE) FROM pred GROUP BY 1
UNION ALL SELECT r_name, '{I.STORIES}', (SELECT MIN(month) FROM roll), (SELECT MAX(month) FROM roll) FROM region),
win AS (SELECT s.panel, spec.*, e.high AS t1, coalesce(e.high - to_months(back), b.low, CAST(since || '-01' AS DATE)) AS t0 FROM spec JOIN spans s ON s.role = spec.of
LEFT JOIN spans e ON e.panel = s.panel AND e.role = ends LEFT JOIN spans b ON b.panel = s.panel AND b.role = from_role),
meas AS (SELECT win.panel, insight, position, arg_min(f / h, mon.month) AS a, arg_max(l / h, mon.month) AS b, SUM(s / h) / SUM(n) AS mean, COUNT(*) FILTER (s / h / n < threshold) AS below, COUNT(*) FILTER (s / h / n > threshold) AS above
FROM win JOIN roles ON role = win.of JOIN mon ON mon.panel = win.panel AND mon.series_id = roles.series_id AND mon.month BETWEEN t0 AND t1 LEFT JOIN ppl ON ppl.panel = win.panel AND ppl.month = mon.month
CROSS JOIN LATERAL (SELECT CASE WHEN per_capita THEN people ELSE 1.0 END AS h) WHERE f / h IS NOT NULL GROUP BY ALL),
feat AS (SELECT panel, f, v, red FROM (SELECT panel, month, f, red, v, MAX(month) OVER (PARTITION BY panel) AS newest FROM (SELECT sig.*, CASE f {' '.join(f"WHEN '{f}' THEN {f}" for f, _ in RULES)} END AS v FROM sig JOIN fj USING (panel, month))) WHERE month = newest),
flags AS (SELECT panel, COUNT(*) FILTER (red) AS reds, arg_max(v, abs(v)) FILTER (red AND v <> 0) AS top_red, arg_max(v, abs(v)) FILTER (NOT red AND v <> 0) AS top_green FROM feat GROUP BY 1),
ends AS (SELECT MIN(probability) AS lo, MAX(probability) AS hi FROM grid),
val AS (SELECT win.*, CASE aggregation WHEN 'latest' THEN b WHEN 'change_pct' THEN (b - a) / NULLIF(a, 0) * 100 WHEN 'pct_of_start' THEN b / NULLIF(a, 0) * 100 WHEN 'average' THEN mean WHEN 'count_below' THEN below WHEN 'count_above' THEN above
WHEN 'prediction_latest' THEN (SELECT arg_max(probability, date) FROM pred WHERE pred.panel = win.panel) WHEN 'prediction_at_date' THEN (SELECT arg_max(probability, date) FROM pred WHERE pred.panel = win.panel AND date <= last_day(t0))
WHEN 'prediction_count_above' THEN (SELECT COUNT(*) FROM pred WHERE pred.panel = win.panel AND probability > threshold)
WHEN 'prediction_direction' THEN CASE WHEN (SELECT arg_max(probability, date) FROM pred WHERE pred.panel = win.panel) > (SELECT arg_max(probability, date) FROM pred WHERE pred.panel = win.panel AND date <= last_day(t0)) THEN 1 ELSE -1 END
WHEN 'scenario_min' THEN lo WHEN 'scenario_max' THEN hi WHEN 'feature_red_count' THEN reds WHEN 'feature_value' THEN CASE WHEN feature_of = 'strongest_red' THEN top_red ELSE top_green END END AS x FROM win LEFT JOIN meas USING (panel, insight, position) LEFT JOIN flags USING (panel) CROSS JOIN ends)"""
SQL = f"WITH {FEATS}, {PRED}, {LEVELS}, {JSON}, {SIG}, {TABLE}, {ROLE_NAMES}, {VALUES} "


def add(name: str, sql: str):
    def wrap(f):
        QUERIES[name], ORACLE[name] = f, SQL + sql
        return f

    return wrap


def made(spark, d):
    """The claims of all insights and panels, and the tables they were read off."""
    obs = panel_obs(spark, d)
    ends = lambda c: (F.trunc(F.min(c), "MM").alias("low"), F.trunc(F.max(c), "MM").alias("high"))
    names = F.element_at(F.create_map(*[F.lit(x) for role, s in NAMES.items() for x in (s, role)]), F.col("series_id"))
    of_series = obs.filter(F.col("series_id").isin(*NAMES.values())).groupBy("panel", names.alias("role"), "metric").agg(*ends("date"))
    scores = kept(predictions_of(obs), "predictions")
    of_scores = scores.groupBy("panel").agg(*ends("date")).select("panel", F.lit(I.RISK).alias("role"), F.col("panel").alias("metric"), "low", "high")
    months = stories(spark, d, EARLY).agg(*ends("month"))
    of_stories = table(spark, d, "region").select(F.col("r_name").alias("panel"), F.lit(I.STORIES).alias("role"), F.lit("").alias("metric")).join(F.broadcast(months))
    newest = with_json(spark, d).groupBy("panel").agg(F.max_by(F.struct("features_json"), "month").alias("x")).select(F.col("panel").alias("metric"), "x.features_json")
    newest = kept(newest, "features")
    signals = I.strongest_values(M.feature_signals(newest, ["metric"]), newest)
    tables = parts(obs), scores.select(F.col("panel").alias("metric"), "date", "probability"), grid_of(obs), signals
    return I.insight_claims(of_series.unionByName(of_scores).unionByName(of_stories), *tables, ROWS), tables


COUNTED = "SELECT panel, insight, kind, position, aggregation, strftime(CASE WHEN t1 IS NOT NULL THEN t0 END, '%Y-%m') AS period_start, strftime(t1, '%Y-%m') AS period_end, coalesce(sign(x) * floor(abs(x) * pow(10.0, digits) + 0.5) / pow(10.0, digits), 0) AS value FROM val"


@add("insight_claims", COUNTED)
def insight_claims(spark, d):
    """The claims of all 21 insights, for every panel."""
    return made(spark, d)[0].select("panel", "insight", "kind", "position", "aggregation", "period_start", "period_end", "value")


@add("insight_report", "SELECT panel, insight, COUNT(*) AS total, COUNT(x) AS passed_count FROM val GROUP BY 1, 2")
def insight_report(spark, d):
    """The insights graded by the verifier that readers use: a claim passes where its value could be formed."""
    claims, tables = made(spark, d)
    claims = kept(claims, "claims")
    results = K.verify_claims(claims, *tables).join(claims.select("claim_id", "panel", "insight"), "claim_id")
    return results.groupBy("panel", "insight").agg(F.count("*").alias("total"), F.count_if("passed").alias("passed_count"))
