"""Claims of the single insights: rules as rows of data, windows found from the tables, values read off running sums."""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .claims import BOUNDARY, COUNTS, PREDICTIONS, SCENARIOS, computed, first_day, measured, verify_prediction_claims


class Rule(NamedTuple):
    """What to read (a role) and over which months: up to the last month of the role `end`, from so many months before it, the first month of a
    role or a named event (`start`); no end: no months. feature: which of the strongest signals a feature_value is."""

    of: str
    aggregation: str
    start: int | str = 0
    end: str | None = None
    threshold: float | None = None
    digits: int = 2
    per_capita: bool = False
    use_raw: bool = False
    feature: str | None = None


# Public ids of the series in each role, and the months of the named events.
SERIES = {"unrate": "UNRATE", "u6": "U6RATE", "spread": "T10Y2Y", "gdp": "GDPC1", "prices": "CPIAUCSL", "info": "USINFO", "trades": "CES2023800001", "power": "IPG2211S"}
EVENTS = {"launch": "2022-11", "baseline": "2020-02"}
RISK, STORIES = "recession_risk", "stories"  # roles whose months are those of predictions and of stories

change, share = "change_pct", "pct_of_start"
# The insights, their kinds, and the claims that each makes.
INSIGHTS = {
    "dashboard_intro": ("trend", [Rule("unrate", "latest", 0, "unrate", digits=1), Rule("gdp", change, 12, "gdp"), Rule("spread", "latest", 0, "spread")]),
    "overview": ("trend", [Rule("unrate", change, 1, "unrate"), Rule("u6", change, 1, "unrate"), Rule("gdp", change, 12, "gdp"), Rule("prices", change, 12, "prices")]),
    "recession_risk": ("trend", [Rule(RISK, "prediction_latest", 0, RISK, digits=4), Rule(RISK, "prediction_at_date", 12, RISK, digits=4), Rule(RISK, "prediction_count_above", threshold=0.5), Rule(RISK, "prediction_direction", 6, RISK)]),
    "feature_snapshot": ("trend", [Rule(RISK, "feature_red_count"), Rule(RISK, "feature_value", feature="strongest_red", digits=6), Rule(RISK, "feature_value", feature="strongest_green", digits=6)]),
    "scenario_explorer": ("comparison", [Rule(RISK, "prediction_latest", digits=4), Rule(RISK, "scenario_min", digits=6), Rule(RISK, "scenario_max", digits=6)]),
    "deep_divergence": ("comparison", [Rule("info", share, "launch", "info", per_capita=True), Rule("trades", share, "launch", "info", per_capita=True), Rule("info", change, "launch", "info", per_capita=True)]),
    "deep_energy": ("correlation", [Rule("power", share, "launch", "power"), Rule("info", share, "launch", "power"), Rule("power", change, "launch", "power"), Rule("info", change, "launch", "power")]),
    "deep_synthesis_charts": ("comparison", [Rule("trades", share, "launch", "info", per_capita=True), Rule("power", share, "launch", "info"), Rule("info", share, "launch", "info", per_capita=True)]),
    "T10Y2Y_UNRATE": ("correlation", [Rule("spread", "count_below", "spread", "unrate", 0.0), Rule("unrate", change, 12, "unrate"), Rule("spread", "average", 12, "unrate")]),
    "GDPC1": ("trend", [Rule("gdp", change, "gdp", "gdp"), Rule("gdp", change, 12, "gdp"), Rule("gdp", "average", 12, "gdp")]),
    "CPIAUCSL": ("trend", [Rule("prices", change, 12, "prices"), Rule("prices", change, 60, "prices"), Rule("prices", "average", 12, "prices")]),
    "USINFO_CES2023800001": ("comparison", [Rule("info", change, "info", "info", per_capita=True), Rule("trades", change, "info", "info", per_capita=True), Rule("info", change, "launch", "info", per_capita=True), Rule("trades", change, "launch", "info", per_capita=True)]),
    "employment_growth": ("trend", [Rule("info", change, 24, "info", per_capita=True), Rule("trades", change, 24, "info", per_capita=True), Rule("info", share, 24, "info", per_capita=True)]),
    "covid_recovery": ("comparison", [Rule("info", share, "baseline", "info", use_raw=True), Rule("trades", share, "baseline", "info", use_raw=True), Rule("info", change, "baseline", "info", use_raw=True), Rule("trades", change, "baseline", "info", use_raw=True)]),
    "U6_U3": ("trend", [Rule("unrate", change, 12, "unrate"), Rule("u6", change, 12, "unrate"), Rule("u6", "count_above", "u6", "unrate", 7.0)]),
    "IPG2211S_USINFO": ("correlation", [Rule("power", change, "launch", "power"), Rule("info", change, "launch", "power"), Rule("power", share, "launch", "power"), Rule("info", share, "launch", "power")]),
    "synthesis": ("trend", [Rule("spread", "count_below", "spread", "unrate", 0.0), Rule("info", change, "info", "unrate", per_capita=True), Rule("prices", change, 12, "unrate"), Rule("unrate", change, 12, "unrate")]),
    "hn_labor_sentiment": ("correlation", [Rule("info", change, 11, STORIES), Rule("power", change, 11, STORIES), Rule("info", "latest", 0, "info")]),
    "hn_topic_analysis": ("trend", [Rule("info", change, 11, STORIES), Rule("info", "latest", 0, "info")]),
    "nlp_topic_sentiment": ("trend", [Rule("info", change, 11, "info")]),
    "nlp_cross_domain": ("correlation", [Rule("info", change, 11, "info"), Rule("u6", "latest", 0, "u6", digits=1)]),
}

SPEC = "insight string, kind string, position int, of string, aggregation string, back int, from_role string, since string, ends string, threshold double, digits int, per_capita boolean, use_raw boolean, feature string"


def spec_rows(insights: dict = INSIGHTS, events: dict = EVENTS) -> list[dict]:
    """The rules as rows of SPEC: the start is a number of months (back), a role (from_role) or a month (since)."""
    rows = []
    for insight, (kind, rules) in insights.items():
        for position, r in enumerate(rules):
            named = isinstance(r.start, str)
            rows.append({"insight": insight, "kind": kind, "position": position, "of": r.of, "aggregation": r.aggregation, "back": None if named else r.start, "from_role": r.start if named and r.start not in events else None, "since": events.get(r.start) if named else None, "ends": r.end, "threshold": r.threshold, "digits": r.digits, "per_capita": r.per_capita, "use_raw": r.use_raw, "feature": r.feature})
    return rows


def placed(spans: DataFrame, rows: list[dict]) -> DataFrame:
    """The claims of every panel without their values: claim_id, panel, the columns of SPEC, metric, period_start, period_end.

    spans: panel, role, metric, low, high (first and last month). A panel's roles, of which there are as many as the rules name, become
    one map, from which its claims are read; a panel is one row, so no panel meets another, and there is one shuffle. A claim
    whose role the panel does not have is left out; one whose window has no end (no stories, say) has no months.
    """
    roles = {r[k] for r in rows for k in ("of", "from_role", "ends")} - {None}
    maps = spans.filter(F.col("role").isin(*roles)).groupBy("panel").agg(F.map_from_entries(F.collect_list(F.struct("role", F.struct("metric", "low", "high")))).alias("_m"))
    each = maps.select("panel", "_m", F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{SPEC.replace(' ', ':').replace(',:', ', ')}>>")))
    of = lambda c: F.try_element_at("_m", F.col(c))
    last = of("ends")["high"]
    first = F.coalesce(F.add_months(last, -F.col("back")), of("from_role")["low"], first_day("since"))
    text = lambda c: F.when(last.isNotNull(), F.date_format(c, "yyyy-MM"))
    out = each.withColumns({"claim_id": F.concat_ws("/", "panel", "insight", F.col("position").cast("string")), "metric": of("of")["metric"], "period_start": text(first), "period_end": text(last)})
    return out.filter("metric is not null").drop("_m", "back", "from_role", "since", "ends")


def insight_claims(spans: DataFrame, parts: DataFrame, predictions: DataFrame, grid: DataFrame, signals: DataFrame, rows: list[dict]) -> DataFrame:
    """Every claim of every insight and panel with its value.

    parts: monthly_parts(); predictions: metric, date, probability; grid: probability; signals: metric, red_count, strongest_red,
    strongest_green (the values of the strongest features). A value that cannot be formed (no data, nothing to start from) is 0, as it is
    for a reader of the claim; verify_claims then fails it.
    """
    claims = placed(spans, rows)
    kind = F.col("aggregation")
    monthly = claims.filter(kind.isin(*BOUNDARY, "average", *COUNTS))
    read = monthly.join(measured(monthly, parts), "claim_id").select("claim_id", computed().alias("value"))
    asked = claims.filter(kind.isin(*PREDICTIONS, *SCENARIOS)).withColumn("value", F.lit(0.0))
    scored = verify_prediction_claims(asked, predictions, grid, signals.select("metric", "red_count"), 12).select("claim_id", F.col("actual_value").alias("value"))
    flag = F.when(kind == "feature_red_count", F.col("red_count").cast("double")).when(F.col("feature") == "strongest_red", F.col("strongest_red")).otherwise(F.col("strongest_green"))
    flags = claims.filter(kind.isin("feature_red_count", "feature_value")).join(signals, "metric").select("claim_id", flag.alias("value"))
    values = claims.join(read.unionByName(scored).unionByName(flags), "claim_id", "left")
    return values.withColumn("value", F.coalesce(rounded(F.col("value"), F.col("digits")), F.lit(0.0))).drop("digits")


def rounded(value: Column, digits: Column) -> Column:
    """Half away from zero at so many digits of each row."""
    scale = F.pow(F.lit(10.0), digits)
    return F.signum(value) * F.floor(F.abs(value) * scale + 0.5) / scale


def strongest_values(labelled: DataFrame, features: DataFrame) -> DataFrame:
    """metric, red_count and the values of the features that feature_signals() names (null where it names none).

    labelled: metric, red_count, strongest_red, strongest_green (names); features: metric, features_json.
    """
    table = F.from_json("features_json", "map<string,double>")
    value = lambda c: F.try_element_at(table, F.col(c)).alias(c)
    return labelled.join(features.select("metric", "features_json"), "metric").select("metric", "red_count", value("strongest_red"), value("strongest_green"))
