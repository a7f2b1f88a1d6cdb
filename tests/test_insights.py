"""Claims of the insights on hand-made panels: windows, missing roles, values that cannot be formed."""

import datetime as dt

from pyspark.sql import functions as F
from seriesloom.operators import claims as K
from seriesloom.operators import insights as I

EVENTS = {"launch": "2020-06", "baseline": "2020-02"}


def months(n, start=2020):
    return [dt.date(start + i // 12, 1 + i % 12, 1) for i in range(n)]


def tables(spark, series, people=()):
    """parts and spans of {(panel, role): values by month}."""
    obs = spark.createDataFrame([(f"{p}.{r}", p, r, m, float(v), float(v) * 2) for (p, r), vs in series.items() for m, v in zip(months(len(vs)), vs)], "metric string, panel string, role string, date date, value_adj double, value double")
    heads = spark.createDataFrame([(f"{p}.{r}", m, float(v)) for p, r, vs in people for m, v in zip(months(len(vs)), vs)], "metric string, month date, people double")
    spans = obs.groupBy("panel", "role", "metric").agg(F.min("date").alias("low"), F.max("date").alias("high"))
    return K.monthly_parts(obs, heads), spans


def outside(spark):
    predictions = spark.createDataFrame([("a", m, 0.1 * i) for i, m in enumerate(months(10))], "metric string, date date, probability double")
    grid = spark.createDataFrame([(0.25,), (0.75,)], "probability double")
    signals = spark.createDataFrame([("a", 2, -1.5, 0.25)], "metric string, red_count int, strongest_red double, strongest_green double")
    return predictions, grid, signals


def test_windows_and_values(spark):
    values = [100 + i for i in range(24)]
    parts, spans = tables(spark, {("a", "info"): values, ("a", "trades"): values[::-1], ("a", "u6"): [6.0, 7.0, 7.5] * 6, ("b", "info"): [0.0] * 3}, [("a", "info", [2.0] * 12 + [4.0] * 12)])
    spans = spans.unionByName(spark.createDataFrame([("a", I.RISK, "a", dt.date(2020, 1, 1), dt.date(2020, 10, 1))], spans.schema))
    rules = {
        "x": ("trend", [I.Rule("info", "change_pct", 12, "info"), I.Rule("info", "change_pct", "launch", "info", per_capita=True), I.Rule("info", "latest", 0, "info", use_raw=True), I.Rule("trades", "pct_of_start", "info", "info"), I.Rule("u6", "count_above", "u6", "info", 7.0), I.Rule("info", "average", 1, "u6")]),
        "y": ("trend", [I.Rule(I.RISK, "prediction_latest", 0, I.RISK, digits=4), I.Rule(I.RISK, "prediction_at_date", 5, I.RISK), I.Rule(I.RISK, "prediction_count_above", threshold=0.5), I.Rule(I.RISK, "prediction_direction", 6, I.RISK), I.Rule(I.RISK, "scenario_min"), I.Rule(I.RISK, "feature_red_count"), I.Rule(I.RISK, "feature_value", feature="strongest_red")]),
        "z": ("trend", [I.Rule("info", "change_pct", 11, I.STORIES), I.Rule("gdp", "latest", 0, "gdp")]),  # no stories; no such series
    }
    rows = I.spec_rows(rules, EVENTS)
    claims = I.insight_claims(spans, parts, *outside(spark), rows)
    found = {r.claim_id: (r.period_start, r.period_end, r.value) for r in claims.collect()}
    assert found == {
        "a/x/0": ("2020-12", "2021-12", 10.81), "a/x/1": ("2020-06", "2021-12", round((123 / 4) / (105 / 2) * 100 - 100, 2)), "a/x/2": ("2021-12", "2021-12", 246.0),
        "a/x/3": ("2020-01", "2021-12", 81.3), "a/x/4": ("2020-01", "2021-12", 6.0), "a/x/5": ("2021-05", "2021-06", 116.5),
        "a/y/0": ("2020-10", "2020-10", 0.9), "a/y/1": ("2020-05", "2020-10", 0.4), "a/y/2": (None, None, 4.0), "a/y/3": ("2020-04", "2020-10", 1.0), "a/y/4": (None, None, 0.25), "a/y/5": (None, None, 2.0), "a/y/6": (None, None, -1.5),
        "a/z/0": (None, None, 0.0),
        "b/x/0": ("2019-03", "2020-03", 0.0), "b/x/1": ("2020-06", "2020-03", 0.0), "b/x/2": ("2020-03", "2020-03", 0.0), "b/x/5": (None, None, 0.0), "b/z/0": (None, None, 0.0),
    }
    graded = {r.claim_id: r.passed for r in K.verify_claims(claims, parts, *outside(spark)).collect()}
    assert {c for c, ok in graded.items() if not ok} == {"a/z/0", "b/x/0", "b/x/1", "b/x/5", "b/z/0"}  # nothing to start from, or no months


def test_all_insights(spark):
    """Every insight of the table is claimed in full where all roles are there; one role that is a third of all rows, and an empty panel."""
    series = {("a", r): [10 + (i * 7) % 5 + 0.1 * i for i in range(70)] for r in I.SERIES} | {("b", "info"): list(range(1, 200))}
    parts, spans = tables(spark, series, [("a", r, [2.0] * 70) for r in I.SERIES])
    more = [("a", r, "a", dt.date(2020, 1, 1), dt.date(2022, 1, 1)) for r in (I.RISK, I.STORIES)]
    claims = I.insight_claims(spans.unionByName(spark.createDataFrame(more, spans.schema)), parts, *outside(spark), I.spec_rows(events=EVENTS))
    counts = {r.insight: r.n for r in claims.filter("panel = 'a'").groupBy("insight").agg(F.count("*").alias("n")).collect()}
    assert counts == {k: len(rules) for k, (_, rules) in I.INSIGHTS.items()} and len(counts) == 21
    assert K.verify_claims(claims.filter("panel = 'a'"), parts, *outside(spark)).filter("not passed").count() == 0
    assert I.insight_claims(spans.limit(0), parts, *outside(spark), I.spec_rows()).count() == 0


def test_features_that_are_not_there(spark):
    """A feature's value passes only where the panel has features, and one of that colour; the value itself is then 0."""
    parts, spans = tables(spark, {("a", "info"): [1.0], ("b", "info"): [1.0]})
    spans = spans.unionByName(spark.createDataFrame([(p, I.RISK, p, dt.date(2020, 1, 1), dt.date(2020, 10, 1)) for p in "ab"], spans.schema))
    rules = {"f": ("trend", [I.Rule(I.RISK, "feature_red_count"), I.Rule(I.RISK, "feature_value", feature="strongest_red"), I.Rule(I.RISK, "feature_value", feature="strongest_green")])}
    named = spark.createDataFrame([("a", 0, "", "x")], "metric string, red_count int, strongest_red string, strongest_green string")
    signals = I.strongest_values(named, spark.createDataFrame([("a", '{"x": -2.5}')], "metric string, features_json string"))
    tables_ = parts, *outside(spark)[:2], signals
    claims = I.insight_claims(spans, *tables_, I.spec_rows(rules))
    assert {r.claim_id: r.value for r in claims.collect()} == {"a/f/0": 0.0, "a/f/1": 0.0, "a/f/2": -2.5, "b/f/0": 0.0, "b/f/1": 0.0, "b/f/2": 0.0}
    assert {r.claim_id for r in K.verify_claims(claims, *tables_).filter("passed").collect()} == {"a/f/0", "a/f/2"}


def test_sums_in_any_order(spark):
    """A month's sum is the same whatever the order of its days: else one that cancels out is now under, now not under 0."""
    thirds = [1 / 3, 2 / 3, -1.0, 7 / 3, -7 / 3, 0.1, 0.2, -0.3]
    days = lambda p, vs: [(p, dt.date(2020, 1, 1 + i), v, v) for i, v in enumerate(vs)]
    obs = spark.createDataFrame([r for k in range(8) for r in days(f"m{k}", thirds[k:] + thirds[:k])], "metric string, date date, value double, value_adj double")
    assert len({(r.sum_raw, r.sum_adj) for r in K.monthly_parts(obs.coalesce(1)).collect()}) == 1
    odd = spark.createDataFrame(days("i", [float("inf"), 1.0]) + days("z", [0.0]) + days("t", [1e-310, 1e-310]) + days("h", [9e19] * 3) + days("u", [None]) + days("n", [None, 2.5]), obs.schema)
    assert {r.metric: r.sum_raw for r in K.monthly_parts(odd).collect()} == {"i": float("inf"), "z": 0.0, "t": 2e-310, "h": 2.7e20, "u": None, "n": 2.5}
