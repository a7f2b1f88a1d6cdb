"""Running values, and what is read off them, beside plain loops."""

import random

import pytest
from pyspark.sql import functions as F
from seriesloom.operators import claims as K
from seriesloom.operators import model as M
from seriesloom.operators.ordered import running


def brute(rows, keys, order):
    """rows: dicts with v and w. Sums of v, nearest w before and behind."""
    out = {}
    groups = {}
    for r in rows:
        groups.setdefault(tuple(r[k] for k in keys), []).append(r)
    for some in groups.values():
        some.sort(key=lambda r: tuple((r[c] is not None, r[c] or 0) for c in order))
        total, last = 0, None
        for r in some:
            total += r["v"] or 0
            last = r["w"] if r["w"] is not None else last
            out[r["id"]] = [total, last, None]
        following = None
        for r in reversed(some):
            following = r["w"] if r["w"] is not None else following
            out[r["id"]][2] = following
    return out


@pytest.mark.parametrize("keys", [["k"], [], ["k", "j"]])
def test_running_values_with_a_key_of_most_rows(spark, keys):
    rng = random.Random(len(keys))
    rows = [{"id": i, "k": rng.choice(("hot", "hot", "hot", "a", "b", None)), "j": rng.randrange(2), "at": rng.randrange(300), "v": rng.choice((1, 5, None)), "w": rng.choice((None, None, i))} for i in range(900)]
    frame = spark.createDataFrame([tuple(r.values()) for r in rows], "id long, k string, j int, at int, v long, w long").repartition(3)
    got = running(frame, keys, ["at", "id"], ("v",), ("w",), ("w",)).collect()
    want = brute(rows, keys, ["at", "id"])
    assert len(got) == len(rows) and all([r.v_sum, r.w_last, r.w_next] == want[r.id] for r in got)
    assert running(frame.limit(0), keys, ["at", "id"], ("v",)).count() == 0


CLAIM = "claim_id long, metric string, aggregation string, value double, period_start string, period_end string, threshold double, per_capita boolean, use_raw boolean"
KINDS = [*K.BOUNDARY, "average", *K.COUNTS]


def month(i):
    return f"{2000 + i // 12:04d}-{1 + i % 12:02d}"


def test_claims_with_a_third_on_one_metric_are_as_by_a_join(spark):
    """One metric has a third of all claims; ranges are empty, turned around, before and after the data; thresholds and people are missing."""
    rng = random.Random(5)
    metrics = ["hot", *"abcdef"]
    obs = [(m, month(i) + f"-{d:02d}", v, v + rng.choice((0.0, 1.0))) for m in metrics for i in range(6, 60) if rng.random() < 0.7 for d in rng.sample(range(1, 28), 2) for v in [rng.choice((1.0, 2.0, -3.5, 0.0, 100.0))]]
    people = [(m, month(i) + "-01", rng.choice((2.0, 4.0, 0.0, None))) for m in metrics for i in range(60) if rng.random() < 0.8]
    claims = [(n, "hot" if n % 3 == 0 else rng.choice([*metrics, "unknown"]), rng.choice(KINDS), 1.0, month(rng.randrange(70)), month(rng.randrange(70)), rng.choice((0.0, 1.0, 1.5, None)), rng.random() < 0.4, rng.random() < 0.5) for n in range(600)]
    days = spark.createDataFrame(obs, "metric string, day string, value double, value_adj double").select("metric", F.to_date("day").alias("date"), "value", "value_adj")
    heads = spark.createDataFrame(people, "metric string, day string, people double").select("metric", F.to_date("day").alias("month"), "people")
    parts = K.monthly_parts(days, heads)
    frame = spark.createDataFrame(claims, CLAIM)
    got = {r.claim_id: r for r in K.measured(frame, parts).collect()}
    months = {}
    for r in parts.collect():
        months.setdefault(r.metric, []).append(r)
    for n, metric, kind, _, start, end, threshold, pc, raw in claims:
        rows = []
        for r in sorted(months.get(metric, []), key=lambda r: r.month):
            head = r.people if pc else 1.0
            if start <= r.month.strftime("%Y-%m") <= end and head:
                way = "raw" if raw else "adj"
                rows.append((r[f"first_{way}"] / head, r[f"last_{way}"] / head, r[f"sum_{way}"] / head, r.n))
        assert (n in got) == bool(rows)
        if rows:
            x = got[n]
            assert (x.a, x.b) == (rows[0][0], rows[-1][1]) and abs(x["mean"] - sum(r[2] for r in rows) / sum(r[3] for r in rows)) < 1e-9
            means = [r[2] / r[3] for r in rows]
            if kind == "count_below":
                assert x.below == (0 if threshold is None else sum(m < threshold for m in means))
            if kind == "count_above":
                assert x.above == (0 if threshold is None else sum(m > threshold for m in means))


def test_counts_and_as_of_lookups_of_predictions(spark):
    rng = random.Random(8)
    scores = [(rng.choice(("hot", "hot", "a")), month(rng.randrange(40)) + "-15", rng.choice((0.1, 0.5, 0.5, 0.9))) for _ in range(300)]
    scores = [(m, d, p) for i, (m, d, p) in enumerate(scores) if (m, d) not in {(x, y) for x, y, _ in scores[:i]}]
    claims = [(n, rng.choice(("hot", "a", "none")), rng.choice(K.PREDICTIONS), 1.0, month(rng.randrange(45)), None, rng.choice((0.5, 0.3, None)), False, False) for n in range(90)]
    predictions = spark.createDataFrame(scores, "metric string, day string, probability double").select("metric", F.to_date("day").alias("date"), "probability")
    grid, red = spark.createDataFrame([(0.1,)], "probability double"), spark.createDataFrame([("a", 1)], "metric string, red_count int")
    got = {r.claim_id: r.actual_value for r in K.verify_prediction_claims(spark.createDataFrame(claims, CLAIM), predictions, grid, red).collect()}
    for n, metric, kind, _, start, _, threshold, *_ in claims:
        own = sorted((d, p) for m, d, p in scores if m == metric)
        before = [p for d, p in own if d[:7] <= start]
        latest, as_of = (own[-1][1] if own else None), (before[-1] if before else None)
        if kind == "prediction_count_above":
            want = None if not own else 0 if threshold is None else sum(p > threshold for _, p in own)
        elif kind == "prediction_direction":
            want = 1.0 if latest is not None and as_of is not None and latest > as_of else -1.0
        else:
            want = latest if kind == "prediction_latest" else as_of
        assert got[n] == want, (n, kind)


def test_no_claim_meets_months_in_a_join(spark):
    """Claims meet what was measured by their ids only."""
    obs = spark.createDataFrame([("m", "2000-01-01", 1.0, 1.0)], "metric string, day string, value double, value_adj double").select("metric", F.to_date("day").alias("date"), "value", "value_adj")
    plan = K.measured(spark.createDataFrame([(1, "m", "average", 1.0, "2000-01", "2000-02", 0.0, False, False)], CLAIM), K.monthly_parts(obs))._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and not any("month" in line or "metric" in line for line in joins if "_part" not in line)


def test_area_under_the_curve_over_all_orders(spark):
    rng = random.Random(3)
    rows = [(rng.choice((0.1, 0.25, 0.25, rng.random())), rng.randrange(2), rng.randrange(2)) for _ in range(400)]
    frame = spark.createDataFrame(rows, "probability double, label int, prediction int").repartition(3)
    pos, neg = [p for p, y, _ in rows if y], [p for p, y, _ in rows if not y]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    scored = M.evaluate_classifier(frame)
    assert abs(scored.first()["auc"] - want) < 1e-12
    assert "SinglePartition" not in running(frame.groupBy("probability").count(), [], ["probability"], ("count",))._jdf.queryExecution().executedPlan().toString().split("Broadcast")[0]
    assert M.evaluate_classifier(frame.limit(0)).filter("auc is not null").count() == 0
