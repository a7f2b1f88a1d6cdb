"""Hand-made rows for what the SQL twins do not reach."""

import datetime as dt
import json
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from seriesloom.functions import columns as C
from seriesloom.functions.unicode import nfkc
from seriesloom.operators import arima as A
from seriesloom.operators import claims as K
from seriesloom.operators import model as M
from seriesloom.operators import panel as P
from seriesloom.operators import retrieval as R
from seriesloom.operators import shock as H
from seriesloom.operators import stories as S
from seriesloom.operators import topics as T
from seriesloom.sources import loading as L
from seriesloom.sources import tables as B


@pytest.mark.parametrize(("expected", "actual", "near"), [(4.2, 4.0, True), (4.2, 5.0, False), (0.1, 0.3, True), (0.0, 0.4, True), (0.0, 0.6, False), (-7.2, -10.0, False), (100.0, 104.0, True)])
def test_tolerance(spark, expected, actual, near):
    assert spark.range(1).select(C.within_tolerance(F.lit(expected), F.lit(actual)).alias("x")).first().x is near


def test_normalised_text(spark):
    text = "“holy” –  cow — ok… ﬁne"
    rows = spark.createDataFrame([(text,), ("word " * 40,), ("x" * 300,), (None,)], "t string")
    assert [r.t for r in rows.select(C.normalize_text(F.col("t"), 50, nfkc).alias("t")).collect()] == ['"holy" - cow - ok... fine', " ".join(["word"] * 10), "x" * 50, ""]


def test_series_files(spark, tmp_path):
    obs = [{"date": "2024-01-01", "value": "1.5"}, {"date": "2024-01-01", "value": 9}, {"date": "2024-02-01", "value": "."}, {"date": "2010-01-01", "value": 3}, {"date": "2024-03-01", "value": None}, {"date": "2024-04-01", "value": 2}]
    (tmp_path / "a.json").write_text(json.dumps({"series_id": "A", "name": "a", "frequency": "monthly", "observations": obs}))
    meta, rows = L.load_series_json(spark, str(tmp_path), "2020-01-01")
    assert [(str(r.date), r.value, r.value_adj) for r in rows.orderBy("date").collect()] == [("2024-01-01", 1.5, 1.5), ("2024-04-01", 2.0, 2.0)]
    assert meta.first().name == "a"
    stats = L.load_stats(L.read_series_json(spark, str(tmp_path)), "2020-01-01").first()
    assert (stats.inserted, stats.skipped_null, stats.skipped_date) == (3, 2, 1)


def test_story_files_are_taken_whole_or_not(spark, tmp_path):
    story = {"story_id": 1, "created_utc": "2023-06-05T00:00:00Z", "title": "t", "sentiment_score": 0.5, "sentiment_label": "positive"}
    path = tmp_path / "s.json"
    path.write_text(json.dumps([story, story | {"title": "later"}, {"story_id": 2, "sentiment_score": 0, "sentiment_label": "neutral"}]))
    assert [(r.title, str(r.month)) for r in L.load_stories_json(spark, str(path)).collect()] == [("later", "2023-06-01")]
    path.write_text(json.dumps([story, {"story_id": 3, "created_utc": "2023-06-05", "title": "x"}]))
    assert L.load_stories_json(spark, str(path)).count() == 0


def test_broken_files_and_the_first_file_of_a_series(spark, tmp_path):
    """Files that are cut off are named and left out; of two files of a series the first by name counts, whatever their sizes."""
    one = {"series_id": "A", "name": "first", "observations": [{"date": "2024-01-01", "value": 1}]}
    two = {"series_id": "A", "name": "second", "units": "u", "observations": [{"date": "2024-01-01", "value": 2}, {"date": "2024-02-01", "value": 3}] + [{"date": "2023-01-01", "value": "x" * 999}]}
    for name, text in (("b.json", json.dumps(two)), ("a.json", json.dumps(one)), ("c.json", '{"series_id": "C", "observations": [{"date": "20'), ("d.json", "")):
        (tmp_path / name).write_text(text)
    raw = L.read_series_json(spark, str(tmp_path))
    meta = {r.series_id: r for r in L.series_metadata(raw).collect()}
    assert list(meta) == ["A"] and (meta["A"].name, meta["A"].units) == ("first", "u")
    assert sorted((str(r.date), r.value) for r in L.clean_observations(raw).collect()) == [("2024-01-01", 1.0), ("2024-02-01", 3.0)]
    assert [(r.file.rsplit("/", 1)[1], r.n_broken) for r in L.file_errors(raw).collect()] == [("c.json", 1)]


def test_story_lines_with_broken_and_unscored_ones(spark, tmp_path):
    story = {"story_id": 1, "created_utc": "2023-06-05T00:00:00Z", "title": "t", "sentiment_score": 0.5, "sentiment_label": "positive"}
    (tmp_path / "a.json").write_text("\n".join([json.dumps(story), '{"story_id": 9, "tit', json.dumps(story | {"story_id": 2})]))
    (tmp_path / "b.json").write_text(json.dumps(story | {"title": "of the later file"}))
    rows, counts = L.stories_and_counts(spark, str(tmp_path), lines=True)
    assert sorted((r.story_id, r.title) for r in rows.collect()) == [(1, "of the later file"), (2, "t")] and counts == {"rows": 3, "broken": 1, "unscored": 0}
    (tmp_path / "c.json").write_text('{"story_id": 5, "created_utc": "2023-01-01", "title": "x"}')
    rows, counts = L.stories_and_counts(spark, str(tmp_path), lines=True)
    assert rows.count() == 0 and counts["unscored"] == 1


def test_commits_that_fail_leave_the_table_as_it_was(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/table"
    frame = lambda rows: spark.createDataFrame(rows, "k string, v int, `a b` string")
    table = lambda: sorted(tuple(r) for r in B.read_table(spark, path).collect())
    assert B.commit_upsert(spark, path, frame([(f"k{i}", i, "x") for i in range(50)]), ["k"], "one", buckets=8)
    before, folders = table(), B.commits(spark, path)[-1]["folders"]
    update = frame([("k3", -3, "y"), ("new", 1, "y")])

    def broken(batches):
        for batch in batches:
            yield batch
            raise ValueError("lost while it was written")

    with pytest.raises(Exception, match="lost while"):
        B.commit_upsert(spark, path, update.mapInArrow(broken, update.schema), ["k"], "two")
    assert table() == before
    with monkeypatch.context() as m:  # all is written, but the driver goes before the entry is published
        m.setattr(B, "published", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            B.commit_upsert(spark, path, update, ["k"], "two")
    assert table() == before
    assert B.commit_upsert(spark, path, update, ["k"], "two", keep_cols=("a b",)) and not B.commit_upsert(spark, path, update, ["k"], "two")
    after = sorted([r for r in before if r[0] != "k3"] + [("k3", -3, "x"), ("new", 1, "y")])
    assert table() == after
    now = B.commits(spark, path)[-1]["folders"]
    assert sum(now[b] == folders[b] for b in folders) >= len(folders) - 2  # only buckets of the updates are new
    with pytest.raises(RuntimeError, match="another commit"):
        B.published(spark, path, {}, 2)
    assert B.commit_prune(spark, path, frame([("k1", 0, "")]), "k", "k", "three") and table() == [("k1", 1, "x"), ("new", 1, "y")]
    assert B.commit_prune(spark, path, frame([]), "k", "", "four") and table() == []


def test_curated_files(spark, tmp_path):
    docs, notes = tmp_path / "docs", tmp_path / "notes"
    docs.mkdir(), notes.mkdir()
    doc = {"id": "x", "series_id": "A", "title": "T", "content": "c"}
    for name, d in (("1", doc), ("2", doc | {"title": "second"}), ("3", doc | {"id": "y", "series_id": "unknown"}), ("4", doc | {"id": "z", "content": " "})):
        (docs / f"{name}.json").write_text(json.dumps(d))
    (notes / "idea.md").write_text("intro\n# A title\nbody")
    (notes / "bare.md").write_text("no heading")
    meta = spark.createDataFrame([("A",)], "series_id string")
    got = sorted((r.series_id, r.doc_type, r.title) for r in L.load_curated_docs(spark, str(docs), str(notes), meta, "2024-01-01").collect())
    assert got == [("A", "scholarly:x", "T"), ("_CROSS_SERIES", "concept:bare", "bare"), ("_CROSS_SERIES", "concept:idea", "A title")]


def test_csv_export_counts_rows(spark, tmp_path):
    counts = L.export_queries_csv({"a": spark.range(7), "b": spark.range(0)}, str(tmp_path))
    assert counts == {"a": 7, "b": 0}
    assert spark.read.option("header", True).csv(f"{tmp_path}/a").count() == 7


def test_upsert_modes(spark):
    old = spark.createDataFrame([(1, "a", "k"), (2, "b", None)], "id int, v string, w string")
    new = spark.createDataFrame([(2, None, "n"), (3, "c", "n")], "id int, v string, w string")
    rows = lambda mode, keep=(): sorted(map(tuple, L.upsert(old, new, ["id"], mode, keep).collect()))
    assert rows("replace") == [(1, "a", "k"), (2, None, "n"), (3, "c", "n")]
    assert rows("ignore") == [(1, "a", "k"), (2, "b", None), (3, "c", "n")]
    assert rows("replace", ("v",)) == [(1, "a", "k"), (2, "b", "n"), (3, "c", "n")]


def test_taper_weights(spark):
    rows = spark.createDataFrame([(d, 0.0, 124.0) for d in ("2021-09-01", "2021-10-01", "2021-11-01", "2021-12-01", "2022-01-01")], "d string, f double, a double")
    got = rows.select(H.taper_blend(F.to_date("d"), F.col("f"), F.col("a"), "2022-01-01").alias("x")).collect()
    assert [round(r.x, 6) for r in got] == [0.0, 1.0, 32.0, 62.0, 93.0]


def test_arima_follows_a_line_and_a_season():
    line = 3.5 + 0.1 * np.arange(36)
    assert np.allclose(A.arima_forecast(line, 4, 12), 7.1 + 0.1 * np.arange(4), atol=1e-6)
    season = np.tile(np.sin(np.arange(12)), 5)
    assert np.abs(A.arima_forecast(season, 12, 12) - season[:12]).max() < 0.2
    for short in (np.arange(8.0), np.full(9, 2.0), np.array([1.0, 5.0] * 5)):
        assert np.isfinite(A.arima_forecast(short, 5, 12)).all()


def dense_likelihood(z, mean, values, errors, variance):
    """Log-density of a Gaussian vector whose covariances come from 3,000 weights of past errors."""
    psi = np.zeros(3000)
    for k in range(len(psi)):
        psi[k] = (errors[k] if k < len(errors) else 0) - sum(values[j] * psi[k - j] for j in range(1, min(k, len(values) - 1) + 1))
    gamma = np.array([variance * (psi[: len(psi) - h] * psi[h:]).sum() for h in range(len(z))])
    cov = gamma[np.abs(np.subtract.outer(np.arange(len(z)), np.arange(len(z))))]
    return -0.5 * (len(z) * np.log(2 * np.pi) + np.linalg.slogdet(cov)[1] + (z - mean) @ np.linalg.solve(cov, z - mean))


@pytest.mark.parametrize("order", [(0, 0, 0, 0), (1, 1, 1, 1), (2, 0, 0, 1), (0, 2, 1, 0), (3, 3, 2, 2)])
def test_arima_likelihood_is_that_of_a_gaussian_vector(order):
    rng = np.random.default_rng(sum(order))
    u = rng.normal(size=(3, 1 + sum(order))) * 0.4
    series = [A.Prepared(rng.normal(size=n), np.ones(1), 1.0, True, True) for n in (30, 41, 25)]
    batch = A.batch_of(series, 4)
    mean, values, errors = A.unpacked(u, order, 4, True)
    variance = np.array([1.0, 2.0, 0.5])
    want = [dense_likelihood(s.z, m, v, e, x) for s, m, v, e, x in zip(series, mean, values, errors, variance, strict=True)]
    assert np.allclose(A.log_likelihood(batch, mean, values, errors, variance), want, atol=1e-8)


def test_arima_polynomials_multiply_and_stay_inside():
    u = np.array([[0.0, 0.7, -0.4, 0.9, 5.0, -0.3]])
    _, values, errors = A.unpacked(u, (2, 1, 1, 1), 4, True)
    a = A.from_partial(A.INSIDE * np.tanh(u[:, 1:3]))[0]
    assert np.allclose(values[0], np.convolve([1, *-a], [1, 0, 0, 0, -A.INSIDE * np.tanh(5.0)]))
    assert all(np.abs(np.roots(w)).max() < 1 for w in (values[0], errors[0]))


def test_arima_exact_fit_has_the_largest_likelihood_nearby():
    rng = np.random.default_rng(5)
    e = rng.normal(size=620)
    z = np.zeros(620)
    for t in range(13, 620):
        z[t] = 0.6 * z[t - 1] + 0.5 * z[t - 12] - 0.3 * z[t - 13] + e[t] + 0.4 * e[t - 1]
    series = [A.Prepared(z[20:], np.ones(1), 1.0, True, True)]
    batch, order = A.batch_of(series, 12), (1, 1, 1, 0)
    u, _ = A.fitted(batch, order, True, 12, True)
    mean, values, errors = A.unpacked(u, order, 12, True)
    assert abs(-values[0, 1] - 0.6) < 0.1 and abs(-values[0, 12] - 0.5) < 0.1 and abs(errors[0, 1] - 0.4) < 0.12
    assert np.isclose(values[0, 13], values[0, 1] * values[0, 12])  # multiplied out

    def most(u):
        """The likelihood with the best variance for it."""
        v, f, _ = A.filtered(batch, *A.unpacked(u, order, 12, True))
        return A.log_likelihood(batch, *A.unpacked(u, order, 12, True), (v**2 / f).mean(1))[0]

    assert all(most(u + d * x) <= most(u) + 1e-6 for d in np.eye(u.shape[1]) for x in (-0.02, 0.02))


def test_arima_forecasts_of_known_models():
    """Over 40 series of a known seasonal model, the error is hardly above that of forecasts with the true weights."""
    rng = np.random.default_rng(7)
    histories, futures, ideal = [], [], []
    for _ in range(40):
        e = rng.normal(size=360)
        w = e.copy()
        for t in range(360):
            w[t] += (0.5 * w[t - 1] if t else 0.0) - (0.6 * e[t - 12] if t >= 12 else 0.0)
        y = w.copy()
        for t in range(12, 360):
            y[t] += y[t - 12]
        histories.append(y[100:340])
        futures.append(y[340:352])
        past, errs = list(w[:340]), list(e[:340])
        for _ in range(12):
            past.append(0.5 * past[-1] - 0.6 * errs[len(past) - 12])
        ideal.append(np.array(past[340:]) + y[328:340])
    got = A.arima_forecasts(histories, [12] * 40, 12)
    rms = lambda some: np.sqrt(np.mean((np.array(some) - np.array(futures)) ** 2))
    assert rms(got) < 1.15 * rms(ideal)


def test_arima_batches_change_nothing():
    rng = np.random.default_rng(3)
    some = [np.cumsum(rng.normal(size=n)) for n in (9, 25, 40, 61, 30)] + [np.full(20, 3.0), np.arange(15.0), np.array([2.0])]
    whole = A.arima_forecasts(some, [6, 3, 1, 12, 2, 4, 5, 2], 12)
    for y, f in zip(some, whole, strict=True):
        assert np.allclose(A.arima_forecast(y, len(f), 12), f, atol=1e-4 * max(1, np.abs(y).max()))
    assert A.arima_forecasts([], [], 12) == []


def test_arima_over_series_with_gaps_nulls_and_no_window(spark):
    day = lambda i: dt.date(2018 + i // 12, 1 + i % 12, 1)
    rows = [(7, "S", day(i), float(i % 12)) for i in range(36)] + [(7, "N", day(i), None if i % 3 == 0 else float("nan") if i % 3 == 1 else 1.0 * i) for i in range(36)] + [(8, "S", day(i), 2.0) for i in range(20)] + [(9, "S", day(i), 1.0) for i in range(5)]
    obs = spark.createDataFrame(rows, "panel long, series_id string, date date, value double")
    got = H.shock_forecast(obs, "2020-01-01", "2020-06-01").collect()
    assert {(r.panel, r.series_id) for r in got} == {(7, "S"), (7, "N")} and len(got) == 12 and all(math.isfinite(r.forecast) for r in got)
    assert H.shock_forecast(obs.limit(0), "2020-01-01", "2020-06-01").count() == 0


def test_short_series_keep_their_values(spark):
    rows = [("p", "S", dt.date(2019 + i // 12, 1 + i % 12, 1), float(i), float(i)) for i in range(12, 20)]
    obs = spark.createDataFrame(rows, "panel string, series_id string, date date, value double, value_adj double")
    for method in ("linear", "seasonal_naive", "arima"):
        assert H.shock_adjust_standard(obs, "2020-03-01", "2020-06-01", method).filter("value != value_adj").count() == 0


def test_dedupe_keeps_first_fields_and_all_tags(spark):
    rows = spark.createDataFrame([(2, "x", ["q1"], 0), (1, "y", ["q2"], 1), (2, "z", ["q3", "q1"], 2), (3, "w", [], 3)], "story_id long, title string, matched_queries array<string>, position int")
    assert [(r.story_id, r.title, r.matched_queries) for r in S.dedupe_union_tags(rows).orderBy("position").collect()] == [(2, "x", ["q1", "q3"]), (1, "y", ["q2"]), (3, "w", [])]


def test_ties_go_to_the_smaller_id(spark):
    rows = spark.createDataFrame([(i, "2023-01", 10) for i in (9, 3, 7)], "story_id long, month string, score int")
    assert [r.story_id for r in S.top_n_per_month(rows, 2).orderBy("story_id").collect()] == [3, 7]


def test_scorer_seam_and_prescored_rows(spark):
    rows = spark.createDataFrame([(1, "great growth", None, None, None), (2, "[deleted]", "", None, None), (3, "x", "y", 0.25, "positive")], "story_id long, title string, text_excerpt string, sentiment_score double, sentiment_label string")
    got = {r.story_id: (r.sentiment_score, r.sentiment_label) for r in S.score_stories(rows).collect()}
    assert got[1][1] == "positive" and got[2] == (0.0, "neutral") and got[3] == (0.25, "positive")


@pytest.mark.parametrize(("text", "n"), [("", 0), ("One line.", 1), ("A sentence of words here. " * 200, 7)])
def test_chunks(text, n):
    chunks = R.chunks_of(text)
    assert len(chunks) == n or n == 7 and len(chunks) >= 6
    assert all(R.size_of(c) <= 200 for c in chunks)


def test_chunk_ranges_against_one_unit_at_a_time():
    rng = np.random.default_rng(3)
    for _ in range(300):
        sizes, most, overlap = list(rng.integers(1, 12, rng.integers(1, 15))), int(rng.integers(1, 20)), int(rng.integers(0, 4))
        want, held = [], []
        for i, n in enumerate(sizes):
            if held and sum(sizes[j] for j in held) + n > most:
                want.append(held)
                held = held[-overlap:] if 0 < overlap < len(held) else []
            held = [*held, i]
        want.append(held)
        assert [list(range(a, b)) for a, b in R.ranges_of(sizes, most, overlap)] == want


def test_nearest_over_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    points = rng.normal(size=(60, 4))
    rows = spark.createDataFrame([(i, p.tolist(), i % 3) for i, p in enumerate(points)], "doc_id long, embedding array<double>, label long")
    asked = rows.filter("doc_id < 20").select(F.col("doc_id").alias("query_id"), "embedding", F.when(F.col("doc_id") % 2 == 0, F.lit(9)).otherwise(F.col("label")).alias("hint"))
    monkeypatch.setattr(R, "QUERY_BLOCK", 7)
    monkeypatch.setattr(R, "VECTOR_BLOCK", 11)
    got = {(r.query_id, r["rank"]): r.doc_id for r in R.knn_retrieve(rows, asked, 5, "label", "l2").collect()}
    for q in range(20):
        among = [i for i in range(60) if q % 2 == 0 or i % 3 == q % 3]
        near = sorted(among, key=lambda i: (((points[i] - points[q]) ** 2).sum(), i))[:5]
        assert [got[q, k] for k in range(1, 6)] == near
    assert R.knn_retrieve(rows.limit(0), asked, 5).count() == 0


def test_chunks_overlap_and_keep_long_units():
    units = [f"Sentence number {i} has some words in it." for i in range(40)]
    chunks = R.chunks_of(" ".join(units), 60, 1)
    for a, b in zip(chunks, chunks[1:]):
        assert b.startswith(re.split(r"(?<=[.])\s", a)[-1])
    assert R.chunks_of("word " * 500, 100) == [("word " * 500).strip()]


def test_factors_find_blocks(spark):
    tokens = spark.createDataFrame([(i, ["apple", "pear", "plum"] if i % 2 else ["steel", "iron", "zinc"]) for i in range(20)], "doc_id long, tokens array<string>")
    w, h = T.nmf_topics(*T.tfidf(tokens, 1, 1.0), k=2, iters=20)
    topic = {r.doc_id: r.topic_id for r in T.topic_assign(w).collect()}
    assert {topic[i] for i in range(0, 20, 2)} != {topic[i] for i in range(1, 20, 2)} and len({topic[i] for i in range(0, 20, 2)}) == 1
    assert {frozenset(r.top_terms) for r in T.topic_top_terms(h, 3).collect()} == {frozenset(["apple", "pear", "plum"]), frozenset(["steel", "iron", "zinc"])}


def test_classifier_measures(spark):
    rows = spark.createDataFrame([(1, 1, 0.9), (1, 0, 0.4), (0, 1, 0.6), (0, 0, 0.4)], "label int, prediction int, probability double")
    r = M.evaluate_classifier(rows).first()
    assert (r.precision, r.recall, r.f1) == (0.5, 0.5, 0.5) and abs(r.auc - 0.625) < 1e-12
    assert M.evaluate_classifier(rows.filter("label = 1")).first().auc is None


def test_expanding_folds_only_look_ahead(spark):
    rows = spark.createDataFrame([(dt.date(2000 + i // 12, 1 + i % 12, 1),) for i in range(60)], "month date")
    parts = M.expanding_folds(rows, 4)
    assert len(parts) == 4
    for before, after in parts:
        assert before.agg(F.max("month")).first()[0] < after.agg(F.min("month")).first()[0]


def test_runs_and_streaks(spark):
    months = [dt.date(2024, m, 1) for m in range(1, 13) if m != 6]
    flags = spark.createDataFrame([("p", "S", m, int(m.month in (2, 3, 5, 7, 12))) for m in months], "panel string, series_id string, date date, flag int")
    assert sorted((r.run_start.month, r.run_end.month) for r in P.flag_runs(flags).collect()) == [(2, 4), (5, 8), (12, 12)]
    monthly = flags.select("panel", "series_id", F.col("date").alias("month"), (-F.col("flag")).cast("double").alias("value"))
    assert P.longest_streak(monthly, 0.0).first().longest == 2
    assert P.longest_streak(monthly, 0.0, calendar=True).first().longest == 2
    assert P.longest_streak(monthly.filter("month in (date'2024-05-01', date'2024-07-01')"), 0.0, calendar=True).first().longest == 1


def test_prediction_split_without_event(spark):
    rows = spark.createDataFrame([("p", dt.date(2024, m, 1), 0.1, 0) for m in (1, 2)], "panel string, date date, probability double, actual int")
    assert {r.part for r in P.prediction_split(rows).collect()} == {"evaluated"}


def test_citation_tags(spark):
    rows = spark.createDataFrame([("n", "A [ref:1]  fact [ref:01], and [ref:7] too [ref:1].")], "narrative_id string, text string")
    provided = spark.createDataFrame([("n", 1, "T", "w" * 300), ("m", 7, "U", "x")], "narrative_id string, ref_id long, title string, content string")
    texts, records, warnings = K.extract_citations(rows, provided)
    assert texts.first().text == "A fact, and [ref:7] too."
    assert [(r.ref_id, len(r.excerpt)) for r in records.collect()] == [(1, 240)]
    assert [r.ref_id for r in warnings.collect()] == [7]


def test_claims_on_twelve_months(spark):
    days = [dt.date(2024, m, 1) for m in range(1, 13)]
    obs = [("SPREAD", d, -1.0 if 4 <= d.month <= 11 else 1.0) for d in days] + [("RATE", d, 3.5 + 0.7 * i / 11) for i, d in enumerate(days)]
    parts = K.monthly_parts(spark.createDataFrame([(m, d, v, v) for m, d, v in obs], "metric string, date date, value double, value_adj double"))
    rows = [(1, "SPREAD", "count_below", 8.0, 0.0), (2, "SPREAD", "count_below", 11.0, 0.0), (3, "RATE", "latest", 4.2, None), (4, "RATE", "change_pct", 20.0, None), (5, "RATE", "direction", -1.0, None), (6, "NONE", "latest", 1.0, None)]
    claims = spark.createDataFrame([(i, m, a, v, t, "2024-01", "2024-12", False, True) for i, m, a, v, t in rows], "claim_id long, metric string, aggregation string, value double, threshold double, period_start string, period_end string, per_capita boolean, use_raw boolean")
    got = {r.claim_id: r.passed for r in K.judged_claims(claims, parts, (*K.BOUNDARY, *K.COUNTS), 2).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True, 5: False, 6: False}


def test_scoring_after_an_observed_export(spark, tmp_path):
    """An Observation of the session must not get into scoring; and the arithmetic is that of the fitted model."""
    from pyspark.sql import Observation
    from pyspark.sql import functions as F
    from seriesloom.operators import model as M

    rows = spark.createDataFrame([(float(i % 7), 1.0, float((i * 5) % 3), int(i % 7 > 3 or i % 11 == 0)) for i in range(80)], "a double, b double, c double, label int")
    seen = Observation("rows")
    rows.observe(seen, F.count("*").alias("n")).write.csv(str(tmp_path / "out"))
    assert seen.get["n"] == 80
    model = M.train_logistic(rows, ["a", "b", "c"])
    got = model.score(rows).collect()
    assert {r.prediction for r in got} == {0, 1} and all((r.probability > 0.5) == (r.prediction == 1) for r in got)
    assert model.score(rows.withColumn("a", F.lit(None).cast("double"))).first().probability is None
    grown = M.forest(rows, ["a", "b", "c"], "label", 5, 3, 1)
    assert {r.prediction for r in grown.score(rows).collect()} == {0, 1}


def dense_factors(x, k, rounds, seed):
    """Least squares in turn over a dense matrix, one number at a time; also the error before each round."""
    h, errors = T.first_topics(k, x.shape[1], seed), []
    for _ in range(rounds):
        w = np.zeros((len(x), k))
        for _ in range(300):
            for j in range(k):
                w[:, j] = np.maximum(0, w[:, j] + ((x - w @ h) @ h[j]) / (h[j] @ h[j]))
        errors.append(float(((x - w @ h) ** 2).sum()))
        best = h
        for _ in range(20):
            for j in range(k):
                best = best.copy()
                best[j] = np.maximum(0, best[j] + (w[:, j] @ (x - w @ best)) / (w[:, j] @ w[:, j]))
        h = best
    return w, h, errors


def test_factors_are_those_of_a_dense_run(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.random((60, 12)) * (rng.random((60, 12)) < 0.4), 3)
    x[x.sum(1) == 0, 0] = 0.5
    terms = [f"t{j:02d}" for j in range(12)]
    rows = [(i, terms[j], float(x[i, j])) for i in range(60) for j in range(12) if x[i, j]]
    weights, vocab = spark.createDataFrame(rows, "doc_id long, term string, weight double").repartition(3), spark.createDataFrame([(t,) for t in terms], "term string")
    losses: list[float] = []
    w, h = T.nmf_topics(weights, vocab, k=3, iters=400, tol=1e-5, losses=losses)
    want_w, _, errors = dense_factors(x, 3, len(losses), 42)
    assert np.allclose(losses, errors, rtol=1e-6)
    assert all(a >= b - 1e-9 for a, b in zip(losses, losses[1:])) and 3 < len(losses) < 400
    got = {r.doc_id: r.weights for r in w.collect()}
    _, want_h, _ = dense_factors(x, 3, len(losses) - 1, 42)
    assert np.allclose([got[i] for i in range(60)], want_w, atol=1e-4)
    assert np.allclose([[r.weight for r in sorted(h.filter(f"topic_id = {t}").collect(), key=lambda r: r.term)] for t in range(3)], want_h, atol=1e-4)
    assert T.nmf_topics(weights.limit(0), vocab.limit(0))[0].count() == 0


@pytest.fixture(scope="module")
def checkered(spark):
    """Rows over 60 months whose class is seen from two features together only, so trees of one level tell nothing."""
    rng = np.random.default_rng(1)
    rows = [(dt.date(2000 + m // 12, 1 + m % 12, 1), *map(float, x), int((x[0] > 0) ^ (x[1] > 0))) for m in range(60) for x in rng.normal(size=(8, 3))]
    return spark.createDataFrame(rows, "month date, a double, b double, c double, label int").repartition(3).cache()


def test_nested_forests_are_the_first_trees_and_upper_levels(spark, checkered):
    from pyspark.ml.classification import RandomForestClassificationModel
    from pyspark.ml.feature import VectorAssembler

    features = ["a", "b", "c"]
    path = M.saved_forest(checkered, features, "label", 8, 5, 3, 42)
    model, rows = RandomForestClassificationModel.load(path), VectorAssembler(inputCols=features, outputCol="_x").transform(checkered).collect()
    x = np.array([[r.a, r.b, r.c] for r in rows])
    got = M.Trees(spark, path).nested(x, (3, 8), (0, 2, 5))
    assert np.allclose(got[8, 5], [model.predictProbability(r._x)[1] for r in rows])
    first = [np.mean([t.predictProbability(r._x)[1] for t in model.trees[:3]]) for r in rows[:50]]
    assert np.allclose(got[3, 5][:50], first)
    nodes = {}
    for r in spark.read.parquet(f"{path}/data").collect():
        nodes[r.treeID, r.nodeData.id] = r.nodeData

    def walked(tree, row, depth):
        n = nodes[tree, 0]
        for _ in range(depth):
            if n.leftChild > 0:
                n = nodes[tree, n.leftChild if row[n.split.featureIndex] <= n.split.leftCategoriesOrThreshold[0] else n.rightChild]
        return n.impurityStats[1] / sum(n.impurityStats)

    for depth in (0, 2):
        assert np.allclose(got[8, depth][:40], [np.mean([walked(t, row, depth) for t in range(8)]) for row in x[:40]])


def test_forest_search_chooses_as_the_plain_loop(spark, checkered, monkeypatch):
    features, grid = ["a", "b", "c"], ((12,), (1, 6), (3, 150))
    plain = {}
    for depth in grid[1]:
        for leaf in grid[2]:
            aucs = [M.evaluate_classifier(M.forest(before, features, "label", 12, depth, leaf).score(after)).first()["auc"] for before, after in M.expanding_folds(checkered, 2)]
            plain[12, depth, leaf] = sum(a or 0.0 for a in aucs)
    chosen, real = [], M.forest
    monkeypatch.setattr(M, "forest", lambda *a, **k: (chosen.append(a[3:]), real(*a, **k))[1])
    model = M.train_forest(checkered, features, grid=grid, folds=2)
    assert chosen == [max(plain, key=plain.get)] == [(12, 6, 3)] and set(model.weights) == set(features)


@pytest.mark.parametrize("label", [0, 1])
def test_models_of_one_class_score_every_row(spark, checkered, label):
    """With rows of one class alone to train on, both models are sure of it; months of the other class are scored too."""
    features, train = ["a", "b", "c"], checkered.withColumn("label", F.lit(label))
    models = [M.train_logistic(train, features), M.train_forest(train, features, grid=((2, 4), (1, 3), (5,)), folds=2)]
    assert [{(r.probability, r.prediction) for r in m.score(checkered).collect()} for m in models] == [{(float(label), label)}] * 2
    aucs = [M.evaluate_classifier(m.score(checkered)).first()["auc"] for m in models]
    assert aucs == [0.5, 0.5]  # all probabilities are equal
    for order in ([0, 1], [1, 0]):
        got = M.select_and_score([models[i] for i in order], aucs, checkered, actual="label", by=()).collect()
        assert len(got) == checkered.count() and {(r.probability, r.prediction, r.model_name) for r in got} == {(float(label), label, models[order[0]].name)}
    trees = M.Trees(spark, M.saved_forest(train, features, "label", 3, 2, 5, 42))
    assert (trees.nested(np.zeros((2, 3)), (3,), (2,))[3, 2] == label).all()


def test_forest_search_weighs_each_fold_once(spark, checkered, monkeypatch):
    """The fits of a fold read one table of weights, and no fit makes Python objects of its trees in the driver."""
    from pyspark.ml.classification import RandomForestClassifier

    calls, real = [], M.weighted
    monkeypatch.setattr(M, "weighted", lambda *a: (calls.append(1), real(*a))[1])
    monkeypatch.setattr(RandomForestClassifier, "_create_model", lambda *a: pytest.fail("a Python model was made"))
    M.train_forest(checkered, ["a", "b", "c"], grid=((2, 4), (2,), (3, 9)), folds=2)
    assert len(calls) == 3  # two folds and the chosen setting
