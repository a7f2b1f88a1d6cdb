"""Months that a stream gives out: restarts, late rows, repeated ids, hot and null keys."""

import datetime as dt
import time

import pytest
from seriesloom.streaming import rollup as U

SCHEMA = "story_id long, created_utc timestamp, title string, text_excerpt string, sentiment_score double, panel string"


def feed(spark, folder, rows):
    """A file more for the stream: (id, time, title, score, panel)."""
    spark.createDataFrame([(i, dt.datetime.fromisoformat(t), title, None, score, panel) for i, t, title, score, panel in rows], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    time.sleep(0.05)  # files are read in the order of their times


def run(spark, tmp_path, **columns):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = U.stream_calendar_months(stream, str(tmp_path / "out"), str(tmp_path / "state"), ("layoff",), **columns)
    query.awaitTermination()
    keys = "panel string, " if columns.get("by") else ""
    rows = spark.read.schema(keys + U.MONTH).parquet(str(tmp_path / "out")).collect()
    return {(*r[:-5], str(r.month)): (r.mean_sentiment, r.story_count, r.tag_story_count, r.days) for r in rows}, len(rows), U.late_rows(query)


def test_restart_and_late_rows(spark, tmp_path):
    data = str(tmp_path / "in")
    feed(spark, data, [(1, "2024-01-31T23:59:59", "Layoff", 1.0, "a"), (2, "2024-01-05T00:00:00", "x", None, "a"), (3, "2024-01-05T10:00:00", None, float("nan"), "a")])
    feed(spark, data, [(4, "2024-02-01T00:00:00", "x", 0.5, "a"), (1, "2024-01-31T23:59:59", "Layoff", 1.0, "a")])
    assert run(spark, tmp_path) == ({}, 0, 0)  # a day of delay: January may still come
    feed(spark, data, [(5, "2024-01-31T12:00:00", "x", 0.0, "a")])  # in time
    feed(spark, data, [(6, "2024-02-29T23:00:00", "LAYOFFS", -0.5, "a")])
    feed(spark, data, [(7, "2024-01-20T12:00:00", "x", 9.0, "a"), (8, "2024-02-29T01:00:00", "x", 0.0, "a")])  # the first is late
    january = {("2024-01-01",): (0.5, 4, 1, 2)}
    assert run(spark, tmp_path) == (january, 1, 1)
    feed(spark, data, [(9, "2024-04-15T00:00:00", "x", 0.0, "a")])
    found, rows, late = run(spark, tmp_path)  # a third run gives nothing out twice; March has no stories
    assert (found, rows, late) == (january | {("2024-02-01",): (0.0, 3, 1, 2)}, 2, 0)


def test_keys(spark, tmp_path):
    """A key that holds nearly all rows, a null key, and the turn of a year."""
    data = str(tmp_path / "in")
    hot = [(i, f"2023-12-{1 + i % 31:02}T12:00:00", "x", float(i % 3), "hot") for i in range(300)]
    feed(spark, data, hot + [(1000, "2023-12-31T23:59:59", "x", 1.0, None), (1001, "2024-01-01T00:00:00", "x", 1.0, "b")])
    feed(spark, data, [(1002, "2024-01-20T00:00:00", "x", 1.0, "b")])
    found, rows, late = run(spark, tmp_path, by=("panel",))
    assert (found, rows, late) == ({("hot", "2023-12-01"): (1.0, 300, 0, 31), (None, "2023-12-01"): (1.0, 1, 0, 1)}, 2, 0)


def test_nothing_and_zones(spark, tmp_path):
    feed(spark, str(tmp_path / "in"), [])
    assert run(spark, tmp_path) == ({}, 0, 0)
    spark.conf.set("spark.sql.session.timeZone", "Europe/Paris")
    try:
        with pytest.raises(ValueError, match="UTC"):
            run(spark, tmp_path)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
