"""The monthly roll-up over an unbounded stream of stories."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators.stories import TAG_WORDS, tagged

MONTH = "month date, mean_sentiment double, story_count long, tag_story_count long, days int"
STORE = "spark.sql.streaming.stateStore.providerClass"
EPOCH = dt.datetime(1970, 1, 1)


def once(stream: DataFrame, delay: str, id_: str, on: str) -> DataFrame:
    """The stream with each id once; rows later than the delay are dropped here, so they count as late once (late_rows)."""
    return stream.withColumn(on, F.col(on).cast("timestamp")).withWatermark(on, delay).dropDuplicatesWithinWatermark([id_])


def daily_rollup(stream: DataFrame, keywords=TAG_WORDS, delay: str = "1 day", id_: str = "story_id", on: str = "created_utc") -> DataFrame:
    """day, mean_sentiment, story_count, tag_story_count of a stream: each id once; a day comes out when it is complete, later rows are dropped."""
    days = once(stream, delay, id_, on).groupBy(F.window(on, "1 day").alias("w")).agg(F.avg("sentiment_score").alias("mean_sentiment"), F.count("*").alias("story_count"), F.count_if(tagged(keywords)).alias("tag_story_count"))
    return days.select(F.col("w.start").cast("date").alias("day"), "mean_sentiment", "story_count", "tag_story_count")


def monthly_of_days(days: DataFrame) -> DataFrame:
    n = F.sum("story_count")
    return days.groupBy(F.trunc("day", "MM").alias("month")).agg((F.sum(F.col("mean_sentiment") * F.col("story_count")) / n).alias("mean_sentiment"), n.alias("story_count"), F.sum("tag_story_count").alias("tag_story_count"))


def month_end(key: tuple) -> int:
    """Milliseconds at which the month of a key ends: the key's last part is its first day, in the session's zone as its day windows."""
    first = key[-1]
    return int((dt.datetime(first.year + first.month // 12, first.month % 12 + 1, 1) - EPOCH).total_seconds() * 1000)


class Months(StatefulProcessor):
    """The sums of a month, and a timer at its end that gives them out; at most 31 rows come in for a key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.sums = handle, handle.getValueState("sums", "total double, scored long, story_count long, tag_story_count long, days int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = not self.sums.exists()
        total, scored, stories, tags, days = (0.0, 0, 0, 0, 0) if new else self.sums.get()
        for part in rows:
            total += float(part["total"].fillna(0.0).sum())
            scored, stories, tags, days = scored + int(part["scored"].sum()), stories + int(part["story_count"].sum()), tags + int(part["tag_story_count"].sum()), days + len(part)
        self.sums.update((total, scored, stories, tags, days))
        if new:
            self.handle.registerTimer(month_end(key))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        total, scored, stories, tags, days = self.sums.get()
        self.sums.clear()
        values = {"month": [key[-1]], "mean_sentiment": [total / scored if scored else None], "story_count": [stories], "tag_story_count": [tags], "days": [days]}
        yield pd.DataFrame({f"k{i}": [k] for i, k in enumerate(key[:-1])} | values)

    def close(self) -> None:
        pass


def monthly_rollup(stream: DataFrame, keywords=TAG_WORDS, delay: str = "1 day", id_: str = "story_id", on: str = "created_utc", by: tuple[str, ...] = ()) -> DataFrame:
    """The columns by, month, mean_sentiment, story_count, tag_story_count, days (with stories) of a stream: calendar months, each given out once, when it is complete.

    Days are windows, summed in each task before their shuffle, so a key with most of the stories sends a row for each day and task; a month's state
    is five numbers and a timer at the month's end, and takes in at most 31 rows. Each id counts once. A row later than the
    delay is dropped and counted (late_rows). Scores that are null or not a number count as stories but not in the mean; a month
    without any score has a null mean. A null time has no month and is left out; null keys are a key. The session's zone must be UTC, as the timers' is.
    """
    if stream.sparkSession.conf.get("spark.sql.session.timeZone") not in ("UTC", "Etc/UTC", "Z", "+00:00"):
        raise ValueError("months of a stream end by the clock of UTC: set spark.sql.session.timeZone to UTC")
    score = F.nanvl(F.col("sentiment_score").cast("double"), F.lit(None).cast("double"))
    narrow = once(stream.filter(F.col(on).isNotNull()), delay, id_, on).select(on, score.alias("score"), tagged(keywords).alias("tag"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(by)])
    keys = [f"k{i}" for i in range(len(by))]
    days = narrow.groupBy(F.window(on, "1 day").alias("w"), *keys).agg(F.sum("score").alias("total"), F.count("score").alias("scored"), F.count("*").alias("story_count"), F.count_if("tag").alias("tag_story_count"))
    dated = days.select(*keys, F.window_time("w").alias("at"), F.trunc(F.col("w.start").cast("date"), "MM").alias("month"), "total", "scored", "story_count", "tag_story_count")
    kinds = "".join(f"{k} {dated.schema[k].dataType.simpleString()}, " for k in keys)
    months = dated.groupBy(*keys, "month").transformWithStateInPandas(Months(), kinds + MONTH, "append", "eventTime")
    return months.withColumnsRenamed(dict(zip(keys, by, strict=True)))


def appended(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes rows to out as files that are committed by batch; starts again from checkpoint where it stopped. Takes what there is and ends."""
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def stream_monthly_rollup(stream: DataFrame, out: str, checkpoint: str, keywords=TAG_WORDS, delay: str = "1 day", **columns) -> StreamingQuery:
    """Writes complete days to out."""
    return appended(daily_rollup(stream, keywords, delay, **columns), out, checkpoint)


def stream_calendar_months(stream: DataFrame, out: str, checkpoint: str, keywords=TAG_WORDS, delay: str = "1 day", **columns) -> StreamingQuery:
    """Writes complete months to out. Timers need the RocksDB store; a started query keeps its own settings, so the session's are put back."""
    conf = stream.sparkSession.conf
    before = conf.get(STORE, None)
    conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return appended(monthly_rollup(stream, keywords, delay, **columns), out, checkpoint)
    finally:
        conf.set(STORE, before) if before else conf.unset(STORE)


def late_rows(query: StreamingQuery) -> int:
    """Rows that came later than the delay, in the batches that the query still remembers (spark.sql.streaming.numRecentProgressUpdates)."""
    return sum(max((s.numRowsDroppedByWatermark for s in p.stateOperators), default=0) for p in query.recentProgress)
