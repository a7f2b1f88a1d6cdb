"""Stories: shaping hits, de-duplication, ranking by month, sentiment and its monthly roll-up."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import lagged, month_of, normalize_text, ordered, ratio
from .panel import between, first_of, side_by_side
from .sentiment import Sentiment

# Words that tag a story.
TAG_WORDS = ("layoff", "laid off", "layoffs", "fired", "let go", "downsized", "riffed", "rif", "reduction in force", "restructuring", "severance", "terminated")
# Titles of stories that are gone.
DELETED = ("[deleted]", "[dead]", "[flagged]")
START = "2022-01-01"


def shape_hits(hits: DataFrame, query: Column, link: str = "https://example.org/item?id=", limit: int = 500, compose=None) -> DataFrame:
    """Raw hits (objectID, created_at_i, title, story_text, points, num_comments, url) as stories; those without a number or a title are left out."""
    shaped = hits.select(
        F.col("objectID").try_cast("long").alias("story_id"),
        F.timestamp_seconds("created_at_i").alias("created_utc"),
        normalize_text(F.col("title"), limit, compose).alias("title"),
        normalize_text(F.col("story_text"), limit, compose).alias("text_excerpt"),
        F.coalesce("points", F.lit(0)).alias("score"),
        F.coalesce("num_comments", F.lit(0)).alias("num_comments"),
        F.nullif(F.col("url"), F.lit("")).alias("url"),
        F.array(query).alias("matched_queries"),
    )
    good = shaped.filter(F.col("story_id").isNotNull() & F.col("created_utc").isNotNull() & (F.col("title") != ""))
    return good.withColumn("permalink", F.concat(F.lit(link), F.col("story_id").cast("string")))


def dedupe_union_tags(stories: DataFrame, id_: str = "story_id", pos: str = "position", tags: str = "matched_queries") -> DataFrame:
    """One row for each id: the first row's fields, and the union of all rows' tags in order of first sight.

    Tags are first made one row for each id and tag, so an id that comes very often is summed up before it is gathered.
    """
    others = [c for c in stories.columns if c not in (id_, tags)]
    first = stories.groupBy(id_).agg(F.min_by(F.struct(*others), pos).alias("s"))
    seen = stories.select(id_, pos, F.posexplode(tags).alias("k", "tag")).groupBy(id_, "tag").agg(F.min(F.struct(pos, "k")).alias("at"))
    lists = seen.groupBy(id_).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "tag"))), lambda x: x["tag"]).alias(tags))
    return first.join(lists, id_, "left").select(id_, "s.*", F.coalesce(tags, F.array().cast("array<string>")).alias(tags))


def bucket_by_month(stories: DataFrame, start: str = START, on: str = "created_utc") -> DataFrame:
    return stories.filter(F.col(on) >= F.lit(start).cast("timestamp")).withColumn("bucket", F.date_format(on, "yyyy-MM"))


def top_n_per_month(stories: DataFrame, n: int = 30, month: str = "month") -> DataFrame:
    """The n best of each month by score, then by id; the limit on the rank prunes each task's rows before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(month).orderBy(F.desc("score"), "story_id"))
    return stories.withColumn("_n", rank).filter(F.col("_n") <= n).drop("_n")


def ingest_stats(hits: DataFrame, stories: DataFrame, kept: DataFrame) -> DataFrame:
    """hits_total, unique, kept"""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(hits, "hits_total").crossJoin(F.broadcast(one(stories, "unique"))).crossJoin(F.broadcast(one(kept, "kept")))


def placeholder(text: Column, excerpt: Column) -> Column:
    return F.trim(text).isin(*DELETED) & (F.trim(F.coalesce(excerpt, F.lit(""))) == "")


def sentiment_from_probs(df: DataFrame, positive: str = "positive", negative: str = "negative", neutral: str = "neutral") -> DataFrame:
    """sentiment_score: the positive less the negative probability (0 where missing); sentiment_label: the likeliest class."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)) if c in df.columns else F.lit(0.0)
    p, n, m = zero(positive), zero(negative), zero(neutral)
    gone = placeholder(F.col("title"), F.col("text_excerpt"))
    label = F.when((p > n) & (p > m), "positive").when((n > p) & (n > m), "negative").otherwise("neutral")
    return df.withColumns({"sentiment_score": F.when(gone, 0.0).otherwise(p - n), "sentiment_label": F.when(gone, "neutral").otherwise(label)})


def lexicon_scorer(texts: list[str]) -> list[dict[str, float]]:
    """A stand-in for a model: words for and against, counted."""
    out = []
    for text in texts:
        words = re.findall(r"[a-z']+", text.lower())
        good, bad = sum(w in GOOD for w in words), sum(w in BAD for w in words)
        out.append({"positive": good / (good + bad + 1), "negative": bad / (good + bad + 1), "neutral": 1 / (good + bad + 1)})
    return out


GOOD, BAD = {"good", "great", "gain", "growth", "hope", "strong", "win"}, {"bad", "loss", "fear", "fired", "layoff", "weak", "worse"}


def score_stories(df: DataFrame, scorer: Callable[[list[str]], list[dict[str, float]]] | Sentiment = lexicon_scorer, batch_size: int = 16, rescore: bool = False) -> DataFrame:
    """Adds sentiment by a fitted Sentiment, or by scorer(texts) -> class probabilities, in batches, each worker for itself. Scored rows stay unless rescore."""
    has = "sentiment_score" in df.columns
    base = df if has else df.withColumns({"sentiment_score": F.lit(None).cast("double"), "sentiment_label": F.lit(None).cast("string")})
    text = F.concat(F.col("title"), F.lit("\n"), F.coalesce("text_excerpt", F.lit("")))

    @F.pandas_udf("struct<positive:double,negative:double,neutral:double>")
    def probabilities(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            rows = [r for at in range(0, len(texts), batch_size) for r in scorer(list(texts.iloc[at : at + batch_size].fillna("")))]
            yield pd.DataFrame(rows, columns=["positive", "negative", "neutral"])

    todo = F.lit(True) if rescore else F.col("sentiment_score").isNull()
    fresh = base.filter(todo)
    fresh = scorer.scored(fresh, text) if isinstance(scorer, Sentiment) else fresh.withColumn("_p", probabilities(text))
    named = fresh.select("*", *[F.col(f"_p.{c}").alias(f"_{c}") for c in ("positive", "negative", "neutral")])
    scored = sentiment_from_probs(named, "_positive", "_negative", "_neutral").drop("_p", "_positive", "_negative", "_neutral")
    return scored if rescore else scored.unionByName(base.filter(~todo))


def scoring_stats(df: DataFrame, rescore: bool = False) -> DataFrame:
    """scored (rows that need it), skipped_deleted, skipped_prescored"""
    done = F.lit(False) if rescore else F.col("sentiment_score").isNotNull()
    gone = placeholder(F.col("title"), F.col("text_excerpt"))
    return df.agg(F.count_if(~done & ~gone).alias("scored"), F.count_if(~done & gone).alias("skipped_deleted"), F.count_if(done).alias("skipped_prescored"))


def tagged(keywords) -> Column:
    """Does title or excerpt hold a keyword, as a part of any word and in any case?"""
    pattern = "|".join(re.escape(k.lower()) for k in keywords)
    return F.lower(F.concat_ws("\n", "title", "text_excerpt")).rlike(pattern)


def monthly_sentiment_rollup(stories: DataFrame, keywords=TAG_WORDS) -> DataFrame:
    return stories.groupBy("month").agg(F.avg("sentiment_score").alias("mean_sentiment"), F.count("*").alias("story_count"), F.count_if(tagged(keywords)).alias("tag_story_count"))


def top_k_reference_stories(stories: DataFrame, k: int = 5, series_id: str = "_SOCIAL", title_limit: int = 240) -> DataFrame:
    """The k best stories of each month as reference documents."""
    excerpt = F.trim(F.coalesce("text_excerpt", F.lit("")))
    return top_n_per_month(stories, k).select(
        F.lit(series_id).alias("series_id"),
        F.concat(F.lit("social:hn:"), F.col("story_id").cast("string")).alias("doc_type"),
        F.substring("title", 1, title_limit).alias("title"),
        F.when(excerpt == "", F.col("title")).otherwise(F.concat("title", F.lit("\n\n"), excerpt)).alias("content"),
    )


def in_months(first: int, last: int, of: str = "_latest") -> Column:
    """Is month between the months so many before the latest complete one?"""
    return F.col("month").between(F.add_months(of, -first), F.add_months(of, -last))


def with_latest(rollup: DataFrame, as_of: str) -> DataFrame:
    """rollup with _latest, its latest month before the one of as_of, which is not complete."""
    done = rollup.filter(F.col("month") < F.trunc(F.lit(as_of).cast("date"), "MM"))
    return rollup.crossJoin(F.broadcast(done.agg(F.max("month").alias("_latest"))))


def rollup_window_stats(rollup: DataFrame, as_of: str, months: int = 12, digits: int = 4) -> DataFrame:
    """Mean sentiment of the last complete months and of those before, its change, and the stories of the last ones."""
    rows = with_latest(rollup, as_of)
    now, before = in_months(months - 1, 0), in_months(2 * months - 1, months)
    mean = lambda w: F.avg(F.when(w, F.col("mean_sentiment")))
    out = rows.agg(F.max("_latest").alias("latest_month"), mean(now).alias("current"), mean(before).alias("prior"), F.sum(F.when(now, F.col("story_count"))).alias("total"), F.sum(F.when(now, F.col("tag_story_count"))).alias("tagged"))
    return out.select("latest_month", F.round("current", digits).alias("current"), F.round("prior", digits).alias("prior"), F.round(F.col("current") - F.col("prior"), digits).alias("change"), "total", "tagged", F.round(ratio(F.col("tagged"), F.col("total")), digits).alias("share"))


def volume_trend(rollup: DataFrame, as_of: str, months: int = 6, string_bounds: bool = False, digits: int = 4) -> DataFrame:
    """Tagged stories by month, recent against earlier: more than a tenth up or down is a trend.

    string_bounds leaves out the last month of either window, as comparing YYYY-MM-01 with YYYY-MM as text does.
    """
    rows, cut = with_latest(rollup, as_of), int(string_bounds)
    mean = lambda w: F.coalesce(F.avg(F.when(w, F.col("tag_story_count"))), F.lit(0.0))
    out = rows.agg(mean(in_months(months - 1, cut)).alias("r"), mean(in_months(2 * months - 1, months + cut)).alias("p"))
    trend = F.when(F.col("r") > F.col("p") * 1.1, "increasing").when(F.col("r") < F.col("p") * 0.9, "decreasing").otherwise("stable")
    return out.select(F.round("r", digits).alias("recent_avg"), F.round("p", digits).alias("prior_avg"), trend.alias("trend"))


def sentiment_vs_index(rollup: DataFrame, obs: DataFrame, id_: str, pop: str, as_of: str, date_min=None, date_max=None, by=("panel",), digits: int = 2) -> DataFrame:
    """Three-row mean sentiment beside a series per head, rebased to 100 at the first month that has both."""
    by = list(by)
    w = Window.partitionBy(F.lit(0)).orderBy("month")  # one row for each month
    mood = rollup.select("month", F.avg("mean_sentiment").over(w.rowsBetween(-2, 0)).alias("s"))
    per = side_by_side(obs, [id_, pop], by).filter(F.col(id_).isNotNull() & F.col(pop).isNotNull()).select(*by, month_of(F.col("date")).alias("month"), ratio(F.col(id_), F.col(pop)).alias("v"))
    both = per.join(mood, "month").filter(F.col("month") < F.trunc(F.lit(as_of).cast("date"), "MM"))
    out = both.select(*by, "month", F.round("s", digits).alias("sentiment_3m"), F.round(ratio(F.col("v"), first_of("v", by, "month")) * 100, digits).alias("pc_index"))
    return between(out, "month", date_min, date_max)


def tag_volume_vs_gap(rollup: DataFrame, obs: DataFrame, a: str, b: str, by=("panel",), digits: int = 2) -> DataFrame:
    by = list(by)
    gap = side_by_side(obs, [a, b], by).select(*by, month_of(F.col("date")).alias("month"), F.round(F.col(a) - F.col(b), digits).alias("gap")).filter("gap is not null")
    return gap.join(rollup.select("month", "tag_story_count"), "month").select(*by, "month", "tag_story_count", "gap")
