"""Topics and n-grams of stories: tokens, TF-IDF, non-negative factors, monthly bigrams, and their roll-ups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import quarter_label
from ..sources.scratch import kept

# Tokens that are no words of a topic.
EXTRA_STOP_WORDS = (
    "x27", "x2f", "quot", "href", "https", "http", "www", "com", "amp", "gt", "lt", "ve", "pre", "don", "didn", "doesn", "isn",
    "wasn", "weren", "wouldn", "couldn", "shouldn", "hasn", "haven", "ll", "re", "hn", "ask", "nofollow", "rel", "built", "org",
    "html", "io", "musk", "musk's", "elon", "zuckerberg", "bezos", "twitter", "ex", "tesla", "spacex", "meta", "facebook",
)
TOKEN = r"(?U)\b\w\w+\b"


def default_stop_words() -> list[str]:
    return [*StopWordsRemover.loadDefaultStopWords("english"), *EXTRA_STOP_WORDS]


def topic_documents(stories: DataFrame) -> DataFrame:
    text = F.trim(F.concat_ws(" ", F.trim("title"), F.trim(F.coalesce("text_excerpt", F.lit("")))))
    return stories.select(F.col("story_id").alias("doc_id"), text.alias("text")).filter("text <> ''")


def tokens_of(text: Column, stop_words: list[str]) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    stops = F.array(*[F.lit(w) for w in stop_words])
    return F.filter(words, lambda w: ~F.array_contains(stops, w))


def tokenize(docs: DataFrame, stop_words: list[str] | None = None) -> DataFrame:
    return docs.select("doc_id", tokens_of(F.col("text"), default_stop_words() if stop_words is None else stop_words).alias("tokens"))


def tfidf(tokens: DataFrame, min_df: int = 3, max_df: float = 0.85, max_features: int = 2000) -> tuple[DataFrame, DataFrame]:
    """(doc_id, term, weight with rows of length 1), (term, df, total, idf). The vocabulary has at most max_features terms, so it is broadcast."""
    tf = tokens.select("doc_id", F.explode("tokens").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    n = tokens.filter(F.size("tokens") > 0).agg(F.count("*").alias("_n"))
    seen = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).crossJoin(F.broadcast(n))
    some = seen.filter((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("_n"))).orderBy(F.desc("total"), "term").limit(max_features)
    vocab = some.select("term", "df", "total", (F.log((1 + F.col("_n")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = tf.join(F.broadcast(vocab.select("term", "idf")), "term").withColumn("w", F.col("tf") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id")))
    return raw.select("doc_id", "term", (F.col("w") / length).alias("weight")), vocab


class Rows:
    """Documents of an Arrow batch as sparse rows: all columns and values one after another, and where each row begins."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        lists = batch.column("idx")
        self.n, self.cols, self.values = len(lists), np.asarray(lists.flatten()), np.asarray(batch.column("weight").flatten())
        self.begins = np.asarray(lists.offsets)[:-1] - (np.asarray(lists.offsets)[0] if len(lists) else 0)  # no row is empty
        self.owner = np.repeat(np.arange(self.n), np.diff(np.append(self.begins, len(self.cols))))

    def times(self, h: np.ndarray) -> np.ndarray:
        """The product with h transposed: documents by topics."""
        return np.add.reduceat(self.values[:, None] * h.T[self.cols], self.begins, axis=0)

    def turned_times(self, w: np.ndarray, terms: int) -> np.ndarray:
        """The product of w transposed with the rows: topics by terms."""
        return np.stack([np.bincount(self.cols, self.values * column[self.owner], terms) for column in w.T])


def coordinate_descent(x: np.ndarray, target: np.ndarray, gram: np.ndarray, sweeps: int, tol: float = 0.0) -> np.ndarray:
    """Rows of non-negative weights with a smaller squared error: one coordinate of all rows after the other takes its best value.

    The error of a row w is w gram w / 2 - w target. Coordinates without weight in gram become 0.
    """
    x = x.copy()
    for _ in range(sweeps):
        moved = 0.0
        for j in range(len(gram)):
            new = np.maximum(0.0, x[:, j] + (target[:, j] - x @ gram[:, j]) / gram[j, j]) if gram[j, j] > 1e-12 else np.zeros(len(x))
            moved = max(moved, float(np.abs(new - x[:, j]).max(initial=0.0)))
            x[:, j] = new
        if moved <= tol * max(1e-12, float(x.max(initial=0.0))):
            break
    return x


def document_weights(rows: Rows, h: np.ndarray) -> np.ndarray:
    """Every document's best weights for given topics; they depend on nothing else, so a task that is run again gives the same."""
    return coordinate_descent(np.zeros((rows.n, len(h))), rows.times(h), h @ h.T, 200, 1e-6)


def better_topics(h: np.ndarray, wx: np.ndarray, ww: np.ndarray) -> np.ndarray:
    return coordinate_descent(h.T, wx.T, ww, 20, 1e-6).T


def first_topics(k: int, terms: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).random((k, max(1, terms))) + 0.1


def nmf_topics(weights: DataFrame, vocab: DataFrame, k: int = 8, iters: int = 300, seed: int = 42, tol: float = 1e-4, shards: int = 16, losses: list[float] | None = None) -> tuple[DataFrame, DataFrame]:
    """W (doc_id, weights), H (topic_id, term, weight), by least squares in turn.

    Documents stay where they are, in a written table: each round sends the topics (k by vocabulary) out, finds every document's best
    weights for them, and brings back sums (products of weights with weights and with documents, and the squared error), which give
    better topics. The error falls in every round; the rounds end when it falls by less than tol of the first one. Only the vocabulary,
    which is bounded, and the sums of at most shards groups of tasks reach the driver. losses: gets the error of each round.
    """
    spark = weights.sparkSession
    terms = [r["term"] for r in vocab.orderBy("term").collect()]
    ids = spark.createDataFrame(list(enumerate(terms)), "idx int, term string")
    docs = kept(weights.filter("weight != 0").join(F.broadcast(ids), "term").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("idx", "weight"))).alias("x")).select("doc_id", "x.idx", "x.weight"), "sparse-rows")
    h = first_topics(k, len(terms), seed)

    def sums_of(h: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            total, seen = np.zeros(h.size + len(h) ** 2 + 1), False
            for batch in batches:
                if batch.num_rows:
                    rows = Rows(batch)
                    w = document_weights(rows, h)
                    wx, ww = rows.turned_times(w, h.shape[1]), w.T @ w
                    total += np.concatenate((wx.ravel(), ww.ravel(), [(rows.values**2).sum() - 2 * (wx * h).sum() + (ww * (h @ h.T)).sum()]))
                    seen = True
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % shards]), pa.array([total], pa.list_(pa.float64()))], names=["shard", "sums"])

        return run

    def add(table: pa.Table) -> pa.Table:
        return pa.table({"sums": pa.array([sum(np.asarray(x.values) for x in table.column("sums"))], pa.list_(pa.float64()))})

    errors: list[float] = [] if losses is None else losses
    for _ in range(iters if terms else 0):
        parts = docs.mapInArrow(sums_of(h), "shard long, sums array<double>").groupBy("shard").applyInArrow(add, "sums array<double>").collect()
        if not parts:
            break
        total = sum(np.array(r["sums"]) for r in parts)
        errors.append(float(total[-1]))
        if len(errors) > 1 and errors[-2] - errors[-1] < tol * errors[0]:
            break
        h = better_topics(h, total[: h.size].reshape(h.shape), total[h.size : -1].reshape(k, k))
    last = h

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                w = list(document_weights(Rows(batch), last))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(w, pa.list_(pa.float64()))], names=["doc_id", "weights"])

    topics = spark.createDataFrame([(t, term, float(h[t, j])) for t in range(k) for j, term in enumerate(terms)], "topic_id int, term string, weight double")
    return docs.mapInArrow(apply, "doc_id long, weights array<double>"), topics


def topic_top_terms(topics: DataFrame, n: int = 5, overrides: dict[int, str] | None = None) -> DataFrame:
    """topic_id, label (the first three terms, unless overridden), top_terms"""
    rank = F.row_number().over(Window.partitionBy("topic_id").orderBy(F.desc("weight"), "term"))
    top = topics.withColumn("_n", rank).filter(F.col("_n") <= n).groupBy("topic_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "term"))), lambda x: x["term"]).alias("top_terms"))
    label = F.array_join(F.slice("top_terms", 1, 3), " / ")
    for topic, name in (overrides or {}).items():
        label = F.when(F.col("topic_id") == topic, name).otherwise(label)
    return top.select("topic_id", label.alias("label"), "top_terms")


def topic_assign(w: DataFrame) -> DataFrame:
    """doc_id, topic_id (the first of the largest weights), score"""
    most = F.array_max("weights")
    return w.select("doc_id", (F.array_position("weights", most) - 1).cast("int").alias("topic_id"), most.alias("score"))


def topic_story_counts(topics: DataFrame, assign: DataFrame) -> DataFrame:
    counts = assign.groupBy("topic_id").agg(F.count("*").alias("n"))
    return topics.select("topic_id").distinct().join(counts, "topic_id", "left").select("topic_id", F.coalesce("n", F.lit(0)).alias("story_count"))


def monthly_top_bigrams(stories: DataFrame, n: int = 10, stop_words: list[str] | None = None) -> DataFrame:
    """month, ngram, count: the n most frequent pairs of neighbouring kept tokens within titles; months with fewer than two titles are left out."""
    stops = default_stop_words() if stop_words is None else stop_words
    titled = stories.filter(F.trim("title") != "")
    enough = titled.groupBy("month").agg(F.count("*").alias("_t")).filter("_t >= 2").select("month")
    tokens = titled.select("month", tokens_of(F.col("title"), stops).alias("t")).filter(F.size("t") > 1)
    pairs = F.transform(F.sequence(F.lit(1), F.size("t") - 1), lambda i: F.concat_ws(" ", F.element_at("t", i), F.element_at("t", i + 1)))
    counts = tokens.select("month", F.explode(pairs).alias("ngram")).groupBy("month", "ngram").agg(F.count("*").alias("count"))
    rank = F.row_number().over(Window.partitionBy("month").orderBy(F.desc("count"), "ngram"))
    return counts.join(enough, "month", "left_semi").withColumn("_n", rank).filter(F.col("_n") <= n).drop("_n")


def quarterly_ngram_heatmap(ngrams: DataFrame, top: int = 8, quarters: list[str] | None = None) -> DataFrame:
    """ngram by quarter, 0 where it does not occur; the top most frequent n-grams overall."""
    best = ngrams.groupBy("ngram").agg(F.sum("count").alias("_all")).orderBy(F.desc("_all"), "ngram").limit(top).select("ngram")
    some = ngrams.join(F.broadcast(best), "ngram", "left_semi").withColumn("quarter", quarter_label(F.col("month")))
    grouped = some.groupBy("ngram")
    return (grouped.pivot("quarter", quarters) if quarters else grouped.pivot("quarter")).sum("count").fillna(0)


def topic_rows(assign: DataFrame, topics: DataFrame, stories: DataFrame) -> DataFrame:
    """Assigned stories with their topic's label; topics are few."""
    named = assign.join(F.broadcast(topics.select("topic_id", "label")), "topic_id")
    return named.join(stories.select(F.col("story_id").alias("doc_id"), "month", "sentiment_score"), "doc_id")


def topic_month_counts(assign: DataFrame, topics: DataFrame, stories: DataFrame, as_of: str, date_min=None, date_max=None) -> DataFrame:
    rows = topic_rows(assign, topics, stories).filter(F.col("month") < F.trunc(F.lit(as_of).cast("date"), "MM"))
    if date_min:
        rows = rows.filter(F.col("month") >= F.lit(date_min).cast("date"))
    if date_max:
        rows = rows.filter(F.col("month") <= F.lit(date_max).cast("date"))
    return rows.groupBy("topic_id", "label", "month").agg(F.count("*").alias("story_count"))


def topic_sentiment(assign: DataFrame, topics: DataFrame, stories: DataFrame, digits: int = 4) -> DataFrame:
    """topic_id, label, mean, min, max, median, n, most_negative and dominant (one topic each; the smallest id on ties)"""
    s = F.col("sentiment_score")
    each = topic_rows(assign, topics, stories).groupBy("topic_id", "label").agg(F.round(F.avg(s), digits).alias("mean"), F.min(s).alias("min"), F.max(s).alias("max"), F.round(F.median(s), digits).alias("median"), F.count("*").alias("n"))
    ends = each.agg(F.min(F.struct("mean", "topic_id")).alias("a"), F.max(F.struct("n", -F.col("topic_id"))).alias("b"))
    return each.crossJoin(F.broadcast(ends)).select(*each.columns, (F.col("topic_id") == F.col("a.topic_id")).alias("most_negative"), (-F.col("topic_id") == F.col("b.col2")).alias("dominant"))


def top_topics_monthly_sentiment(assign: DataFrame, topics: DataFrame, stories: DataFrame, labels: list[str] | None = None, k: int = 2, digits: int = 4) -> DataFrame:
    """month by label of the k topics with the most stories: mean sentiment."""
    rows = topic_rows(assign, topics, stories)
    best = rows.groupBy("topic_id").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "topic_id").limit(k).select("topic_id")
    grouped = rows.join(F.broadcast(best), "topic_id", "left_semi").groupBy("month")
    return (grouped.pivot("label", labels) if labels else grouped.pivot("label")).agg(F.round(F.avg("sentiment_score"), digits))
