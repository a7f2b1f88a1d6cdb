"""Registered queries over stories, topics and retrieval, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.unicode import nfkc
from ..operators import model as M
from ..operators import panel as P
from ..operators import retrieval as R
from ..operators import sentiment as N
from ..operators import stories as S
from ..operators import topics as T
from ..operators import vectors as E
from ..streaming import rollup as U
from ..sources.scratch import kept, scratch_path
from .stand_ins import OBS, WORDS, observations, stories, stories_sql, table

QUERIES: dict = {}
ORACLE: dict = {}
STORIES = stories_sql()
AS_OF = "2025-06-15"
EARLY = "1996-01-01"
D = 6


def add(name: str, sql: str | None = None, ctes: str = STORIES):
    def wrap(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = f"WITH {ctes} {sql}" if ctes else sql
        return f

    return wrap


def scored(spark, d, start="2022-01-01"):
    return S.sentiment_from_probs(stories(spark, d, start))


def rollup(spark, d, start="2022-01-01"):
    return S.monthly_sentiment_rollup(scored(spark, d, start), WORDS)


# ---- ingestion ----
NORMAL = """SELECT doc_id, CASE WHEN length(t) <= 300 THEN t WHEN strpos(h, ' ') > 0 AND 300 - strpos(reverse(h), ' ') >= 150 THEN rtrim(substr(h, 1, 300 - strpos(reverse(h), ' '))) ELSE rtrim(h) END AS text
FROM (SELECT doc_id, t, substr(t, 1, 300) AS h FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t FROM documents))"""


@add("normalize_text", NORMAL, "")
def normalize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", C.normalize_text(F.col("text"), 300, nfkc).alias("text"))


HITS = """SELECT event_id AS story_id, CAST(floor(epoch(ts)) AS BIGINT) AS seconds, 'item ' || event_type AS title, coalesce(user_id, 0) AS score, 0 AS num_comments, CASE WHEN event_id % 3 <> 0 THEN 'http://x/' || event_id END AS url FROM events WHERE event_id % 7 <> 0 AND event_type <> 'view'"""


@add("shape_hits", HITS, "")
def shape_hits(spark, d):
    e = table(spark, d, "events")
    hits = e.select(
        F.when(F.col("event_id") % 7 == 0, "none").otherwise(F.col("event_id").cast("string")).alias("objectID"),
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("created_at_i"),
        F.when(F.col("event_type") == "view", "  ").otherwise(F.concat(F.lit(" item  "), "event_type")).alias("title"),
        F.col("props").alias("story_text"),
        F.col("user_id").alias("points"),
        F.lit(None).cast("long").alias("num_comments"),
        F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("http://x/"), "event_id")).alias("url"),
    )
    out = S.shape_hits(hits, F.lit("all"))
    return out.select("story_id", F.unix_timestamp("created_utc").alias("seconds"), "title", "score", "num_comments", "url")


def twice(spark, d):
    one = stories(spark, d)
    again = one.withColumns({"matched_queries": F.array(F.lit("again"), F.lit("src1")), "position": F.col("position") + 10_000_000})
    return one.unionByName(again)


@add("dedupe_union_tags", "SELECT story_id, score, CASE WHEN source = 'src1' THEN 'src1,again' ELSE source || ',again,src1' END AS tags FROM stories")
def dedupe_union_tags(spark, d):
    return S.dedupe_union_tags(twice(spark, d)).select("story_id", "score", F.array_join("matched_queries", ",").alias("tags"))


@add("bucket_by_month", "SELECT event_id, strftime(ts, '%Y-%m') AS bucket FROM events WHERE ts >= TIMESTAMP '2024-01-11'", "")
def bucket_by_month(spark, d):
    return S.bucket_by_month(table(spark, d, "events"), "2024-01-11", "ts").select("event_id", "bucket")


@add("top_n_per_month", "SELECT story_id, month, score FROM stories QUALIFY ROW_NUMBER() OVER (PARTITION BY month ORDER BY score DESC, story_id) <= 30")
def top_n_per_month(spark, d):
    return S.top_n_per_month(stories(spark, d)).select("story_id", "month", "score")


@add("ingest_stats", 'SELECT 2 * COUNT(*) AS hits_total, COUNT(*) AS "unique", (SELECT COUNT(*) FROM (SELECT story_id FROM stories QUALIFY ROW_NUMBER() OVER (PARTITION BY month ORDER BY score DESC, story_id) <= 30)) AS kept FROM stories')
def ingest_stats(spark, d):
    unique = S.dedupe_union_tags(twice(spark, d))
    return S.ingest_stats(twice(spark, d), unique, S.top_n_per_month(unique))


# ---- sentiment ----
@add("sentiment_from_probs", "SELECT story_id, sentiment_score, sentiment_label FROM scored")
def sentiment_from_probs(spark, d):
    return scored(spark, d).select("story_id", "sentiment_score", "sentiment_label")


@add("score_stories")
def score_stories(spark, d):
    return S.score_stories(stories(spark, d).drop("positive", "negative")).select("story_id", "sentiment_score", "sentiment_label")


def fitted_sentiment(spark, d):
    """Stories with a label (2: good and not toxic, 0: toxic, 1: neither), held_out (a third, by a hash of the id), and a model of the others."""
    rows = stories(spark, d).withColumn("held_out", F.crc32(F.col("story_id").cast("string")) % 3 == 1)
    rows = rows.withColumn("label", F.when(F.col("negative") == 1, 0).when(F.col("positive") == 1, 2).when(F.col("positive").isNotNull(), 1)).drop("positive", "negative")
    return rows, N.fit_sentiment(rows.filter("not held_out"))


@add("score_stories_fitted")
def score_stories_fitted(spark, d):
    """All stories by the fitted model."""
    rows, model = fitted_sentiment(spark, d)
    return S.score_stories(rows, model).select("story_id", "held_out", "label", "sentiment_score", "sentiment_label")


@add("sentiment_evaluation")
def sentiment_evaluation(spark, d):
    """How well the fitted model tells toxic stories among those that it has not seen."""
    rows, model = fitted_sentiment(spark, d)
    p = F.col("_p.negative")
    scored = model.scored(rows.filter("held_out and label is not null")).select((F.col("label") == 0).cast("int").alias("label"), p.alias("probability"), (p > 0.5).cast("int").alias("prediction"))
    return M.evaluate_classifier(scored)


@add("scoring_stats", "SELECT COUNT(*) FILTER (positive + negative = 0 AND NOT gone) AS scored, COUNT(*) FILTER (positive + negative = 0 AND gone) AS skipped_deleted, COUNT(*) FILTER (positive + negative > 0) AS skipped_prescored FROM scored")
def scoring_stats(spark, d):
    some = scored(spark, d)
    known = F.coalesce("positive", F.lit(0.0)) + F.coalesce("negative", F.lit(0.0)) > 0
    return S.scoring_stats(some.withColumn("sentiment_score", F.when(known, F.col("sentiment_score"))))


@add("monthly_sentiment_rollup", f"SELECT month, round(mean_sentiment, {D}) AS mean_sentiment, story_count, tag_story_count FROM roll")
def monthly_sentiment_rollup(spark, d):
    return rollup(spark, d).withColumn("mean_sentiment", F.round("mean_sentiment", D))


@add("top_k_reference_stories", "SELECT '_SOCIAL' AS series_id, 'social:hn:' || story_id AS doc_type, substr(title, 1, 240) AS title, CASE WHEN trim(text_excerpt) = '' THEN title ELSE title || chr(10) || chr(10) || trim(text_excerpt) END AS content FROM stories QUALIFY ROW_NUMBER() OVER (PARTITION BY month ORDER BY score DESC, story_id) <= 5")
def top_k_reference_stories(spark, d):
    return S.top_k_reference_stories(stories(spark, d))


def months(a: int, b: int) -> str:
    return f"month BETWEEN latest - INTERVAL {a} MONTH AND latest - INTERVAL {b} MONTH"


LATEST = "(SELECT *, (SELECT MAX(month) FROM roll WHERE month < DATE '2025-06-01') AS latest FROM roll)"
STATS = f"SELECT latest_month, round(c, {D}) AS \"current\", round(p, {D}) AS prior, round(c - p, {D}) AS change, total, tagged, round(tagged / NULLIF(total, 0), {D}) AS share FROM (SELECT MAX(latest) AS latest_month, AVG(mean_sentiment) FILTER ({months(11, 0)}) AS c, AVG(mean_sentiment) FILTER ({months(23, 12)}) AS p, CAST(SUM(story_count) FILTER ({months(11, 0)}) AS BIGINT) AS total, CAST(SUM(tag_story_count) FILTER ({months(11, 0)}) AS BIGINT) AS tagged FROM {LATEST})"


@add("rollup_window_stats", STATS)
def rollup_window_stats(spark, d):
    return S.rollup_window_stats(rollup(spark, d), AS_OF, digits=D)


def trend_sql(cut: int) -> str:
    return f"SELECT round(r, {D}) AS recent_avg, round(p, {D}) AS prior_avg, CASE WHEN r > p * 1.1::DOUBLE THEN 'increasing' WHEN r < p * 0.9::DOUBLE THEN 'decreasing' ELSE 'stable' END AS trend FROM (SELECT coalesce(AVG(tag_story_count) FILTER ({months(5, cut)}), 0) AS r, coalesce(AVG(tag_story_count) FILTER ({months(11, 6 + cut)}), 0) AS p FROM {LATEST})"


@add("volume_trend", trend_sql(0))
def volume_trend(spark, d):
    return S.volume_trend(rollup(spark, d), AS_OF, digits=D)


@add("volume_trend_text_bounds", trend_sql(1))
def volume_trend_text_bounds(spark, d):
    return S.volume_trend(rollup(spark, d), AS_OF, string_bounds=True, digits=D)


BOTH = f"{OBS}, {stories_sql(EARLY)}"
MOOD = f"""SELECT panel, month, round(s, {D}) AS sentiment_3m, round(v / NULLIF(first_value(v) OVER (PARTITION BY panel ORDER BY month), 0) * 100, {D}) AS pc_index FROM (
SELECT a.panel, a.date AS month, a.value / NULLIF(p.value, 0) AS v FROM obs a JOIN obs p ON p.series_id = 'POP' AND p.panel = a.panel AND p.date = a.date WHERE a.series_id = 'SECTOR_A') JOIN (SELECT month, AVG(mean_sentiment) OVER (ORDER BY month ROWS 2 PRECEDING) AS s FROM roll) USING (month) WHERE month < DATE '1999-08-01'"""


@add("sentiment_vs_index", MOOD, BOTH)
def sentiment_vs_index(spark, d):
    return S.sentiment_vs_index(rollup(spark, d, EARLY), observations(spark, d), "SECTOR_A", "POP", "1999-08-20", digits=D)


@add("tag_volume_vs_gap", f"SELECT panel, month, tag_story_count, gap FROM (SELECT panel, date AS month, round(MAX(value) FILTER (series_id = 'RATE6') - MAX(value) FILTER (series_id = 'RATE3'), {D}) AS gap FROM obs GROUP BY 1, 2) JOIN roll USING (month) WHERE gap IS NOT NULL", BOTH)
def tag_volume_vs_gap(spark, d):
    return S.tag_volume_vs_gap(rollup(spark, d, EARLY), observations(spark, d), "RATE6", "RATE3", digits=D)


# ---- topics ----
STOPS = ["the", "and", "of", "la", "de", "der", "die", "que"]
STOP_SQL = "[" + ", ".join(f"'{w}'" for w in STOPS) + "]"
DOCS = STORIES + f""", docs AS (SELECT story_id AS doc_id, trim(trim(title) || ' ' || trim(text_excerpt)) AS text FROM stories WHERE trim(trim(title) || ' ' || trim(text_excerpt)) <> ''),
toks AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}_]{{2,}}'), lambda w: NOT list_contains({STOP_SQL}, w)) AS tokens FROM docs),
tf AS (SELECT doc_id, term, COUNT(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM toks) GROUP BY 1, 2),
vocab AS (SELECT term, df, total, ln((1 + n) / (1 + df)) + 1 AS idf FROM (SELECT term, COUNT(*) AS df, CAST(SUM(tf) AS BIGINT) AS total, (SELECT COUNT(*) FROM toks WHERE len(tokens) > 0) AS n FROM tf GROUP BY 1) WHERE df >= 3 AND df <= 0.85 * n ORDER BY total DESC, term LIMIT 2000)"""


def documents(spark, d):
    return T.topic_documents(stories(spark, d))


@add("topic_documents", "SELECT doc_id, text FROM docs", DOCS)
def topic_documents(spark, d):
    return documents(spark, d)


@add("tokenize", "SELECT doc_id, array_to_string(tokens, ' ') AS tokens FROM toks", DOCS)
def tokenize(spark, d):
    return T.tokenize(documents(spark, d), STOPS).select("doc_id", F.array_join("tokens", " ").alias("tokens"))


@add("tfidf", f"SELECT doc_id, term, round(w / sqrt(SUM(w * w) OVER (PARTITION BY doc_id)), {D}) AS weight FROM (SELECT doc_id, term, tf * idf AS w FROM tf JOIN vocab USING (term))", DOCS)
def tfidf(spark, d):
    return T.tfidf(T.tokenize(documents(spark, d), STOPS))[0].withColumn("weight", F.round("weight", D))


@add("tfidf_vocabulary", f"SELECT term, df, total, round(idf, {D}) AS idf FROM vocab", DOCS)
def tfidf_vocabulary(spark, d):
    return T.tfidf(T.tokenize(documents(spark, d), STOPS))[1].withColumn("idf", F.round("idf", D))


def factors(spark, d):
    weights, vocab = T.tfidf(T.tokenize(documents(spark, d), STOPS))
    return T.nmf_topics(weights, vocab)


@add("nmf_topics")
def nmf_topics(spark, d):
    w, _ = factors(spark, d)
    return T.topic_assign(w)


@add("topic_top_terms")
def topic_top_terms(spark, d):
    return T.topic_top_terms(factors(spark, d)[1], overrides={0: "first"})


WEIGHTS = "w AS (SELECT doc_id, [n_chars % 5, n_chars % 7, n_chars % 3, length(lang)]::DOUBLE[] AS weights FROM documents WHERE lang IS NOT NULL AND n_chars IS NOT NULL), assigned AS (SELECT doc_id, CAST(list_position(weights, list_max(weights)) - 1 AS INTEGER) AS topic_id, list_max(weights) AS score FROM w)"
NAMES = "topics AS (SELECT * FROM (VALUES (0, 'zero'), (1, 'one'), (2, 'two'), (3, 'three'), (4, 'four')) AS t(topic_id, label))"
ROWS = "rows_ AS (SELECT a.topic_id, label, month, sentiment_score FROM assigned a JOIN topics USING (topic_id) JOIN scored ON story_id = doc_id)"


def assigned(spark, d):
    docs = table(spark, d, "documents").filter("lang is not null and n_chars is not null")
    return T.topic_assign(docs.select("doc_id", F.array(*[(F.col("n_chars") % n).cast("double") for n in (5, 7, 3)], F.length("lang").cast("double")).alias("weights")))


def names(spark):
    return spark.createDataFrame([(0, "zero"), (1, "one"), (2, "two"), (3, "three"), (4, "four")], "topic_id int, label string")


@add("topic_assign", "SELECT doc_id, topic_id, score FROM assigned", WEIGHTS)
def topic_assign(spark, d):
    return assigned(spark, d)


@add("topic_story_counts", "SELECT topic_id, COUNT(doc_id) AS story_count FROM topics LEFT JOIN assigned USING (topic_id) GROUP BY 1", f"{WEIGHTS}, {NAMES}")
def topic_story_counts(spark, d):
    return T.topic_story_counts(names(spark), assigned(spark, d))


GRAMS = f"""gram AS (SELECT month, ngram, COUNT(*) AS "count" FROM (SELECT month, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS ngram FROM (
SELECT month, list_filter(regexp_extract_all(lower(title), '[\\p{{L}}\\p{{M}}\\p{{N}}_]{{2,}}'), lambda w: NOT list_contains({STOP_SQL}, w)) AS t FROM stories WHERE trim(title) <> '' AND month IN (SELECT month FROM stories WHERE trim(title) <> '' GROUP BY 1 HAVING COUNT(*) >= 2)) WHERE len(t) > 1)
GROUP BY 1, 2 QUALIFY ROW_NUMBER() OVER (PARTITION BY month ORDER BY COUNT(*) DESC, ngram) <= 10)"""


@add("monthly_top_bigrams", 'SELECT month, ngram, "count" FROM gram', f"{STORIES}, {GRAMS}")
def monthly_top_bigrams(spark, d):
    return T.monthly_top_bigrams(stories(spark, d), stop_words=STOPS)


QUARTERS = ["2022-Q1", "2023-Q2", "2024-Q3", "2025-Q4"]


@add("quarterly_ngram_heatmap", "SELECT ngram, " + ", ".join(f"CAST(coalesce(SUM(\"count\") FILTER (year(month) || '-Q' || quarter(month) = '{q}'), 0) AS BIGINT) AS \"{q}\"" for q in QUARTERS) + ' FROM gram WHERE ngram IN (SELECT ngram FROM gram GROUP BY 1 ORDER BY SUM("count") DESC, ngram LIMIT 8) GROUP BY 1', f"{STORIES}, {GRAMS}")
def quarterly_ngram_heatmap(spark, d):
    return T.quarterly_ngram_heatmap(T.monthly_top_bigrams(stories(spark, d), stop_words=STOPS), quarters=QUARTERS)


TOPICS = f"{STORIES}, {WEIGHTS}, {NAMES}, {ROWS}"


@add("topic_month_counts", "SELECT topic_id, label, month, COUNT(*) AS story_count FROM rows_ WHERE month < DATE '2025-06-01' AND month >= DATE '2023-01-01' GROUP BY 1, 2, 3", TOPICS)
def topic_month_counts(spark, d):
    return T.topic_month_counts(assigned(spark, d), names(spark), scored(spark, d), AS_OF, "2023-01-01")


@add("topic_sentiment", f"SELECT *, topic_id = arg_min(topic_id, mean) OVER () AS most_negative, topic_id = first_value(topic_id) OVER (ORDER BY n DESC, topic_id) AS dominant FROM (SELECT topic_id, label, round(AVG(sentiment_score), {D}) AS mean, MIN(sentiment_score) AS min, MAX(sentiment_score) AS max, round(median(sentiment_score), {D}) AS median, COUNT(*) AS n FROM rows_ GROUP BY 1, 2)", TOPICS)
def topic_sentiment(spark, d):
    return T.topic_sentiment(assigned(spark, d), names(spark), scored(spark, d), D)


@add("top_topics_monthly_sentiment", f"SELECT month, round(AVG(sentiment_score) FILTER (label = 'zero'), {D}) AS zero, round(AVG(sentiment_score) FILTER (label = 'one'), {D}) AS one FROM rows_ WHERE label IN ('zero', 'one') AND topic_id IN (SELECT topic_id FROM rows_ GROUP BY 1 ORDER BY COUNT(*) DESC, topic_id LIMIT 3) GROUP BY 1", TOPICS)
def top_topics_monthly_sentiment(spark, d):
    out = T.top_topics_monthly_sentiment(assigned(spark, d), names(spark), scored(spark, d), ["zero", "one"], 3, D)
    return out.filter("zero is not null or one is not null")


# ---- retrieval ----
@add("chunk_documents")
def chunk_documents(spark, d):
    return R.chunk_documents(table(spark, d, "documents"))


@add("embed_chunks")
def embed_chunks(spark, d):
    return R.embed_chunks(R.chunk_documents(table(spark, d, "documents").select("doc_id", "text")))


WORDS_IN = """SELECT doc_id || '::0' AS chunk_id, cell, COUNT(*) AS words FROM (SELECT doc_id, ('0x' || substr(md5(word), 1, 6))::BIGINT % 64 AS cell
FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\\S+')) AS word FROM documents)) GROUP BY ALL"""


@add("embed_whole", WORDS_IN, "")
def embed_whole(spark, d):
    """Whole texts as chunks; the vectors of the stand-in encoder, of length 1, scaled back to their words' number."""
    chunks = table(spark, d, "documents").filter("text is not null").select("doc_id", F.lit(0).alias("chunk_index"), "text")
    vectors = R.embed_chunks(chunks)
    sizes = chunks.select(F.concat(F.col("doc_id").cast("string"), F.lit("::0")).alias("chunk_id"), F.size(F.regexp_extract_all(F.lower("text"), F.lit(r"\S+"), F.lit(0))).alias("n"))
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    cells = vectors.join(sizes, "chunk_id").withColumn("total", total).select("chunk_id", "n", "total", F.posexplode("embedding").alias("cell", "w")).filter("w > 0")
    return cells.select("chunk_id", F.col("cell").cast("long").alias("cell"), F.round(F.col("w") * F.col("n") / F.col("total")).cast("long").alias("words"))


NEAR_WORDS = """texts AS (SELECT row_number() OVER () AS r, regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]{2,}') AS t FROM documents WHERE text IS NOT NULL),
words AS (SELECT r, unnest(t) AS term, unnest(range(len(t))) AS pos FROM texts),
vocab AS (SELECT term FROM (SELECT term, COUNT(DISTINCT r) AS df FROM words GROUP BY 1) WHERE df >= 3 ORDER BY df DESC, term LIMIT 10000),
ahead AS (SELECT term AS a, unnest([lead(term, 1) OVER w, lead(term, 2) OVER w, lead(term, 3) OVER w, lead(term, 4) OVER w, lead(term, 5) OVER w]) AS b FROM words WINDOW w AS (PARTITION BY r ORDER BY pos)),
pairs AS (SELECT a, b, COUNT(*) AS n FROM ahead WHERE a IN (SELECT term FROM vocab) AND b IN (SELECT term FROM vocab) GROUP BY 1, 2),
both_ AS (SELECT term, other, CAST(SUM(n) AS BIGINT) AS n FROM (SELECT a AS term, b AS other, n FROM pairs UNION ALL SELECT b, a, n FROM pairs) GROUP BY 1, 2),
sums AS (SELECT term, CAST(SUM(n) AS DOUBLE) AS s FROM both_ GROUP BY 1)"""


@add("word_associations", f"SELECT x.term, other, n, round(ln(n * (SELECT SUM(s) FROM sums) / (p.s * q.s)), {D}) AS weight FROM both_ x JOIN sums p ON p.term = x.term JOIN sums q ON q.term = other WHERE ln(n * (SELECT SUM(s) FROM sums) / (p.s * q.s)) > 0", NEAR_WORDS)
def word_associations(spark, d):
    """The table that learnt vectors come from, by terms."""
    tokens = T.tokenize(table(spark, d, "documents").filter("text is not null"), [])
    vocab = kept(E.vocabulary(tokens).select("idx", "term"), "vector-vocabulary")
    found = E.associations(E.pair_counts(tokens, [r["term"] for r in vocab.orderBy("idx").collect()]))
    named = found.join(F.broadcast(vocab.withColumnRenamed("idx", "row")), "row").join(F.broadcast(vocab.select(F.col("idx").alias("col"), F.col("term").alias("other"))), "col")
    return named.select("term", "other", "n", F.round("weight", D).alias("weight"))


@add("embed_chunks_learnt")
def embed_chunks_learnt(spark, d):
    """All chunks by vectors learnt from all whole texts."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return E.embed_learnt(R.chunk_documents(docs), E.learn_vectors(T.tokenize(docs, [])))


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")


def asked(spark, d):
    return vectors(spark, d).filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "embedding", F.when(F.col("doc_id") % 100 == 0, F.col("label")).when(F.col("doc_id") % 150 == 0, -1).alias("hint"))


V = """v AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS e, label FROM embeddings), q AS (SELECT doc_id AS query_id, e AS qe, CASE WHEN doc_id % 100 = 0 THEN label WHEN doc_id % 150 = 0 THEN -1 END AS hint FROM v WHERE doc_id % 50 = 0)"""
KNN = "SELECT query_id, doc_id, rank, round(distance, 6) AS distance FROM (SELECT query_id, doc_id, distance, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS INTEGER) AS rank FROM (SELECT query_id, doc_id, {dist} AS distance FROM q JOIN v ON {on})) WHERE rank <= 5"


@add("knn_retrieve", KNN.format(dist="1 - list_cosine_similarity(qe, e)", on="hint IS NULL OR hint = label OR NOT EXISTS (SELECT 1 FROM v v2 WHERE v2.label = hint)"), V)
def knn_retrieve(spark, d):
    return R.knn_retrieve(vectors(spark, d), asked(spark, d), hint_col="label").withColumn("distance", F.round("distance", D))


@add("knn_retrieve_l2", KNN.format(dist="list_distance(qe, e)", on="true"), V)
def knn_retrieve_l2(spark, d):
    return R.knn_retrieve(vectors(spark, d), asked(spark, d), metric="l2").withColumn("distance", F.round("distance", D))


def hits(spark, d, k):
    kinds = vectors(spark, d).select("doc_id", F.when(F.col("label") == 3, "scholarly:x").when(F.col("label") < 3, "series_notes").otherwise("social:y").alias("doc_type"))
    return R.knn_retrieve(vectors(spark, d), asked(spark, d), k=k).join(kinds, "doc_id").select("query_id", "doc_id", "doc_type", "rank", "distance")


FLOOR = """k AS (SELECT query_id, doc_id, CASE WHEN label = 3 THEN 'scholarly:x' WHEN label < 3 THEN 'series_notes' ELSE 'social:y' END AS doc_type, distance, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS INTEGER) AS rank FROM (SELECT query_id, doc_id, label, 1 - list_cosine_similarity(qe, e) AS distance FROM q, v)),
h AS (SELECT * FROM k WHERE rank <= 7), have AS (SELECT query_id, COUNT(*) FILTER (doc_type = 'scholarly:x') AS n FROM h GROUP BY 1),
pool AS (SELECT * FROM k WHERE rank <= 60 AND doc_type <> 'series_notes' QUALIFY ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY rank) <= 15),
more AS (SELECT pool.*, ROW_NUMBER() OVER (PARTITION BY pool.query_id ORDER BY pool.rank) AS i FROM pool WHERE doc_type = 'scholarly:x' AND rank > 7)"""


@add("retrieve_with_floor", "SELECT query_id, doc_id, doc_type, rank FROM h UNION ALL SELECT query_id, doc_id, doc_type, CAST(7 + i AS INTEGER) FROM more JOIN have USING (query_id) WHERE i <= 3 - n", f"{V}, {FLOOR}")
def retrieve_with_floor(spark, d):
    return R.retrieve_with_floor(hits(spark, d, 7), hits(spark, d, 60)).select("query_id", "doc_id", "doc_type", "rank")


@add("reference_context", "SELECT query_id, string_agg(n || '. [ref:' || doc_id || '] ' || line, chr(10) ORDER BY n) AS context FROM (SELECT query_id, h.doc_id, CASE WHEN length(text) > 150 THEN substr(text, 1, 150) || '...' ELSE text END AS line, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM h JOIN documents USING (doc_id)) GROUP BY 1", f"{V}, {FLOOR}")
def reference_context(spark, d):
    return R.reference_context(hits(spark, d, 7), table(spark, d, "documents").select("doc_id", "text"))


# ---- stream ----
DAYS = "SELECT CAST(ts AS DATE) AS day, round(AVG(value), 6) AS mean_sentiment, COUNT(*) AS story_count, COUNT(*) FILTER (event_type IN ('click', 'view')) AS tag_story_count FROM events GROUP BY 1 HAVING CAST(ts AS DATE) + 1 <= (SELECT MAX(ts) FROM events) - INTERVAL 1 DAY"


def event_stream(spark, d, *more):
    """Events as a stream of stories, with the named columns beside."""
    stream = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return stream.select(F.col("event_id").alias("story_id"), F.col("ts").alias("created_utc"), F.col("event_type").alias("title"), F.lit("").alias("text_excerpt"), F.col("value").alias("sentiment_score"), *more)


def streamed_days(spark, d):
    here = scratch_path(spark, "stream")
    query = U.stream_monthly_rollup(event_stream(spark, d), f"{here}/days", f"{here}/state", ("click", "view"))
    query.awaitTermination()
    return spark.read.schema("day date, mean_sentiment double, story_count long, tag_story_count long").parquet(f"{here}/days")


@add("stream_monthly_rollup", DAYS, "")
def stream_monthly_rollup(spark, d):
    """Events as an unbounded stream of stories; the days that are complete when the stream has been read."""
    return streamed_days(spark, d).withColumn("mean_sentiment", F.round("mean_sentiment", D))


MONTHS = f"SELECT CAST(date_trunc('month', day) AS DATE) AS month, round(SUM(mean_sentiment * story_count) / SUM(story_count), {D}) AS mean_sentiment, CAST(SUM(story_count) AS BIGINT) AS story_count, CAST(SUM(tag_story_count) AS BIGINT) AS tag_story_count FROM ({DAYS.replace('round(AVG(value), 6)', 'AVG(value)')}) GROUP BY 1"


@add("stream_months", MONTHS, "")
def stream_months(spark, d):
    """The stream's complete days summed up by month."""
    return U.monthly_of_days(streamed_days(spark, d)).withColumn("mean_sentiment", F.round("mean_sentiment", D))


CALENDAR = f"SELECT {{key}}CAST(date_trunc('month', ts) AS DATE) AS month, round(AVG(value), {D}) AS mean_sentiment, COUNT(*) AS story_count, COUNT(*) FILTER (event_type IN ('click', 'view')) AS tag_story_count, CAST(COUNT(DISTINCT CAST(ts AS DATE)) AS INTEGER) AS days FROM events GROUP BY ALL HAVING date_trunc('month', ANY_VALUE(ts)) + INTERVAL 1 MONTH <= (SELECT MAX(ts) FROM events) - INTERVAL 1 DAY"


def streamed_months(spark, d, **columns):
    here = scratch_path(spark, "months")
    U.stream_calendar_months(event_stream(spark, d, "event_type"), f"{here}/months", f"{here}/state", ("click", "view"), **columns).awaitTermination()
    keys = "".join(f"{c} string, " for c in columns.get("by", ()))
    return spark.read.schema(keys + U.MONTH).parquet(f"{here}/months").withColumn("mean_sentiment", F.round("mean_sentiment", D))


@add("stream_calendar_months", CALENDAR.format(key=""), "")
def stream_calendar_months(spark, d):
    """The months that are complete when the stream has been read, as the stream gives them out."""
    return streamed_months(spark, d)


@add("stream_months_by_type", CALENDAR.format(key="event_type, "), "")
def stream_months_by_type(spark, d):
    return streamed_months(spark, d, by=("event_type",))
