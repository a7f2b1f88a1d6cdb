"""Domain tables derived from the given ones: observations by region, stories, predictions, claims.

Each has a twin in SQL, as common table expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# series_id, name, category, frequency, units, kind
SERIES = [
    ("SPREAD", "discount spread", "rates", "daily", "points", "rate"),
    ("RATE3", "filled share", "rates", "monthly", "percent", "rate"),
    ("RATE6", "filled or partial share", "rates", "monthly", "percent", "rate"),
    ("SECTOR_A", "urgent orders", "levels", "monthly", "orders", "level"),
    ("SECTOR_B", "high orders", "levels", "monthly", "orders", "level"),
    ("POP", "customers", "levels", "monthly", "persons", "level"),
    ("LEVEL", "shipped value", "levels", "quarterly", "currency", "level"),
    ("INDEX", "mean price", "prices", "monthly", "cents", "level"),
    ("POWER", "shipped quantity", "prices", "monthly", "pieces", "level"),
    ("FLAG", "high share", "flags", "monthly", "0/1", "level"),
    ("EMPTY", "no observations", "flags", "monthly", "0/1", "level"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def metadata(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SERIES, "series_id string, name string, category string, frequency string, units string, kind string")


META = "meta AS (SELECT * FROM (VALUES " + ", ".join(str(x) for x in SERIES) + ") AS m(series_id, name, category, frequency, units, kind))"


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select("n_nationkey", F.col("r_name").alias("panel"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """panel, series_id, date, value, value_adj: monthly, daily and quarterly measures of orders and shipments by region."""
    places = F.broadcast(regions(spark, sf_dir))  # 25 nations
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    lines = table(spark, sf_dir, "lineitem").join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(places, F.col("s_nationkey") == F.col("n_nationkey"))
    share = lambda *kinds: F.count_if(F.col("o_orderstatus").isin(*kinds)) / F.count("*")
    monthly = orders.groupBy("panel", F.trunc("o_orderdate", "MM").alias("date")).agg(
        (100 * share("F")).alias("RATE3"),
        (100 * share("F", "P")).alias("RATE6"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").cast("double").alias("SECTOR_A"),
        F.count_if(F.col("o_orderpriority") == "2-HIGH").cast("double").alias("SECTOR_B"),
        F.count_distinct("o_custkey").cast("double").alias("POP"),
        (F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).cast("double") / F.count("*")).alias("INDEX"),
        F.when(share("F") > 0.35, 1.0).otherwise(0.0).alias("FLAG"),
    )
    shipped = lines.withColumn("day", F.to_date("l_shipdate"))
    daily = shipped.groupBy("panel", F.col("day").alias("date")).agg((F.sum(F.round(F.col("l_discount") * 100).cast("long")).cast("double") / F.count("*") - 5).alias("SPREAD"))
    power = shipped.groupBy("panel", F.trunc("day", "MM").alias("date")).agg(F.sum(F.col("l_quantity").cast("long")).cast("double").alias("POWER"))
    level = shipped.groupBy("panel", F.trunc("day", "quarter").alias("date")).agg((F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).cast("double") / 100).alias("LEVEL"))

    def long(df: DataFrame) -> DataFrame:
        ids = [c for c in df.columns if c not in ("panel", "date")]
        return df.select("panel", "date", F.explode(F.array(*[F.struct(F.lit(i).alias("series_id"), F.col(i).alias("value")) for i in ids])).alias("x")).select("panel", "x.series_id", "date", "x.value")

    return reduce(DataFrame.unionByName, map(long, (monthly, daily, power, level))).withColumn("value_adj", F.col("value"))


OBS = """reg AS (SELECT n_nationkey, r_name AS panel FROM nation JOIN region ON n_regionkey = r_regionkey),
ord AS (SELECT reg.panel, o.*, CAST(date_trunc('month', o_orderdate) AS DATE) AS date FROM orders o JOIN customer ON o_custkey = c_custkey JOIN reg ON c_nationkey = n_nationkey),
shp AS (SELECT reg.panel, l.*, CAST(l_shipdate AS DATE) AS day FROM lineitem l JOIN supplier ON l_suppkey = s_suppkey JOIN reg ON s_nationkey = n_nationkey),
raw_obs AS (
SELECT panel, 'RATE3' AS series_id, date, 100.0::DOUBLE * (COUNT(*) FILTER (o_orderstatus = 'F')::DOUBLE / COUNT(*)) AS value FROM ord GROUP BY panel, date
UNION ALL SELECT panel, 'RATE6', date, 100.0::DOUBLE * (COUNT(*) FILTER (o_orderstatus IN ('F', 'P'))::DOUBLE / COUNT(*)) FROM ord GROUP BY panel, date
UNION ALL SELECT panel, 'SECTOR_A', date, COUNT(*) FILTER (o_orderpriority = '1-URGENT')::DOUBLE FROM ord GROUP BY panel, date
UNION ALL SELECT panel, 'SECTOR_B', date, COUNT(*) FILTER (o_orderpriority = '2-HIGH')::DOUBLE FROM ord GROUP BY panel, date
UNION ALL SELECT panel, 'POP', date, COUNT(DISTINCT o_custkey)::DOUBLE FROM ord GROUP BY panel, date
UNION ALL SELECT panel, 'INDEX', date, SUM(CAST(round(o_totalprice * 100) AS BIGINT))::DOUBLE / COUNT(*) FROM ord GROUP BY panel, date
UNION ALL SELECT panel, 'FLAG', date, CASE WHEN COUNT(*) FILTER (o_orderstatus = 'F')::DOUBLE / COUNT(*) > 0.35 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FROM ord GROUP BY panel, date
UNION ALL SELECT panel, 'SPREAD', day, SUM(CAST(round(l_discount * 100) AS BIGINT))::DOUBLE / COUNT(*) - 5 FROM shp GROUP BY panel, day
UNION ALL SELECT panel, 'POWER', CAST(date_trunc('month', day) AS DATE), SUM(CAST(l_quantity AS BIGINT))::DOUBLE FROM shp GROUP BY 1, 3
UNION ALL SELECT panel, 'LEVEL', CAST(date_trunc('quarter', day) AS DATE), SUM(CAST(round(l_extendedprice * 100) AS BIGINT))::DOUBLE / 100 FROM shp GROUP BY 1, 3),
obs AS (SELECT *, value AS value_adj FROM raw_obs)"""


def stories(spark: SparkSession, sf_dir: str, start: str = "2022-01-01") -> DataFrame:
    """Stories from documents, with class probabilities from labels."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    title = F.substring_index("text", "\n", 1)
    base = docs.select(
        F.col("doc_id").alias("story_id"),
        F.add_months(F.lit(start).cast("date"), (F.col("doc_id") % 48).cast("int")).alias("month"),
        title.alias("title"),
        F.substring(F.col("text"), F.length(title) + 2, F.length("text")).alias("text_excerpt"),
        F.col("n_chars").alias("score"),
        (F.col("doc_id") % 17).alias("num_comments"),
        F.array("source").alias("matched_queries"),
        F.col("doc_id").alias("position"),
    )
    return base.join(labels.select(F.col("doc_id").alias("story_id"), F.col("quality").cast("double").alias("positive"), F.col("toxic").cast("double").alias("negative")), "story_id", "left")


def stories_sql(start: str = "2022-01-01") -> str:
    return f"""stories AS (SELECT d.doc_id AS story_id, CAST(DATE '{start}' + to_months(CAST(d.doc_id % 48 AS INTEGER)) AS DATE) AS month,
split_part(text, chr(10), 1) AS title, substr(text, length(split_part(text, chr(10), 1)) + 2) AS text_excerpt, n_chars AS score,
d.doc_id % 17 AS num_comments, source, coalesce(l.quality, 0)::DOUBLE AS positive, coalesce(l.toxic, 0)::DOUBLE AS negative FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
scored AS (SELECT *, CASE WHEN gone THEN 0 ELSE positive - negative END AS sentiment_score, CASE WHEN gone THEN 'neutral' WHEN positive > negative THEN 'positive' WHEN negative > positive THEN 'negative' ELSE 'neutral' END AS sentiment_label
FROM (SELECT *, trim(title) IN ('[deleted]', '[dead]', '[flagged]') AND trim(text_excerpt) = '' AS gone FROM stories)),
roll AS (SELECT month, AVG(sentiment_score) AS mean_sentiment, COUNT(*) AS story_count, COUNT(*) FILTER (regexp_matches(lower(title || chr(10) || text_excerpt), 'scum|trash|idiot|ingth')) AS tag_story_count FROM scored GROUP BY 1)"""


WORDS = ("scum", "trash", "idiot", "ingth")
