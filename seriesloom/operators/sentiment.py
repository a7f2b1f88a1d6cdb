"""A fitted model of sentiment: hashed words and pairs of words, a regularised multinomial fit, calibrated probabilities."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import IDF, HashingTF, IDFModel, NGram, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import kept, scratch_path

CLASSES = ("negative", "neutral", "positive")  # 0, 1, 2
TEMPERATURES = tuple(float(t) for t in np.round(np.geomspace(0.25, 8.0, 41), 6))


def words(text: Column) -> Column:
    """Runs of letters, digits and apostrophes, lower-cased; no words for a null or empty text."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}']+"), lambda w: w != "")


def buckets(df: DataFrame, text: Column, features: int) -> DataFrame:
    """df with _c: which of so many buckets the words and pairs of words of the whole text fall in; a bucket counts once. What is made on the way is dropped."""
    rows = df.withColumn("_w", words(text))
    rows = NGram(n=2, inputCol="_w", outputCol="_g").transform(rows).withColumn("_t", F.concat("_w", "_g"))
    return HashingTF(numFeatures=features, binary=True, inputCol="_t", outputCol="_c").transform(rows).drop("_w", "_g", "_t")


def vectors(rows: DataFrame, rarity: IDFModel) -> DataFrame:
    """rows with _x: buckets by their rarity, as a vector of length 1 (all zeros without words that the fit knows)."""
    return Normalizer(inputCol="_i", outputCol="_x").transform(rarity.transform(rows)).drop("_c", "_i")


def story_text() -> Column:
    return F.concat_ws("\n", "title", "text_excerpt")


def softened(margins: Column, temperature: float) -> list[Column]:
    """Probabilities of the classes from their margins, divided by the temperature; the largest is subtracted first, so nothing overflows."""
    z = [F.get(margins, F.lit(i)) / temperature for i in range(len(CLASSES))]
    e = [F.exp(x - F.greatest(*z)) for x in z]
    return [x / sum(e[1:], e[0]) for x in e]


class Sentiment:
    """Margins by a saved linear model, probabilities by a temperature."""

    def __init__(self, model: LogisticRegressionModel, rarity: IDFModel, features: int, temperature: float) -> None:
        self.model, self.rarity, self.features, self.temperature = model, rarity, features, temperature

    def margins(self, df: DataFrame, text: Column) -> DataFrame:
        """df with _z, an array of the classes' margins; in the JVM, without a shuffle."""
        return padded(self.model.transform(vectors(buckets(df, text, self.features), self.rarity))).drop("_x", "_r", "_q", "_y")

    def scored(self, df: DataFrame, text: Column | None = None) -> DataFrame:
        """df with _p (negative, neutral, positive): whole texts, null ones as empty (then the fit's intercepts speak)."""
        rows = self.margins(df, story_text() if text is None else text)
        p = softened(F.col("_z"), self.temperature)
        return rows.withColumn("_p", F.struct(*[x.alias(c) for x, c in zip(p, CLASSES, strict=True)])).drop("_z")


def likelihoods(rows: DataFrame, label: str) -> DataFrame:
    """temperature, loss, n: the mean negative log-likelihood of the labels at every temperature, in one pass over margins _z."""
    chosen = lambda t: F.element_at(F.array(*softened(F.col("_z"), t)), F.col(label).cast("int") + 1)
    losses = [F.avg(-F.log(F.greatest(chosen(t), F.lit(1e-300)))) for t in TEMPERATURES]
    return rows.agg(F.array(*[F.struct(F.lit(t).alias("temperature"), loss.alias("loss")) for t, loss in zip(TEMPERATURES, losses, strict=True)]).alias("x")).select(F.inline("x"))


def fit_sentiment(labelled: DataFrame, text: Column | None = None, label: str = "label", features: int = 1 << 14, penalty: float = 1e-4, parts: int = 5, least: int = 3) -> Sentiment:
    """Fits on all labelled rows (label: 0, 1 or 2, by CLASSES; rows without one are left out), calibrated on a part that the first fit has not seen.

    Rows are dealt to parts by a hash of their text, so copies of a text lie in one part and the fit does not depend on files or
    partitions: one part of `parts` chooses the temperature for a model of the others, the model that is kept is fitted on all. The optimiser
    sums gradients in the tasks; the driver holds the weights (features x 3) and the buckets' rarity (logarithmic, by all labelled rows; 0 in fewer
    than `least` of them), never rows. Classes that do not occur get hardly any probability;
    without any labelled row there is nothing to fit, which is an error.
    """
    said = story_text() if text is None else text
    spark = labelled.sparkSession
    known = labelled.filter(F.col(label).isin(0, 1, 2))
    rows = kept(buckets(known.select(F.col(label).cast("double").alias("_label"), F.coalesce(said, F.lit("")).alias("_text")), F.col("_text"), features).withColumn("_part", F.pmod(F.xxhash64("_text"), F.lit(parts))).drop("_text"), "sentiment")
    if rows.isEmpty():
        raise ValueError("no labelled rows")
    rarity = IDF(inputCol="_c", outputCol="_i", minDocFreq=least).fit(rows)
    rows = vectors(rows, rarity)

    def fitted(some: DataFrame) -> LogisticRegressionModel:
        path = scratch_path(spark, "sentiment-model")
        model = LogisticRegression(featuresCol="_x", labelCol="_label", rawPredictionCol="_r", probabilityCol="_q", predictionCol="_y", family="multinomial", regParam=penalty, standardization=False, maxIter=100)
        model.fit(some).write().save(path)  # the model as fitted holds its training summary, and with it the session
        return LogisticRegressionModel.load(path)

    temperature = 1.0
    held, rest = rows.filter("_part = 0"), rows.filter("_part != 0")
    if not held.isEmpty() and not rest.isEmpty():
        margins = padded(fitted(rest).transform(held))
        temperature = likelihoods(margins, "_label").orderBy("loss", "temperature").first()["temperature"]
    return Sentiment(fitted(rows), rarity, features, temperature)


def padded(rows: DataFrame) -> DataFrame:
    """_z from a model's margins, which are infinite if the fit has seen one class only; a class beyond those that it has seen gets one far below the others."""
    z = F.transform(vector_to_array("_r"), lambda x: F.least(F.greatest(x, F.lit(-500.0)), F.lit(500.0)))
    return rows.withColumn("_z", F.transform(F.sequence(F.lit(0), F.lit(len(CLASSES) - 1)), lambda i: F.coalesce(F.get(z, i), F.array_min(z) - 50.0)))
