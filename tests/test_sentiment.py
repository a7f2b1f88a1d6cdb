"""The fitted model of sentiment: held-out figures, its arithmetic by hand, odd inputs."""

import re

import numpy as np
import pytest
from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F
from seriesloom.operators import sentiment as N
from seriesloom.operators import stories as S
from seriesloom.plans import story_queries as Q

GOOD, BAD, PLAIN = "a great win for growth", "awful loss and fear again", "the table of numbers"


@pytest.fixture(scope="module")
def model(spark):
    rows = [(f"{text} {i}", label) for i in range(40) for text, label in ((GOOD, 2), (BAD, 0), (PLAIN, 1))] + [("no label", None), ("odd label", 7)]
    return N.fit_sentiment(spark.createDataFrame(rows, "t string, label int"), F.col("t"), features=1 << 10)


def test_held_out(spark):
    """Toxic stories among those not seen: area under the curve at least 0.8 (0.855 measured)."""
    assert Q.sentiment_evaluation(spark, "/root/testdata/sf0.1").first().auc >= 0.8


def test_margins_by_hand(spark, model):
    texts = ["Great WIN, again!", "fear's loss; the ünlucky 7", "", "growth " * 5000]
    tf = HashingTF(numFeatures=1 << 10)
    rarity, weights, intercept = model.rarity.idf.toArray(), model.model.coefficientMatrix.toArray(), model.model.interceptVector.toArray()
    want = []
    for text in texts:
        w = re.findall(r"[^\W_']+(?:'[^\W_]+)*", text.lower())
        x = np.zeros(1 << 10)
        x[[tf.indexOf(t) for t in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]] = 1
        x *= rarity
        z = weights @ (x / (np.linalg.norm(x) or 1.0)) + intercept
        e = np.exp((z - z.max()) / model.temperature)
        want.append(e / e.sum())
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [list(r._p) for r in model.scored(rows, F.col("t")).orderBy("i").collect()]
    assert np.allclose(got, want, atol=1e-12) and np.allclose(np.sum(got, 1), 1)


def test_stories(spark, model):
    """Null and empty texts, repeated rows, callers' columns of the classes' names and with dots; scored rows stay; the same after a repartition."""
    rows = [(1, GOOD, None, None, "x"), (1, GOOD, None, None, "x"), (2, None, BAD, None, "x"), (3, BAD, "", None, "x"), (4, "", None, None, "x"), (5, "[deleted]", "", None, None), (6, BAD, None, 0.25, "x")]
    df = spark.createDataFrame(rows, "story_id int, title string, text_excerpt string, sentiment_score double, `a.b` string").withColumns({"sentiment_label": F.lit(None).cast("string"), "positive": F.lit("mine")})
    out = S.score_stories(df, model)
    assert out.columns == df.columns and out.filter("positive = 'mine'").count() == 7
    got = sorted((r.story_id, r.sentiment_label, r.sentiment_score) for r in out.filter("sentiment_label is not null").collect())
    assert [g[:2] for g in got if g[0] in (1, 3, 5)] == [(1, "positive"), (1, "positive"), (3, "negative"), (5, "neutral")] and got[0] == got[1]
    assert out.filter("story_id = 6").first().sentiment_score == 0.25
    again = S.score_stories(df.repartition(7), model).filter("sentiment_label is not null").collect()
    assert sorted((r.story_id, r.sentiment_label, r.sentiment_score) for r in again) == got
    assert S.score_stories(df.limit(0), model).count() == 0


def test_few_labels(spark):
    """One class only, and none at all."""
    rows = spark.createDataFrame([("a b c", 0), ("b c d", 0), ("c d e", 0)], "t string, label int")
    p = N.fit_sentiment(rows, F.col("t"), features=64).scored(rows, F.col("t")).first()._p
    assert p.negative > 0.99
    with pytest.raises(ValueError, match="labelled"):
        N.fit_sentiment(rows.limit(0), F.col("t"))
