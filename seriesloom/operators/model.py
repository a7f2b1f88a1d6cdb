"""Training, comparing and applying classifiers on feature matrices; scenario grids and what is read off them."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import ratio, three_way
from ..sources.scratch import kept, scratch_path
from .ordered import running

# Thresholds that make a feature a warning.
SIGNAL_RULES = (("yield_spread", "lt", 0.0), ("yield_inverted_months", "gt", 0.0), ("unrate_12m_change", "gt", 0.0), ("gdp_growth_annualized", "lt", 0.0), ("info_employment_yoy", "lt", 0.0))
NEGATIVE, POSITIVE = ("yield_spread", "gdp_growth_annualized", "info_employment_yoy"), ("yield_inverted_months", "unrate_12m_change")
GAP, GAP_MEDIAN = "u6_u3_gap", 3.5


def weighted(train: DataFrame, label: str) -> DataFrame:
    """weight: rows / (2 * rows of the class), so that both classes weigh the same."""
    sizes = train.groupBy(label).agg(F.count("*").alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_all"))
    return train.join(F.broadcast(sizes.crossJoin(total)), label).withColumn("weight", F.col("_all") / (2.0 * F.col("_n"))).drop("_n", "_all")


def weighed(train: DataFrame, features: list[str], label: str) -> DataFrame:
    """Features, label and weight of each row, written once: fitting reads its rows in several jobs, and each would join the weights anew."""
    return kept(weighted(train.select(*features, label), label), "weighed")


class Scored:
    """A fitted model with its features: adds probability and prediction. probability: from a DataFrame, that DataFrame with _p."""

    def __init__(self, name: str, features: list[str], probability: Callable[[DataFrame], DataFrame], weights: dict[str, float]) -> None:
        self.name, self.features, self.probability, self.weights = name, features, probability, weights

    def score(self, df: DataFrame) -> DataFrame:
        return self.probability(df).select(*df.columns, F.col("_p").alias("probability"), (F.col("_p") > 0.5).cast("int").alias("prediction"))


def line(intercept: float, terms: dict[str, tuple[float, float, float]]) -> Callable[[DataFrame], DataFrame]:
    """The logistic probability from column arithmetic; terms: weight, mean and deviation by feature. A null feature gives null."""
    odds = F.lit(intercept)
    for name, (weight, mean, deviation) in terms.items():
        odds = odds + (F.lit(weight / deviation if deviation else 0.0) * (F.col(name) - mean))
    return lambda df: df.withColumn("_p", 1 / (1 + F.exp(-odds)))


def train_logistic(train: DataFrame, features: list[str], label: str = "label") -> Scored:
    """Standardised features, balanced classes, an L2 penalty of half the squared weights against the summed loss.

    Scoring needs coefficients, means and deviations only; the fitted model, which holds its training summary and with it the
    session, is not kept.
    """
    rows = VectorAssembler(inputCols=features, outputCol="_x").transform(weighed(train, features, label))
    n = rows.count()
    scaler = StandardScaler(inputCol="_x", outputCol="_z", withMean=True, withStd=True).fit(rows)
    model = LogisticRegression(featuresCol="_z", labelCol=label, weightCol="weight", probabilityCol="_p", rawPredictionCol="_r", predictionCol="_y", regParam=1.0 / max(1, n), elasticNetParam=0.0, standardization=False, maxIter=200).fit(scaler.transform(rows))
    weights = dict(zip(features, map(float, model.coefficients), strict=True))
    terms = {f: (w, float(m), float(d)) for (f, w), m, d in zip(weights.items(), scaler.mean, scaler.std, strict=True)}
    return Scored("logistic", features, line(float(model.intercept), terms), weights)


def saved_forest(train: DataFrame, features: list[str], label: str, trees: int, depth: int, leaf: int, seed: int) -> str:
    return grown(weighed(train, features, label), features, label, trees, depth, leaf, seed)


def grown(rows: DataFrame, features: list[str], label: str, trees: int, depth: int, leaf: int, seed: int) -> str:
    """Folder of a forest fitted to rows with their weights. The model as fitted holds its training summary, and with it the session.

    It is saved as the JVM returns it: its Python form makes an object of every tree, some 40,000 calls for 500 trees, which nothing reads.
    """
    rows = VectorAssembler(inputCols=features, outputCol="_x").transform(rows)
    fitted = RandomForestClassifier(featuresCol="_x", labelCol=label, weightCol="weight", probabilityCol="_p", rawPredictionCol="_r", predictionCol="_y", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=seed)._fit_java(rows)
    path = scratch_path(rows.sparkSession, "forest")
    fitted.write().save(path)
    return path


def forest(train: DataFrame, features: list[str], label: str, trees: int, depth: int, leaf: int, seed: int = 42) -> Scored:
    model = RandomForestClassificationModel.load(saved_forest(train, features, label, trees, depth, leaf, seed))
    # Trained on rows of class 0 alone, the model knows one class and gives one probability: that of class 1 is 0.
    second = F.coalesce(F.get(vector_to_array("_p"), F.lit(1)), F.lit(0.0))
    vote = lambda df: model.transform(VectorAssembler(inputCols=features, outputCol="_x").transform(df)).withColumn("_p", second)
    return Scored("forest", features, vote, dict(zip(features, map(float, model.featureImportances.toArray()), strict=True)))


class Trees:
    """The nodes of a saved forest of at most two classes, a row for each tree: feature and threshold of each node, its children, and its share of the second class."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        node, (first, second) = F.col("nodeData"), [F.coalesce(F.get("nodeData.impurityStats", F.lit(k)), F.lit(0.0)) for k in (0, 1)]  # rows of class 0 alone leave no second
        threshold = F.coalesce(F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)), F.lit(0.0))
        columns = {"id": node["id"], "left": node["leftChild"], "right": node["rightChild"], "feature": node["split"]["featureIndex"], "threshold": threshold, "share": second / (first + second)}
        rows = spark.read.parquet(f"{path}/data").select("treeID", *[c.alias(n) for n, c in columns.items()]).toArrow()  # numbers by column: no objects in the driver's Python
        at = rows["treeID"].to_numpy(), rows["id"].to_numpy()
        shape = at[0].max() + 1, at[1].max() + 1
        put = lambda name, kind: (lambda a: (a.__setitem__(at, rows[name].to_numpy()), a)[1])(np.zeros(shape, kind))
        self.share, self.threshold = put("share", float), put("threshold", float)
        self.left, self.right, self.feature = put("left", int), put("right", int), put("feature", int)

    def nested(self, x: np.ndarray, trees: tuple[int, ...], depths: tuple[int, ...]) -> dict[tuple[int, int], np.ndarray]:
        """Probabilities of the rows of x by the first so many trees, cut off at so many levels below their roots."""
        tree, node = np.arange(len(self.share)), np.zeros((len(x), len(self.share)), int)
        out = {}
        for level in range(max(depths) + 1):
            if level in depths:
                sums = np.cumsum(self.share[tree, node], 1)
                out |= {(t, level): sums[:, t - 1] / t for t in trees}
            inner = self.left[tree, node] > 0
            goes_left = np.take_along_axis(x, np.maximum(self.feature[tree, node], 0), 1) <= self.threshold[tree, node]
            node = np.where(inner, np.where(goes_left, self.left[tree, node], self.right[tree, node]), node)
        return out


def expanding_folds(train: DataFrame, folds: int, month: str = "month") -> list[tuple[DataFrame, DataFrame]]:
    """Pairs of what came before and what came next: the months in order are cut into folds + 1 parts of about the same length."""
    months = train.select(month).distinct()
    cuts = months.agg(*[F.percentile(F.unix_date(month), k / (folds + 1)).alias(f"c{k}") for k in range(1, folds + 1)]).first()
    at = [c for c in cuts] if cuts[0] is not None else []
    day = F.unix_date(month)
    return [(train.filter(day <= a), train.filter((day > a) & (day <= b))) for a, b in zip(at, [*at[1:], float("inf")], strict=False)]


def nested_scores(rows: DataFrame, trees: Trees, features: list[str], label: str, counts: tuple[int, ...], depths: tuple[int, ...]) -> DataFrame:
    """trees, depth, label, probability, prediction: of every row of rows for every setting that lies within one forest."""
    shared = rows.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.stack([batch.column(f).to_numpy(zero_copy_only=False).astype(float) for f in features], 1)
                for (t, d), p in shared.value.nested(x, counts, depths).items():
                    same = lambda v: pa.array(np.full(len(p), v), pa.int32())  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([same(t), same(d), batch.column(label).cast(pa.int32()), pa.array(p), pa.array((p > 0.5).astype(np.int32))], names=["trees", "depth", "label", "probability", "prediction"])

    return rows.select(*features, label).mapInArrow(run, "trees int, depth int, label int, probability double, prediction int")


def train_forest(train: DataFrame, features: list[str], label: str = "label", grid: tuple = ((100, 200, 500), (3, 5, 10, 30), (5, 10, 20)), folds: int = 5, seed: int = 42, workers: int = 4) -> Scored:
    """The forest of the grid (trees, depth, rows of a leaf) with the best mean area under the curve over expanding folds; a fold that fails counts 0, the first of equal settings wins.

    One forest of the most trees and the greatest depth is fitted for each fold and number of rows of a leaf; smaller settings are scored from its
    first trees and upper levels, which are forests of those settings themselves (drawn by other random numbers than forests fitted alone).
    workers of these fits run at a time, as they are many small jobs. The chosen setting is then fitted to all rows.
    """
    spark = train.sparkSession
    train = kept(train, "forest-rows")
    counts, depths, leaves = (tuple(x) for x in grid)
    settings = list(itertools.product(counts, depths, leaves))
    parts = expanding_folds(train, folds) if len(settings) > 1 else []
    usable = [k for k, (before, _) in enumerate(parts) if before.agg(F.min(label) < F.max(label)).first()[0]]
    ready = {k: weighed(parts[k][0], features, label) for k in usable}

    def scored(job: tuple[int, int]) -> DataFrame:
        fold, leaf = job
        trees = Trees(spark, grown(ready[fold], features, label, max(counts), max(depths), leaf, seed))
        return kept(nested_scores(parts[fold][1], trees, features, label, counts, depths), "forest-scores").withColumns({"fold": F.lit(fold), "leaf": F.lit(leaf)})

    with ThreadPoolExecutor(workers) as pool:
        every = list(pool.map(scored, itertools.product(usable, leaves)))
    total = dict.fromkeys(settings, 0.0)
    if every:
        for r in evaluate_classifier(reduce(DataFrame.unionByName, every), by=("fold", "trees", "depth", "leaf")).collect():  # a row for each fold and setting
            total[r.trees, r.depth, r.leaf] += r.auc if r.auc is not None else 0.0
    best = max(settings, key=total.get)
    return forest(train, features, label, *best, seed=seed)


def evaluate_classifier(scored: DataFrame, label: str = "label", by: tuple[str, ...] = ()) -> DataFrame:
    """precision, recall, f1 (0 where undefined), auc (null with one class only), by rank sums with mean ranks for ties.

    Rows are first counted by probability; counts of the rows below each are running sums over ranges of probabilities, so no task meets them all.
    """
    y, p = F.col(label) == 1, F.col("prediction") == 1
    counts = scored.groupBy(*by, "probability").agg(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg"), F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"))
    below = running(counts, list(by), ["probability"], ("neg",)).withColumn("below", F.col("neg_sum") - F.col("neg"))
    sums = below.groupBy(*by).agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("u"), *[F.sum(c).alias(c) for c in ("pos", "neg", "tp", "fp", "fn")])
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return sums.select(*by, zero(ratio(F.col("tp"), F.col("tp") + F.col("fp"))).alias("precision"), zero(ratio(F.col("tp"), F.col("tp") + F.col("fn"))).alias("recall"), zero(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("f1"), ratio(F.col("u"), F.col("pos") * F.col("neg")).alias("auc"))


def select_and_score(models: list[Scored], aucs: list[float | None], df: DataFrame, month: str = "month", actual: str = "flag_actual", by: tuple[str, ...] = ("panel",)) -> DataFrame:
    """Every month scored by the model with the largest area under the curve; the first of equal ones, unknown ones last."""
    best = models[max(range(len(models)), key=lambda i: (aucs[i] is not None and aucs[i] == aucs[i], aucs[i] or 0.0, -i))]
    out = best.score(df)
    return out.select(*by, F.col(month).alias("date"), "probability", "prediction", F.col(actual).alias("actual"), F.lit(best.name).alias("model_name"), F.to_json(F.struct(*best.features)).alias("features_json"))


# Lowest level, step and number of levels of each axis of the grid, in hundredths.
AXES = {"yield_spread": (-150, 50, 10), "unrate": (300, 50, 9), "gdp_growth_annualized": (-400, 100, 13), "cpi_yoy": (100, 100, 10)}


def axis_levels(spark: SparkSession, axes: dict[str, tuple[int, int, int]]) -> DataFrame:
    """All combinations of levels, with id; levels are whole hundredths, so none drifts. Their number is that of the axes, whatever the data."""
    sizes = [n for *_, n in axes.values()]
    total = reduce(int.__mul__, sizes, 1)
    out, rest = spark.range(total).withColumnRenamed("id", "scenario_id"), F.col("scenario_id")
    for (name, (low, step, n)) in reversed(list(axes.items())):
        out = out.withColumn(name, (low + step * (rest % n)) / 100.0)
        rest = F.floor(rest / n)
    return out.select("scenario_id", *axes)


def scenario_grid(spark: SparkSession, axes: dict, latest: DataFrame, model: Scored) -> DataFrame:
    """The grid scored with all other features from the latest row."""
    others = latest.select(*[f for f in model.features if f not in axes]).limit(1)
    return model.score(axis_levels(spark, axes).crossJoin(F.broadcast(others))).select("scenario_id", *axes, "probability", F.lit(model.name).alias("model_name"))


def nearest_scenario(queries: DataFrame, grid: DataFrame, axes: dict[str, tuple[int, int, int]]) -> DataFrame:
    """The grid row nearest to each query after scaling each axis to its range.

    The squared distance is a sum over axes and the grid is regular, so each axis snaps by itself (ties to the lower level)
    and a join by level finds the row: no query meets the whole grid.
    """
    snapped = queries
    for name, (low, step, n) in axes.items():
        k = F.ceil((F.col(name) * 100 - low) / step - 0.5)
        snapped = snapped.withColumn(f"_{name}", F.least(F.greatest(k, F.lit(0)), F.lit(n - 1)).cast("int")).drop(name)
    keyed = grid.withColumns({f"_{name}": F.round((F.col(name) * 100 - low) / step).cast("int") for name, (low, step, n) in axes.items()})
    keys = [f"_{name}" for name in axes]
    return snapped.join(keyed, keys).drop(*keys)


def grid_sensitivity(grid: DataFrame, axes: list[str]) -> DataFrame:
    """axis, sensitivity: the largest range of probabilities within one of its levels."""
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("double").alias("level")) for a in axes]))
    levels = grid.select("probability", each.alias("x")).groupBy("x.axis", "x.level").agg((F.max("probability") - F.min("probability")).alias("range"))
    return levels.groupBy("axis").agg(F.max("range").alias("sensitivity"))


def feature_map(predictions: DataFrame, key: list[str]) -> DataFrame:
    parsed = F.from_json("features_json", "map<string,double>")
    return predictions.select(*key, F.explode(parsed).alias("feature", "value"))


def feature_signals(predictions: DataFrame, key: list[str], rules=SIGNAL_RULES) -> DataFrame:
    """key..., red_count, strongest_red, strongest_green: by absolute value, the first rule on ties; a missing feature counts as 0."""
    table = F.from_json("features_json", "map<string,double>")
    value = lambda f: F.coalesce(F.col("_m")[f], F.lit(0.0))
    each = F.array(*[F.struct(F.lit(f).alias("f"), F.abs(value(f)).alias("size"), F.lit(-i).alias("order"), (value(f) < t if op == "lt" else value(f) > t).alias("red")) for i, (f, op, t) in enumerate(rules)])
    marked = predictions.withColumn("_m", table).withColumn("_r", each)

    def strongest(red: bool) -> Column:
        some = F.filter("_r", lambda x: (x["red"] if red else ~x["red"]) & (x["size"] > 0))
        return F.coalesce(F.array_max(F.transform(some, lambda x: F.struct(x["size"], x["order"], x["f"])))["f"], F.lit(""))

    return marked.select(*key, F.size(F.filter("_r", lambda x: x["red"])).alias("red_count"), strongest(True).alias("strongest_red"), strongest(False).alias("strongest_green"))


def feature_labels(predictions: DataFrame, key: list[str]) -> DataFrame:
    return feature_map(predictions, key).withColumn("label", three_way(F.col("value")))


def feature_signal_color(predictions: DataFrame, key: list[str]) -> DataFrame:
    """key..., feature, value, color; the gap is held against its median over all predictions."""
    each = feature_map(predictions, key)
    middle = each.filter(F.col("feature") == GAP).agg(F.coalesce(F.median("value"), F.lit(GAP_MEDIAN)).alias("_median"))
    f, v = F.col("feature"), F.col("value")
    color = F.when(f == GAP, F.when(v > F.col("_median"), "red").otherwise("green")).when(f.isin(*NEGATIVE), F.when(v < 0, "red").otherwise("green")).when(f.isin(*POSITIVE), F.when(v > 0, "red").otherwise("green")).otherwise("gray")
    return each.crossJoin(F.broadcast(middle)).withColumn("color", color).drop("_median")


def risk_timeline_stats(predictions: DataFrame, by: tuple[str, ...] = ("panel",), digits: int = 4) -> DataFrame:
    """latest, prob_12m_ago, prob_6m_ago (as of: the latest row up to then), above_count (over 0.5), total, trend."""
    last = predictions.groupBy(*by).agg(F.max("date").alias("_last"))
    rows = predictions.join(last, list(by))
    as_of = lambda n: F.max_by(F.when(F.col("date") <= F.add_months("_last", -n), F.col("probability")), F.when(F.col("date") <= F.add_months("_last", -n), F.col("date")))
    out = rows.groupBy(*by).agg(F.max_by("probability", "date").alias("latest"), as_of(12).alias("prob_12m_ago"), as_of(6).alias("prob_6m_ago"), F.count_if(F.col("probability") > 0.5).alias("above_count"), F.count("*").alias("total"))
    return out.withColumn("trend", F.signum(F.col("latest") - F.col("prob_6m_ago")).cast("int")).withColumns({c: F.round(c, digits) for c in ("latest", "prob_12m_ago", "prob_6m_ago")})
