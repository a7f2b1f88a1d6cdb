"""Quality by hierarchical empirical Bayes: a document's own evidence, and what its host and path have shown."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import lookup_join, small_batches, whole_row, written

MARKS = np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8)
CHUNK_WORDS = 64


def features(text: str | None) -> np.ndarray:
    """Square roots of shares (marks, letters, repeats) over the whole text, the same at their worst stretch, and sizes."""
    raw = (text or "").encode()
    n = max(1, len(raw))
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    k = max(1, len(words))
    same = [a == b for a, b in zip(words, words[1:], strict=False)]
    worst_repeat = worst_caps = 0.0
    for at in range(0, len(words), CHUNK_WORDS):
        some = words[at : at + CHUNK_WORDS]
        if len(some) >= 8:
            worst_repeat = max(worst_repeat, 1 - len(set(some)) / len(some))
            worst_caps = max(worst_caps, sum(map(bytes.isupper, some)) / len(some))
    lines = raw.split(b"\n")
    shares = [*(seen[MARKS] / n), seen[65:91].sum() / n, seen[97:123].sum() / n, seen[48:58].sum() / n, seen[128:].sum() / n, seen[32] / n, seen[10] / n]
    shares += [sum(same) / k, 1 - len(set(words)) / k, 1 - len(set(lines)) / len(lines), worst_repeat, worst_caps]
    sizes = [math.log1p(len(words)) / 10, math.log1p(len(raw) / k) / 3, math.log1p(len(set(words))) / 10]
    return np.concatenate((np.sqrt(np.maximum(shares, 0.0)), sizes))


class Logistic:
    """Logistic regression by Newton steps with an L2 penalty; inputs are standardised."""

    def __init__(self, x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 25) -> None:
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = np.column_stack((np.ones(len(x)), self.standard(x)))
        w, ridge = np.zeros(z.shape[1]), np.full(z.shape[1], penalty)
        ridge[0] = 1e-6
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(ridge), z.T @ (p - y) + ridge * w)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + self.standard(x) @ self.weights[1:], -30, 30)))


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds x, the features, and drops the text."""
    small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c not in (text, "x")]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py()) for t in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(x, pa.list_(pa.float64()))], names=[*names, "x"])

    return docs.select(*names, text).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "x array<double>"]))


def fit(featured: DataFrame, labels: DataFrame, doc_id: str = "doc_id", most: int = 20_000) -> Logistic | None:
    """Learns from at most about most labelled rows, drawn by a hash of doc_id; labels: doc_id, quality (null: unlabelled)."""
    marks = labels.filter(F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias(doc_id)).agg((F.avg("quality") >= 0.5).cast("int").alias("_good"))
    n = marks.count()
    some = marks.filter(F.pmod(F.xxhash64(doc_id, F.lit(3)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, most / max(1, n))))
    rows = sorted((r["_good"], *r["x"]) for r in featured.select(doc_id, "x").join(some, doc_id).select("_good", "x").limit(2 * most).collect())
    if len({r[0] for r in rows}) < 2:
        return None
    table = np.array(rows)
    return Logistic(table[:, 1:], table[:, 0])


def with_evidence(rows: DataFrame, model: Logistic | None, text: str | None = None) -> DataFrame:
    """Adds p_doc, the classifier's probability, from the features in x or from the field text of the struct _row."""
    small_batches(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("x") if text is None else pa.StructArray.field(batch.column("_row"), text)
            x = np.array([v.as_py() if text is None else features(v.as_py()) for v in values])
            p = shared.value(x) if shared.value is not None and len(x) else np.full(len(values), 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=[*batch.schema.names, "p_doc"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("p_doc", DoubleType())]))


def logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9))
    return F.log(p / (1 - p))


def sites(evidence: DataFrame, host: str = "_host", path: str = "_path") -> tuple[DataFrame, float]:
    """site (host and path), n and s of the path, host_mean and strengths, by grouped sums; and the global mean.

    A host's mean shrinks toward the global one and a path's toward its host's, by as many pseudo-documents as the spread of
    documents within paths is larger than that of the means (analysis of variance), at least 10 and at most 10,000.
    """
    by_path = evidence.groupBy(host, path).agg(F.count("*").alias("n"), F.sum("p_doc").alias("s"), F.sum(F.col("p_doc") * F.col("p_doc")).alias("q"))
    by_path = written(by_path, "quality-paths")
    by_host = by_path.groupBy(host).agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"), F.sum(F.col("n") * F.col("n")).alias("host_nn"), F.sum("q").alias("host_q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("host_ss"), F.count("*").alias("paths"))
    by_host = written(by_host, "quality-hosts")
    # Sums of squares of paths' means around their hosts', of hosts' around the global one, and of documents within paths.
    own = F.col("host_s") * F.col("host_s") / F.col("host_n")
    t = by_host.agg(
        F.sum("host_n").alias("n"), F.sum("host_s").alias("s"), F.count("*").alias("hosts"), F.sum("paths").alias("paths"),
        F.sum(F.col("host_q") - F.col("host_ss")).alias("within"), F.sum(F.col("host_ss") - own).alias("of_paths"), F.sum(own).alias("of_hosts"),
        F.sum(F.col("host_nn") / F.col("host_n")).alias("nn_paths"), F.sum(F.col("host_n") * F.col("host_n")).alias("nn_hosts"),
    ).first()
    n, mean = t["n"] or 0, t["s"] / t["n"] if t["n"] else 0.5
    noise = max(t["within"], 0.0) / (n - t["paths"]) if n and n > t["paths"] else mean * (1 - mean)

    def strength(squares: float, free: int, size: float) -> float:
        """free: groups less the means that they are held against; size: what a unit of spread adds to the sum of squares."""
        spread = (squares - free * noise) / size if size > 0 else 0.0
        return float(min(10_000.0, max(10.0, noise / spread if spread > 0 else 10_000.0)))

    k_host = strength(t["of_hosts"] - n * mean * mean, t["hosts"] - 1, n - t["nn_hosts"] / n) if n else 10.0
    k_path = strength(t["of_paths"], t["paths"] - t["hosts"], n - t["nn_paths"]) if n else 10.0
    out = by_path.join(by_host, host).select(
        F.sha2(F.concat_ws("\x00", host, path), 256).alias("_site"), "n", "s", "host_n", "host_s", F.lit(k_host).alias("k_host"), F.lit(k_path).alias("k_path")
    )
    return written(out, "quality-sites"), mean


def combined(rows: DataFrame, site_table: DataFrame, mean: float, weight: float = 0.5) -> DataFrame:
    """Adds host_mean, path_mean and score to rows with p_doc and _site.

    The site's odds against the global ones are added to the document's own, damped by weight; a document's own evidence is
    first taken out of its site's, so that it is not counted twice.
    """
    of = lookup_join(rows, site_table, "_site", "p_doc", "n")
    host_mean = (F.col("k_host") * mean + F.col("host_s") - F.col("p_doc")) / (F.col("k_host") + F.col("host_n") - 1)
    out = of.withColumn("host_mean", host_mean)
    out = out.withColumn("path_mean", (F.col("k_path") * F.col("host_mean") + F.col("s") - F.col("p_doc")) / (F.col("k_path") + F.col("n") - 1))
    odds = logit(F.col("p_doc")) + weight * (logit(F.col("path_mean")) - logit(F.lit(mean)))
    return out.withColumn("score", 1 / (1 + F.exp(-odds))).drop("_site", "n", "s", "host_n", "host_s", "k_host", "k_path")


def placed(docs: DataFrame, host: str, path: tuple[str, ...]) -> DataFrame:
    """Adds _host, _path and _site; a null counts as an empty name."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    docs = docs.withColumns({"_host": name(host), "_path": F.concat_ws("/", *[name(c) for c in path])})
    return docs.withColumn("_site", F.sha2(F.concat_ws("\x00", "_host", "_path"), 256))


def quality_scores(docs: DataFrame, labels: DataFrame, host: str = "source", path: tuple[str, ...] = ("lang",), doc_id: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """A row for each document: doc_id, p_doc, host_mean, path_mean, score, keep (score at least least).

    A null text counts as empty; a null host or path as a site of its own; repeated rows each count; without labels of both
    kinds p_doc is 0.5. Extra columns are not carried.
    """
    featured = written(with_features(placed(docs.select(doc_id, text, host, *path), host, path).select(doc_id, text, "_host", "_path", "_site"), text), "quality-features")
    model = fit(featured, labels, doc_id)
    evidence = with_evidence(featured, model).select(doc_id, "_host", "_path", "_site", "p_doc")
    table, mean = sites(evidence)
    scored = combined(evidence, table, mean)
    return scored.select(doc_id, "p_doc", "host_mean", "path_mean", "score", (F.col("score") >= least).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, host: str = "source", path: tuple[str, ...] = ("lang",), least: float = 0.5) -> DataFrame:
    """The documents whose score is at least least; columns and texts stay as they are, whatever their names. Evidence is made
    anew from each text in the second pass, so that no text is shuffled where the table of sites is small enough to be broadcast."""
    featured = written(with_features(placed(docs.select("doc_id", "text", host, *path), host, path).select("doc_id", "text", "_host", "_path")), "quality-features")
    model = fit(featured, labels)
    table, mean = sites(with_evidence(featured, model).select("_host", "_path", "p_doc"))
    whole = docs.select(whole_row(docs).alias("_row"), F.col(host).alias("_in0"), *[F.col(c).alias(f"_in{i}") for i, c in enumerate(path, 1)])
    inner = placed(whole, "_in0", tuple(f"_in{i}" for i in range(1, len(path) + 1))).select("_row", "_site")
    return combined(with_evidence(inner, model, "text"), table, mean).filter(F.col("score") >= least).select("_row.*")
