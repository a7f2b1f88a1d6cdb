import numpy as np
from pyspark.sql import functions as F
from seriesloom.llm import quality

SCHEMA = "doc_id long, text string, source string, lang string, score string"


def rows():
    rng = np.random.default_rng(0)
    out = []
    for i in range(300):
        words = [str(w) for w in rng.choice(["the", "of", "and", "reading", "house", "quiet", "river", "stone"], 60)]
        good = i % 5 > 0
        out.append((i, " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words), "bad" if i % 10 in (0, 1) else "fine", "en", "clash"))
    return out + [(900, None, None, None, None), (901, "", "new", None, None), (902, "x " * 20_000, "new", "en", None)]


def labels(spark):
    return spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(150)] + [(0, 0), (None, 1), (5, None)], "doc_id long, quality int")


def test_held_out_accuracy_and_site_means(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    got = {r.doc_id: r for r in quality.quality_scores(docs, labels(spark)).collect()}
    assert len(got) == 303
    assert np.mean([got[i].keep == (i % 5 > 0) for i in range(150, 300)]) > 0.98
    assert got[150].host_mean < got[152].host_mean
    assert all(0 <= r.score <= 1 for r in got.values())


def test_shrinkage_equals_brute_force(spark):
    evidence = [("a", "p", 0.9)] * 6 + [("a", "q", 0.2)] * 3 + [("b", "p", 0.6)]
    table, mean = quality.sites(spark.createDataFrame(evidence, "_host string, _path string, p_doc double"))
    assert abs(mean - np.mean([p for *_, p in evidence])) < 1e-12
    r = table.filter((F.col("n") == 3)).first()
    scored = quality.combined(spark.createDataFrame([("a", "q", 0.2)], "_host string, _path string, p_doc double").withColumn("_site", F.lit(r["_site"])), table, mean).first()
    host = (r.k_host * mean + 6 * 0.9 + 3 * 0.2 - 0.2) / (r.k_host + 9 - 1)
    assert abs(scored.host_mean - host) < 1e-9
    assert abs(scored.path_mean - (r.k_path * host + 0.4) / (r.k_path + 2)) < 1e-9


def test_filter_keeps_columns_and_clean_rows(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    out = quality.keep_good(docs, labels(spark))
    assert out.columns == docs.columns
    ids = {r.doc_id for r in out.collect()}
    assert len(ids & {i for i in range(300) if i % 5}) > 235 and len(ids & {i for i in range(0, 300, 5)}) < 3


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame(rows()[:3] * 2, SCHEMA)
    none = labels(spark).filter("false")
    assert [r.p_doc for r in quality.quality_scores(docs, none).collect()] == [0.5] * 6
    assert quality.quality_scores(docs.filter("false"), none).count() == 0


def test_clashing_columns_keep_their_values(spark):
    names = ["n", "s", "host_n", "p_doc", "_site", "_row", "x", "k_path"]
    docs = spark.createDataFrame(rows(), SCHEMA).withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in names})
    before = {r.doc_id: r.asDict() for r in docs.collect()}
    out = [r.asDict() for r in quality.keep_good(docs, labels(spark)).collect()]
    assert len(out) > 200 and all(r == before[r["doc_id"]] for r in out)


def test_strengths_equal_brute_force(spark):
    """Analysis of variance by hand: paths around their hosts' means, hosts around the global one."""
    rng = np.random.default_rng(4)
    evidence = [(f"h{h}", f"p{p}", float(np.clip(0.2 * h + 0.1 * p + rng.normal(0, 0.1), 0, 1))) for h in range(4) for p in range(3) for _ in range(5 + 7 * p + h)]
    table, mean = quality.sites(spark.createDataFrame(evidence, "_host string, _path string, p_doc double"))
    r = table.first()
    values = np.array([p for *_, p in evidence])
    host, path = np.array([h for h, *_ in evidence]), np.array([h + p for h, p, _ in evidence])
    mean_of = lambda g: np.array([values[g == k].mean() for k in g])
    size_of = lambda g: np.array([(g == k).sum() for k in g])
    noise = ((values - mean_of(path)) ** 2).sum() / (len(values) - 12)
    of_paths = (((mean_of(path) - mean_of(host)) ** 2).sum() - 8 * noise) / (len(values) - (size_of(path) / size_of(host)).sum())
    of_hosts = (((mean_of(host) - mean) ** 2).sum() - 3 * noise) / (len(values) - size_of(host).sum() / len(values))
    assert abs(r.k_path - np.clip(noise / of_paths, 10, 10_000)) < 1e-6 and abs(r.k_host - np.clip(noise / of_hosts, 10, 10_000)) < 1e-6


def test_many_sites_are_joined_by_shuffle(spark, monkeypatch):
    from seriesloom.llm import common

    docs = spark.createDataFrame(rows(), SCHEMA)
    small = sorted(map(str, quality.quality_scores(docs, labels(spark)).collect()))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 1)
    assert [x.split("p_doc")[0] for x in sorted(map(str, quality.quality_scores(docs, labels(spark)).collect()))] == [x.split("p_doc")[0] for x in small]


def test_columns_of_any_name_stay(spark):
    from odd_columns import as_rows, with_odd_columns

    docs = with_odd_columns(spark.createDataFrame(rows(), SCHEMA))
    out = quality.keep_good(docs, labels(spark))
    assert out.columns == docs.columns
    kept = as_rows(out)
    assert len(kept) > 200 and set(kept) <= set(as_rows(docs))
