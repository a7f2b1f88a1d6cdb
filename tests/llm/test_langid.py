import zlib

import numpy as np
from pyspark.sql import functions as F
from seriesloom.llm import langid

VOWELS = {"aa": "the of and ing tion ", "bb": "der und ein sch keit ", "cc": "él niño año señor "}
SCHEMA = "doc_id long, text string, lang string, score string"


def frame(spark):
    rows = [(i, VOWELS[k] * (1 + i % 40), k, "clash") for i, k in enumerate(list(VOWELS) * 60)]
    rows += [(500, None, "aa", None), (501, "", "aa", None), (502, "123 !?", "aa", None), (503, VOWELS["bb"] * 400, None, None), (None, VOWELS["cc"] * 9, "cc", None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_gradients_equal_differences():
    net = langid.fresh(["a", "b", "c"], hidden=3)
    rng = np.random.default_rng(0)
    ids, y = rng.integers(0, 256, (7, 4)), rng.integers(0, 3, 4)
    _, grads = langid.gradients(net, ids, y)
    for w, g in zip(net.weights(), grads, strict=True):
        i = np.abs(g).argmax()
        old = w.flat[i]
        w.flat[i] = old + 1e-2
        above, _ = langid.gradients(net, ids, y)
        w.flat[i] = old - 1e-2
        below, _ = langid.gradients(net, ids, y)
        w.flat[i] = old
        assert abs((above - below) / 2e-2 - g.flat[i]) < 1e-3


def test_every_row_is_labelled_and_held_out_rows_are_right(spark):
    rows = langid.predict_languages(frame(spark)).collect()
    assert len(rows) == 185
    by_id = {r.doc_id: r for r in rows}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 3 == 1) and 0 <= r.score <= 1
    assert [by_id[i].lang_pred for i in (500, 501, 502, 503, None)] == ["und", "und", "und", "bb", "cc"]
    want = [list(VOWELS)[i % 3] for i in range(180)]
    assert np.mean([by_id[i].lang_pred == want[i] for i in range(180)]) > 0.97


def test_held_out_labels_are_not_read(spark):
    docs = frame(spark)
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1
    other = docs.withColumn("lang", F.when(held, F.lit("zz")).otherwise(F.col("lang")))
    assert sorted(map(str, langid.predict_languages(docs).collect())) == sorted(map(str, langid.predict_languages(other).collect()))


def test_filter_keeps_columns(spark):
    docs = frame(spark)
    out = langid.keep_identified(docs)
    assert out.columns == docs.columns and out.count() == 182


def test_no_rows(spark):
    assert langid.predict_languages(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = langid.predict_languages(spark.createDataFrame([(1, "abc", None, None)] * 2, SCHEMA)).collect()
    assert [(r.lang_pred, r.score) for r in rows] == [("und", 0.0)] * 2


def test_clashing_columns_keep_their_values(spark):
    docs = frame(spark).withColumns({"lang_pred": F.concat(F.lit("p"), F.col("doc_id").cast("string")), "SCORE_": F.lit(3)})
    before = {(r.doc_id, r.text): r.asDict() for r in docs.collect()}
    out = [r.asDict() for r in langid.keep_identified(docs).collect()]
    assert len(out) == 182 and all(r == before[r["doc_id"], r["text"]] for r in out)


def test_pooling_equals_one_text_at_a_time():
    """Each position's probabilities, window by window of one text, against all texts at once."""
    net, rng = langid.fresh(["a", "b", "c"]), np.random.default_rng(1)
    texts = [bytes(rng.integers(32, 250, n, np.uint8)) for n in (1, 5, 127, 128, 129, 700, 0, 300)]
    got = langid.pooled(net, texts, windows=3)
    for row, raw in zip(got, texts, strict=True):
        total = np.zeros(3)
        for at in range(0, len(raw), langid.WINDOW):
            padded = b" " * langid.WARM + raw + b" " * (langid.WINDOW + langid.WARM)
            ids = np.frombuffer(padded[at : at + langid.WINDOW + 2 * langid.WARM], np.uint8).astype(np.intp)[:, None]
            total += langid.position_probabilities(net, ids)[: min(langid.WINDOW, len(raw) - at), 0].sum(0)
        assert np.allclose(row, total / max(1, len(raw)), atol=1e-5)


def test_columns_of_any_name_stay(spark):
    from odd_columns import as_rows, with_odd_columns

    docs = with_odd_columns(frame(spark))
    out = langid.keep_identified(docs)
    assert out.columns == docs.columns
    ids = {(r.doc_id, r.text) for r in out.collect()}
    assert len(ids) == 182 and as_rows(out) == [x for x in as_rows(docs.filter(F.col("text").isNotNull())) if any(f"'doc_id': {i}," in x for i, _ in ids)]
