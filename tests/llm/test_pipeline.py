import corpus_pipeline
import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def kept(spark):
    docs, out = corpus_pipeline.table(spark, "/root/testdata/sf0.001", "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, "/root/testdata/sf0.001"), "stage")
        out.append((name, docs))
    return out


def test_stages_keep_columns_and_only_drop_rows(spark, kept):
    before = corpus_pipeline.table(spark, "/root/testdata/sf0.001", "documents")
    columns = before.columns
    for name, docs in kept[:-1]:
        assert docs.columns == columns
        assert docs.join(before, "doc_id", "left_anti").count() == 0 and docs.count() == docs.select("doc_id").distinct().count()
        if name == "secrets":
            assert docs.count() == before.count()
        else:
            assert docs.join(before, columns, "left_anti").count() == 0
        before = docs


def test_every_document_left_is_packed_whole(spark, kept):
    left, pieces = kept[-2][1], kept[-1][1]
    sums = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("tokens"))
    assert sums.filter("n != tokens").count() == 0 and sums.count() == left.count()
