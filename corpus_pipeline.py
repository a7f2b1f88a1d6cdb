"""The corpus pipeline: language, quality, near-duplicates, secrets, packing; each stage works on what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm import langid, minhash, packing, quality, secrets
from seriesloom.llm.common import table, written
from seriesloom.llm.queries import tokenizer


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, or in which no language is probable. Nulls in other columns stay."""
    return langid.keep_identified(docs)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose quality score, with the evidence of host and path, is under a half."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    return minhash.keep_one(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks owner-specific credentials in the text; n_chars follows. All documents stay."""
    return secrets.masked(docs).withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left: one row for each piece of a sequence."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("language ID", language), ("quality", good), ("near-duplicates", unique), ("secrets", without_secrets), ("packing", packed)]
#: No SQL expresses the trained models, the signatures or the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
