"""The numbered queries: each applies its operator to the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import alignment, ann, langid, lm, media, minhash, packing, pieces, prefixes, quality, quartiles, secrets, warc
from .common import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_languages(table(spark, sf_dir, "documents"))


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return lm.score_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.align(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, tokenizer("piece_bpe_32k.model"))


def op12_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quartiles.fingerprint_edits(table(spark, sf_dir, "documents"))


def op13_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.trie(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_langid, op2_pieces, op3_media, op4_minhash, op5_nearest, op6_quality, op7_lm, op8_packing, op9_warc, op10_secrets, op11_alignment, op12_quartiles, op13_prefixes)}
ORACLE = {
    "op9_warc": """SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha256(h) AS payload_digest, CASE WHEN refers IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers AS refers_to,
CASE WHEN refers IS NULL THEN greatest(1, CAST(ceil(octet_length(encode(h)) / 65536) AS BIGINT)) ELSE 0 END AS chunks, true AS intact FROM (
SELECT page_id, h, CASE WHEN octet_length(encode(h)) >= 100 AND page_id IS DISTINCT FROM MIN(page_id) OVER (PARTITION BY h) THEN MIN(page_id) OVER (PARTITION BY h) END AS refers FROM (SELECT page_id, coalesce(html, '') AS h FROM pages))""",
}
