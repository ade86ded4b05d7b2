"""Thin queries over the operators, one for each, with production parameters and whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, exact_dedup, langid, line_dedup, lm_score, media, minhash_dedup, packing, quality, sentencepiece_bpe, toxicity, url_filter, vector_codes
from .common import crc32_mod
from .oracles import ORACLES  # noqa: F401


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_documents(_table(spark, sf_dir, "documents"), path)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc32_mod(F.col("doc_id"), 3) == 1
    return quality.classify_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), held_out)


#: Host and path of each rule, and whether it allows.
URL_RULES = (
    ("org", "/", True),
    ("example.org", "/es/", False),
    ("example.org", "/en/1", False),
    ("com", "/fr/", True),
    ("com", "/de/", False),
)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), [url_filter.Rule(*r) for r in URL_RULES])


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(_table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(_table(spark, sf_dir, "documents"), crc32_mod(F.col("doc_id"), 5) == 0)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepiece_bpe.encode_decode(_table(spark, sf_dir, "documents"), path)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicate_lines(_table(spark, sf_dir, "documents"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(_table(spark, sf_dir, "documents"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.audio_features(_table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_table(spark, sf_dir, "embeddings"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc32_mod(F.col("doc_id"), 4) == 2
    return toxicity.classify_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), held_out)


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_phrases(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_minhash_dedup, op2_packing, op3_quality, op4_url_filter, op5_exact_dedup, op6_language, op7_sentencepiece, op8_line_dedup, op9_lm_score, op10_media, op11_vector_codes, op12_toxicity, op13_phrases)}
