"""A training corpus from raw documents: quality, language, exact and near duplicates, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next stage's docs, so that a stage starts from a plain table whatever ran before it.  All but the last
return the columns of docs, whatever their names; an empty table stays empty in every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depweave.llm import exact_dedup, langid, minhash_dedup, packing, quality
from depweave.llm.common import Scratch, crc32_mod
from depweave.sources.scratch import owned_folders


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Null and empty texts are judged by the statistics of an empty text; rows with a null doc_id are judged but not
    learnt from; repeated rows go or stay together.  Without a labelled row all stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_quality(docs, labels, crc32_mod(F.col("doc_id"), 3) == 1)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear.

    Null, empty and letterless texts go, and so do texts whose two best languages are equally good.  Where docs
    have no language to learn from, all go.  Rows with a null doc_id are judged but not learnt from.
    """
    return langid.keep_identified(docs, crc32_mod(F.col("doc_id"), 5) == 0)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the smallest doc_id, one row where that is repeated.

    Null counts as empty.  A row with a null doc_id stays only where its whole group has none.
    """
    return exact_dedup.keep_first(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: the smallest doc_id.

    Null and empty texts are components of their own and stay.  Rows with a null doc_id link like any other and
    stay only in components without a named row.
    """
    return minhash_dedup.keep_representatives(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the remaining documents, placed in sequences; null and empty texts are one end id."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each intermediate table goes once the next one is written."""
    scratch = Scratch(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with owned_folders(spark):  # what the stage's operators write for themselves
            docs = scratch.write(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs


#: The classifier, the compressor and the packing program are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
