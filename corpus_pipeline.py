"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

Every stage takes nulls in any column, empty and very long texts, repeated rows and an empty table: rows are judged by
their own texts, null texts as empty ones, and the near-duplicate stage keeps of rows alike in all but other columns the
one with the least hash. All but the last return the columns of documents. No texts tie: scores are cut at a threshold.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sheetweave.llm import bpe, decontamination, quality, simhash, toxicity
from sheetweave.llm.common import drop, folder, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't found toxic."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates: texts whose sets of five-word shingles have a similarity of 0.8 or more."""
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each kept document, with the digests of the round trip."""
    return bpe.round_trip_digests(docs)


STAGES = [("quality", quality_stage), ("toxicity", toxicity_stage), ("near_dedup", near_dedup_stage), ("decontamination", decontamination_stage), ("byte_bpe", encoding_stage)]
#: Fitted classifiers, hashing and tokenisation have no SQL; the tests hold run() against plain versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents; what a stage wrote is deleted once the next one has read it."""
    docs, at = table(spark, sf_dir, "documents"), f"{folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{at}/{k}-{name}")
        docs = spark.read.parquet(f"{at}/{k}-{name}")
        if k:
            drop(spark, f"{at}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
