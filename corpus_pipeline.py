"""A training corpus from `documents`: five stages, each written as Parquet and read again as the next one's documents.

Toxic and low-quality documents go, one document of each group of near copies stays, secrets are cut out of the texts,
and what is left is packed into sequences. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import packing, quality, secrets, simhash, toxicity
from attesta.llm._common import materialize, restored, table
from attesta.llm.queries import tokenizer_path
from attesta.sources.scratch import last_table, release, temporaries


def kept(docs: DataFrame, scores: DataFrame, good: int) -> DataFrame:
    """The rows of docs whose own prediction in scores (made with carry) is `good`, whatever their doc_id."""
    return restored(scores.where(F.col("predicted") == good), docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kept(docs, toxicity.toxicity_scores(docs, table(spark, sf_dir, "labels"), carry=True), 0)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kept(docs, quality.quality_scores(docs, table(spark, sf_dir, "labels"), carry=True), 1)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_secrets(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity_stage), ("quality", quality_stage), ("near_dedup", dedup_stage), ("secrets", secrets_stage), ("packing", packing_stage)]

#: Trained models and fingerprints are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's table is deleted when the next one is written; the last stays for the caller."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with temporaries(spark):
            docs = materialize(stage(spark, docs, sf_dir), f"stage_{name}")
        release(spark, before)
        before = [last_table(spark)]
    return docs
