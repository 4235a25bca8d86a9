"""From raw documents to packed training sequences.

Stages, each a function of (spark, docs, sf_dir) whose result is written as Parquet and read
again as the next one's documents:

1. toxicity: documents that the classifier rejects go.
2. near_dedup: one document of each group of near copies stays.
3. decontamination: documents that hold too much of a benchmark go.
4. secrets: what looks like a secret is replaced by a mark; all documents stay.
5. packing: the documents' token ids, cut and dealt into sequences.

All stages but the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seclog.llm.contamination import decontaminate
from seclog.llm.neardup import deduplicated
from seclog.llm.packing import pack
from seclog.llm.secrets import redact
from seclog.llm.store import Scratch
from seclog.llm.toxicity import reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicated(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]

#: SQL can express neither the classifier nor the signatures: tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that all stages keep."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
