"""Corpus preparation as five stages over documents; each is (spark, docs, sf_dir) -> DataFrame, written and read in between.

quality: what the classifier rejects goes. near_dedup: one document of each near-duplicate group stays (five-word shingles,
similarity 0.8 or more). decontaminate: documents that leak a benchmark item go. secrets: found secrets are masked. mix: the
documents that the mix to target weights takes, one row per copy, with their output shard (columns shard and copy).

Every stage works on rows: null texts are empty (the classifier decides on them), rows with a null id are judged like any other
but are nobody's duplicate, rows that repeat an id go or stay together in near_dedup and are judged one by one elsewhere,
extra columns pass through, an empty table stays empty. Texts are whole, whatever their length; ties go to the smallest id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.decontaminate import decontaminated
from quillspark.llm.minhash import one_of_each
from quillspark.llm.mixing import mixed_corpus
from quillspark.llm.quality import quality_filter
from quillspark.llm.secrets import redacted
from quillspark.llm.shared import stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_corpus(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secrets", secret_scan), ("mix", mix)]
#: Trained scores and seeded draws: not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        docs = stage(docs, name) if k + 1 < len(STAGES) else docs
    return docs
