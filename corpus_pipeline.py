"""The corpus pipeline: stages in order, each written and read again before the next.

Every stage takes (spark, docs, sf_dir), works on all documents its predecessor kept, and returns documents; the last
adds their shard. No SQL can express the language and SimHash stages, so there is no twin: tests compare the stages with plain forms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hazeflow.llm import decontamination, language, mixing, sharding, simhash
from hazeflow.session import materialize

N_SHARDS = 16


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised: those without a letter, and those no language has the larger half of, go."""
    return language.recognised(docs, language.fit(docs, ~language.held_out()))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the one with the smallest id."""
    return simhash.one_per_component(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    return decontamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in ratio 1, 2, 3; a document taken several times comes as several rows."""
    return mixing.mixed_documents(docs, mixing.label_quality(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents and their shard, shards of near equal size; repeats of a document share theirs."""
    return sharding.shard_documents(docs, N_SHARDS)


STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
