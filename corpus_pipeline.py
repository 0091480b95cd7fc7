"""The corpus pipeline: language ID, near-dedup, repeated passages, benchmark leaks, source mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hostlens.llm import decontam, langid, mixing, simhash, suffix_runs
from hostlens.llm.common import written


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those that are und go."""
    return langid.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, a similarity of about 0.8 or more): the one with the smallest doc_id."""
    return simhash.kept_documents(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the bytes of 200-byte strings that start more than once."""
    return suffix_runs.without_repeats(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: documents, repeated or cut as their source's target wants, with shard and order."""
    return mixing.mixed(docs)


STAGES = [
    ("language_id", identify),
    ("simhash_near_dedup", near_dedup),
    ("suffix_array_dedup", drop_repeats),
    ("benchmark_decontamination", decontaminate),
    ("source_mix", mix),
]

#: SQL has no trained classifier, SimHash or tree of draws; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
