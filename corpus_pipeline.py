"""A corpus pipeline: each stage takes what the one before it kept."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import decontaminate, line_dedup, mixing, ngram_join, toxicity
from tidewater.llm.common import shared_dir


def _keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; the model learns from all labelled documents of the input. Null and empty
    texts have no hits and stay; rows that repeat an id are judged by their own texts; without labels every document stays.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels)
    return docs.where(toxicity.score(F.col("text"), model) < 0.3)


def _drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line go, and documents of which nothing is left. Null, empty and wordless texts stay as they are."""
    return line_dedup.clean(docs)


def _one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays (5-word shingles, similarity 0.8). Texts without
    words link with nothing and stay.
    """
    return ngram_join.one_of_each(docs)


def _drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. An empty benchmark, or one of texts without words, matches nothing."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their places in the mixture: copies of each at the target weights (0: left out), in the order of mix_turn."""
    return mixing.mixture_of(docs)


STAGES = [
    ("toxicity", _keep_civil),
    ("line_dedup", _drop_repeated_lines),
    ("ngram_join", _one_of_each_group),
    ("decontaminate", _drop_contaminated),
    ("mixing", _mix),
]

#: The stages fit models and follow links, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = os.path.join(shared_dir(spark), f"pipeline-{uuid.uuid4().hex}")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
