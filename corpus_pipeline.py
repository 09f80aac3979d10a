"""A corpus pipeline of five stages over ``documents``; each stage's output is written and read again.

Toxic documents go; lines found on many sites are cut; of each group of near copies the one with the
smallest id stays; documents that hold a benchmark item go; the rest is segmented into pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quitanda.llm import line_spread, merge_dropout, ngram_join, pigeonhole, toxicity
from quitanda.llm.common import table
from quitanda.llm.queries import dropout_model
from quitanda.session import scratch_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_spread.drop_boilerplate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pigeonhole.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def segment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return merge_dropout.checked(docs, dropout_model())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("sentencepiece", segment),
]

ORACLE_SQL = None  # toxicity is a trained model; SQL cannot express it


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
