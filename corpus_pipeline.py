"""The corpus pipeline: quality rules, exact dedup, near dedup, mixing to target weights, sampled segmentations.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet below the
shared checkpoint folder and rereads it as the next stage's documents, so a stage works on all that its predecessor kept
and no stage is computed twice.  All but the last return the columns of documents.

Defined cases (per stage, see the operators): null and empty texts have no words and go in stage 1; an empty table passes
through every stage; extra columns are kept up to the last stage; documents mixed in twice appear twice after stage 4 and draw
samples of their own in stage 5.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pricewire.llm import bloom_dedup, ngram_join, piece_sampling, pivotal_mix, quality_rules
from pricewire.llm.common import shared_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that the base rules or the learned decision list reject go."""
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of equal texts the row with the largest doc_id stays."""
    return bloom_dedup.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: five-word shingles, similarity 0.8 or more; one document of each group stays."""
    return ngram_join.keep_one(docs, k=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: each document as often as the mix takes it."""
    return pivotal_mix.mixed(docs)


def segment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: the distinct sampled segmentations of each document and copy, with their ids (packed, see ``unpacked``)."""
    return piece_sampling.sample_copies(docs)


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix", mix),
          ("segment", segment)]

# Stages 1, 4 and 5 (a learned list, hashed random draws) have no SQL form; tests compare run() to plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
