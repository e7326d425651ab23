"""The corpus pipeline: each stage works on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelworks.llm import decontaminate, exact, jaccard, language, mixing
from panelworks.llm.staging import documents, stored


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose best two languages are nearly level, go."""
    return language.keep_identified(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space one stays."""
    return exact.drop_exact_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (shingles of five words, similarity 0.8) the smallest id stays."""
    return jaccard.keep_one_of_each(docs, length=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, and how often each is repeated in a last column ``times`` (with an underscore more
    if there is one of that name). Documents without words stay out."""
    times = mixing.free_name("times", docs.columns)
    return mixing.repeat_rows(docs, out=times).where(F.col(f"`{times}`") > 0)


STAGES = [
    ("language", language_stage),
    ("exact_copies", exact_stage),
    ("near_copies", near_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]
#: Compression, hashing and set similarity have no SQL; tests hold the stages against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again as the next one's input."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
