"""Corpus pipeline: quality classifier, line dedup, n-gram Jaccard join, benchmark decontamination, mixing to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trawl.llm import pipeline_stages as stages

STAGES = stages.STAGES
#: The classifier and the fuzzy line groups have no SQL form; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of all stages, each written as Parquet and read again, applied to documents."""
    return stages.run(spark, sf_dir)
