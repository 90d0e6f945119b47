"""The stages of the corpus pipeline, each a thin call of an operator.

Each stage works on all that the one before it kept, and is written as Parquet in the shared scratch folder and read again. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Bitmap, checkpointed, numbered, scratch, wide_buckets_for
from .decontaminate import decontaminate
from .line_dedup import dedup_lines
from .mixing import mixed_documents
from .ngram_join import ngram_jaccard_components
from .quality import score_documents


def _without(rows: DataFrame, gone: DataFrame, names: list[str]) -> DataFrame:
    """The columns `names` of numbered rows but for those whose number is in gone (row). Only rows that may be among them are shuffled."""
    gone = checkpointed(gone.select(F.col("row").alias("__gone")).distinct())
    marked = rows.withColumn("__maybe", Bitmap(gone, "__gone").has(F.xxhash64("__row")))
    left = marked.where("__maybe").join(gone, F.col("__row") == F.col("__gone"), "left_anti")
    return marked.where("not __maybe").select(*names).unionByName(left.select(*names))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score below 0.7) go, each row by its own text, whatever its doc_id."""
    labels, rows = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"), numbered(docs)
    scored = score_documents(rows, labels, row="__row")
    return _without(rows, scored.where("predicted = 0").select("row"), docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of similar lines that of the first row stays; documents of which no line is left go."""
    return dedup_lines(docs, shorter=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the least doc_id (nulls last), and of several rows with that id the first."""
    rows = numbered(docs)
    groups = ngram_jaccard_components(rows.select(F.col("__row").alias("doc_id"), "text"), buckets=wide_buckets_for(docs.select("doc_id", "text"))).where("n_shingles > 0").select(F.col("doc_id").alias("row"), "component_id")
    many = checkpointed(groups.join(groups.where("row != component_id").select("component_id").distinct(), "component_id", "left_semi"))
    named = rows.select(F.col("__row").alias("row"), F.col("doc_id").cast("long").alias("id")).join(many, "row")
    stay = named.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("s")).select(F.col("s.row").alias("row"))
    return _without(rows, many.join(stay, "row", "left_anti").select("row"), docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go: those with a hit and hits on a twentieth of their words or more."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as it is taken, numbered by copy_no."""
    return mixed_documents(docs)


STAGES = [("quality", quality), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("decontamination", benchmark), ("mixing", mixture)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
