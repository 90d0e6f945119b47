"""Import and export of records as JSON lines, CSV and Parquet."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import COLUMNS, RecordError, with_defaults

JSON_DDL = "namespace string, id string, vector array<float>, vectors map<string,array<float>>, sparse map<string,float>, metadata variant, multi_vectors map<string,array<array<float>>>, expires_at double, ttl double"


def read_jsonl(spark: SparkSession, path: str, namespace: str = "", now: float = 0.0) -> DataFrame:
    """One record object a line; blank lines are skipped. ttl counts from now."""
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", JSON_DDL).alias("r")).select("r.*")
    rows = rows.withColumn("expires_at", F.coalesce("expires_at", F.lit(float(now)) + F.col("ttl"))).drop("ttl")
    return with_defaults(rows.withColumn("metadata", F.coalesce("metadata", F.parse_json(F.lit("{}")))), namespace)


def from_arrays(spark: SparkSession, ids: list[str], vectors: np.ndarray, metadata: list[dict] | None = None, namespace: str = "") -> DataFrame:
    """Records from a matrix with a row for each id, by way of Arrow."""
    if vectors.ndim != 2 or len(ids) != len(vectors) or metadata is not None and len(metadata) != len(ids):
        raise RecordError("ids, rows of the matrix and metadata differ in number")
    flat = pa.array(np.ascontiguousarray(vectors, dtype=np.float32).ravel())
    offsets = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * vectors.shape[1])
    rows = pa.table({"id": pa.array([str(i) for i in ids]), "vector": pa.ListArray.from_arrays(offsets, flat), "metadata": pa.array([json.dumps(m) for m in metadata or [{}] * len(ids)])})
    return with_defaults(spark.createDataFrame(rows), namespace)


def write_jsonl(records: DataFrame, path: str) -> None:
    records.select(F.to_json(F.struct(*COLUMNS)).alias("value")).write.text(path)


def typed(column: str):
    """A CSV field as a JSON value: an integer, else a float, else a string; empty is null."""
    c = F.trim(F.col(column))
    integer = F.when(c.rlike(r"^[+-]?[0-9]+$"), c.try_cast("bigint"))
    real = F.when(c.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), c.try_cast("double"))
    return F.coalesce(integer.cast("string"), real.cast("string"), F.to_json(F.struct(F.col(column).alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col(column).alias("x")))) - 6))


def csv_records(rows: DataFrame, id_column: str = "id", vector_column: str = "vector", namespace: str = "", metadata: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of rows with text columns: rejects are rows whose vector isn't a JSON array of numbers. Other columns become metadata.

    Rows without an id column, or with a null id, get row_<hash> names.
    """
    names = metadata if metadata is not None else [c for c in rows.columns if c not in (id_column, vector_column)]
    vector = F.from_json(F.col(vector_column), "array<float>")
    made = F.concat(F.lit("row_"), F.hex(F.xxhash64(*rows.columns)))
    own = F.coalesce(F.col(id_column).cast("string"), made) if id_column in rows.columns else made
    pairs = [F.when(F.col(n).isNotNull(), F.concat(F.to_json(F.array(F.lit(n))).substr(F.lit(2), F.length(F.to_json(F.array(F.lit(n)))) - 2), F.lit(":"), typed(n))) for n in names]
    text = F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}")) if pairs else F.lit("{}")
    marked = rows.withColumns({"__v": vector, "__id": own, "__m": text})
    bad = F.col("__v").isNull() | F.exists("__v", lambda x: x.isNull())
    good = marked.where(~bad).select(F.col("__id").alias("id"), F.col("__v").alias("vector"), F.col("__m").alias("metadata"))
    return with_defaults(good, namespace), marked.where(bad).select(*rows.columns)


def read_csv(spark: SparkSession, path: str, id_column: str = "id", vector_column: str = "vector", namespace: str = "") -> tuple[DataFrame, DataFrame]:
    return csv_records(spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path), id_column, vector_column, namespace)
