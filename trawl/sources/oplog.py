"""Folding an op log into records: every op of a key counts, in order, and how the log is cut into batches changes nothing.

An op is upsert or insert (a whole record replaces its key's), delete, metadata (a JSON object whose top-level keys replace those of the stored
one) or ttl (its expires_at replaces the stored one, null clears it). Metadata and ttl ops of a key that isn't there when they come do nothing.
Records of one key are never gathered: the last whole record is picked by a rank, patches pre-aggregate to the last value of each top-level key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import COLUMNS, RECORD_DDL

KEY = ["namespace", "id"]
UPSERT, INSERT, DELETE, METADATA, TTL = "upsert", "insert", "delete", "metadata", "ttl"
WHOLE = (UPSERT, INSERT, DELETE)
OP_DDL = f"seq bigint, op string, {RECORD_DDL}, patch string"
OP_COLUMNS = ("seq", "op", *COLUMNS, "patch")


def fold_last(ops: DataFrame, by: str = "seq") -> DataFrame:
    """ops (namespace, id, ..., by) to the last one of each key."""
    order = Window.partitionBy(*KEY).orderBy(F.col(by).desc())
    return ops.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def apply_records(current: DataFrame, upserts: DataFrame) -> DataFrame:
    """current without the keys of upserts, and upserts (distinct keys)."""
    kept = current.join(upserts.select(*KEY), KEY, "left_anti")
    return kept.select(*COLUMNS).unionByName(upserts.select(*COLUMNS))


def apply_deletes(current: DataFrame, keys: DataFrame) -> DataFrame:
    return current.join(keys.select(*KEY), KEY, "left_anti")


def _as_map(text: Column) -> Column:
    return F.from_json(text, "map<string,variant>")


def merged_metadata(metadata: Column, patch: Column) -> Column:
    """A shallow merge of JSON objects: the patch's top-level keys win."""
    return F.parse_json(F.to_json(F.map_zip_with(_as_map(F.to_json(metadata)), _as_map(patch), lambda _, a, b: F.coalesce(b, a)), {"ignoreNullFields": "false"}))


def apply_patches(current: DataFrame, patches: DataFrame) -> DataFrame:
    """patches (namespace, id, patch JSON), distinct keys; vectors and expiry stay."""
    joined = current.join(patches.select(*KEY, "patch"), KEY, "left")
    return joined.withColumn("metadata", F.when(F.col("patch").isNull(), F.col("metadata")).otherwise(merged_metadata(F.col("metadata"), F.col("patch")))).select(*COLUMNS)


def merged_patches(patches: DataFrame, by: str = "at") -> DataFrame:
    """patches (namespace, id, patch, by) to one patch of each key: for each top-level key its last value."""
    fields = patches.select(*KEY, by, F.explode(_as_map(F.col("patch"))).alias("field", "value")).select(*KEY, by, "field", F.to_json("value").alias("value"))
    last = fields.groupBy(*KEY, "field").agg(F.max_by("value", by).alias("value"))
    entries = F.collect_list(F.struct("field", F.parse_json("value")))
    return last.groupBy(*KEY).agg(F.to_json(F.map_from_entries(entries), {"ignoreNullFields": "false"}).alias("patch"))


def apply_ops(current: DataFrame, ops: DataFrame, by: str = "seq", only: frozenset[str] | None = None) -> DataFrame:
    """current (distinct keys) after ops (seq, op, namespace, id, ..., patch) in order of `by`; seq is distinct within a key.

    Applying a log in batches, or a batch once more, gives the same. only: the kinds of ops that there are, where they are known.
    """
    kinds = only or frozenset((*WHOLE, METADATA, TTL))
    rows = current.select(*COLUMNS)
    whole = fold_last(ops.where(F.col("op").isin(*WHOLE)), by) if kinds & {*WHOLE} else None
    if whole is not None:
        rows = apply_records(apply_deletes(rows, whole), whole.where(F.col("op") != DELETE).select(*COLUMNS))
    if not kinds & {METADATA, TTL}:
        return rows
    later = ops.where(F.col("op").isin(METADATA, TTL))
    if whole is not None:
        later = later.join(whole.select(*KEY, F.col(by).alias("__since")), KEY, "left").where(F.col("__since").isNull() | (F.col(by) > F.col("__since")))
    if METADATA in kinds:
        rows = apply_patches(rows, merged_patches(later.where(F.col("op") == METADATA), by))
    if TTL in kinds:
        until = later.where(F.col("op") == TTL).groupBy(*KEY).agg(F.max_by(F.struct("expires_at"), by).alias("__ttl"))
        rows = rows.join(until, KEY, "left").withColumn("expires_at", F.when(F.col("__ttl").isNull(), F.col("expires_at")).otherwise(F.col("__ttl.expires_at"))).select(*COLUMNS)
    return rows
