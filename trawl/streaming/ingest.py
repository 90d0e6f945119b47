"""Structured Streaming ingest of an op log into a collection, and its batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.oplog import OP_DDL, apply_ops
from ..sources.store import Collection

__all__ = ["OP_DDL", "apply_ops", "start_ingest"]


def start_ingest(collection: Collection, ops: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
    """A streaming ops DataFrame, each micro-batch one segment of the collection's log. A retried batch, told by its number and the checkpoint's path, is left out."""

    def commit(batch: DataFrame, number: int) -> None:
        collection._load()
        collection.apply(batch, (checkpoint, number))

    writer = ops.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
