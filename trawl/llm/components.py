"""Distributed union-find: partitions contract their own edges, step by step in fewer ones, alternating large-star and small-star rounds join what lies in several.

No step gathers a node's neighbours; a hot node's rows pre-aggregate to a minimum before the shuffle,
and the join back on a hot node is an ordinary equi-join, which adaptive execution can split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """edges (u, v): large: join larger neighbours to the least of a closed neighbourhood; small: the smaller ones and the node."""
    if small:
        own = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = own.groupBy("u").agg(F.min("v").alias("m"))
        moved = own.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        kept = least.select("u", F.col("m").alias("v"))
        return moved.unionByName(kept).distinct()
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's edges to stars around the least nodes of its own components: hooking larger roots under smaller ones and halving paths, in arrays."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return
    u, v = (np.concatenate(x) for x in zip(*parts, strict=True))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v, up = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        a, b = up[u], up[v]
        apart = a != b
        if not apart.any():
            break
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(nxt := up[up], up):
            up = nxt
    moved = np.flatnonzero(up != np.arange(len(nodes)))
    for i in range(0, len(moved), 1 << 16):
        rows = moved[i : i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(nodes[rows]), pa.array(nodes[up[rows]])], names=["u", "v"])


def connected_components(edges: DataFrame, most_rounds: int = 60, most_edges: int = 1_000_000) -> DataFrame:
    """edges (a long, b long) to one row (node, component) per node that has an edge; component: the least node.

    Each partition, of about most_edges edges, first contracts its own to stars, and the stars are gathered into fewer partitions and contracted again as long as their number falls by a quarter;
    alternating rounds then join the stars of different partitions, if there are several, until a round changes no edge. Null ends and loops count for nothing; repeated edges count once.
    """
    pairs = edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    raw = checkpointed(pairs)
    parts = max(1, -(-raw.count() // most_edges))
    now = checkpointed(raw.coalesce(parts).mapInArrow(_contract, "u long, v long"))
    while parts > 1 and 4 * (fewer := max(1, -(-now.count() // most_edges))) <= 3 * parts:  # stars have fewer edges than what they came from, and fit into fewer partitions
        now, parts = checkpointed(now.coalesce(fewer).mapInArrow(_contract, "u long, v long")), fewer
    sign = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = sign(now) if parts > 1 else None
    for _ in range(most_rounds if parts > 1 else 0):
        now = checkpointed(_star(_star(now, False), True))
        if (after := sign(now)) == before:
            break
        before = after
    else:
        if parts > 1:
            raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
