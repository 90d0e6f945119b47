"""Approximate search by an inverted file: k-means cells, the nearest cells of a query, exact rescoring, an exact fallback."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import metric_name
from .dense import against, dense_scores, matrix, payload_scores, ranked
from .quantize import distances, kmeans, nearest

#: Cells over the square root of the rows, and the share of cells that is probed; measured by the query ann_ivf_recall.
PRESETS = {"default": (1.0, 0.65), "high_recall": (1.0, 0.8), "fast": (1.0, 0.55)}
SAMPLE, MOST_CELLS = 65_536, 65_536


@dataclass
class InvertedFile:
    """centroids, and every row's cell: rows (cell, namespace, id, vector)."""

    centroids: np.ndarray
    rows: DataFrame
    probes: int
    fallbacks: int = 0

    @classmethod
    def build(cls, records: DataFrame, cells: int | None = None, preset: str = "default", sample: int = SAMPLE) -> InvertedFile:
        """Cells are fitted on at most `sample` rows, those with the least hashes; every row is indexed. Null vectors aren't."""
        records = records.where("vector is not null")
        n = records.count()
        density, share = PRESETS[preset]
        cells = cells or max(1, min(MOST_CELLS, int(density * np.sqrt(n))))
        chosen = records.select("vector", F.xxhash64("namespace", "id").alias("h")).orderBy("h").limit(sample).toArrow().column("vector").to_pylist()
        x = np.array(chosen, dtype=np.float64) if chosen else np.zeros((1, 1))
        centroids = kmeans(_unit(x), min(cells, len(x)), 15)

        @F.pandas_udf("int")
        def cell(vectors: pd.Series) -> pd.Series:
            return pd.Series(nearest(_unit(np.array(vectors.tolist(), dtype=np.float64)), centroids).astype(np.int32))

        rows = records.select(cell("vector").alias("cell"), "namespace", "id", "vector")
        return cls(centroids, rows, max(1, round(share * len(centroids))))

    def search(self, queries: DataFrame, k: int = 10, metric: str = "cosine", allowed: DataFrame | None = None) -> DataFrame:
        """(qid, rank, namespace, id, score); queries with fewer than k rows in their cells are searched exactly.

        The blocked kernel scores the rows of a query's cells, so pairs of queries and rows aren't moved between tasks before the top-k.
        """
        centroids, probes, metric = self.centroids, self.probes, metric_name(metric)
        rows = self.rows if allowed is None else self.rows.join(allowed.select("namespace", "id"), ["namespace", "id"], "left_semi")
        asked = queries.select(F.col("qid").cast("string").alias("qid"), "vector").where("vector is not null")
        held = np.zeros(len(centroids), dtype=np.int64)
        for r in rows.groupBy("cell").count().collect():
            held[r["cell"]] = r["count"]

        @F.pandas_udf("bigint")
        def reached(vectors: pd.Series) -> pd.Series:
            return pd.Series(np.concatenate([held[at].sum(axis=1) for at in _probed(np.array(vectors.tolist(), dtype=np.float64), centroids, probes)]))

        def scorer(vectors: pa.Array):
            q = matrix(vectors).astype(np.float64)
            each = against(metric, q)
            inside = np.zeros((len(centroids), len(q)), dtype=bool)
            at = np.concatenate(list(_probed(q, centroids, probes)))
            inside[at, np.arange(len(q))[:, None]] = True

            def score(column: pa.StructArray) -> np.ndarray:
                cell, vector = column.flatten()
                return np.where(inside[cell.to_numpy(zero_copy_only=False)], each(matrix(vector)), -np.inf)

            return score

        width = 8 * centroids.shape[1] + len(centroids)
        near = payload_scores(rows.select("namespace", "id", F.struct("cell", "vector").alias("payload")), asked.select("qid", F.col("vector").alias("payload")), width, scorer, k)
        found = ranked(near, "score", k).select("qid", "rank", "namespace", "id", "score")
        rest = asked.where(reached("vector") < k)
        self.fallbacks = rest.count()
        if not self.fallbacks:
            return found
        exact = ranked(dense_scores(rows, rest, metric, None, k).withColumnRenamed("dense", "score"), "score", k).select("qid", "rank", "namespace", "id", "score")
        return found.join(rest.select("qid"), "qid", "left_anti").unionByName(exact)


def _probed(x: np.ndarray, centroids: np.ndarray, probes: int) -> Iterator[np.ndarray]:
    """The nearest cells of each vector, some vectors at a time."""
    step = max(1, (4 << 20) // len(centroids))
    for a in range(0, max(1, len(x)), step):
        yield np.argsort(distances(_unit(x[a : a + step]), centroids), axis=1, kind="stable")[:, :probes] if len(x) else np.zeros((0, probes), dtype=np.int64)


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)
