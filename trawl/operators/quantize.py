"""Two-stage retrieval over quantized vectors: scalar, binary, product and two-bit codes; approximate candidates, exact rescoring.

A Codec is fitted on records, encodes vectors to bytes and scores stored bytes against queries in the blocked kernel, so a search over stored codes reads no floats but those of its candidates.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dense import Scorer, against, best_sums, matrix, payload_scores, ranked

METHODS = {"scalar": "scalar", "int8": "scalar", "binary": "binary", "product": "product", "pq": "product", "two_bit": "two_bit", "twobit": "two_bit"}
PQ_ROUNDS, PQ_SAMPLE = 20, 65_536
#: Candidates for each wanted row, where none are asked for: coarser codes need more.
MULTIPLIERS = {"scalar": 10, "product": 10, "binary": 20, "two_bit": 20}


def method_name(name: str) -> str:
    if name.lower() not in METHODS:
        raise ValueError(f"unknown quantization {name!r}")
    return METHODS[name.lower()]


def candidates_for(n: int, fetch_k: int, multiplier: int = 10) -> int:
    return min(n, max(1, fetch_k) * max(1, multiplier))


def _elements(records: DataFrame) -> DataFrame:
    return records.select(F.posexplode("vector").alias("dim", "v")).select("dim", F.col("v").cast("double").alias("v"))


def calibrate_scalar(records: DataFrame) -> DataFrame:
    """(dim, low, high, scale): scale is 255 / (high - low), 0 for a range below 1e-10. One row for each dimension."""
    span = F.col("high") - F.col("low")
    return _elements(records).groupBy("dim").agg(F.min("v").alias("low"), F.max("v").alias("high")).withColumn("scale", F.when(span < 1e-10, 0.0).otherwise(255.0 / span))


def _vectors(calibration: DataFrame, *columns: str) -> tuple[Column, ...]:
    """A calibration, which has as many rows as dimensions, as literal arrays."""
    rows = calibration.orderBy("dim").select(*columns).collect()
    return tuple(F.array(*(F.lit(float(r[c])) for r in rows)) for c in columns)


def scalar_codes(calibration: DataFrame, vector: str = "vector") -> Column:
    """Truncated codes from 0 to 255; 128 where a dimension has no range."""
    low, scale = _vectors(calibration, "low", "scale")
    parts = F.arrays_zip(F.col(vector).alias("v"), low.alias("l"), scale.alias("s"))
    return F.transform(parts, lambda p: F.when(p.s == 0, F.lit(128)).otherwise(F.least(F.lit(255.0), F.greatest(F.lit(0.0), (p.v.cast("double") - p.l) * p.s)).cast("int")))


def scalar_decode(calibration: DataFrame, codes: str = "codes") -> Column:
    low, scale = _vectors(calibration, "low", "scale")
    parts = F.arrays_zip(F.col(codes).alias("c"), low.alias("l"), scale.alias("s"))
    return F.transform(parts, lambda p: F.when(p.s == 0, p.l).otherwise(p.l + p.c / p.s).cast("float"))


def binary_codes(vector: str | Column = "vector") -> Column:
    """One bit for each element, 1 if it is above 0; words of 32 bits, least significant first."""
    v = F.col(vector) if isinstance(vector, str) else vector
    bits = F.transform(v, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), (i % 32).cast("int"))).otherwise(F.lit(0).cast("long")))
    words = F.sequence(F.lit(0), F.ceil(F.size(v) / 32).cast("int") - 1)
    return F.transform(words, lambda w: F.aggregate(F.slice(bits, w * 32 + 1, F.lit(32)), F.lit(0).cast("long"), lambda s, b: s + b))


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)


_HALF = pa.schema([("dim", pa.int32()), ("bin", pa.int64()), ("n", pa.int64())])


def _histogram(kept: dict[int, np.ndarray] | None):
    """Counts of a task by dimension and by the high half of a sortable form of each float, or, for the high halves of `kept`, by all of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(0)).astype(np.float32)
            bits = x.view(np.uint32)
            keys = np.where(bits >> 31 == 1, ~bits, bits | np.uint32(1 << 31)).astype(np.int64)
            for d in range(x.shape[1]):
                own = keys[:, d]
                own = own >> 16 if kept is None else own[np.isin(own >> 16, kept[d])]
                bins, n = np.unique(own, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bins), d, dtype=np.int32)), pa.array(bins), pa.array(n)], schema=_HALF)

    return run


def two_bit_boundaries(records: DataFrame) -> DataFrame:
    """records (vector) to (dim, q1, q2, q3): each dimension's order statistics at n/4, n/2 and 3n/4, not interpolated.

    Exact, by two passes that count: the first by the upper 16 bits of each float, of which there are 65,536, the second by all of it where a wanted one lies.
    """
    rows = records.select("vector").where("vector is not null")
    schema = "dim int, bin bigint, n bigint"
    counted = lambda kept: rows.mapInArrow(_histogram(kept), schema).groupBy("dim", "bin").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    coarse, kept, before = counted(None), {}, {}
    for d, part in coarse.groupby("dim"):
        part = part.sort_values("bin")
        ends, bins = part["n"].cumsum().to_numpy(), part["bin"].to_numpy()
        n = int(ends[-1])
        want = [min(n * k // 4, n - 1) for k in (1, 2, 3)]
        at = [int(np.searchsorted(ends, w, "right")) for w in want]
        kept[int(d)], before[int(d)] = np.unique(bins[at]), [(w - (int(ends[i - 1]) if i else 0), int(bins[i])) for w, i in zip(want, at, strict=True)]
    out = []
    if kept:
        for d, part in counted(kept).groupby("dim"):
            part = part.sort_values("bin")
            values = []
            for rank, high in before[int(d)]:
                own = part[part["bin"].to_numpy() >> 16 == high]
                key = int(own["bin"].to_numpy()[int(np.searchsorted(own["n"].cumsum().to_numpy(), rank, "right"))])
                bits = key & 0x7FFFFFFF if key >> 31 else ~key & 0xFFFFFFFF
                values.append(float(np.array([bits], dtype=np.uint32).view(np.float32)[0]))
            out.append((int(d), *values))
    return records.sparkSession.createDataFrame(out, "dim int, q1 double, q2 double, q3 double")


def two_bit_levels(boundaries: DataFrame, vector: Column) -> Column:
    """Levels from 0 to 3 by <= against the boundaries."""
    q1, q2, q3 = _vectors(boundaries, "q1", "q2", "q3")
    parts = F.arrays_zip(vector.alias("v"), q1.alias("a"), q2.alias("b"), q3.alias("c"))
    return F.transform(parts, lambda p: F.when(p.v <= p.a, 0).when(p.v <= p.b, 1).when(p.v <= p.c, 2).otherwise(3))


def level_maxsim(asked: Column, stored: Column) -> Column:
    """The sum over query tokens of the best sum of level products over stored tokens."""
    product = lambda q, d: F.aggregate(F.zip_with(q, d, lambda x, y: x * y), F.lit(0), lambda s, x: s + x)
    return F.aggregate(F.transform(asked, lambda q: F.array_max(F.transform(stored, lambda d: product(q, d)))), F.lit(0), lambda s, x: s + x)


def default_parts(dimension: int) -> int:
    return next(m for m in (16, 12, 10, 8, 6, 4, 3, 2, 1) if dimension % m == 0)


@dataclass
class ProductQuantizer:
    """codebooks: parts x centroids x width."""

    codebooks: np.ndarray

    @classmethod
    def train(cls, records: DataFrame, parts: int | None = None, centroids: int = 256, rounds: int = PQ_ROUNDS, sample: int = PQ_SAMPLE) -> ProductQuantizer:
        """Lloyd's rounds from the first vectors in key order, on the first `sample` of them (the documented bound of what the driver holds)."""
        x = matrix(records.orderBy("namespace", "id").select("vector").limit(sample).toArrow().column("vector").combine_chunks()).astype(np.float64)
        if not len(x):
            raise ValueError("there is nothing to train on")
        m = parts or default_parts(x.shape[1])
        if m <= 0 or x.shape[1] % m or not 1 <= centroids <= 256:
            raise ValueError("parts divide the dimension; centroids are 1 to 256")
        return cls(np.stack([kmeans(x[:, i * (x.shape[1] // m) : (i + 1) * (x.shape[1] // m)], centroids, rounds) for i in range(m)]))

    def encode(self, x: np.ndarray) -> np.ndarray:
        m, _, width = self.codebooks.shape
        return np.stack([nearest(x[:, i * width : (i + 1) * width], self.codebooks[i]) for i in range(m)], axis=1)

    def codes(self, vector: str = "vector") -> Column:
        own = self

        @F.pandas_udf("array<int>")
        def encode(vectors: pd.Series) -> pd.Series:
            return pd.Series(list(own.encode(np.array(vectors.tolist(), dtype=np.float64)).astype(np.int32)))

        return encode(F.col(vector))

    def distances(self, query: np.ndarray) -> np.ndarray:
        """Squared distances of a query's parts to all centroids."""
        m, _, width = self.codebooks.shape
        return ((self.codebooks - np.asarray(query, dtype=np.float64).reshape(m, 1, width)) ** 2).sum(axis=2)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids, as |x|^2 - 2xc + |c|^2."""
    return (x**2).sum(axis=1)[:, None] - 2 * (x @ centroids.T) + (centroids**2).sum(axis=1)[None, :]


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The first of the nearest centroids of each row, in blocks of some 32 MB."""
    step = max(1, (4 << 20) // max(1, len(centroids)))
    return np.concatenate([distances(x[a : a + step], centroids).argmin(axis=1) for a in range(0, len(x), step)]) if len(x) else np.zeros(0, dtype=np.int64)


def kmeans(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Starts from the first k rows, padded with zeros; a centroid without rows stays."""
    c = np.zeros((k, x.shape[1]))
    c[: min(k, len(x))] = x[:k]
    for _ in range(rounds):
        at = nearest(x, c)
        n = np.bincount(at, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def rescored(records: DataFrame, candidates: DataFrame, queries: DataFrame, metric: str, k: int) -> DataFrame:
    """candidates (qid, namespace, id) scored exactly and cut to the k best."""
    from ..functions import metrics

    joined = candidates.select("qid", "namespace", "id").join(records.select("namespace", "id", "vector"), ["namespace", "id"]).join(queries.select(F.col("qid").cast("string").alias("qid"), F.col("vector").alias("qv")), "qid")
    return ranked(joined.select("qid", "namespace", "id", metrics.score(metric, F.col("vector"), F.col("qv")).alias("score")), "score", k).select("qid", "rank", "namespace", "id", "score")


@dataclass
class Codec:
    """A method and what was fitted for it: arrays by name, a few numbers for each dimension or codebook entry."""

    method: str
    fitted: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fit(cls, records: DataFrame, method: str, parts: int | None = None, centroids: int = 256) -> Codec:
        """records (vector, ...); the product method learns from a bounded sample, the others from all rows."""
        method = method_name(method)
        if method == "product":
            return cls(method, {"codebooks": ProductQuantizer.train(records, parts, centroids).codebooks})
        rows = (calibrate_scalar(records) if method == "scalar" else two_bit_boundaries(records)).orderBy("dim").collect() if method != "binary" else []
        names = {"scalar": ("low", "scale"), "two_bit": ("q1", "q2", "q3"), "binary": ()}[method]
        return cls(method, {n: np.array([r[n] for r in rows]) for n in names})

    def encode(self, x: np.ndarray) -> np.ndarray:
        """A row of bytes for each vector."""
        x, f = x.astype(np.float64), self.fitted
        if self.method == "binary":
            return np.packbits(x > 0, axis=1, bitorder="little")
        if self.method == "product":
            return ProductQuantizer(f["codebooks"]).encode(x).astype(np.uint8)
        if self.method == "two_bit":
            return ((x > f["q1"]).astype(np.uint8) + (x > f["q2"]) + (x > f["q3"])).astype(np.uint8)
        scaled = np.clip((x - f["low"]) * f["scale"], 0, 255)
        return np.where(f["scale"] == 0, 128, scaled).astype(np.uint8)

    def scorer(self, metric: str, queries: pa.Array) -> Scorer:
        """Approximate scores of stored codes; the order is what counts."""
        q, f = matrix(queries).astype(np.float64), self.fitted
        raw = lambda column: np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), -1)
        if self.method == "binary":
            signs = np.where(q > 0, 1.0, -1.0).astype(np.float32)
            return lambda column: (2.0 * np.unpackbits(raw(column), axis=1, count=q.shape[1], bitorder="little").astype(np.float32) - 1) @ signs.T
        if self.method == "two_bit":
            levels = self.encode(q).astype(np.float32)
            return lambda column: (raw(column).astype(np.float32) @ levels.T).astype(np.float64)
        if self.method == "scalar":
            safe = np.where(f["scale"] == 0, 1.0, f["scale"])
            back = lambda codes: np.where(f["scale"] == 0, f["low"], f["low"] + codes / safe).astype(np.float32)
            exact = against(metric, q)
            return lambda column: exact(back(raw(column)))
        parts = np.arange(f["codebooks"].shape[0])  # a query's distance to the centroids of a code: to the vector that they make
        return lambda column: 0.0 - distances(f["codebooks"][parts, raw(column)].reshape(len(column), -1), q)

    def codes(self, records: DataFrame, column: str = "vector") -> DataFrame:
        """records (namespace, id, vector) to (namespace, id, code binary)."""

        @F.pandas_udf("binary")
        def encoded(vectors: pd.Series) -> pd.Series:
            return pd.Series([r.tobytes() for r in self.encode(np.array(vectors.tolist(), dtype=np.float64))])

        return records.where(F.col(column).isNotNull()).select("namespace", "id", encoded(column).alias("code"))

    def to_json(self) -> dict:
        return {"method": self.method, "fitted": {k: {"shape": list(v.shape), "data": base64.b64encode(v.astype("<f8").tobytes()).decode()} for k, v in self.fitted.items()}}

    @classmethod
    def from_json(cls, said: dict) -> Codec:
        return cls(said["method"], {k: np.frombuffer(base64.b64decode(v["data"]), dtype="<f8").reshape(v["shape"]) for k, v in said["fitted"].items()})


def search_quantized(records: DataFrame, queries: DataFrame, method: str, k: int = 10, metric: str = "cosine", multiplier: int | None = None, quantizer: ProductQuantizer | None = None, codec: Codec | None = None, codes: DataFrame | None = None, fetch_k: int = 0) -> DataFrame:
    """The k best of the candidates that the codes rank best, with exact scores: (qid, rank, namespace, id, score).

    codec and codes (namespace, id, code): fitted and stored before; without them they are made from records. fetch_k: at least so many times the multiplier are candidates.
    """
    method = method_name(method)
    if codec is None:
        codec = Codec(method, {"codebooks": quantizer.codebooks}) if quantizer is not None else Codec.fit(records, method)
    stored = codes if codes is not None else codec.codes(records)
    n = stored.count()
    count = candidates_for(n, max(k, fetch_k), multiplier or MULTIPLIERS[method])
    asked = queries.select(F.col("qid").cast("string").alias("qid"), F.col("vector").alias("payload")).where("payload is not null")
    width = 8 * (asked.agg(F.max(F.size("payload"))).first()[0] or 1)
    approximate = payload_scores(stored, asked, width, lambda qs: codec.scorer(metric, qs), count, "approximate")
    return rescored(records, ranked(approximate, "approximate", count), queries, metric, k)


@dataclass
class TokenIndex:
    """Two-bit codes of a token-vector space: levels of all token vectors of a record, in one string of bytes, against the boundaries of the space's dimensions."""

    codec: Codec
    rows: DataFrame

    @classmethod
    def build(cls, records: DataFrame, space: str) -> TokenIndex:
        """records (namespace, id, multi_vectors) to an index of those that have the space."""
        tokens = F.try_element_at("multi_vectors", F.lit(space))
        own = records.select("namespace", "id", tokens.alias("tokens")).where("tokens is not null")
        codec = Codec.fit(own.select(F.explode("tokens").alias("vector")), "two_bit")

        @F.pandas_udf("binary")
        def levels(ts: pd.Series) -> pd.Series:
            return pd.Series([codec.encode(np.array([list(v) for v in t], dtype=np.float64)).tobytes() if len(t) else b"" for t in ts])

        return cls(codec, own.select("namespace", "id", levels("tokens").alias("code")))

    def scores(self, queries: DataFrame, k: int | None) -> DataFrame:
        """queries (qid, tokens) to (qid, namespace, id, score): the sum over query tokens of the best product of levels."""
        from .search import check_tokens

        asked, width = check_tokens(queries, "codes")
        codec, dim = self.codec, max(1, len(self.codec.fitted["q1"]))

        def scorer(queries: pa.Array) -> Scorer:
            sizes = queries.value_lengths().to_numpy(zero_copy_only=False)
            q = codec.encode(matrix(queries.flatten())).astype(np.float32)

            def score(column: pa.Array) -> np.ndarray:
                held = column.to_pylist()
                x = np.frombuffer(b"".join(held), dtype=np.uint8).reshape(-1, dim)
                return best_sums(np.array([len(c) // dim for c in held]), sizes, lambda a, b: x[a:b].astype(np.float32) @ q.T)

            return score

        return payload_scores(self.rows, asked, width, scorer, k)

    def search(self, records: DataFrame, queries: DataFrame, space: str, k: int = 10, metric: str = "cosine", multiplier: int = MULTIPLIERS["two_bit"]) -> DataFrame:
        """The k best of k * multiplier candidates by levels, scored exactly by late interaction."""
        from ..functions import metrics

        near = ranked(self.scores(queries, k * multiplier), "score", k * multiplier).select("qid", "namespace", "id")
        tokens = records.select("namespace", "id", F.try_element_at("multi_vectors", F.lit(space)).alias("tokens"))
        pairs = near.join(tokens, ["namespace", "id"]).join(queries.select(F.col("qid").cast("string").alias("qid"), F.col("tokens").alias("asked")), "qid")
        return ranked(pairs.select("qid", "namespace", "id", metrics.maxsim(metric, F.col("asked"), F.col("tokens")).alias("score")), "score", k).select("qid", "rank", "namespace", "id", "score")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of exact's (qid, namespace, id) that found has."""
    key = ["qid", "namespace", "id"]
    return found.select(*key).join(exact.select(*key), key, "left_semi").count() / max(1, exact.count())
