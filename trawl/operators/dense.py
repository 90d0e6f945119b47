"""The blocked kernels: products of a batch of records with a block of queries, in Arrow batches, exact top-k, and ranks by counting.

Predicates are applied before. Queries are read in blocks of at most QUERY_BYTES, so what a task gets has a fixed bound; records are scanned once for each block, CELLS of scores at a time.
A kernel's scorer turns a column of payloads (vectors, token vectors, codes) and a block of queries into a rows x queries array.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import metric_name
from ..schema import RecordError

QUERY_BYTES = 32 << 20
ROWS = 8192
#: Cells of rows x queries, or of tokens x query tokens, that a task scores at once; pairs that it emits at once; bytes of a held row of a top-k.
CELLS, PAIRS, HELD = 1 << 20, 1 << 16, 24
Scorer = Callable[[pa.Array], np.ndarray]


def against(metric: str, queries: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Scores of records against these queries: a rows x queries array, in doubles; higher is better."""
    q = queries.astype(np.float64)
    if metric == "manhattan":
        return lambda x: 0.0 - np.stack([np.abs(x.astype(np.float64) - v).sum(axis=1) for v in q], axis=1)
    if metric == "euclidean":
        return lambda x: 0.0 - np.stack([np.sqrt(((x.astype(np.float64) - v) ** 2).sum(axis=1)) for v in q], axis=1)
    if metric == "cosine":
        length = lambda v: (lambda n: np.where(n == 0, 1.0, n))(np.linalg.norm(v, axis=1))
        sizes = length(q)[None, :]

        def cosine(x: np.ndarray) -> np.ndarray:  # products are divided, not vectors, so that exact ties stay
            x = x.astype(np.float64)
            out = x @ q.T
            out /= length(x)[:, None] * sizes
            return out

        return cosine
    return lambda x: x.astype(np.float64) @ q.T


def scores(metric: str, records: np.ndarray, queries: np.ndarray) -> np.ndarray:
    return against(metric, queries)(records)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, or 0."""
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def settled(s: np.ndarray) -> np.ndarray:
    """Scores to 40 binary digits: products of equal vectors differ in the last ones by their places in a matrix, but equal rows tie."""
    m, e = np.frexp(s)
    return np.ldexp(np.rint(np.ldexp(m, 40)), e - 40)


def matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    x = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    return x[:, :dim] if dim else x


def vector_scorer(metric: str, queries: pa.Array, dim: int | None) -> Scorer:
    sizes = pc.unique(queries.value_lengths()).to_pylist()
    if len(sizes) > 1:
        raise RecordError(f"query vectors have {sorted(sizes)} elements")
    q = matrix(queries, dim)
    score = against(metric, q)

    def checked(column: pa.Array) -> np.ndarray:
        x = matrix(column, dim)
        if x.shape[1] != q.shape[1]:
            raise RecordError(f"stored vectors have {x.shape[1]} elements, queries {q.shape[1]}")
        return score(x)

    return checked


def token_scorer(metric: str, queries: pa.Array) -> Scorer:
    """Late interaction: the sum over query tokens of the best score over stored tokens; 0 if either has none."""
    sizes = queries.value_lengths().to_numpy(zero_copy_only=False)
    each = against(metric, matrix(queries.flatten())) if sizes.any() else None

    def score(column: pa.Array) -> np.ndarray:
        n, flat = column.value_lengths().to_numpy(zero_copy_only=False), column.flatten()
        return best_sums(n, sizes, lambda a, b: each(matrix(flat.slice(a, b - a))))

    return score


def best_sums(n: np.ndarray, sizes: np.ndarray, each: Callable[[int, int], np.ndarray]) -> np.ndarray:
    """Rows of n tokens x queries of so many: sums over query tokens of the best over the row's. each(a, b): stored tokens a to b x all query tokens; at most CELLS (or a token's) at a time."""
    out, held, some = np.zeros((len(n), len(sizes))), np.flatnonzero(n), np.flatnonzero(sizes)
    if not len(held) or not len(some):
        return out
    starts, own = (np.cumsum(sizes) - sizes)[some], n[held]
    ends, most = np.cumsum(own), max(1, CELLS // int(sizes.sum()))
    a = 0
    while a < len(held):
        first = ends[a] - own[a]
        b = max(a + 1, int(np.searchsorted(ends, first + most, "right")))
        if own[a] > most:  # one long row, in pieces
            best = each(first, first + most).max(axis=0)[None]
            for t in range(first + most, ends[a], most):
                best = np.maximum(best, each(t, min(t + most, ends[a])).max(axis=0)[None])
        elif (own[a:b] == own[a]).all():  # some 15 times as fast
            best = each(first, ends[b - 1]).reshape(b - a, own[a], -1).max(axis=1)
        else:
            best = np.maximum.reduceat(each(first, ends[b - 1]), (ends - own)[a:b] - first, axis=0)
        out[np.ix_(held[a:b], some)] = np.add.reduceat(best, starts, axis=1)
        a = b
    return out


class Best:
    """The k best rows of each query that a task has seen, by score, namespace and id: some k rows for each query are held, however many tie."""

    def __init__(self, k: int, width: int):
        self.k, self.width = k, width
        self.least, self.whole = np.full(width, -np.inf), False
        self.parts: list[tuple] = []
        self.keys = self.waiting = 0
        self.most = max(CELLS // 4, k * width)

    def add(self, s: np.ndarray, namespace: pa.Array, id: pa.Array) -> None:
        if not self.whole and self.k < len(s):
            self.least = np.maximum(self.least, self._below(np.partition(s, len(s) - self.k, axis=0)[len(s) - self.k]))
        row, q = np.nonzero((s >= self.least) & (s != -np.inf))
        if not len(row):
            return
        rows, at = np.unique(row, return_inverse=True)
        self.parts.append((settled(s[row, q]), q.astype(np.int32), at + self.keys, namespace.take(pa.array(rows)), id.take(pa.array(rows))))
        self.keys, self.waiting = self.keys + len(rows), self.waiting + len(row)
        if self.waiting > self.most:
            self.cut()

    @staticmethod
    def _below(s: np.ndarray) -> np.ndarray:
        """What a score that settles to s, or to a score that settles as s does, is not below."""
        return np.where(np.isfinite(s), s - np.abs(s) * 2.0**-38, s)

    def cut(self) -> None:
        score, query, key = (np.concatenate([p[i] for p in self.parts]) for i in range(3))
        names = pa.table([pa.chunked_array([p[i] for p in self.parts]) for i in (3, 4)], names=["namespace", "id"])
        self.parts.clear()
        place = np.empty(len(names), dtype=np.int64)
        place[pc.sort_indices(names, sort_keys=[("namespace", "ascending"), ("id", "ascending")]).to_numpy()] = np.arange(len(names))
        order = np.lexsort((place[key], -score, query))
        q = query[order]
        nth = np.arange(len(q)) - np.searchsorted(q, np.arange(self.width))[q]
        last = nth == self.k - 1
        self.least[q[last]] = np.maximum(self.least[q[last]], self._below(score[order[last]]))
        kept = order[nth < self.k]
        used, at = np.unique(key[kept], return_inverse=True)
        names = names.take(pa.array(used)).combine_chunks()
        self.parts.append((score[kept], query[kept], at, names.column(0).combine_chunks(), names.column(1).combine_chunks()))
        self.keys, self.waiting, self.whole = len(used), 0, True

    def rows(self, qids: pa.Array, name: str) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self.cut()
            score, query, key, namespace, id = self.parts[0]
            yield from _pairs(qids, query, namespace, id, key, score, name)


def _pairs(qids: pa.Array, query: np.ndarray, namespace: pa.Array, id: pa.Array, row: np.ndarray, score: np.ndarray, name: str) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(row), PAIRS):
        at = pa.array(row[a : a + PAIRS])
        yield pa.RecordBatch.from_arrays([qids.take(pa.array(query[a : a + PAIRS])), namespace.take(at), id.take(at), pa.array(score[a : a + PAIRS].astype(np.float64))], names=["qid", "namespace", "id", name])


def _emitted(make, k: int | None, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, scorer, floor = make()
        step, best = max(1, min(ROWS, CELLS // len(qids))), Best(k, len(qids)) if k is not None else None
        for whole in batches:
            for a in range(0, whole.num_rows, step):
                batch = whole.slice(a, step)
                s = scorer(batch.column(2))
                if best is not None:
                    best.add(s, batch.column(0), batch.column(1))
                    continue
                row, q = np.nonzero(s >= floor if floor is not None else s != -np.inf)
                yield from _pairs(qids, q, batch.column(0), batch.column(1), row, s[row, q], name)
        if best is not None:
            yield from best.rows(qids, name)

    return run


def _blocks(asked: DataFrame, width: int) -> Iterator[pa.Table]:
    """The rows of asked (qid, ...), in blocks of at most QUERY_BYTES of `width` bytes each."""
    n = asked.count()
    blocks = max(1, -(-n * width // QUERY_BYTES))
    for i in range(blocks):
        some = asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i).toArrow().combine_chunks()
        if len(some):
            yield some


def _column(some: pa.Table, name: str) -> pa.Array:
    return some.column(name).combine_chunks()


def payload_scores(records: DataFrame, asked: DataFrame, width: int, scorer: Callable[[pa.Array], Scorer], k: int | None = None, name: str = "score", floors: dict[str, float] | None = None) -> DataFrame:
    """records (namespace, id, payload), asked (qid, payload of some `width` bytes) to (qid, namespace, id, name).

    scorer: a block's payloads to its Scorer, made once in each task. All pairs; with k those that may be among the k best of each query, of which a task holds and emits k;
    with floors (qid to a score) those that reach them. A score of minus infinity leaves a pair out.
    """
    spark, out = records.sparkSession, None
    schema = f"qid string, namespace string, id string, {name} double"
    for some in _blocks(asked, width + HELD * (k or 0)):
        own = np.array([floors.get(q, -np.inf) for q in some.column("qid").to_pylist()]) if floors is not None else None
        shared = spark.sparkContext.broadcast((some, own))

        def make(shared=shared):
            rows, floor = shared.value
            return _column(rows, "qid"), scorer(_column(rows, "payload")), floor

        part = records.mapInArrow(_emitted(make, k, name), schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def _vectors_of(queries: DataFrame) -> tuple[DataFrame, int]:
    asked = queries.select(F.col("qid").cast("string").alias("qid"), F.col("vector").alias("payload")).where("payload is not null")
    return asked, 8 * (asked.agg(F.max(F.size("payload"))).first()[0] or 1)


def dense_scores(records: DataFrame, queries: DataFrame, metric: str, dim: int | None = None, k: int | None = None, floors: dict[str, float] | None = None) -> DataFrame:
    """records (namespace, id, vector), queries (qid string, vector) to (qid, namespace, id, dense).

    All pairs, or with k those that may be among the k best of each query, or with floors those that reach them. dim: only so many elements are compared. Null vectors
    have no scores.
    """
    metric = metric_name(metric)
    rows = records.select("namespace", "id", "vector").where("vector is not null")
    asked, width = _vectors_of(queries)
    return payload_scores(rows, asked, width, lambda vs: vector_scorer(metric, vs, dim), k, "dense", floors)


def space_scores(records: DataFrame, queries: DataFrame, spaces: list[tuple[str, float]], metric: str, dim: int | None = None, k: int | None = None) -> DataFrame:
    """records (namespace, id, and a column of vectors for each space), queries (qid, the same columns), spaces (column, weight) to (qid, namespace, id, dense).

    The weighted sum of the spaces that both have, of pairs that have one in common, in one scan: all, or with k those that may be among the k best of each query.
    """
    metric, names = metric_name(metric), [n for n, _ in spaces]
    packed = lambda *keys: (*keys, F.struct(*names).alias("payload"))
    asked = queries.select(*packed(F.col("qid").cast("string").alias("qid")))
    some = asked.agg(*(F.max(F.size(F.col("payload")[n])).alias(n) for n in names)).first()
    weights = [w for _, w in spaces]
    return payload_scores(records.select(*packed("namespace", "id")), asked, 8 * max(1, sum(max(0, v or 0) for v in some)), lambda qs: _space_scorer(metric, qs, weights, dim), k, "dense")


def _space_scorer(metric: str, queries: pa.StructArray, weights: list[float], dim: int | None) -> Scorer:
    valid = lambda c: pc.is_valid(c).to_numpy(zero_copy_only=False)
    parts = [(valid(c), vector_scorer(metric, c.drop_null(), dim) if c.null_count < len(c) else None, w) for c, w in zip(queries.flatten(), weights, strict=True)]

    def score(column: pa.StructArray) -> np.ndarray:
        out, common = np.zeros((len(column), len(queries))), np.zeros((len(column), len(queries)), dtype=bool)
        for c, (has, each, weight) in zip(column.flatten(), parts, strict=True):
            own = valid(c)
            if each is not None and own.any():
                out[np.ix_(own, has)] += weight * each(c.drop_null())
                common |= own[:, None] & has[None, :]
        out[~common] = -np.inf
        return out

    return score


def ranked(df: DataFrame, by: str, k: int | None, per: str = "qid", name: str = "rank") -> DataFrame:
    """Rows by descending score, then namespace and id, within each query; the first k, or all."""
    order = Window.partitionBy(per).orderBy(F.col(by).desc(), F.col("namespace"), F.col("id"))
    df = df.withColumn(name, F.row_number().over(order).cast("long"))
    return df if k is None else df.where(F.col(name) <= k)


# ---- ranks by counting


#: Scores count as equal that agree in so many digits, as sums in different orders differ in the last ones.
DIGITS = 11


class Places:
    """A query's candidates in order of rank; before() tells how many rows of a batch come at or before which of them."""

    def __init__(self, candidates: list[tuple[float, str, str]]):
        self.order = sorted((-round(float(settled(s)), DIGITS), ns, i) for s, ns, i in candidates)
        self.values = np.array([s for s, _, _ in self.order])
        self.place = {(ns, i): at for at, (_, ns, i) in enumerate(self.order)}
        self.ids = pa.array([i for _, _, i in self.order], pa.string())

    def before(self, score: np.ndarray, namespace: pa.Array, id: pa.Array) -> np.ndarray:
        """Of the rows with a score above 0, how many come after the candidate before and not after each candidate, which counts itself."""
        score = np.round(settled(score), DIGITS)
        low = np.searchsorted(self.values, -score, "left")
        counts = score > 0
        tied = (np.searchsorted(self.values, -score, "right") > low) & counts
        own = pc.is_in(id, self.ids).to_numpy(zero_copy_only=False)
        for r in np.flatnonzero(tied | own):  # a candidate, or a score that one has too: by namespace and id
            key = (namespace[int(r)].as_py(), id[int(r)].as_py())
            if key in self.place:
                low[r], counts[r] = self.place[key], self.values[self.place[key]] < 0
            elif tied[r]:
                low[r] = bisect_left(self.order, (-score[r], *key))
        return np.bincount(low[counts], minlength=len(self.order) + 1)[: len(self.order)]


def _counted(places: dict[str, Places], qids: list[str], score_of: Callable[[pa.RecordBatch], np.ndarray]):
    """Counts of one task: (qid, place, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {q: np.zeros(len(places[q].order), dtype=np.int64) for q in qids if q in places}
        for whole in batches:
            step = max(1, min(ROWS, CELLS // max(1, len(qids))))
            for a in range(0, whole.num_rows, step):
                batch = whole.slice(a, step)
                s = score_of(batch)
                for j, q in enumerate(qids):
                    if q in total:
                        total[q] += places[q].before(s[:, j], batch.column(0), batch.column(1))
        yield place_counts(total)

    return run


_COUNTS = "qid string, place bigint, n bigint"


def place_counts(total: dict[str, np.ndarray], *kind: int) -> pa.RecordBatch:
    """Counts of one task: (qid, place, n), and its kind if there are several."""
    rows = [(q, i, int(n), *kind) for q, counts in total.items() for i, n in enumerate(counts) if n]
    columns = [pa.array([r[0] for r in rows], pa.string()), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(1, 3 + len(kind)))]
    return pa.RecordBatch.from_arrays(columns, names=["qid", "place", "n", "kind"][: len(columns)])


def ranks_of(spark, counts: pa.Table, candidates: dict[str, list], name: str) -> DataFrame:
    """The rank of each candidate with a score above 0: how many rows come at or before its place."""
    found: dict[str, dict[int, int]] = {}
    for q, place, n in zip(*(counts.column(c).to_pylist() for c in ("qid", "place", "n")), strict=True):
        found.setdefault(q, {})[place] = n
    out: list[list] = [[], [], [], []]
    for q, rows in candidates.items():
        seen = 0
        for i, (s, ns, key) in enumerate(Places(rows).order):
            seen += found.get(q, {}).get(i, 0)
            if s < 0:
                for column, v in zip(out, (q, ns, key, seen), strict=True):
                    column.append(v)
    return spark.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["qid", "namespace", "id", name]))


def dense_ranks(records: DataFrame, queries: DataFrame, metric: str, dim: int | None, candidates: dict[str, list], name: str = "dense_rank") -> DataFrame:
    """The ranks, among the positive scores of all records, of some candidates of each query (qid to (score, namespace, id)); a scan that counts, without a shuffle of scores."""
    metric = metric_name(metric)
    rows = records.select("namespace", "id", "vector").where("vector is not null")
    asked, width = _vectors_of(queries)
    spark, counts = records.sparkSession, None
    for some in _blocks(asked, width + 64 * max(map(len, candidates.values()), default=0)):
        own = {q: candidates[q] for q in some.column("qid").to_pylist() if q in candidates}
        shared = spark.sparkContext.broadcast((some, own))

        def run(batches, shared=shared):
            asked, own = shared.value
            scorer = vector_scorer(metric, _column(asked, "payload"), dim)
            return _counted({q: Places(c) for q, c in own.items()}, asked.column("qid").to_pylist(), lambda b: scorer(b.column(2)))(batches)

        part = rows.mapInArrow(run, _COUNTS)
        counts = part if counts is None else counts.unionByName(part)
    summed = (counts if counts is not None else spark.createDataFrame([], _COUNTS)).groupBy("qid", "place").agg(F.sum("n").alias("n")).toArrow()
    return ranks_of(spark, summed, candidates, name)
