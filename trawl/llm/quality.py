"""Quality classifier: random Fourier features over document statistics, ridge regression, isotonic calibration.

Each whole text becomes FEATURES numbers (shares of kinds of characters, word lengths, repetition of words, bigrams and lines; see `statistics`),
standardised and mapped to D cosines with random frequencies, which approximate a Gaussian kernel. Each partition of labelled rows returns its
sums Z'Z and Z'y for each of FOLDS folds; their total gives the ridge weights. Each labelled row is also scored by the weights of the other folds, and these scores are counted
by label in BINS equal bins and pooled into an increasing step function that calibrates scores.

All labelled rows are used. What reaches the driver has a fixed size but for some 500 bytes of moments for each partition: MOST_PARTS * FOLDS matrices of (D + 1)**2
doubles, which are sums of the partitions' ones, BINS counts, and a broadcast model of some 100 KB.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE_WORDS, Words, checkpointed, slices, text_buffer

D, BINS, MOST_PARTS, FOLDS, SEED = 192, 512, 16, 5, 20240229
NAMES = (
    "log_bytes", "log_words", "upper", "digit", "space", "ascii_mark", "stop_mark", "bracket", "pipe", "symbol", "high_bytes", "line_breaks", "word_bytes", "word_bytes_sd",
    "distinct_words", "repeats_next", "distinct_pairs", "top_word", "distinct_lines", "line_words", "marked_ends", "vowels", "char_entropy", "word_entropy", "loud_marks", "capital_words",
)
FEATURES = len(NAMES)


def _of(chars: str | bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars.encode() if isinstance(chars, str) else chars)] = 1
    return out


_KINDS = np.stack([
    _of(bytes(range(65, 91))), _of("0123456789"), _of(b" \t\n\r\x0b\x0c"), _of(bytes([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])), _of(".,;:"), _of("()[]{}<>"), _of("|"), _of("#$%&*@^~_=+\\"),
    _of(bytes(range(0xC0, 0x100))), _of("\n"), _of("aeiouAEIOU"), _of("!?"),
], axis=1)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES numbers for each text; empty texts have zeros but for their sizes' logarithms."""
    n = len(offsets) - 1
    out = np.zeros((n, FEATURES))
    words = Words(data, offsets, SPACE_WORDS)
    sizes = np.diff(offsets)
    lengths = words.end - words.start
    codes = np.unique(words.hash, return_inverse=True)[1] if len(words.hash) else np.zeros(0, dtype=np.int64)
    closes = np.isin(data[words.end - 1], list(b".,;:!?|*%$#&")) if len(lengths) else np.zeros(0, dtype=bool)
    capital = (data[words.start] != LOWER[data[words.start]]) if len(lengths) else np.zeros(0, dtype=bool)
    for i in range(n):
        a, b = int(words.first[i]), int(words.first[i + 1])
        raw = data[offsets[i] : offsets[i + 1]]
        row = out[i]
        row[0], row[1] = math.log1p(sizes[i]), math.log1p(b - a)
        if b == a:
            continue
        histogram = np.bincount(raw, minlength=256)
        share = histogram @ _KINDS / len(raw)
        row[2:12] = share[:10]
        row[21], row[24] = share[10], share[11]
        p = histogram[histogram > 0] / len(raw)
        row[22] = -(p * np.log(p)).sum()
        size = lengths[a:b]
        row[12], row[13] = size.mean(), min(size.std(), 100.0)
        c = codes[a:b]
        counts = np.unique(c, return_counts=True)[1]
        row[14], row[17] = len(counts) / (b - a), counts.max() / (b - a)
        q = counts / (b - a)
        row[23] = -(q * np.log(q)).sum() / math.log(b - a + 1)
        if b - a > 1:
            row[15] = (c[1:] == c[:-1]).mean()
            row[16] = len(np.unique(c[:-1] * np.int64(len(codes) + 1) + c[1:])) / (b - a - 1)
        lines = raw.tobytes().split(b"\n")
        row[18], row[19] = len(set(lines)) / len(lines), math.log1p((b - a) / len(lines))
        row[20], row[25] = closes[a:b].mean(), capital[a:b].mean()
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffer(batch.column(1))
        for a, b in slices(offsets, 3 << 20):
            rows = statistics(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            own = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(2), pa.array([r.tobytes() for r in rows.astype("<f8")], pa.binary())], names=["doc_id", "row", "stats"])


def document_statistics(docs: DataFrame, row: str | None = None) -> DataFrame:
    """docs (doc_id, text) to (doc_id, row, stats: FEATURES little-endian doubles); row: a column that numbers rows, or null."""
    number = (F.col(row) if row else F.lit(None)).cast("long").alias("row")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), number).mapInArrow(_measure, "doc_id long, row long, stats binary")


def fold_of(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    values = batch.column("stats").cast(pa.binary())
    return np.frombuffer(b"".join(values.to_pylist()), dtype="<f8").reshape(-1, FEATURES)


class Model:
    """Means, scales, frequencies, ridge weights and calibration steps."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, bandwidth: float):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.frequencies = rng.standard_normal((FEATURES, D)) / bandwidth
        self.phases = rng.uniform(0, 2 * math.pi, D)
        self.weights = np.zeros(D + 1)
        self.edges, self.values = np.array([0.0]), np.array([0.5])

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([math.sqrt(2 / D) * np.cos(z @ self.frequencies + self.phases), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated; within a step a hundredth of its room keeps the order of raw scores."""
        raw = np.clip(self.raw(x), -0.5, 1.5)
        at = np.clip(np.searchsorted(self.edges, raw, "right") - 1, 0, len(self.values) - 1)
        return np.clip(0.99 * self.values[at] + 0.01 * (raw + 0.5) / 2, 0.0, 1.0)


def pooled(counts: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Isotonic regression of shares ones / counts by pooling adjacent violators; empty bins take their left neighbour's value."""
    blocks: list[list[float]] = []
    for n, y in zip(counts, ones, strict=True):
        blocks.append([float(y), float(n), 1])
        while len(blocks) > 1 and blocks[-2][1] and (not blocks[-1][1] or blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]):
            y2, n2, w2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + y2, blocks[-1][1] + n2, blocks[-1][2] + w2]
    out = np.concatenate([np.full(int(w), y / n if n else np.nan) for y, n, w in blocks])
    known = np.flatnonzero(~np.isnan(out))
    return out[known[np.clip(np.searchsorted(known, np.arange(len(out)), "right") - 1, 0, None)]] if len(known) else np.full(len(out), 0.5)


def _sums(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, D + 1, D + 2))
        for batch in batches:
            z, fold = shared.value.features(_matrix(batch)), batch.column("fold").to_numpy()
            y = batch.column("y").to_numpy(zero_copy_only=False).astype(float)
            for k in range(FOLDS):
                own = fold == k
                total[k] += z[own].T @ np.column_stack([z[own], y[own]])
        yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f8").tobytes()], pa.binary())], names=["total"])

    return run


def _binned(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, weights = shared.value
        for batch in batches:
            z, fold = model.features(_matrix(batch)), batch.column("fold").to_numpy()
            raw = np.clip((z * weights[fold]).sum(axis=1), -0.5, 1.5)
            bins = np.minimum(((raw + 0.5) / 2 * BINS).astype(np.int64), BINS - 1)
            yield pa.RecordBatch.from_arrays([pa.array(bins), batch.column("y")], names=["bin", "y"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((FOLDS, D + 1, D + 2))
    for batch in batches:
        for one in batch.column("total"):
            total += np.frombuffer(one.as_buffer()).reshape(total.shape)
    yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f8").tobytes()], pa.binary())], names=["total"])


def _weights(sums: np.ndarray, ridge: float) -> np.ndarray:
    penalty = np.eye(D + 1) * ridge * max(1.0, sums[-1, D])
    penalty[-1, -1] = 1e-9
    return np.linalg.solve(sums[:, : D + 1] + penalty, sums[:, D + 1])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total, squares = 0, np.zeros(FEATURES), np.zeros(FEATURES)
    for batch in batches:
        x = _matrix(batch)
        n, total, squares = n + len(x), total + x.sum(axis=0), squares + (x**2).sum(axis=0)
    yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tobytes()], pa.binary()), pa.array([squares.tobytes()], pa.binary())], names=["n", "total", "squares"])


def fit(examples: DataFrame, ridge: float = 1e-3, bandwidth: float = 6.0) -> Model:
    """examples (doc_id, stats, y 0 or 1) to a model. Without examples, or with one label only, every score is near the label's share or a half."""
    rows = examples.mapInArrow(_moments, "n long, total binary, squares binary").toArrow().to_pylist()
    n = sum(r["n"] for r in rows)
    total, squares = (sum((np.frombuffer(r[k]) for r in rows), np.zeros(FEATURES)) for k in ("total", "squares"))
    mean = total / max(1, n)
    scale = np.sqrt(np.maximum(squares / max(1, n) - mean**2, 0))
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), bandwidth)
    if not n:
        return model
    sc = examples.sparkSession.sparkContext
    folded = examples.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(FOLDS)).cast("int"))
    # a tree: each partition's sums, those of MOST_PARTS groups of partitions, and their total on the driver
    parts = folded.mapInArrow(_sums(sc.broadcast(model)), "total binary").repartition(MOST_PARTS).mapInArrow(_added, "total binary").toArrow().to_pylist()
    sums = sum((np.frombuffer(r["total"]).reshape(FOLDS, D + 1, D + 2) for r in parts), np.zeros((FOLDS, D + 1, D + 2)))
    model.weights = _weights(sums.sum(axis=0), ridge)
    without = np.stack([_weights(sums.sum(axis=0) - sums[k], ridge) for k in range(FOLDS)])
    bins = folded.mapInArrow(_binned(sc.broadcast((model, without))), "bin long, y int").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("ones")).toArrow().to_pydict()
    counts, ones = np.zeros(BINS), np.zeros(BINS)
    counts[bins["bin"]], ones[bins["bin"]] = bins["n"], bins["ones"]
    if counts.sum():
        model.edges, model.values = np.arange(BINS) / BINS * 2 - 0.5, pooled(counts, ones)
    return model


def _scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(shared.value.score(_matrix(batch)))], names=["doc_id", "row", "score"])

    return run


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, row: str | None = None) -> DataFrame:
    """docs (doc_id, text, ...), labels (doc_id, quality, ...) to (doc_id, held_out, score, predicted) for each row of docs; with `row`, the name of a column that numbers rows, also row.

    Learns from documents with a quality of 0 or 1 whose fold, crc32 of the id as text modulo 4, is not 2. Null and empty texts get the score
    of their statistics; a null doc_id has held_out false and is never learned from. A document that is labelled more than once counts once for each label, and each of
    the rows that repeat a labelled doc_id counts.
    """
    stats = checkpointed(document_statistics(docs, row))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("y in (0, 1)").where(fold_of(F.col("doc_id")) != 2)
    model = fit(checkpointed(stats.join(marks, "doc_id").select("doc_id", "stats", "y")))
    scored = stats.mapInArrow(_scores(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, row long, score double")
    out = scored.select("doc_id", F.coalesce(fold_of(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "row")
    return out if row else out.drop("row")
