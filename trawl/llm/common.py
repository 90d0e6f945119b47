"""Helpers shared by the training-data operators: checkpoints, byte-level word hashing, packed shuffles."""

from __future__ import annotations

import ctypes
import math
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_MIX1, _MIX2 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)

#: Words of the shingle and mixing contracts: everything but space, tab, LF, VT, FF and CR.
SPACE_WORDS = np.ones(256, dtype=bool)
SPACE_WORDS[[0x20, *range(0x09, 0x0E)]] = False
#: Words of the contamination contract: digits, letters and whatever lies above ASCII.
ALNUM_WORDS = np.zeros(256, dtype=bool)
ALNUM_WORDS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: A-Z to a-z on UTF-8 bytes; bytes of longer code points are never in that range.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def shared_folder(spark: SparkSession) -> str:
    """The folder of checkpoints and scratch tables, which all executors and the driver see: spark.checkpoint.dir, or a temporary one where the master is this machine.

    A cluster without that setting is an error, as files of a machine-local folder are lost with an executor or never seen by the others.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not sc.getCheckpointDir():
        if not configured and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="trawl-checkpoints-"))
    return configured or sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder, with its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the memory that a task no longer uses goes back to the system: Python workers wait for more tasks, several beside each other, and would keep it."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return tidy


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _files(docs: DataFrame) -> list[str] | None:
    """The Parquet files that docs is made of, in order of their names, if it is nothing but a scan that reads each once."""
    plan = docs._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRelation" or (source := plan.relation()).getClass().getSimpleName() != "HadoopFsRelation":
        return None
    if source.fileFormat().getClass().getSimpleName() != "ParquetFileFormat" or "_metadata" in docs.columns:
        return None
    read = list(source.location().inputFiles())
    names = sorted(r[0] for r in docs.select("_metadata.file_path").distinct().collect())
    return names if len(set(read)) == len(read) < 1 << 22 else None


def numbered(docs: DataFrame, column: str = "__row") -> DataFrame:
    """docs with a number that no other row has, the same in every read.

    Rows of a Parquet scan are numbered by file and place in it, without a copy. Of other frames a table is written to the shared folder, which stays there.
    """
    spark = docs.sparkSession
    if (names := _files(docs)) is not None:
        files = F.broadcast(spark.createDataFrame([(x, i << 40) for i, x in enumerate(names)], "__file string, __first long"))
        at = docs.select("*", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.row_index").alias("__place"))
        return at.join(files, F.col("__path") == F.col("__file")).select(*docs.columns, (F.col("__first") + F.col("__place")).alias(column))
    path = scratch(spark, "rows")
    docs.withColumn(column, F.monotonically_increasing_id()).write.parquet(path)
    return spark.read.parquet(path)


def shuffle_partitions(spark: SparkSession, least: int = 64) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def wide_buckets_for(df: DataFrame, least: int = 8) -> int:
    """Reduce tasks for packed signatures that are decoded a slice at a time: one for each 32 MB of df up to 1024, then one more for each 128 MB.

    The fewer there are, the more signatures of a node share its entry in a blob. Where the optimizer knows no size, as buckets_for.
    """
    if (size := _estimated_bytes(df)) >= 1 << 55:
        return shuffle_partitions(df.sparkSession)
    wanted = -(-size // (32 << 20))
    if wanted > 1024:
        wanted = 1024 + (size - (32 << 30)) // (128 << 20)
    return max(least, min(wanted, 200_000))


def buckets_for(df: DataFrame, least: int = 64) -> int:
    """Reduce tasks for packed signatures of df, from the optimizer's estimate of its size: one for each 4 MB up to 1024, then one more for each 128 MB.

    Where the optimizer knows no size (rows that don't come from files), 64 or spark.sql.shuffle.partitions.
    """
    if (size := _estimated_bytes(df)) >= 1 << 55:
        return shuffle_partitions(df.sparkSession)
    wanted = -(-size // (4 << 20))
    if wanted > 1024:
        wanted = 1024 + (size - (4 << 30)) // (128 << 20)
    return max(shuffle_partitions(df.sparkSession, least), min(wanted, 200_000))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer over 64 bits."""
    x = x ^ (x >> U64(33))
    x = x * _MIX1
    x ^= x >> U64(33)
    x = x * _MIX2
    x ^= x >> U64(33)
    return x


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string array and its len+1 offsets; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int):
    """(first, last) runs of rows with about `most` bytes; a longer row stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


class Words:
    """Word boundaries and 64-bit word hashes of a run of texts; starts, ends: bytes; doc: row of each word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray, tile: int = 1 << 21):
        hashes, starts, ends = [], [], []
        bounds = np.unique(offsets)
        at, size = 0, len(data)
        while at < size:
            stop = min(size, at + tile)
            if stop < size:  # a tile ends where no word is cut
                while True:
                    gaps = np.flatnonzero(~kinds[data[at:stop]])
                    if len(gaps) or stop == size:
                        break
                    stop = min(size, stop + tile)
                if len(gaps) and stop < size:
                    stop = at + int(gaps[-1]) + 1
            part = LOWER[data[at:stop]]
            is_word = kinds[part]
            cut = bounds[np.searchsorted(bounds, at) : np.searchsorted(bounds, stop)] - at
            begins = is_word.copy()
            begins[1:] &= ~is_word[:-1]
            begins[cut] = is_word[cut]
            s = np.flatnonzero(begins)
            closes = is_word.copy()
            closes[:-1] &= ~is_word[1:]
            inner = cut[cut > 0] - 1
            closes[inner] = is_word[inner]
            e = np.flatnonzero(closes) + 1
            if len(s):
                hashes.append(_span_hashes(part, s, e))
                starts.append(s + at)
                ends.append(e + at)
            at = stop
        empty = np.zeros(0, dtype=np.int64)
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, dtype=U64)
        self.start = np.concatenate(starts) if starts else empty
        self.end = np.concatenate(ends) if ends else empty
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        n = len(offsets) - 1
        self.first = np.searchsorted(self.doc, np.arange(n + 1))  # first word of each row, and the end
        self.count = np.diff(self.first)


_POWERS = np.multiply.accumulate(np.append(U64(1), np.full(4095, U64(0x9E3779B97F4A7C15), dtype=U64)))


def powers(n: int) -> np.ndarray:
    """At least n powers of an odd constant modulo 2**64."""
    return _POWERS if n <= len(_POWERS) else np.multiply.accumulate(np.append(U64(1), np.full(n, _POWERS[1], dtype=U64)))


def _span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes modulo 2**64 of spans of bytes that don't overlap."""
    sizes = ends - starts
    before = np.cumsum(sizes) - sizes
    inside = np.arange(int(sizes.sum())) - np.repeat(before, sizes)
    where = inside + np.repeat(starts, sizes)
    values = (data[where].astype(U64) + U64(1)) * powers(int(sizes.max()))[inside]
    return mix(np.add.reduceat(values, before) + sizes.astype(U64))


def shingle_hashes(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of all rows, and len+1 offsets. A row with fewer words, but not none, has one."""
    w, first, n_docs = words.hash, words.first, len(words.count)
    factors = mix(np.arange(1, width + 1).astype(U64) * U64(0xD1B54A32D192ED03)) | U64(1)
    n = np.where(words.count >= width, words.count - width + 1, (words.count > 0).astype(np.int64))
    offsets = np.concatenate([[0], np.cumsum(n)])
    h = np.zeros(int(offsets[-1]), dtype=U64)
    full = max(0, len(w) - width + 1)
    rolled = np.zeros(full, dtype=U64)
    for j in range(width):
        rolled += w[j : j + full] * factors[j]
    long = words.count >= width
    if long.any():
        sizes = n[long]
        inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        h[inside + np.repeat(offsets[:-1][long], sizes)] = rolled[inside + np.repeat(first[:-1][long], sizes)]
    for i in np.flatnonzero((words.count > 0) & ~long):
        own = w[first[i] : first[i + 1]]
        h[offsets[i]] = np.append(own * factors[: len(own)], mix(np.array([len(own)], dtype=U64))).sum(dtype=U64)
    h = mix(h)
    for i in range(n_docs):
        h[offsets[i] : offsets[i + 1]].sort()
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = h[1:] != h[:-1]
    inner = offsets[:-1][n > 0]
    keep[inner] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return h[keep], kept[offsets]


_KEY_SALT, _CHECK_SALT = U64(0x2545F4914F6CDD1D), U64(0x8CB92BA72F3D8DD7)


def set_keys(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row's set of hashes a 64-bit key, 0 for an empty set, and 32 bits of another hash: sets count as equal where both agree."""
    sizes = np.diff(offsets)
    out, check = np.zeros(len(sizes), dtype=U64), np.zeros(len(sizes), dtype=np.int64)
    some = sizes > 0
    if some.any():
        at, n = offsets[:-1][some], sizes[some].astype(U64)
        out[some] = mix(np.add.reduceat(mix(h ^ _KEY_SALT), at) + n)
        out[some & (out == 0)] = U64(1)
        check[some] = (mix(np.add.reduceat(mix(h + _CHECK_SALT), at) ^ n) >> U64(33)).astype(np.int64)
    return out, check


class Bitmap:
    """A set of longs as a bitmap of one hash: has() may be true for others, never false for a member.

    Built by a distributed OR over 64-bit pieces. It has some eight bits a member, LEAST_BITS to MOST_BITS in powers of two: 32 MB at most reach the driver and are
    broadcast. It only spares rows a join; beyond some 33 million members it passes more and more of the others, and results stay the same.
    """

    LEAST_BITS, MOST_BITS = 20, 28

    def __init__(self, df: DataFrame, column: str, hashed: bool = False):
        """hashed: the column holds 64-bit hashes already."""
        spark = df.sparkSession
        bits = min(self.MOST_BITS, max(self.LEAST_BITS, math.ceil(math.log2(max(1, 8 * df.count())))))
        at = F.pmod(F.col(column) if hashed else F.xxhash64(F.col(column).cast("long")), F.lit(1 << bits))
        pieces = df.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("piece")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("at", F.lit(64)).cast("int"))).alias("x")).toArrow()
        words = np.zeros((1 << bits) // 64, dtype=np.int64)
        words[pieces.column("piece").to_numpy()] = pieces.column("x").to_numpy()
        self.bits, self.shared = bits, spark.sparkContext.broadcast(words)

    def has(self, hashed: Column) -> Column:
        """hashed: F.xxhash64 of the column."""
        shared, mask = self.shared, (1 << self.bits) - 1

        @F.arrow_udf("boolean")
        def member(h: pa.Array) -> pa.Array:
            at = h.to_numpy(zero_copy_only=False) & mask
            return pa.array((shared.value[at >> 6] >> (at & 63)) & 1 == 1)

        return member(hashed)
