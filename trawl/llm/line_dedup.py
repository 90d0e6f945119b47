"""Fuzzy line dedup: MinHash over character shingles, banding, exact Jaccard verification, distributed union-find.

Lines are parted by line feeds and lower-cased (A-Z). A line's set is its distinct hashed 8-character shingles; equal lower-cased lines are one node. One-permutation
MinHash fills BANDS * ROWS values from one hash of each shingle (an empty one borrows from the next full one, to the side that a hash picks); lines
that agree in all values of a band become candidates, of which a pair of similarity 0.75 is missed with a chance of about 0.0025.
With `shorter`, lines of fewer than LEAST_CHARS characters count too, unless they are blank: equal ones are one node at any length, and those that have shingles get their
candidates from prefix signatures (see prefix_signatures), which miss no similar line, short or long.
Candidates pass through odd sketches and are then verified exactly on whole sets. Of each component, and of each line that occurs
more than once, the first occurrence by (doc_id, line number) stays.

Two passes over the documents: signatures and occurrences; the texts of candidate lines. What moves between tasks is packed signatures, the candidates' texts,
and 24 bytes for each line. Hot lines pre-aggregate to one row for each task; what keeps the rows of a hot candidate group apart is described in
similar_sets. Documents that lose no line are not shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, U64, Bitmap, buckets_for, checkpointed, lean, mix, numbered, powers, slices, text_buffer
from .components import connected_components
from .packed import PACKED_DDL, PAIRS, PAIRS_DDL, Packer, by_bucket, candidates, riders, split_riders
from .similar_sets import exact_groups, odd_sketch, probable_groups

#: BANDS * ROWS is a power of two.
WIDTH, BANDS, ROWS = 8, 16, 4
LEAST_CHARS = 20
_EMPTY = np.uint32(0xFFFFFFFF)
_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=U64)


#: Of each byte: whether it starts a character other than a line feed; whether it isn't white space; its value in keys, lower-cased.
_IS_LEAD = np.array([(b & 0xC0) != 0x80 and b != 0x0A for b in range(256)], dtype=np.int8)
_IS_SAID = np.array([b != 0x20 and not 0x09 <= b <= 0x0D for b in range(256)], dtype=np.int8)
_VALUE = LOWER.astype(U64) + U64(1)
_VALUE[0x0A] = U64(0)


class Lines:
    """Lines of a run of texts: doc, number, first and end byte, characters, key and 31 more bits (check) of the lower-cased line."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        filled = offsets[:-1][np.diff(offsets) > 0]
        breaks = np.flatnonzero(data == 0x0A)
        self.start = np.unique(np.concatenate([filled, breaks + 1])) if len(data) else np.zeros(0, dtype=np.int64)
        self.start = self.start[self.start < len(data)]
        # a text that ends in a line feed has an empty last line, which never counts
        self.end = np.append(self.start[1:], len(data)) if len(self.start) else self.start
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.end = self.end - (data[self.end - 1] == 0x0A) if len(self.start) else self.end
        first = np.searchsorted(self.doc, np.arange(len(offsets)))
        self.number = np.arange(len(self.start)) - first[self.doc]
        if not len(self.start):
            self.chars = self.check = np.zeros(0, dtype=np.int64)
            self.key = np.zeros(0, dtype=U64)
            return
        # spans with their line feeds cover all bytes; a line feed adds nothing to the sums
        size = np.diff(np.append(self.start, len(data)))
        self.chars = np.add.reduceat(_IS_LEAD[data], self.start, dtype=np.int64)
        inside = np.arange(len(data), dtype=np.int32) - np.repeat(self.start.astype(np.int32), size)
        values = _VALUE[data]
        values *= powers(int(size.max()))[inside]
        size = (self.end - self.start).astype(U64)
        self.key = mix(np.add.reduceat(values, self.start) + size)
        values ^= values >> U64(29)  # not linear in the bytes, so it tells lines apart whose first sums agree
        self.check = (mix(np.add.reduceat(values, self.start) ^ size) >> U64(33)).astype(np.int64)

    def chosen(self, least: int, shorter: bool = False) -> np.ndarray:
        """Lines of at least this many characters and a shingle; then all others that count, with shorter those that hold more than white space."""
        long = (self.chars >= least) & (self.chars >= WIDTH)
        counts = self.chars >= least
        if shorter and len(self.start):
            counts = counts | (np.add.reduceat(_IS_SAID[self.data], self.start, dtype=np.int64) > 0)
        return np.concatenate([np.flatnonzero(long), np.flatnonzero(counts & ~long)])

    def windows(self, rows: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray]:
        """(hashes in unsigned integers of this kind, line of each as index into rows) of all character shingles of these lines, in order."""
        text = LOWER[self.data].tobytes().decode("utf-8", "replace").encode("utf-32-le")
        x = _windows(np.frombuffer(text, dtype=np.uint32).astype(kind, copy=False))
        size = self.chars + (np.diff(np.append(self.start, len(self.data))) > self.end - self.start)
        first = (np.cumsum(size) - size)[rows]
        n = np.maximum(self.chars[rows] - WIDTH + 1, 0)
        line = np.repeat(np.arange(len(rows), dtype=np.int32), n)
        at = np.arange(int(n.sum()), dtype=np.int32) + np.repeat((first - (np.cumsum(n) - n)).astype(np.int32), n)
        return _mix32(x[at]) if kind is np.uint32 else mix(x[at]), line


def _windows(x: np.ndarray) -> np.ndarray:
    """Hashes of the windows of 8 characters, by way of those of 2 and 4."""
    shift = x.dtype.type(29 if x.itemsize == 8 else 15)
    for c, size in zip(_C.astype(x.dtype), (1, 2, 4), strict=True):
        x = x[: max(0, len(x) - size)] * c + x[size:]
        x ^= x >> shift
    return x


def _mix32(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def minhash_bands(h: np.ndarray, line: np.ndarray, n_lines: int) -> tuple[np.ndarray, np.ndarray]:
    """An n_lines x BANDS array of band signatures from 32-bit hashes, whose highest bits pick the value that they compete for; every line needs a shingle.

    And of each line how many values its own shingles filled: it has that many distinct ones at least.
    """
    k = BANDS * ROWS
    values = np.full(n_lines * k, _EMPTY, dtype=np.uint32)
    np.minimum.at(values, line * np.int64(k) + (h >> np.uint32(32 - k.bit_length() + 1)), h)
    out = values.reshape(n_lines, k)
    filled = np.count_nonzero(out != _EMPTY, axis=1)
    sparse = np.flatnonzero(filled < k)
    if len(sparse):
        part = out[sparse]
        full, at = part != _EMPTY, np.arange(k)
        left = np.maximum.accumulate(np.where(full, at, -1), axis=1)
        left = np.where(left < 0, left[:, -1:], left)
        right = np.minimum.accumulate(np.where(full, at, k)[:, ::-1], axis=1)[:, ::-1]
        right = np.where(right == k, right[:, :1], right)
        go_left = (mix(at.astype(U64)) & U64(1)).astype(bool)
        pick = np.where(full, at, np.where(go_left, left, right))
        out[sparse] = np.take_along_axis(part, pick, axis=1) + ((at - pick) % k).astype(np.uint32) * np.uint32(0x9E3779B9)
    bands = np.zeros((n_lines, BANDS), dtype=U64)
    for r in range(ROWS):
        bands = mix(bands * _C[1] + out[:, r::ROWS].astype(U64))
    return mix(bands + np.arange(BANDS).astype(U64) * _C[2]), filled


def prefix_signatures(h: np.ndarray, line: np.ndarray, most: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, line of each) of lines of at most `most` distinct shingles: two sets that are similar share one, whatever their sizes.

    Similar sets share num / den of either, so the `take` least hashes that they share are among the n - ceil(n * num / den) + take least of a set of n. A signature is of
    `take` hashes of that prefix: two, if all similar sets of more than one shingle share two.
    """
    take = 2 if 2 * num > den else 1
    order = np.lexsort((h, line))
    h, line = h[order], line[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
    h, line = h[new].astype(U64), line[new]
    owner, first, n = np.unique(line, return_index=True, return_counts=True)
    few = n <= most
    owner, first, n = owner[few], first[few], n[few]
    prefix = np.minimum(n, n - -(-n * num // den) + take)
    sigs, owners = [], []
    for i in range(int(prefix.max(initial=0))):
        rows = np.flatnonzero(prefix > i)
        one = mix(h[first[rows] + i] + _C[0])
        if take == 1:
            sigs.append(one), owners.append(owner[rows])
            continue
        alone = n[rows] == 1
        sigs.append(one[alone]), owners.append(owner[rows[alone]])
        for j in range(i + 1, int(prefix.max())):
            more = prefix[rows] > j
            sigs.append(mix(one[more] * _C[1] + h[first[rows[more]] + j])), owners.append(owner[rows[more]])
    return np.concatenate([np.zeros(0, dtype=U64), *sigs]), np.concatenate([np.zeros(0, dtype=np.int64), *owners])


_PLACES = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("number", pa.int64())])


def _index(least: int, buckets: int, shorter: bool, num: int, den: int):
    """documents (doc_id, text) to packed band signatures, with all occurrences of lines as riders."""

    # no line that is similar to a shorter one has more distinct shingles
    most = max(0, least - WIDTH) * den // num if shorter else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(buckets)
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for first, last in slices(offsets, 2 << 20):
                keys, sigs, owners, seen = [], [], [], 0
                for a, b in slices(offsets[first : last + 1], 1 << 19):
                    a, b = a + first, b + first
                    lines = Lines(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    rows = lines.chosen(least, shorter)
                    if not len(rows):
                        continue
                    ids = batch.column(0).slice(a, b - a).take(pa.array(lines.doc[rows]))
                    yield riders(pa.RecordBatch.from_arrays([pa.array(lines.key[rows].view(np.int64)), ids, pa.array(lines.number[rows] | (lines.check[rows] << 32))], schema=_PLACES), int(lines.key[rows[0]] % U64(buckets)))
                    _, once = np.unique(lines.key[rows], return_index=True)
                    rows = rows[np.sort(once)]
                    h, line = lines.windows(rows, np.uint32)
                    long = int(np.count_nonzero(lines.chars[rows] >= max(least, WIDTH)))  # they come first
                    cut = np.searchsorted(line, long)
                    bands, filled = minhash_bands(h[:cut], line[:cut], long)
                    sigs.append(bands.ravel()), owners.append(np.repeat(np.arange(long), BANDS) + seen)
                    if most:
                        few = np.append(filled <= most, np.ones(len(rows) - long, dtype=bool))[line]
                        sig, owner = prefix_signatures(h[few], line[few], most, num, den)
                        sigs.append(sig), owners.append(owner + seen)
                    keys.append(lines.key[rows])
                    seen += len(rows)
                if sum(map(len, sigs)):
                    yield from packer.add(np.concatenate(sigs), np.concatenate(owners), np.concatenate(keys), np.ones(seen, dtype=np.int64))
        yield from packer.flush()

    return run


def _find(most: int, num: int, den: int):
    """Candidates; and, with a null in hot, occurrences as (a: key, b: doc_id, na: line number with the check above it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: list[pa.RecordBatch] = []
        for rows in split_riders(batches, blobs):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(rows), pa.bool_()), *rows.columns, pa.nulls(len(rows), pa.int64())], schema=PAIRS)
        yield from candidates(iter(blobs), most, num, den)

    return run


_TEXTS = pa.schema([("key", pa.int64()), ("check", pa.int64()), ("line", pa.string())])


def _texts(least: int, wanted: Bitmap, shorter: bool):
    """The lines, once for each batch, that may be wanted."""
    shared, mask = wanted.shared, (1 << wanted.bits) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            for a, b in slices(offsets, 1 << 19):
                lines = Lines(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                rows = lines.chosen(least, shorter)
                _, once = np.unique(lines.key[rows], return_index=True)
                rows = rows[once]
                at = mix(lines.key[rows]).view(np.int64) & mask
                rows = rows[((shared.value[at >> 6] >> (at & 63)) & 1) == 1]
                raw = lines.data.tobytes()
                texts = [raw[lines.start[i] : lines.end[i]].decode("utf-8", "replace") for i in rows]
                yield pa.RecordBatch.from_arrays([pa.array(lines.key[rows].view(np.int64)), pa.array(lines.check[rows]), pa.array(texts, pa.string())], schema=_TEXTS)

    return run


_SETS = pa.schema([("key", pa.int64()), ("check", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary()), ("payload", pa.binary())])


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of lines, given as UTF-8."""
    data, offsets = text_buffer(texts)
    lines = Lines(data, offsets)
    h, line = lines.windows(np.arange(len(lines.start)), U64)
    cuts = np.searchsorted(line, np.arange(len(lines.start) + 1))
    for i in range(len(lines.start)):
        h[cuts[i] : cuts[i + 1]].sort()
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
    kept = np.concatenate([[0], np.cumsum(keep)])[cuts]
    h = h[keep]
    return [h[kept[i] : kept[i + 1]] for i in range(len(lines.start))]


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("line").cast(pa.binary())
        for a in range(0, len(texts), 2048):
            part = texts.slice(a, 2048)
            sets = shingle_sets(part)
            yield pa.RecordBatch.from_arrays([batch.column("key").slice(a, 2048), batch.column("check").slice(a, 2048), pa.array([len(x) for x in sets], pa.int64()), pa.array([odd_sketch(x) for x in sets], pa.binary()), part], schema=_SETS)


def line_index(docs: DataFrame, num: int = 75, den: int = 100, least: int = LEAST_CHARS, most_shared: int = 32, shorter: bool = False, buckets: int | None = None) -> DataFrame:
    """docs (doc_id long, text string) to candidates and occurrences, checkpointed. Lines of fewer than `least` characters only count with `shorter`, blank ones never."""
    buckets = buckets or buckets_for(docs)
    packed = docs.mapInArrow(lean(_index(least, buckets, shorter, num, den)), PACKED_DDL).repartition(buckets, by_bucket())
    return checkpointed(packed.mapInArrow(lean(_find(most_shared, num, den)), PAIRS_DDL))


def line_components(texts: DataFrame, index: DataFrame, num: int = 75, den: int = 100, least: int = LEAST_CHARS, shorter: bool = False) -> DataFrame:
    """texts (text string) and their line_index to (key, component, check) of the lines that are similar to another line."""
    found = index.where("hot is not null")
    keys = found.select(F.explode(F.when(F.col("hot"), F.array("b")).otherwise(F.array("a", "b"))).alias("key")).distinct()
    wanted = Bitmap(keys.select(_mixed("key").alias("at")), "at", hashed=True)
    lines = texts.mapInArrow(lean(_texts(least, wanted, shorter)), "key long, check long, line string").join(keys, "key", "left_semi").dropDuplicates(["key"])
    sets = checkpointed(lines.mapInArrow(lean(_sets), "key long, check long, n long, sketch binary, payload binary"))
    groups = checkpointed(probable_groups(found, sets, num, den, fold=False)).withColumnRenamed("node", "key")
    labels = exact_groups(checkpointed(sets.join(groups, "key").select("component", "key", "payload", "degree")), num, den, decode=shingle_sets)
    return labels.withColumnRenamed("node", "key").join(sets.select("key", "check"), "key")


def _mixed(column: str):
    @F.arrow_udf("bigint")
    def mixed(x: pa.Array) -> pa.Array:
        return pa.array(mix(x.to_numpy(zero_copy_only=False).view(U64)).view(np.int64))

    return mixed(column)


def repeated_lines(docs: DataFrame, num: int = 75, den: int = 100, least: int = LEAST_CHARS, shorter: bool = False, buckets: int | None = None) -> DataFrame:
    """docs (doc_id, text) to (doc_id, number, first_doc_id, first_number): the lines that go, by line number from 0, and the one that stays for them.

    Null texts have no lines; lines of null doc_ids are left alone, as are those shorter than `least` characters unless `shorter` is set, and shorter blank ones. Of rows that repeat a doc_id, a line number stands for
    the lines of that number in all of them. buckets: reduce tasks for signatures, if not by the estimated size of docs.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    index = line_index(source, num, den, least, shorter=shorter, buckets=buckets)
    labels = line_components(source.select("text"), index, num, den, least, shorter)
    places = index.where("hot is null and b is not null").select(F.col("a").alias("key"), F.shiftright("na", 32).alias("check"), F.col("b").alias("doc_id"), (F.col("na") % (1 << 32)).alias("number"))
    at, alone = F.struct("doc_id", "number"), F.when(F.col("component").isNull(), F.col("check")).otherwise(-1)
    lines = places.groupBy("key", "check").agg(F.min(at).alias("first"), F.count("*").alias("n")).join(labels, ["key", "check"], "left").withColumns({"label": F.coalesce("component", "key"), "alone": alone})
    firsts = lines.groupBy("label", "alone").agg(F.min("first").alias("kept"), F.sum("n").alias("n")).where("n > 1")
    many = checkpointed(lines.join(firsts.drop("n"), ["label", "alone"]).select("key", "check", "kept"))
    gone = places.join(many, ["key", "check"]).where(at != F.col("kept"))
    return gone.select("doc_id", "number", F.col("kept.doc_id").alias("first_doc_id"), F.col("kept.number").alias("first_number")).distinct()


def dedup_lines(docs: DataFrame, num: int = 75, den: int = 100, least: int = LEAST_CHARS, drop_emptied: bool = True, shorter: bool = False) -> DataFrame:
    """docs (text, ...) without repeated lines, with the same columns. drop_emptied: rows whose text had lines and has only white space left go.

    Rows count by their place in the table, whatever their doc_id, which may be null or repeated: of equal or similar lines that of the first row stays, and of rows that
    are equal one stays. Texts that lose no line stay as they are, byte for byte.
    """
    names = docs.columns
    rows = numbered(docs)
    gone = checkpointed(repeated_lines(rows.select(F.col("__row").alias("doc_id"), "text"), num, den, least, shorter, buckets_for(docs.select("text"))).groupBy("doc_id").agg(F.collect_set("number").alias("__gone")).withColumnRenamed("doc_id", "__id"))
    touched = Bitmap(gone, "__id")
    marked = rows.withColumn("__touched", F.coalesce(touched.has(F.xxhash64(F.col("__row"))), F.lit(False)))
    lines = F.split("text", "\n")
    left = F.array_join(F.filter(F.transform(lines, lambda x, i: F.when(~F.array_contains("__gone", i.cast("long")), x)), lambda x: x.isNotNull()), "\n")
    joined = marked.where("__touched").join(gone, F.col("__row") == F.col("__id"), "left")
    cut = joined.withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(left))
    if drop_emptied:
        cut = cut.where(F.col("__gone").isNull() | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    return marked.where("not __touched").select(*names).unionByName(cut.select(*names))
