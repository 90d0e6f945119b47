"""N-gram Jaccard join: universe-partition pigeonhole with one-deletion neighbourhoods.

Each text is a set of hashed word shingles. Sets of a size band share a segmentation: the hash universe is cut into m
ranges. Sets a and b with Jaccard >= num/den differ in at most H = (den - num) * (|a| + |b|) // (den + num) elements, so of any
H + 1 segments one agrees. A segment for which both sides also index all subsets with one element left out counts twice, as
it takes two differences to part such segments. Segments that are empty match everything, so a set passes them over and takes the
next ones; a set that runs out of segments indexes the empty ones too. `allocate` picks m and the number of
neighbourhood segments of each band by estimated cost: rows indexed against expected chance matches.

Candidates are then verified: first by odd sketches (the parity of hashed elements; the popcount of two sketches' XOR
is a lower bound of the sets' difference, so no link is lost), then exactly on the whole shingle sets.
Equal sets are one node throughout. Only components are built from links; copies never expand into pairs.

Memory: a map task holds one Arrow batch and some MB of sketches; a reduce task one bucket of packed signatures (their number follows the table's size), decoded a slice at a time. The sets of a signature
that more than `most_shared` distinct sets share, and groups of near copies, are compared with representatives, round by round (see similar_sets).

Sets are compared through 64-bit hashes of whole shingles and sets are told apart by 64 + 31 bits of two hashes. Of different sets with one 64-bit key, of
which a table of 10**10 texts has two or three, only one is searched for near copies; none is taken for the other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_WORDS, U64, Bitmap, Words, checkpointed, lean, mix, set_keys, shingle_hashes, slices, text_buffer, wide_buckets_for
from .components import connected_components
from .packed import PACKED_DDL, PAIR_BLOBS, Packer, by_bucket, candidates, pair_blobs, pairs_of_blobs, riders, split_riders
from .similar_sets import differences, exact_groups, odd_sketch, probable_groups

BAND_GROWTH = 1.6
MOST_SHARED = 32
#: Signatures that a reduce task decodes at once; sketches that a map task holds until it sends them on.
MOST_DECODED, MOST_HELD = 1 << 19, 8 << 20
_SEG, _BAND = U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB)


def bands(largest: int, num: int, den: int) -> list[tuple[int, int]]:
    """(least, most) size of each band; wide enough that partners are at most one band away."""
    growth, out, low = max(BAND_GROWTH, den / num), [], 1
    while low <= largest:
        high = max(low, int(low * growth), low * den // num)
        out.append((low, high))
        low = high + 1
    return out


@lru_cache(maxsize=4096)
def allocate(high: int, need: int, log_sets: int) -> tuple[int, int]:
    """(segments, neighbourhood segments at the front) of a band; need: credits that its largest pairs ask for.

    cost = rows indexed + 0.4 for each chance candidate. A segment of c elements is taken to meet N * 0.0003**c others by chance, `MOST_SHARED`
    at most, as more are compared in blocks.
    """
    best = None
    for slack in (1.15, 1.35, 1.6):
        for share in (0.0, 0.0625, 0.125, 0.25, 0.5, 1.0):
            m = 1
            while m + math.floor(share * m) < need * slack:
                m += max(1, m // 16)
            double, c = math.floor(share * m), high / m
            chance = lambda k: min(MOST_SHARED, 10.0**log_sets * 0.0003**k)
            rows = matches = 0.0
            p = math.exp(-c)
            for k in range(1, 40):
                p *= c / k
                rows += p * ((m - double) + double * (1 + k * (k > 1)))
                matches += p * ((m - double) * chance(k) + double * (chance(k) + k * chance(max(1, k - 1)) * (k > 1)))
            spent = min(1.0, need / max(1e-9, (m + double) * (1 - math.exp(-c))))
            cost = rows * spent + matches * spent * 0.4 + 2 * m * math.exp(-c)
            if best is None or cost < best[0]:
                best = cost, m, double
    return best[1], best[2]


def signatures(h: np.ndarray, offsets: np.ndarray, num: int, den: int, log_sets: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, row) of all rows' sets; see the module's text."""
    sizes = np.diff(offsets)
    if not len(h):
        return np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
    cuts = bands(int(sizes.max()) * den // num + 1, num, den)
    lows, highs = np.array([x[0] for x in cuts]), np.array([x[1] for x in cuts])
    plan = np.array([allocate(b, int(differences(b, b, num, den)) + 1, log_sets) for _, b in cuts])
    own = np.searchsorted(lows, np.maximum(sizes, 1), "right") - 1
    out_sig, out_row = [], []
    for step in (0, 1):  # the segmentation of the own band; that of the next one, where larger partners are
        band = own + step
        rows = np.flatnonzero((sizes > 0) & (sizes * den // num >= lows[np.minimum(band, len(cuts) - 1)]) & (band < len(cuts)))
        if not len(rows):
            continue
        n, band = sizes[rows], band[rows]
        m, double = plan[band, 0], plan[band, 1]
        need = differences(n, np.minimum(highs[band], n * den // num), num, den) + 1
        total = int(n.sum())
        at = np.repeat(offsets[rows] - (np.cumsum(n) - n), n) + np.arange(total)
        x, r = h[at], np.repeat(np.arange(len(rows)), n)
        seg = ((x >> U64(32)) * m[r].astype(U64)) >> U64(32)
        new = np.ones(total, dtype=bool)
        new[1:] = (r[1:] != r[:-1]) | (seg[1:] != seg[:-1])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, total))
        sr, sn = r[start], seg[start].astype(np.int64)
        y = mix(x ^ _SEG)
        sums = np.add.reduceat(y, start)
        twice = (sn < double[sr]) & (size > 1)
        credit = 1 + twice.astype(np.int64)
        run = np.cumsum(credit)
        first = np.searchsorted(sr, np.arange(len(rows)))
        run -= (run[first] - credit[first])[sr]
        used = run - credit < need[sr]
        salt = mix(sn.astype(U64) * _SEG + band[sr].astype(U64) * _BAND)
        out_sig.append(mix(sums[used] ^ salt[used]))
        out_row.append(rows[sr[used]])
        wide = np.repeat(used & twice, size)
        if wide.any():
            group = np.repeat(np.arange(len(start)), size)[wide]
            out_sig.append(mix((sums[group] - y[wide]) ^ salt[group]))
            out_row.append(rows[sr[group]])
        last = np.append(first[1:], len(sr)) - 1
        short = np.flatnonzero(run[last] < need)
        for i in short:  # too few segments hold elements: the empty ones count too
            gone = np.setdiff1d(np.arange(m[i]), sn[first[i] : last[i] + 1])
            out_sig.append(mix(U64(0) ^ mix(gone.astype(U64) * _SEG + band[i : i + 1].astype(U64) * _BAND)))
            out_row.append(np.full(len(gone), rows[i]))
            single = np.flatnonzero((sn[first[i] : last[i] + 1] < double[i]) & (size[first[i] : last[i] + 1] == 1)) + first[i]
            out_sig.append(mix(U64(0) ^ salt[single]))
            out_row.append(np.full(len(single), rows[i]))
    return np.concatenate(out_sig), np.concatenate(out_row)


def _index(width: int, num: int, den: int, buckets: int, log_sets: int):
    """documents (doc_id, text) to packed signatures and, in bucket -1 - b, packed rows of documents and of nodes, these in the bucket of their key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, nodes, held = Packer(buckets), [], 0
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            ids = batch.column(0)
            for a, b in slices(offsets, 2 << 20):
                part = offsets[a : b + 1] - offsets[a]
                h, at = shingle_hashes(Words(data[offsets[a] : offsets[b]], part, SPACE_WORDS), width)
                (keys, check), n = set_keys(h, at), np.diff(at)
                own, told = ids.slice(a, b - a), n | (check << 32)
                yield riders(pa.RecordBatch.from_arrays([own, pa.array(keys.view(np.int64)), pa.array(told)], schema=_MEMBERS), int(keys[0] % U64(buckets)))
                named = np.flatnonzero(own.is_valid().to_numpy(zero_copy_only=False) & (n > 0))
                doc = own.fill_null(0).to_numpy(zero_copy_only=False)
                named = named[np.lexsort((doc[named], told[named], keys[named]))]
                once = np.flatnonzero(np.append(True, keys[named][1:] != keys[named][:-1]))[: len(named)]  # equal sets of a batch are indexed once
                first = named[once]
                chosen = np.zeros(len(keys), dtype=bool)
                chosen[first] = True
                if len(first):
                    sketches = [odd_sketch(h[at[i] : at[i + 1]]) for i in first]
                    most = np.maximum.reduceat(told[named], once)
                    nodes.append(pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(keys[first].view(np.int64)), pa.array(told[first]), pa.array(most), pa.array(sketches, pa.binary())], schema=_NODES))
                    held += sum(map(len, sketches))
                if held >= MOST_HELD:
                    yield from _dealt(_one_each(nodes), buckets)
                    nodes, held = [], 0
                keep = np.repeat(chosen, n)
                sub = np.concatenate([[0], np.cumsum(n[chosen])])
                sigs, owner = signatures(h[keep], sub, num, den, log_sets)
                yield from packer.add(sigs, owner, keys[chosen], n[chosen])
        yield from packer.flush()
        yield from _dealt(_one_each(nodes), buckets)

    return run


#: Rows of documents and of distinct keys; n holds the set's size and, above it, the check. Of a key's sets `n` is the least, with its least doc_id, and `most` the largest.
_MEMBERS = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64())])
_NODES = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("most", pa.int64()), ("sketch", pa.binary())])
_FOUND = pa.schema([*_MEMBERS, *(f for f in _NODES if f.name not in _MEMBERS.names), *PAIR_BLOBS])
_FOUND_DDL = "doc_id long, key long, n long, node long, most long, sketch binary, hot boolean, pairs binary"


def _one_each(nodes: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Rows of nodes, one for each key."""
    table = pa.Table.from_batches(nodes, schema=_NODES).combine_chunks()
    if not len(table):
        return pa.RecordBatch.from_pylist([], schema=_NODES)
    doc, node, n, most = (table.column(i).to_numpy() for i in range(4))
    order = np.lexsort((doc, n, node))
    first = np.flatnonzero(np.append(True, node[order][1:] != node[order][:-1]))
    rows = table.take(pa.array(order[first])).set_column(3, _NODES.field("most"), pa.array(np.maximum.reduceat(most[order], first)))
    return rows.combine_chunks().to_batches()[0]


def _dealt(nodes: pa.RecordBatch, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of nodes as riders of the buckets of their keys, so that all of a key meet in one task."""
    bucket = (nodes.column(1).to_numpy().view(U64) % U64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    ids, at = np.unique(bucket[order], return_index=True)
    for k, a, b in zip(ids.tolist(), at, [*at[1:], len(order)], strict=False):
        yield riders(nodes.take(pa.array(order[a:b])), k)


def _padded(rows: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([rows.column(f.name) if f.name in rows.schema.names else pa.nulls(len(rows), f.type) for f in _FOUND], schema=_FOUND)


def _find(most: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: list[pa.RecordBatch] = []
        nodes: list[pa.RecordBatch] = []
        for rows in split_riders(batches, blobs):
            if "node" in rows.schema.names:
                nodes.append(rows)
            else:
                yield _padded(rows)
        one = _one_each(nodes)
        nodes.clear()
        for i in range(0, len(one), 1024):
            yield _padded(one.slice(i, 1024))
        for pairs in candidates(iter(blobs), most, num, den, MOST_DECODED):
            yield _padded(pair_blobs(pairs))

    return run


def shingle_sets(width: int):
    """A decoder of texts in UTF-8 to their sorted distinct shingle hashes."""

    def decode(texts: pa.Array) -> list[np.ndarray]:
        data, offsets = text_buffer(texts)
        out = []
        for a, b in slices(offsets, 2 << 20):
            h, at = shingle_hashes(Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], SPACE_WORDS), width)
            out += [h[at[i] : at[i + 1]] for i in range(b - a)]
        return out

    return decode


def _keyed(width: int):
    """The key of a text's set, and its size with the check."""

    @F.arrow_udf("key bigint, n bigint")
    def keyed(texts: pa.Array) -> pa.Array:
        data, offsets = text_buffer(texts)
        out = [(np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64))]
        for a, b in slices(offsets, 2 << 20):
            h, at = shingle_hashes(Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], SPACE_WORDS), width)
            keys, check = set_keys(h, at)
            out.append((keys, np.diff(at) | (check << 32)))
        keys, told = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.StructArray.from_arrays([pa.array(keys.view(np.int64)), pa.array(told)], names=["key", "n"])

    return keyed.asNondeterministic()("text")  # else the optimizer asks for keys that aren't null of all texts, before any filter


def ngram_jaccard_components(docs: DataFrame, width: int = 5, num: int = 75, den: int = 100, most_shared: int = MOST_SHARED, few: int = 256, many: int = 4096, buckets: int | None = None) -> DataFrame:
    """docs (doc_id long, text string, ...) to one row (doc_id, n_shingles, component_id) for each.

    Two rows link when den * |intersection| >= num * |union| of their distinct `width`-word shingles (lower-cased A-Z,
    words parted by ASCII white space; a shorter text is one shingle). component_id: the least doc_id reachable.
    Null and empty texts: n_shingles 0, their own component. A null doc_id has no component. Rows that repeat a doc_id each get a row.
    Columns other than doc_id and text are not read. buckets: reduce tasks for signatures, if not by the estimated size of docs.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    log_sets = max(1, math.ceil(math.log10(max(10, source.select("doc_id").count()))))
    buckets = buckets or wide_buckets_for(docs)
    packed = source.mapInArrow(lean(_index(width, num, den, buckets, log_sets)), PACKED_DDL)
    found = checkpointed(packed.repartition(buckets, by_bucket()).mapInArrow(lean(_find(most_shared, num, den)), _FOUND_DDL))

    members = found.where("key is not null").select("doc_id", "key", "n")
    nodes = found.where("node is not null").select(F.col("node").alias("key"), (F.col("n") % (1 << 32)).alias("n"), F.col("n").alias("own"), "most", "doc_id", "sketch")
    pairs = found.where("pairs is not null").select("hot", "pairs").mapInArrow(lean(pairs_of_blobs), "hot boolean, a long, b long")
    groups = checkpointed(probable_groups(pairs, nodes, num, den, few, many))

    wanted = checkpointed(groups.join(nodes.select(F.col("key").alias("node"), "doc_id", "own"), "node").select("doc_id", F.col("node").alias("key"), F.col("own").alias("n"), "component", "degree"))
    maybe = source.where(Bitmap(wanted, "doc_id").has(F.xxhash64("doc_id")))  # spares most texts the shuffle
    keyed = maybe.withColumn("of", _keyed(width)).select("doc_id", F.col("of.key").alias("key"), F.col("of.n").alias("n"), "text")  # after a repeated doc_id some texts have another key
    texts = keyed.join(wanted, ["doc_id", "key", "n"]).dropDuplicates(["doc_id", "key", "n"])  # texts are shuffled once, for both
    sets = checkpointed(texts.select("component", "key", "degree", F.col("text").cast("binary").alias("payload")))
    labels = exact_groups(sets, num, den, decode=shingle_sets(width)).select(F.col("node").alias("key"), F.col("component").alias("label"))

    known = nodes.select("key", "own", "doc_id").join(labels, "key", "left").select("key", "own", "doc_id", F.coalesce("label", "key").alias("label"))
    least = known.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of_key = known.join(least, "label").select("key", F.col("own").alias("n"), "component_id")
    if nodes.where("own != most").limit(1).count():  # other sets have the key of one: each of them is a group of its own
        others = members.where("n > 0 and doc_id is not null").join(nodes.select("key", F.col("own").alias("n")), ["key", "n"], "left_anti")
        of_key = of_key.unionByName(others.groupBy("key", "n").agg(F.min("doc_id").alias("component_id")).select("key", "n", "component_id"))
    own = F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id"))
    return members.join(of_key, ["key", "n"], "left").select("doc_id", (F.col("n") % (1 << 32)).alias("n_shingles"), own.alias("component_id"))
