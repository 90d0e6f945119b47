"""A shuffle of packed signatures: one row for each batch and bucket instead of one for each signature.

A map task turns its batch's (signature, node) pairs into binary blobs, one for each bucket of signatures; a blob
holds 4 bytes of each signature, a 4-byte index into its table of nodes, and that table (node, size).
Two signatures that agree in bucket and 4 bytes only make a false candidate, which verification drops.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import U64

NODE = np.dtype([("node", "<u8"), ("size", "<u4")])
PACKED = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])
PACKED_DDL = "bucket int, blob binary"


class Packer:
    """Gathers (signature, node) pairs of a task's batches until a blob for each bucket is worth its header: 16 signatures a bucket, at most some 100 MB."""

    def __init__(self, buckets: int):
        self.buckets, self.parts, self.held, self.nodes = buckets, [], 0, 0

    def add(self, sigs: np.ndarray, owners: np.ndarray, nodes: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((sigs, owners + self.nodes, nodes, sizes))
        self.held, self.nodes = self.held + len(sigs), self.nodes + len(nodes)
        if self.held >= 16 * self.buckets:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            yield pack(*(np.concatenate(x) for x in zip(*self.parts, strict=True)), self.buckets)
        self.parts, self.held, self.nodes = [], 0, 0


def pack(sigs: np.ndarray, owners: np.ndarray, nodes: np.ndarray, sizes: np.ndarray, buckets: int) -> pa.RecordBatch:
    """sigs: 64 bits each; owners: index into nodes for each."""
    bucket = (sigs >> U64(32)) % U64(buckets)
    order = np.argsort((bucket << U64(32)) | (sigs & U64(0xFFFFFFFF)))
    bucket, low, owners = bucket[order].astype(np.int64), (sigs[order] & U64(0xFFFFFFFF)).astype("<u4"), owners[order]
    ids, at = np.unique(bucket, return_index=True)
    blobs = []
    for a, b in zip(at, [*at[1:], len(bucket)], strict=True):
        used, index = np.unique(owners[a:b], return_inverse=True)
        table = np.empty(len(used), dtype=NODE)
        table["node"], table["size"] = nodes[used], sizes[used]
        blobs.append(np.array([b - a, len(used)], dtype="<u4").tobytes() + low[a:b].tobytes() + index.astype("<u4" if len(used) > 65535 else "<u2").tobytes() + table.tobytes())
    return pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(blobs, pa.binary())], schema=PACKED)


def unpack(bucket: int, blob: bytes, least: int = 0, below: int = 1 << 32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket and signature, node, size) of each signature in a blob whose 4 bytes lie in that range."""
    n, used = np.frombuffer(blob, dtype="<u4", count=2)
    wide = "<u4" if used > 65535 else "<u2"
    low = np.frombuffer(blob, dtype="<u4", count=n, offset=8)
    index = np.frombuffer(blob, dtype=wide, count=n, offset=8 + 4 * int(n))
    table = np.frombuffer(blob, dtype=NODE, count=used, offset=8 + (4 + np.dtype(wide).itemsize) * int(n))
    if least > 0 or below < 1 << 32:
        a, b = (int(np.searchsorted(low, np.uint32(x))) if x < 1 << 32 else len(low) for x in (least, below))  # a blob is in their order
        low, index = low[a:b], index[a:b]
    return low.astype(U64) | (U64(bucket) << U64(32)), table["node"][index], table["size"][index]


def _sliced(bucket: int, blobs: list[bytes], most: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The blobs of a bucket in slices of about `most` signatures; those of one signature are in one slice."""
    total = sum(int(np.frombuffer(x, dtype="<u4", count=1)[0]) for x in blobs)
    parts = 1 if most is None else max(1, -(-total // most))
    for i in range(parts):
        found = [unpack(bucket, x, (i << 32) // parts, ((i + 1) << 32) // parts) for x in blobs]
        yield tuple(np.concatenate(x) for x in zip(*found, strict=True))


def riders(rows: pa.RecordBatch, bucket: int) -> pa.RecordBatch:
    """Other rows that travel with the signatures of a batch: they come out of split_riders in the task of this bucket."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as writer:
        writer.write_batch(rows)
    return pa.RecordBatch.from_arrays([pa.array([-1 - bucket], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], schema=PACKED)


def split_riders(batches: Iterator[pa.RecordBatch], blobs: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The riders of a task's rows; the packed signatures are appended to blobs."""
    for batch in batches:
        kinds = batch.column(0).to_numpy()
        for i in np.flatnonzero(kinds < 0):
            with pa.ipc.open_stream(batch.column(1)[int(i)].as_py()) as reader:
                yield from reader
        blobs.append(batch.filter(pa.array(kinds >= 0)))


def by_bucket() -> Column:
    return F.when(F.col("bucket") < 0, -1 - F.col("bucket")).otherwise(F.col("bucket"))


PAIRS = pa.schema([("hot", pa.bool_()), ("a", pa.int64()), ("b", pa.int64()), ("na", pa.int64()), ("nb", pa.int64())])
PAIRS_DDL = "hot boolean, a long, b long, na long, nb long"


#: Pairs that a task holds before it drops repeated ones and yields them.
MOST_PAIRS = 2_000_000


def _distinct(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    a, b, na, nb = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((b, a))
    a, b, na, nb = a[order], b[order], na[order], nb[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return pa.RecordBatch.from_arrays([pa.array(np.zeros(int(new.sum()), dtype=bool)), *(pa.array(x[new].astype(np.int64)) for x in (a.view(np.int64), b.view(np.int64), na, nb))], schema=PAIRS)


PAIR_BLOBS = pa.schema([("hot", pa.bool_()), ("pairs", pa.binary())])


def pair_blobs(pairs: pa.RecordBatch, most: int = 4096) -> pa.RecordBatch:
    """Rows of candidates, all hot or none, in blobs of 16 bytes a pair (a, b)."""
    ab = np.stack([pairs.column(1).to_numpy(), pairs.column(2).to_numpy()]).astype("<i8")
    blobs = [ab[:, i : i + most].tobytes() for i in range(0, ab.shape[1], most)]
    return pa.RecordBatch.from_arrays([pa.array(pairs.column(0).slice(0, 1).to_pylist() * len(blobs), pa.bool_()), pa.array(blobs, pa.binary())], schema=PAIR_BLOBS)


def pairs_of_blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """pair_blobs to rows (hot, a, b)."""
    for batch in batches:
        for hot, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            a, b = np.frombuffer(blob.as_py(), dtype="<i8").reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), hot)), pa.array(a), pa.array(b)], names=["hot", "a", "b"])


def candidates(batches: Iterator[pa.RecordBatch], most: int, num: int, den: int, most_decoded: int | None = None) -> Iterator[pa.RecordBatch]:
    """Candidate pairs (hot false: node a < node b as unsigned, and sizes) of signatures that at most `most` nodes share.

    A signature that more nodes share yields a row for each of them instead (hot true: a is the least of its nodes, b a node, nb its size); signatures with the same least node, which near
    copies have many of, yield the rows of one group. Pairs whose sizes rule out den * min >= num * max are dropped.
    A bucket's signatures are decoded at once, or about most_decoded of them; its pairs are told once for each MOST_PAIRS.
    """
    parts: dict[int, list[bytes]] = {}
    for batch in batches:
        for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parts.setdefault(k, []).append(blob)
    while parts:
        yield from _of_bucket(*parts.popitem(), most, num, den, most_decoded)


def _of_bucket(bucket: int, blobs: list[bytes], most: int, num: int, den: int, most_decoded: int | None) -> Iterator[pa.RecordBatch]:
    found, held = [], 0
    for sig, node, size in _sliced(bucket, blobs, most_decoded):
        order = np.argsort(sig)
        sig = sig[order]
        same = sig[1:] == sig[:-1]
        more = np.append(same, False) | np.append(False, same)  # most signatures have one node and end here
        sig, order = sig[more], order[more]
        node, size = node[order], size[order]
        order = np.lexsort((node, sig))
        sig, node, size = sig[order], node[order], size[order]
        new = np.ones(len(sig), dtype=bool)
        new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
        sig, node, size = sig[new], node[new], size[new]
        starts = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])) if len(sig) else np.zeros(0, dtype=np.int64)
        counts = np.diff(np.append(starts, len(sig)))
        shared = np.repeat(counts, counts)
        hot = shared > most
        if hot.any():
            hub, key, n = np.repeat(node[starts], counts)[hot], node[hot], size[hot].astype(np.int64)  # nodes are in order within a signature
            order = np.lexsort((key, hub))
            hub, key, n = hub[order], key[order], n[order]
            new = np.ones(len(hub), dtype=bool)
            new[1:] = (hub[1:] != hub[:-1]) | (key[1:] != key[:-1])
            hub, key, n = hub[new], key[new], n[new]
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(hub), dtype=bool)), pa.array(hub.view(np.int64)), pa.array(key.view(np.int64)), pa.array(np.zeros(len(hub), dtype=np.int64)), pa.array(n)], schema=PAIRS)
        some = (shared > 1) & ~hot
        sig, node, size = sig[some], node[some], size[some].astype(np.int64)
        for d in range(1, most):
            if d >= len(sig):
                break
            same = np.flatnonzero(sig[d:] == sig[:-d])
            if not len(same):
                break
            a, b = same, same + d
            near = np.minimum(size[a], size[b]) * den >= np.maximum(size[a], size[b]) * num
            a, b = a[near], b[near]
            found.append((node[a], node[b], size[a], size[b]))
            held += len(a)
        if held >= MOST_PAIRS:
            yield _distinct(found)
            found, held = [], 0
    if found:
        yield _distinct(found)
