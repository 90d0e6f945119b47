"""From candidate pairs of sets to exact groups: odd sketches first, then whole sets; neither expands a group into all its pairs.

A set is a sorted array of distinct 64-bit hashes with a 64-bit key. Sets a and b link when den * |intersection| >= num * |union|.

The sets of hot signatures that have the same least set are compared with each other by sketch in one block, up to `many` of them. A larger group of n sets, or one that sketches can't part, is compared
with one representative first. Sets that aren't connected to it by then give further representatives, round by round and eight times as many each time, those with most probable links first, as
an original has that many of its copies link to; each is compared with the whole group; what is connected to the first one in between needs no comparison of its own. So a large group of near copies costs n comparisons
for each representative, not n * n; only sets that link to nothing are each compared with their whole group in the end, as they have to be.

Blocks are bounded in rows and in bytes (MOST_BYTES on either side, or one set), and whole sets are decoded a slice of SLICE_BYTES at a time, so that groups of very long texts take
more blocks instead of more memory.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, Bitmap, checkpointed, lean, slices
from .components import connected_components

Decoder = Callable[[pa.Array], list[np.ndarray]]

MOST_BYTES, SLICE_BYTES = 16 << 20, 2 << 20
#: Of the sketches by which sets of a block are told apart before they are compared.
MOST_BITS = 4096


def differences(a, b, num: int, den: int):
    """The most elements in which sets of these sizes differ at that similarity."""
    return (den - num) * (a + b) // (den + num)


def sketch_bits(n: int) -> int:
    return 64 << max(0, math.ceil(math.log2(max(1, n * 4.8 / 64))))


def odd_sketch(h: np.ndarray) -> bytes:
    """The parity of hashed elements, in a power of two of at least 4.8 bits for each, which tells similarities below some 0.73 from 0.75; larger ones fold into smaller ones."""
    bits = sketch_bits(len(h))
    ones = np.bincount((h & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(ones.astype(np.uint8), bitorder="little").tobytes()


def _fold(x: bytes, size: int) -> int:
    value, at = int.from_bytes(x, "little"), len(x)
    while at > size:
        at //= 2
        value = (value >> (8 * at)) ^ (value & ((1 << (8 * at)) - 1))
    return value


def _may_link(sa: bytes, sb: bytes, na: int, nb: int, num: int, den: int) -> bool:
    size = min(len(sa), len(sb))
    return (_fold(sa, size) ^ _fold(sb, size)).bit_count() <= differences(na, nb, num, den)


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _by_sketch(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, sa, sb = (batch.column(k).to_pylist() for k in ("a", "b", "na", "nb", "sa", "sb"))
            near = [_may_link(sa[i], sb[i], na[i], nb[i], num, den) for i in range(len(a))]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(near, pa.bool_()), batch.column("star")], names=["a", "b", "near", "star"])

    return run


def _quarter(column: str):
    """Sketches folded to a quarter of their bits, 64 at least."""

    @F.arrow_udf("binary")
    def quarter(sketches: pa.Array) -> pa.Array:
        out = []
        for x in sketches.to_pylist():
            size = max(8, len(x or b"") // 4)
            out.append(x if x is None or len(x) <= size else _fold(x, size).to_bytes(size, "little"))
        return pa.array(out, pa.binary())

    return quarter(column)


def _told(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """pairs (a, b, star) whose nodes (key, n, sketch) may link by their sketches, or that are of a star, as (a, b, near, star), checkpointed."""
    left = nodes.select(F.col("key").alias("a"), F.col("sketch").alias("sa"), F.col("n").alias("na"))
    right = nodes.select(F.col("key").alias("b"), F.col("sketch").alias("sb"), F.col("n").alias("nb"))
    both = pairs.join(left, "a").join(right, "b").where("sa is not null and sb is not null")
    return checkpointed(both.mapInArrow(lean(_by_sketch(num, den)), "a long, b long, near boolean, star boolean").where("near or star"))


class _Forest:
    """Union-find over row numbers; add() tells whether the edge joins two trees."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def add(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y


def _folded(raw: list[bytes]) -> np.ndarray:
    """Sketches, a row each, folded to the size of the smallest."""
    size = min(map(len, raw))
    return np.array([np.frombuffer(x if len(x) == size else _fold(x, size).to_bytes(size, "little"), dtype=np.uint64) for x in raw])


def _whole_by_sketch(num: int, den: int):
    """Rows (key, n, sketch) of one group to a spanning forest of the pairs that may link."""

    def run(_: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        key, n, raw = (table.column(c).to_pylist() for c in ("key", "n", "sketch"))
        order = sorted(range(len(key)), key=lambda i: (n[i], key[i]))
        folded, size = _folded([raw[i] for i in order]), np.array([n[i] for i in order])
        trees, out = _Forest(len(order)), []
        for i in range(len(order) - 1):
            others = slice(i + 1, int(np.searchsorted(size, size[i] * den // num, "right")))
            apart = np.bitwise_count(folded[others] ^ folded[i]).sum(axis=1, dtype=np.int64)
            for j in np.flatnonzero(apart <= differences(size[i], size[others], num, den)) + i + 1:
                if trees.add(i, int(j)):
                    out.append((key[order[i]], key[order[j]]))
        return pa.Table.from_pylist([{"a": a, "b": b} for a, b in out], schema=_EDGES)

    return run


def _block_by_sketch(num: int, den: int):
    """Rows (role, key, n, sketch) of a block of representatives (role 0) and one of members (role 1) to a spanning forest of the pairs that may link."""

    def run(_: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        role, key, n, raw = (table.column(c).to_pylist() for c in ("role", "key", "n", "sketch"))
        ones = [i for i in range(len(key)) if role[i] == 1]
        number = {k: i for i, k in enumerate(dict.fromkeys(key))}
        trees, out = _Forest(len(number)), []
        if not ones:
            return _EDGES.empty_table()
        folded = _folded(raw)
        others, size = folded[ones], np.array([n[i] for i in ones])
        for i in (i for i in range(len(key)) if role[i] == 0):
            apart = np.bitwise_count(others ^ folded[i]).sum(axis=1, dtype=np.int64)
            for j in np.flatnonzero(apart <= differences(size, n[i], num, den)):
                if key[ones[j]] != key[i] and trees.add(number[key[i]], number[key[ones[j]]]):
                    out.append((key[i], key[ones[j]]))
        return pa.Table.from_pylist([{"a": a, "b": b} for a, b in out], schema=_EDGES)

    return run


def _linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Of sorted sets without repeats; y isn't empty."""
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int(np.count_nonzero(y[at] == x))
    return den * both >= num * (len(x) + len(y) - both)


def _with_representative(num: int, den: int, decode: Decoder):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_key, first = None, None
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                batch = whole.slice(a, 1024)
                linked = []
                for own, key, i in zip(decode(batch.column("payload")), batch.column("first_key").to_pylist(), range(batch.num_rows), strict=True):
                    if key != first_key:
                        first_key, first = key, decode(batch.column("of_first").slice(i, 1))[0]
                    linked.append(_linked(own, first, num, den))
                yield pa.RecordBatch.from_arrays([batch.column("component"), batch.column("key"), batch.column("first_key"), pa.array(linked)], names=["component", "key", "first_key", "linked"])

    return run


def _parities(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """Odd sketches of that many bits, a row of 64-bit words for each set."""
    out, step = np.zeros((len(sets), bits // 64), dtype=U64), max(1, (1 << 18) // bits)
    for i in range(0, len(sets), step):
        part = sets[i : i + step]
        at = (np.concatenate(part) & U64(bits - 1)).astype(np.int64) + np.repeat(np.arange(len(part)) * bits, [len(x) for x in part])
        ones = (np.bincount(at, minlength=len(part) * bits) & 1).astype(np.uint8)
        out[i : i + step] = np.packbits(ones.reshape(len(part), bits), axis=1, bitorder="little").view(U64)
    return out


def _block_exactly(num: int, den: int, decode: Decoder):
    """Rows (role, key, payload) of a block of representatives (role 0) and one of members (role 1) to the links that join trees.

    Sets whose sizes or sketches rule a link out, or that are in one tree, are not compared: of a group in which few link, that are nearly all.
    """

    def run(_: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        role, payload = table.column("role").to_numpy(), table.column("payload").combine_chunks()
        keys = table.column("key").to_pylist()
        number = {k: i for i, k in enumerate(dict.fromkeys(keys))}
        trees, out = _Forest(len(number)), []
        zeros, ones = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        if not len(zeros) or not len(ones):
            return _EDGES.empty_table()
        firsts, members = decode(payload.take(pa.array(zeros))), payload.take(pa.array(ones))
        bytes_before = np.concatenate([[0], np.cumsum(pc.binary_length(members).fill_null(0).to_numpy(zero_copy_only=False))])
        for a, b in slices(bytes_before, SLICE_BYTES):
            sets = decode(members.slice(a, b - a))
            size = np.array([len(x) for x in sets])
            order = np.argsort(size, kind="stable")
            sets, size, part = [sets[k] for k in order], size[order], ones[a:b][order]
            bits = min(MOST_BITS, sketch_bits(int(size[-1])))
            sketches = _parities(sets, bits)
            for i, own, sketch in zip(zeros, firsts, _parities(firsts, bits), strict=True):
                n = len(own)
                lo, hi = np.searchsorted(size, max(1, -(-n * num // den)), "left"), np.searchsorted(size, n * den // num, "right")
                apart = np.bitwise_count(sketches[lo:hi] ^ sketch).sum(axis=1, dtype=np.int64)
                at = number[keys[i]]
                for k in np.flatnonzero(apart <= differences(size[lo:hi], n, num, den)) + lo:
                    j = number[keys[part[k]]]
                    if trees.root(at) != trees.root(j) and _linked(own, sets[k], num, den):
                        trees.add(at, j)
                        out.append((keys[i], keys[part[k]]))
        return pa.Table.from_pylist([{"a": a, "b": b} for a, b in out], schema=_EDGES)

    return run


def _in_blocks(asks: DataFrame, members: DataFrame, values: DataFrame, few: int, many: int, compare) -> DataFrame:
    """asks, members (grp, key, size), values (key, ...): every representative with every member of its group, in blocks of about few and many rows and MOST_BYTES at most."""
    blocks = lambda rows: F.ceil(F.greatest(F.count("*") / rows, F.sum("size") / MOST_BYTES)).cast("int")
    asked = asks.groupBy("grp").agg(blocks(few).alias("s"))
    sizes = members.join(asked.select("grp"), "grp", "left_semi").groupBy("grp").agg(blocks(many).alias("t")).join(asked, "grp")
    row, column = F.pmod(F.xxhash64("key"), F.col("s")).cast("int"), F.pmod(F.xxhash64("key"), F.col("t")).cast("int")
    left = asks.join(sizes, "grp").select("grp", "key", row.alias("i"), F.explode(F.sequence(F.lit(0), F.col("t") - 1)).alias("j"), F.lit(0).alias("role"))
    right = members.join(sizes, "grp").select("grp", "key", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("i"), column.alias("j"), F.lit(1).alias("role"))
    return left.unionByName(right).join(values, "key").groupBy("grp", "i", "j").applyInArrow(compare, "a long, b long")


def _degrees(edges: DataFrame) -> DataFrame:
    """(key, degree): the number of edges at each node."""
    return edges.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("degree"))


def _foremost(loose: DataFrame, width: int) -> DataFrame:
    """Of each group of loose (grp, key, size, degree) about `width` rows: those of the highest degrees, by powers of two, and a hashed share of the last power."""
    levels = loose.groupBy("grp", F.floor(F.log2(F.col("degree") + 1)).alias("level")).agg(F.count("*").alias("c"))
    above = F.coalesce(F.sum("c").over(Window.partitionBy("grp").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = levels.withColumn("left", F.lit(width) - above).where("left > 0").select("grp", "level", F.ceil(F.col("c") / F.col("left")).alias("every"))
    rows = loose.withColumn("level", F.floor(F.log2(F.col("degree") + 1))).join(taken, ["grp", "level"])
    return rows.where(F.pmod(F.xxhash64("key", F.lit(width)), F.col("every")) == 0).select("grp", "key", "size")


def _resolved(edges: DataFrame, members: DataFrame, compare: Callable[[DataFrame], DataFrame], first: int) -> tuple[DataFrame, DataFrame]:
    """edges (a, b), members (grp, key, hub, size in bytes, degree) to components (node, component) of all links inside groups, and the edges found.

    compare: representatives (grp, key, size) to the edges between them and all members of their groups. A member that is in its hub's component is settled; of the
    others the `first` of each group with the highest degree are compared in the first round, and eight times as many in each further one.
    """
    asked, width = None, first
    while True:
        labels = checkpointed(connected_components(edges))
        own, hubs = labels.select(F.col("node").alias("key"), F.col("component").alias("l")), labels.select(F.col("node").alias("hub"), F.col("component").alias("m"))
        loose = members.where("key != hub").join(own, "key", "left").join(hubs, "hub", "left").where("coalesce(l, key) != coalesce(m, hub)").select("grp", "key", "size", "degree")
        loose = checkpointed(loose if asked is None else loose.join(asked.select("grp", "key"), ["grp", "key"], "left_anti"))
        if not loose.limit(1).count():
            return labels, edges
        asks = checkpointed(_foremost(loose, width))
        edges = edges.unionByName(checkpointed(compare(asks)))
        asked = asks if asked is None else asked.unionByName(asks)
        width *= 8


def probable_groups(found: DataFrame, nodes: DataFrame, num: int, den: int, few: int = 256, many: int = 4096, fold: bool = True) -> DataFrame:
    """(node, component, degree) of components that hold every link among the candidates; degree: the probable links of a node that were kept.

    found: rows of packed.candidates; nodes (key, n, sketch), checkpointed. Pairs that sketches rule out go. fold: by sketches of a quarter first, which pays for large sets. The sets of hot signatures that have the same least set are compared in one
    block if they are at most `many`; else with that one, and what isn't connected to it then in rounds.
    """
    hot = found.where("hot").select(F.col("a").alias("grp"), F.col("b").alias("key")).distinct()
    hot = checkpointed(hot.join(nodes.select("key", F.octet_length("sketch").cast("long").alias("size")), "key").select("grp", "key", "size"))
    fits = (F.count("*") <= many) & (F.sum("size") <= MOST_BYTES)
    sizes = hot.groupBy("grp").agg(fits.alias("fits"))
    values = nodes.select("key", F.col("n").cast("long").alias("n"), "sketch")
    small = hot.drop("size").join(sizes.where("fits").select("grp"), "grp", "left_semi").join(values, "key")
    warm = small.groupBy("grp").applyInArrow(_whole_by_sketch(num, den), "a long, b long")
    large = hot.join(sizes.where("not fits").select("grp"), "grp", "left_semi")
    stars = large.where("key != grp").select(F.col("grp").alias("a"), F.col("key").alias("b"), F.lit(True).alias("star"))
    pairs = found.where("not hot").select("a", "b", F.lit(False).alias("star")).unionByName(stars).groupBy("a", "b").agg(F.max("star").alias("star"))
    passed = pairs
    if fold:  # most pairs meet by chance and end here, so that few carry whole sketches
        first = _told(pairs, nodes.withColumn("sketch", _quarter("sketch")), num, den)
        passed = first.where("near").drop("near")
    asked = nodes
    if fold:  # few nodes have such a pair; only their whole sketches are shuffled
        asked = checkpointed(nodes.where(Bitmap(passed.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "key").has(F.xxhash64("key"))))
    told = _told(passed, asked, num, den)
    edges = checkpointed(told.where("near").select("a", "b").unionByName(warm))
    apart = (first.unionByName(told) if fold else told).where("star and not near").select(F.col("a").alias("grp")).distinct()
    if not apart.limit(1).count():
        labels = connected_components(edges)
    else:
        members = large.join(apart, "grp", "left_semi").join(_degrees(edges), "key", "left")
        members = checkpointed(members.select("grp", "key", F.col("grp").alias("hub"), "size", F.coalesce("degree", F.lit(0)).alias("degree")))
        labels, edges = _resolved(edges, members, lambda asks: _in_blocks(asks, members.select("grp", "key", "size"), values, few, many, _block_by_sketch(num, den)), few)
    return labels.join(_degrees(edges).withColumnRenamed("key", "node"), "node", "left").select("node", "component", F.coalesce("degree", F.lit(0)).alias("degree"))


def exact_groups(sets: DataFrame, num: int, den: int, few: int = 256, many: int = 2048, *, decode: Decoder) -> DataFrame:
    """sets (component long, key long, payload binary, degree long), checkpointed and with distinct keys, to (node, component) of the links within components.

    Each set is compared with one representative of its component, that of the highest degree; what isn't connected to it is compared in rounds. decode: payloads to sets.
    """
    hubs = sets.groupBy("component").agg(F.max(F.struct("degree", "key")).alias("hub")).select("component", F.col("hub.key").alias("first_key"))
    firsts = checkpointed(hubs.join(sets.select(F.col("key").alias("first_key"), F.col("payload").alias("of_first")), "first_key"))
    told = checkpointed(sets.join(firsts, "component").where("key != first_key").mapInArrow(lean(_with_representative(num, den, decode)), "component long, key long, first_key long, linked boolean"))
    edges = told.where("linked").select(F.col("key").alias("a"), F.col("first_key").alias("b"))
    open_groups = told.where("not linked").select("component", "first_key").distinct()
    if not open_groups.limit(1).count():
        return connected_components(edges)
    sized = sets.select("component", "key", F.octet_length("payload").cast("long").alias("size"), "degree")
    members = checkpointed(sized.join(open_groups, "component").select(F.col("component").alias("grp"), "key", F.col("first_key").alias("hub"), "size", "degree"))
    compare = lambda asks: _in_blocks(asks, members.select("grp", "key", "size"), sets.select("key", "payload"), 4 * few, many, _block_exactly(num, den, decode))
    return _resolved(edges, members, compare, few)[0]
