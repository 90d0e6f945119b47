"""Blocks of sets in slices, and sketches folded before they are compared."""

import numpy as np
import pyarrow as pa

from trawl.llm import ngram_join, packed, similar_sets
from trawl.llm.common import mix


def _set(first, n):
    return np.sort(mix(np.arange(first, first + n).astype(np.uint64)))


def _decode(payload):
    return [np.frombuffer(x, dtype=np.uint64) for x in payload.to_pylist()]


def test_slices_of_a_block_give_the_same_links(monkeypatch):
    sets = [_set(1000 * (i % 5) + i // 5, 40) for i in range(25)]
    rows = [{"role": role, "key": i, "payload": x.tobytes()} for role in (0, 1) for i, x in enumerate(sets)]
    found = []
    for size in (1, 1 << 20):
        monkeypatch.setattr(similar_sets, "SLICE_BYTES", size)
        trees = similar_sets._Forest(len(sets))
        for edge in similar_sets._block_exactly(75, 100, _decode)((), pa.Table.from_pylist(rows)).to_pylist():
            trees.add(edge["a"], edge["b"])
        found.append([trees.root(i) for i in range(len(sets))])
    assert found[0] == found[1] == [i % 5 for i in range(25)]


def test_folded_sketches_lose_no_link():
    for n in (3, 20, 300, 5000):
        for shift in range(0, n // 7 + 1, max(1, n // 50)):  # as different as links may be
            a, b = _set(0, n), _set(shift, n)
            if 100 * (n - shift) < 75 * (n + shift):
                continue
            sa, sb = similar_sets.odd_sketch(a), similar_sets.odd_sketch(b)
            small = [similar_sets._fold(x, max(8, len(x) // 4)).to_bytes(max(8, len(x) // 4), "little") for x in (sa, sb)]
            assert similar_sets._may_link(sa, sb, n, n, 75, 100) and similar_sets._may_link(*small, n, n, 75, 100)


def test_blocks_compare_few_sets_exactly(monkeypatch):
    """Sets of a large group that link to nothing cost no exact comparison each with each."""
    asked, linked = [], similar_sets._linked
    monkeypatch.setattr(similar_sets, "_linked", lambda *a: asked.append(1) or linked(*a))
    sets = [_set(1000 * i, 40 + i % 7) for i in range(200)] + [_set(1000 * i + 1, 40) for i in range(0, 200, 10)]
    rows = [{"role": role, "key": i, "payload": x.tobytes()} for role in (0, 1) for i, x in enumerate(sets)]
    edges = similar_sets._block_exactly(75, 100, _decode)((), pa.Table.from_pylist(rows)).to_pylist()
    assert {tuple(sorted(e.values())) for e in edges} == {(10 * i, 200 + i) for i in range(20)}
    assert 20 <= len(asked) < 200  # of 48,400 pairs


def _of_signatures(n_nodes, n_buckets, most_decoded=None):
    rng = np.random.default_rng(5)
    sigs = mix(rng.integers(0, 1400, 6000).astype(np.uint64))
    owners, nodes = rng.integers(0, n_nodes, len(sigs)), mix(np.arange(1, n_nodes + 1).astype(np.uint64))
    batch = packed.pack(sigs, owners, nodes, np.full(n_nodes, 50), n_buckets)
    rows = [r for b in packed.candidates(iter([batch]), 8, 75, 100, *([most_decoded] if most_decoded else [])) for r in b.to_pylist()]
    return batch, {(r["hot"], r["a"], r["b"]) for r in rows}, len(rows)


def test_candidates_of_slices_are_those_of_a_bucket(monkeypatch):
    """Fewer, larger buckets that are decoded a slice at a time give the same pairs, in fewer bytes."""
    many, want, rows = _of_signatures(900, 64)
    few, got, fewer = _of_signatures(900, 4, 100)
    assert got == want and any(x[0] for x in want) and not all(x[0] for x in want) and fewer <= rows
    size = lambda batch: sum(map(len, batch.column(1).to_pylist()))
    assert size(few) < 0.75 * size(many)
    monkeypatch.setattr(packed, "MOST_PAIRS", 10)
    assert _of_signatures(900, 4, 100)[1] == want


def test_pairs_are_kept_in_16_bytes():
    batch, want, n = _of_signatures(900, 4)
    blobs = [packed.pair_blobs(b, 1000) for b in packed.candidates(iter([batch]), 8, 75, 100)]
    assert {tuple(r.values()) for b in packed.pairs_of_blobs(iter(blobs)) for r in b.to_pylist()} == want
    assert sum(len(x) for b in blobs for x in b.column(1).to_pylist()) == 16 * n
    assert packed.pair_blobs(pa.RecordBatch.from_pylist([], schema=packed.PAIRS)).num_rows == 0


def test_a_key_has_one_node_with_its_least_document():
    """Nodes of all batches meet in the task of their key: no shuffle of sketches by key is needed afterwards."""
    texts = ["a b c d e f g", "h i j k l m n", "one two"]
    batches = [pa.RecordBatch.from_pydict({"doc_id": [50 - i, 30 + i, 10 + i], "text": texts}) for i in range(5)]
    spread = [b for x in (batches[:2], batches[2:]) for b in ngram_join._index(5, 75, 100, 4, 1)(iter(x))]
    nodes = []
    for bucket in range(4):
        own = [b.filter(pa.array([k == bucket or k == -1 - bucket for k in b.column(0).to_pylist()])) for b in spread]
        nodes += [r for b in ngram_join._find(32, 75, 100)(iter(own)) for r in b.to_pylist() if r.get("node") is not None]
    assert sorted(r["doc_id"] for r in nodes) == [10, 30, 46] and len({r["node"] for r in nodes}) == 3
    assert all(r["sketch"] and r["n"] == r["most"] for r in nodes)
