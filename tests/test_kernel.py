import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trawl.operators import bm25, dense, mmr
from trawl.operators.dense import Best, _emitted, best_sums, token_scorer
from trawl.operators.quantize import Codec, ProductQuantizer, TokenIndex
from trawl.operators.search import Options, search, search_multi_vector


def _tokens(rng, rows, n, d=8):
    return pa.array([rng.standard_normal((n, d)).astype(np.float32).tolist() for _ in range(rows)], pa.list_(pa.list_(pa.float32())))


def _brute(stored, asked):
    unit = lambda x: np.array(x) / np.linalg.norm(x, axis=1, keepdims=True)
    return np.array([[(unit(q) @ unit(t).T).max(axis=1).sum() if t else 0.0 for q in asked] for t in stored])


def test_late_interaction_is_bounded_in_memory():
    """4,000 rows of 5 tokens against 400 queries of 5: 40 million products, which were held at once."""
    rng = np.random.default_rng(1)
    rows, asked = _tokens(rng, 4000, 5), _tokens(rng, 400, 5)
    batch = pa.RecordBatch.from_arrays([pa.array([""] * 4000), pa.array([f"{i:04}" for i in range(4000)]), rows], names=["namespace", "id", "payload"])
    tracemalloc.start()
    out = list(_emitted(lambda: (pa.array([str(i) for i in range(400)]), token_scorer("cosine", asked), None), 10, "score")(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    got = pa.Table.from_batches(out).to_pandas()
    assert (got.groupby("qid").size() == 10).all()
    want = _brute(rows.to_pylist(), asked.slice(7, 1).to_pylist())[:, 0]
    own = got[got.qid == "7"].sort_values("score", ascending=False)
    assert [int(i) for i in own.id] == np.argsort(-want)[:10].tolist() and np.allclose(own.score, np.sort(want)[::-1][:10])


@pytest.mark.parametrize("cells", [1, 7, 30, 1 << 20])
def test_sums_of_best_tokens_in_pieces(monkeypatch, cells):
    monkeypatch.setattr(dense, "CELLS", cells)
    rng = np.random.default_rng(2)
    stored = [rng.standard_normal((n, 3)).tolist() for n in (2, 0, 9, 1, 3, 3, 0)]
    asked = [rng.standard_normal((n, 3)).tolist() for n in (1, 4, 2)]
    kind = pa.list_(pa.list_(pa.float64()))
    assert np.allclose(token_scorer("cosine", pa.array(asked, kind))(pa.array(stored, kind)), _brute(stored, asked))
    assert best_sums(np.array([0, 0]), np.array([1]), None).tolist() == [[0.0], [0.0]]


def test_a_task_holds_k_rows_of_a_query_whatever_ties():
    rng = np.random.default_rng(3)
    s = rng.integers(0, 4, (500, 6)).astype(float)
    s[rng.random(s.shape) < 0.1] = -np.inf
    s[:, 5] = -np.inf
    s[3, 5] = 1.0
    ids = rng.permutation(500)
    best = Best(7, 6)
    best.most = 40
    for a in range(0, 500, 50):
        best.add(s[a : a + 50] * (1 + 1e-15 * rng.standard_normal((50, 6))), pa.array(["n"] * 50), pa.array([f"{i:03}" for i in ids[a : a + 50]]))
    got = pa.Table.from_batches(list(best.rows(pa.array(list("abcdef")), "score"))).to_pandas()
    for j, q in enumerate("abcdef"):
        want = sorted((-v, f"{i:03}") for v, i in zip(s[:, j], ids) if v != -np.inf)[:7]
        own = got[got.qid == q]
        assert sorted(zip(-own.score, own.id)) == want, q


def test_filtered_late_interaction_equals_brute_force(spark):
    """Only rows that pass the filter count, those without tokens score 0, and equal rows go by id."""
    rng = np.random.default_rng(4)
    kept = [rng.standard_normal((n, 4)).astype(np.float32).tolist() for n in (3, 1, 0, 2, 5)]
    stored = [*kept, *kept, *kept]
    rows = spark.createDataFrame([("", f"{i:02}", t) for i, t in enumerate(stored)], "namespace string, id string, t array<array<float>>")
    rows = rows.select("namespace", "id", F.create_map(F.lit("c"), F.col("t")).alias("multi_vectors"), F.parse_json(F.concat(F.lit('{"odd":'), (F.col("id").cast("int") % 2).cast("string"), F.lit("}"))).alias("metadata"))
    asked = [rng.standard_normal((n, 4)).astype(np.float32).tolist() for n in (2, 4)]
    top = search_multi_vector(rows, spark.createDataFrame([(str(i), t) for i, t in enumerate(asked)], "qid string, tokens array<array<float>>"), "c", 6, tests={"odd": 1}).collect()
    want = _brute(stored, asked)
    for q in (0, 1):
        order = sorted((-round(want[i, q], 9), f"{i:02}") for i in range(15) if i % 2)[:6]
        assert [r.id for r in sorted(top, key=lambda r: r["rank"]) if r.qid == str(q)] == [i for _, i in order]


def _peak(scorer, column, qids):
    batch = pa.RecordBatch.from_arrays([pa.array([""] * len(column)), pa.array([f"{i:05}" for i in range(len(column))]), column], names=["namespace", "id", "payload"])
    tracemalloc.start()
    out = list(_emitted(lambda: (pa.array([str(i) for i in range(qids)]), scorer, None), 20, "score")(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak, pa.Table.from_batches(out).to_pandas()


def test_token_codes_are_bounded_in_memory(monkeypatch):
    """4,000 rows of 5 coded tokens against 400 queries of 5: what is emitted are the best sums of level products."""
    rng = np.random.default_rng(5)
    codec = Codec("two_bit", {"q1": np.full(8, -0.7), "q2": np.zeros(8), "q3": np.full(8, 0.7)})
    tokens, asked, caught = _tokens(rng, 4000, 5), _tokens(rng, 400, 5), {}
    monkeypatch.setattr("trawl.operators.quantize.payload_scores", lambda rows, asked, width, scorer, k: caught.update(scorer=scorer))
    monkeypatch.setattr("trawl.operators.search.check_tokens", lambda queries, space: (queries, 8))
    TokenIndex(codec, None).scores(None, 20)
    levels = codec.encode(np.array(tokens.flatten().flatten()).reshape(-1, 8))
    peak, got = _peak(caught["scorer"](asked), pa.array([r.tobytes() for r in levels.reshape(4000, -1)], pa.binary()), 400)
    assert peak < 100e6
    own = codec.encode(np.array(asked[3].as_py())).astype(int)
    want = (levels.reshape(4000, 5, 8).astype(int) @ own.T).max(axis=1).sum(axis=1)
    order = sorted((-v, f"{i:05}") for i, v in enumerate(want))[:20]
    part = got[got.qid == "3"]
    assert sorted(zip(-part.score, part.id)) == order


@pytest.mark.parametrize("method", ["scalar", "binary", "product", "two_bit"])
def test_codes_are_bounded_in_memory(method):
    """4,000 codes against 4,000 queries; product codes are compared as by tables of distances to centroids."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((4000, 8)).astype(np.float32)
    fitted = {"scalar": {"low": x.min(axis=0), "scale": 255 / np.ptp(x, axis=0)}, "binary": {}, "product": {"codebooks": rng.standard_normal((4, 16, 2))}, "two_bit": {"q1": np.full(8, -0.7), "q2": np.zeros(8), "q3": np.full(8, 0.7)}}[method]
    codec, asked = Codec(method, fitted), pa.array(rng.standard_normal((4000, 8)).tolist())
    codes = codec.encode(x)
    peak, got = _peak(codec.scorer("cosine", asked), pa.array([r.tobytes() for r in codes], pa.binary()), 4000)
    assert peak < 100e6 and (got.groupby("qid").size() == 20).all()
    if method == "product":
        tables = ProductQuantizer(fitted["codebooks"]).distances(np.array(asked[5].as_py()))
        want = -tables[np.arange(4), codes].sum(axis=1)
        part = got[got.qid == "5"].sort_values(["score", "id"], ascending=[False, True])
        assert np.allclose(part.score, np.sort(want)[::-1][:20])


def test_spaces_are_scored_in_one_scan(spark):
    """As a sum over spaces, of pairs with a space in common; without a shuffle of pairs before the top-k."""
    rng = np.random.default_rng(7)
    rows, stored = [], {}
    for i in range(60):
        a, b = rng.standard_normal((2, 3)).astype(np.float32).tolist()
        stored[f"{i:02}"] = (a if i % 5 else None, b if i % 2 else None)
        rows.append(("", f"{i:02}", stored[f"{i:02}"][0], {"rev": b} if i % 2 else None))
    asked = {"0": {"": [1.0, 0.5, 0.0], "rev": [0.0, 1.0, 1.0]}, "1": {"rev": [1.0, 0.0, -1.0]}}
    records = spark.createDataFrame(rows, "namespace string, id string, vector array<float>, vectors map<string,array<float>>")
    queries = spark.createDataFrame(list(asked.items()), "qid string, vectors map<string,array<float>>")
    cos = lambda u, v: float(np.dot(u, v) / np.linalg.norm(u) / np.linalg.norm(v))
    for k in (7, 1000):
        for name in (None, "rev"):
            top = search(records, queries, Options(k=k, namespace=None, spaces={"": 0.7, "rev": 0.3}, vector_name=name))
            assert "HashAggregate" not in top._jdf.queryExecution().executedPlan().toString()
            got = [(r.qid, r.id, round(r.score, 6)) for r in top.orderBy("qid", "rank").collect()]
            want = []
            for q, vs in asked.items():
                pairs = {i: [w * cos(v, vs[n]) for n, v, w in (("", a, 0.7), ("rev", b, 0.3)) if v is not None and n in vs] for i, (a, b) in stored.items() if name is None or b is not None}
                want += [(q, i, round(-s, 6)) for s, i in sorted((-sum(p), i) for i, p in pairs.items() if p)[:k]]
            assert got == want


@pytest.mark.parametrize("metric,weight", [("cosine", 0.7), ("cosine", 0.1), ("dot", 0.5), ("l2", 0.6)])
def test_mmr_by_scans_chooses_as_over_all_rows(spark, monkeypatch, metric, weight):
    """Many copies and ties; few rows are found by a scan, so that several are needed. Pairs that could be chosen don't move: the best few of a task do."""
    monkeypatch.setattr(mmr, "FEW", 2)
    rng = np.random.default_rng(8)
    x = np.repeat(rng.integers(-2, 3, (40, 4)) + 0.25 * rng.integers(0, 2, (40, 4)), 5, axis=0)
    x[:, 0] += 0.5
    order = rng.permutation(len(x))
    rows = spark.createDataFrame([("", f"{i:03}", x[i].tolist()) for i in order], "namespace string, id string, vector array<float>")
    asked = rng.standard_normal((3, 4)).astype(np.float32)
    queries = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(asked)], "qid string, vector array<float>")
    o = Options(k=6, namespace=None, mmr_lambda=weight, metric=metric)
    monkeypatch.setattr("trawl.operators.search.mmr_select", None)
    got = [(r.qid, r["rank"], r.id, round(r.score, 6)) for r in search(rows, queries, o).orderBy("qid", "rank").collect()]
    want = []
    for i, q in enumerate(asked):
        s = dense.settled(dense.scores(o.metric, x, q[None])[:, 0])
        by = np.lexsort((np.arange(len(x)), -s))
        picked = mmr.greedy(s[by], lambda j: dense.settled(dense.scores(o.metric, x[by], x[by][j : j + 1])[:, 0]), 6, weight)
        want += [(str(i), n + 1, f"{by[j]:03}", round(s[by[j]], 6)) for n, j in enumerate(picked)]
    assert got == want


def test_term_scores_are_made_where_postings_lie(spark, monkeypatch):
    """Whatever blocks queries come in; neither postings nor pairs are shuffled, so a term of all rows is not one task's."""
    rng = np.random.default_rng(9)
    texts = [{f"w{t}": float(rng.integers(1, 9)) / 8 for t in rng.choice(20, 4, replace=False)} | {"all": 0.5} for _ in range(40)]
    rows = spark.createDataFrame([("", f"{i:02}", t) for i, t in enumerate(texts)], "namespace string, id string, sparse map<string,float>")
    terms = spark.createDataFrame([(f"q{i % 6}", f"w{i}", 0.25 * (1 + i % 3)) for i in range(24)] + [(f"q{i}", "all", 1.0) for i in range(6)], "qid string, term string, qw double")
    index = bm25.build_index(rows)
    df = {w: sum(w in t for t in texts) for t in texts for w in t}
    average = sum(sum(t.values()) for t in texts) / 40
    score = lambda t, w: np.log((40 - df[w] + 0.5) / (df[w] + 0.5) + 1) * t[w] * 2.2 / (t[w] + 1.2 * (0.25 + 0.75 * sum(t.values()) / average))
    want = sorted((r.qid, f"{i:02}", r.term, r.qw, round(score(t, r.term), 6)) for r in terms.collect() for i, t in enumerate(texts) if r.term in t)
    for size in (32 << 20, 64):
        monkeypatch.setattr(bm25, "QUERY_BYTES", size)
        got = bm25.scored_terms(index, terms, digits=6)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
        assert sorted((r.qid, r.id, r.term, r.qw, round(r.score, 6)) for r in got.collect()) == want
