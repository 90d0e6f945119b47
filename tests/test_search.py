import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trawl.functions.filters import FilterError, compile_filter, parse_terms
from trawl.functions.metrics import metric_name, score
from trawl.functions.text import Analyzer, hashing_embedder
from trawl.functions.text import sparse_terms as terms_of
from trawl.operators import bm25
from trawl.operators.ann import PRESETS, InvertedFile
from trawl.operators.bm25 import bm25_scores, build_index
from trawl.operators.dense import ranked
from trawl.operators.mmr import greedy, mmr_select
from trawl.operators.quantize import ProductQuantizer, binary_codes, candidates_for, default_parts, hamming, recall, search_quantized
from trawl.operators.rerank import compose, hook, metadata_boost, text_match
from trawl.operators.search import Options, _all_scored, candidate_count, query_terms, resolved_fetch_k, search, search_multi_vector
from trawl.plans.explain import configure_tracing, search_with_stats
from trawl.schema import RecordError, Schema, check_query, with_defaults


def records(spark, rows, columns="id string, vector array<float>"):
    return with_defaults(spark.createDataFrame(rows, columns))


def asked(spark, *vectors):
    return spark.createDataFrame([(str(i), [float(x) for x in v]) for i, v in enumerate(vectors)], "qid string, vector array<float>")


def found(df):
    return [(r.id, round(r.score, 6)) for r in df.orderBy("qid", "rank").collect()]


def ids(df):
    return [i for i, _ in found(df)]


META = "id string, vector array<float>, metadata string"


def test_filter_and_dense(spark):
    rows = records(spark, [("elm", [3.0, 0.0], '{"shelf":"low","name":"tide table"}'), ("oak", [2.0, 1.0], '{"shelf":"high","name":"tide chart"}'), ("ash", [0.0, 4.0], "{}")], META)
    got = found(search(rows, asked(spark, [1, 0]), Options(filter={"shelf": "low", "name": {"$contains": "tide"}})))
    assert got == [("elm", 1.0)]


def test_namespaces(spark):
    rows = records(spark, [("docs", "doc1", [1.0, 0.0]), ("notes", "doc1", [0.0, 1.0])], "namespace string, id string, vector array<float>")
    assert len(found(search(rows, asked(spark, [1, 0]), Options(namespace="docs")))) == 1
    assert len(found(search(rows, asked(spark, [1, 0]), Options(namespace=None)))) == 2
    assert found(search(rows, asked(spark, [1, 0]))) == []


def test_hybrid_bm25_values(spark):
    rows = records(spark, [("doc1", [1.0, 0.0], {"rope": 1.0, "knot": 0.5}), ("doc2", [1.0, 0.0], {"sail": 1.0})], "id string, vector array<float>, sparse map<string,float>")
    queries = asked(spark, [1, 0]).withColumn("sparse", F.create_map(F.lit("rope"), F.lit(1.0).cast("float")))
    assert found(search(rows, queries)) == [("doc1", 1.640724), ("doc2", 1.0)]
    top = search(rows, queries, Options(explain=True)).orderBy("rank").collect()
    assert top[0].matched == ["rope"] and round(top[0].term_scores["rope"], 6) == 0.640724 and top[0].sparse_rank == 1 and top[1].sparse_rank is None
    assert build_index(rows.limit(0)).average == 0.0


@pytest.mark.parametrize(("metric", "vectors", "query", "want"), [
    ("euclidean", {"close": [1, 0, 0], "mid": [3, 0, 0], "far": [5, 5, 5]}, [0, 0, 0], [("close", -1.0), ("mid", -3.0), ("far", -8.660254)]),
    ("dot", {"high": [10, 0, 0], "medium": [5, 0, 0], "low": [0, 1, 0]}, [1, 0, 0], [("high", 10.0), ("medium", 5.0), ("low", 0.0)]),
    ("manhattan", {"close": [1, 0, 0], "mid": [2, 1, 0], "far": [3, 3, 3]}, [0, 0, 0], [("close", -1.0), ("mid", -3.0), ("far", -9.0)]),
])
def test_metrics(spark, metric, vectors, query, want):
    rows = records(spark, [(k, [float(x) for x in v]) for k, v in vectors.items()])
    assert found(search(rows, asked(spark, query), Options(metric=metric))) == want
    own = rows.select("id", F.round(score(metric, F.col("vector"), F.array(*map(F.lit, query))), 6).alias("s")).collect()
    assert {r.id: r.s for r in own} == dict(want)


def test_metric_names_and_zero_norm(spark):
    assert metric_name("L2") == "euclidean" and metric_name("Inner_Product") == "dot" and metric_name("l1") == "manhattan"
    with pytest.raises(ValueError):
        metric_name("hamming")
    assert found(search(records(spark, [("z", [0.0, 0.0])]), asked(spark, [1, 0]))) == [("z", 0.0)]


def test_truncation_named_and_spaces(spark):
    rows = records(spark, [("prefix", [1.0, 0.0, -1.0, -1.0]), ("full", [0.0, 1.0, 1.0, 1.0])])
    assert ids(search(rows, asked(spark, [1, 0]), Options(truncate_dim=2))) == ["prefix", "full"]
    named = records(spark, [("doc1", [0.1, 0.9], {"title": [1.0, 0.0], "body": [0.0, 1.0]}), ("doc2", [0.9, 0.1], {"title": [0.0, 1.0], "body": [1.0, 0.0]}), ("doc3", [0.5, 0.5], None)], "id string, vector array<float>, vectors map<string,array<float>>")
    assert ids(search(named, asked(spark, [1, 0]), Options(vector_name="title"))) == ["doc1", "doc2"]
    assert ids(search(named, asked(spark, [1, 0]))) == ["doc2", "doc3", "doc1"]
    both = asked(spark, [1, 0]).select("qid", F.create_map(F.lit("title"), F.col("vector"), F.lit("body"), F.col("vector")).alias("vectors"))
    assert found(search(named, both, Options(spaces={"title": 0.75, "body": 0.25}))) == [("doc1", 0.75), ("doc2", 0.25)]


def test_mmr(spark):
    rows = records(spark, [("doc1", [1.0, 0.0]), ("doc2", [0.99, 0.01]), ("doc3", [0.7, 0.7])])
    assert ids(search(rows, asked(spark, [1, 0]), Options(k=2))) == ["doc1", "doc2"]
    assert ids(search(rows, asked(spark, [1, 0]), Options(k=2, mmr_lambda=0.3))) == ["doc1", "doc3"]
    rng = np.random.default_rng(0)
    x = rng.standard_normal((30, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.sort(x @ x[0])[::-1].copy()
    order = np.argsort(-(x @ x[0]), kind="stable")
    y, weight, picked = x[order], 0.6, [0]
    for _ in range(4):
        rest = [i for i in range(30) if i not in picked]
        picked.append(max(rest, key=lambda i: (weight * s[i] - (1 - weight) * max(0, max(y[i] @ y[j] for j in picked)), s[i])))
    assert greedy(s, lambda i: y @ y[i], 5, weight) == picked


def test_maxsim(spark):
    rows = with_defaults(spark.createDataFrame([("doc1", {"colbert": [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0]]}), ("doc2", {"colbert": [[0.0, 0.0, 1.0], [0.0, 1.0, 0.0]]}), ("doc3", {"other": [[1.0]]})], "id string, multi_vectors map<string,array<array<float>>>").withColumn("vector", F.array(F.lit(0.0))))
    queries = spark.createDataFrame([("0", [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0]])], "qid string, tokens array<array<float>>")
    assert found(search_multi_vector(rows, queries, "colbert")) == [("doc1", 2.0), ("doc2", 1.0)]


def test_rrf_and_weights(spark):
    rows = records(spark, [(f"doc{i:03}", [1.0, 0.0] if i < 120 else [0.0, 1.0], {("rope" if i < 120 else "sail"): 0.5, "deck": 0.5}) for i in range(160)], "id string, vector array<float>, sparse map<string,float>")
    queries = asked(spark, [1, 0]).withColumn("sparse", F.create_map(F.lit("rope"), F.lit(0.5).cast("float"), F.lit("deck"), F.lit(0.5).cast("float")))
    top = search(rows, queries, Options(k=5, fusion="rrf", rrf_k=10)).orderBy("rank").collect()
    assert [r.id for r in top] == [f"doc{i:03}" for i in range(5)] and top[0].dense_rank == 1 and top[0].sparse_rank == 1
    assert round(top[0].score, 9) == round(2 / 11, 9)


def test_filters(spark):
    rows = records(spark, [
        ("doc1", [1.0], '{"tags":["python","rust","go"],"author":{"name":"Alice","n":5},"x":5,"y":null,"a.b":1}'), ("doc2", [1.0], '{"tags":["javascript"],"author":{"name":"Bob","n":2},"x":5.5,"b":true}'), ("doc3", [1.0], '{"x":"5","list":[1,"two",true,null],"parts":[{"n":1},{"n":3}]}'),
    ], META)
    pick = lambda t: sorted(r.id for r in rows.where(compile_filter(t)).collect())
    assert pick({"author.name": "Alice"}) == ["doc1"] and pick({"tags": {"$size": 3}}) == ["doc1"] and pick({"tags": {"$elemMatch": {"$eq": "rust"}}}) == ["doc1"]
    assert pick({"x": 5}) == ["doc1"] and pick({"x": 5.5}) == ["doc2"] and pick({"x": "5"}) == ["doc3"] and pick({"x": 5.0}) == [] and pick({"x": {"$gt": 4}}) == ["doc1", "doc2"]
    assert pick({"y": None}) == ["doc1"] and pick({"y": {"$exists": True}}) == ["doc1"] and pick({"y": {"$exists": False}}) == ["doc2", "doc3"] and pick({"y": {"$ne": 1}}) == ["doc1"]
    assert pick({"$not": {"x": 5}}) == ["doc2", "doc3"] and pick({"x": {"$not": {"$gt": 5}}}) == ["doc1", "doc3"] and pick({"$and": []}) == ["doc1", "doc2", "doc3"] and pick({"$or": []}) == []
    assert pick({"a.b": 1}) == ["doc1"] and pick({"b": True}) == ["doc2"] and pick({"b": 1}) == [] and pick({"list": [1, "two", True, None]}) == ["doc3"] and pick({"author": {"n": 5, "name": "Alice"}}) == ["doc1"]
    assert pick({"parts": {"$elemMatch": {"n": {"$gt": 2}}}}) == ["doc3"] and pick({"x": {"$in": [5, "5"]}}) == ["doc1", "doc3"] and pick({"x": {"$nin": [5]}}) == ["doc2", "doc3"] and pick({"tags": {"$contains": "rust"}}) == []
    for bad in ({}, {"x": {}}, {"x": {"$near": 1}}, {"x": {"$gt": True}}, {"$nor": []}, {"x": {"$in": 3}}):
        with pytest.raises(FilterError):
            compile_filter(bad)
    assert pick(parse_terms(["x>4", "author"])) == ["doc1", "doc2"] and parse_terms([]) is None


def test_ranges(spark):
    rows = records(spark, [(f"doc{i}", [1.0], f'{{"score":{i}}}') for i in range(100)], META)
    n = lambda t: rows.where(compile_filter({"score": t})).count()
    assert (n({"$gt": 90}), n({"$gte": 90}), n({"$lt": 10}), n({"$lte": 10}), n({"$gte": 10, "$lt": 20})) == (9, 10, 10, 11, 10)


def test_query_checks():
    check_query([0.0, 0.0], 2, "euclidean")
    for vector, dim, metric, cut in (([], 2, "dot", None), ([1.0], 2, "dot", None), ([1.0] * 3, 2, "dot", None), ([0.0, 0.0], 2, "cosine", None), ([1.0, 1.0], 2, "cosine", 3)):
        with pytest.raises(RecordError):
            check_query(vector, dim, metric, cut)
    for bad in ({"mmr_lambda": 2}, {"fusion": "x"}, {"vector_name": ""}, {"k": -1}):
        with pytest.raises(RecordError):
            Options(**bad)


def test_searches_check_their_queries(spark):
    rows = records(spark, [("a", [1.0, 0.0]), ("b", [0.0, 1.0])])
    for vector, o in (([], None), ([1.0], None), ([1.0] * 3, None), ([0.0, 0.0], None), ([0.0, 1.0], Options(truncate_dim=1)), ([1.0, 1.0], Options(truncate_dim=3))):
        with pytest.raises(RecordError):
            search(rows, asked(spark, vector), o)
    assert found(search(rows, asked(spark, [0, 0]), Options(metric="l2", k=1))) == [("a", -1.0)]
    with pytest.raises(RecordError):
        search(rows, asked(spark, [1, 0]).select("qid"), None)
    late = rows.withColumn("expires_at", F.when(F.col("id") == "a", 5.0).cast("double"))
    assert ids(search(late, asked(spark, [1, 0]))) == ["b"] and ids(search(late, asked(spark, [1, 0]), Options(now=4.0))) == ["a", "b"]


def test_mmr_with_terms_and_ranks_of_ties(spark):
    """Rows that can't be chosen are dropped first; what is left gives the same choice. Ranks that are counted equal those of a full sort."""
    rng = np.random.default_rng(9)
    x = rng.integers(-2, 3, (150, 3)).astype(float)  # many ties
    rows = records(spark, [(f"{i:03}", [float(v) for v in x[i]], {f"w{i % 5}": 0.5, "all": 0.25}) for i in range(150)], "id string, vector array<float>, sparse map<string,float>")
    queries = asked(spark, [1, 0.5, 0.2], [0, 1, 1]).withColumn("sparse", F.create_map(F.concat(F.lit("w"), F.col("qid")), F.lit(0.7).cast("float"), F.lit("all"), F.lit(0.1).cast("float")))
    for metric in ("cosine", "l2"):
        for o in ({"mmr_lambda": 0.8, "k": 6}, {"fusion": "rrf", "k": 12}, {"explain": True, "k": 7}, {"fusion": "rrf", "k": 5, "dense_weight": 0.3, "sparse_weight": 2.0}):
            got = [(r.qid, r.id, round(r.score, 9), r.asDict().get("dense_rank"), r.asDict().get("sparse_rank")) for r in search(rows, queries, Options(metric=metric, **o)).orderBy("qid", "rank").collect()]
            every = Options(metric=metric, **(o | {"mmr_lambda": None}))
            scored = _all_scored(rows, rows, queries, bm25_scores(build_index(rows), query_terms(queries)), every, True)
            full = mmr_select(scored, rows, Options(metric=metric, **o)) if o.get("mmr_lambda") else ranked(scored, "score", o["k"])
            want = [(r.qid, r.id, round(r.score, 9), r.asDict().get("dense_rank"), r.asDict().get("sparse_rank")) for r in full.orderBy("qid", "rank").collect()]
            assert got == want, (metric, o)


def test_candidate_counts():
    assert candidate_count(200, 10) == 200 and candidate_count(1000, 5) == 64 and candidate_count(1000, 20) == 160
    assert resolved_fetch_k(100, Options(k=10, mmr_lambda=0.5)) == 40 and resolved_fetch_k(30, Options(k=0)) == 30
    assert candidates_for(200, 10, 1) == 10 and candidates_for(200, 10, 4) == 40 and default_parts(64) == 16 and default_parts(7) == 1


def test_binary_codes(spark):
    row = spark.createDataFrame([([1.0, -1.0, 0.5, -0.5, 0.0, 0.1, -0.1, 0.9],)], "vector array<float>").select(binary_codes().alias("c"), hamming(F.array(F.lit(0xFF)), F.array(F.lit(0))).alias("h")).first()
    assert row.c == [0b10100101] and row.h == 8


def _vectors(n=400, d=16, seed=1):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((12, d))
    x = centers[rng.integers(0, 12, n)] + 0.4 * rng.standard_normal((n, d))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def test_quantizers_and_inverted_file(spark):
    x = _vectors()
    rows = records(spark, [(f"d{i:04}", [float(v) for v in x[i]]) for i in range(len(x))]).cache()
    queries = asked(spark, *x[:20])
    exact = search(rows, queries).cache()
    for method, least in (("int8", 0.99), ("binary", 0.9), ("two_bit", 0.9), ("pq", 0.9)):
        assert recall(search_quantized(rows, queries, method), exact) >= least, method
    for preset in PRESETS:
        assert recall(InvertedFile.build(rows, preset=preset).search(queries), exact) >= 0.9, preset
    few = rows.where("id < 'd0003'")
    assert len(found(InvertedFile.build(rows).search(queries.limit(1), allowed=few))) == 3
    q = ProductQuantizer.train(rows, parts=4, centroids=8)
    assert q.codebooks.shape == (4, 8, 4) and q.distances(x[0]).shape == (4, 8)
    with pytest.raises(ValueError):
        ProductQuantizer.train(rows, parts=3)


def test_analyzers(spark):
    df = spark.createDataFrame([("The small grey heron, the END",)], "t string")
    row = df.select(terms_of(F.col("t")).alias("s"), Analyzer().stopwords("en").tokenize(F.col("t")).alias("w"), Analyzer().ngrams(3).tokenize(F.lit("tides no")).alias("g"), Analyzer().sparse_terms_weighted({"a": F.col("t"), "b": F.lit("heron")}, {"b": 2.0}).alias("m"), hashing_embedder(8)(F.col("t")).alias("e")).first()
    assert math.isclose(row.s["the"], 2 / 6, rel_tol=1e-6) and row.w == ["small", "grey", "heron", "end"] and row.g == ["tid", "ide", "des", "no"]
    assert math.isclose(row.m["heron"], 1 / 6 + 2, rel_tol=1e-6) and math.isclose(sum(v * v for v in row.e), 1, rel_tol=1e-5)


def test_rerankers(spark):
    results = spark.createDataFrame([("0", 1, "", "doc1", 1.0, "harbour rope ledger", "Rope ledger", "harbour lights", "attic"), ("0", 2, "", "doc2", 1.0, "harbour lights plan", "Harbour lights", "harbour lights", "cellar")], "qid string, rank bigint, namespace string, id string, score double, text string, title string, query string, source string")
    order = lambda df: [r.id for r in df.orderBy("rank").collect()]
    assert order(text_match()(results)) == ["doc2", "doc1"]
    assert [round(r.rerank_score, 4) for r in metadata_boost(F.col("source"), {"cellar": 0.25})(results).orderBy("rank").collect()] == [1.25, 1.0]
    assert order(compose(text_match(), metadata_boost(F.col("source"), {"attic": 9}))(results)) == ["doc1", "doc2"]
    assert order(compose(text_match(), metadata_boost(F.col("source"), {"cellar": 9}), mode="rrf")(results)) == ["doc2", "doc1"]
    assert order(hook(lambda _, rows: rows[::-1])(results)) == ["doc2", "doc1"] and order(hook(lambda _, rows: [])(results)) == ["doc1", "doc2"]


def test_stats_and_spans(spark):
    from contextlib import contextmanager

    seen = {}

    class Span:
        set_attribute = seen.__setitem__

        def record_exception(self, e):
            seen["error"] = str(e)

    @contextmanager
    def start(name):
        seen["name"] = name
        yield Span()

    configure_tracing(start)
    rows, stats = search_with_stats(records(spark, [("a", [1.0, 0.0]), ("b", [0.0, 1.0])]), asked(spark, [1, 0]), Options(k=1))
    configure_tracing(None)
    assert len(rows) == 1 and stats["considered_count"] == 2 and stats["fetch_k"] == 1 and stats["effective_dimension"] == 2 and seen["name"] == "search" and seen["k"] == 1


def test_schema(spark, tmp_path):
    schema = Schema({"price": "number", "title": "string", "active": "boolean", "author": {"age": "integer"}, "tags": "array<string>"})
    rows = records(spark, [("ok", [1.0], '{"price":1.5,"title":null,"tags":["a"]}'), ("bad", [1.0], '{"price":true,"title":3,"author":{"age":"x"},"tags":["a",1]}'), ("none", [1.0], "{}")], META)
    got = {r.id: r.v for r in rows.select("id", schema.violations(F.col("metadata")).alias("v")).collect()}
    assert got["ok"] == [] and got["none"] == [] and [x.split(":")[0] for x in got["bad"]] == ["author.age", "price", "tags[]", "title"]
    schema.save(str(tmp_path / "s.json"))
    assert Schema.load(str(tmp_path / "s.json")).fields == schema.fields
    strict = Schema({"author": {"age": "integer"}}, strict=True)
    assert rows.where("id = 'bad'").select(strict.violations(F.col("metadata"))).first()[0][0] == "author.age: not integer"
    with pytest.raises(RecordError):
        Schema({"x": "date"})
    with pytest.raises(RecordError):
        schema.check(rows)


def _worded(spark, n=700, seed=3):
    """Rows of which most share a word and some have rare ones, weights that aren't positive, no terms or no vector."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        words = {"all": 0.5, **{f"w{int(w)}": float(np.float32(rng.random())) for w in rng.integers(0, 40, 4)}, **{f"rare{int(w)}": 0.25 for w in rng.integers(0, 2000, 2)}}
        words |= {"none": 0.0, "less": -0.5} if i % 7 == 0 else {}
        out.append((f"n{i % 3}", f"{i:04}", None if i % 11 == 5 else [float(v) for v in rng.integers(-3, 4, 5) + 0.5], None if i % 13 == 4 else words))
    rows = spark.createDataFrame(out, "namespace string, id string, vector array<float>, sparse map<string,float>").repartition(3).cache()
    asked = [(i, v, s) for _, i, v, s in out[::50]] + [("odd", None, {"all": -0.3, "w1": 1.0, "w2": 0.0}), ("bare", [1.0] * 5, None)]
    return out, rows, asked, spark.createDataFrame(asked, "qid string, vector array<float>, sparse map<string,float>")


def _by_hand(out, asked):
    """(qid, namespace, id) to the dense score, BM25 (None without a shared term) and the shared terms."""
    kept = {(ns, i): {t: float(w) for t, w in (s or {}).items() if w > 0} for ns, i, _, s in out}
    df, average = {}, sum(sum(s.values()) for s in kept.values()) / len(out)
    for s in kept.values():
        for t in s:
            df[t] = df.get(t, 0) + 1
    said = {}
    for q, qv, terms in asked:
        for ns, i, v, s in out:
            own = kept[ns, i]
            norm = 0.25 + 0.75 * sum(own.values()) / average
            parts = [float(np.float32(w)) * math.log((len(out) - df[t] + 0.5) / (df[t] + 0.5) + 1) * own[t] * 2.2 / (own[t] + 1.2 * norm) for t, w in (terms or {}).items() if t in own]
            dense = np.dot(v, qv) / np.linalg.norm(v) / np.linalg.norm(qv) if v is not None and qv is not None else None
            said[q, ns, i] = dense, round(sum(parts), 9) if parts else None, sorted(set(terms or {}) & set(s or {}))
    return said


@pytest.mark.parametrize("small", [False, True])
def test_terms_are_scored_without_moving_pairs(spark, monkeypatch, small):
    """Results by hand; no join of queries and rows. small: blocks of a few queries, rows and terms at a time."""
    if small:
        for name, value in (("QUERY_BYTES", 4000), ("CELLS", 500), ("MOST_COMMON", 2)):
            monkeypatch.setattr(bm25, name, value)
    out, rows, asked, queries = _worded(spark)
    want = _by_hand(out, asked)
    for weights in ((1.0, 1.0), (0.4, 2.0)):
        top = search(rows, queries, Options(namespace=None, k=20, dense_weight=weights[0], sparse_weight=weights[1]))
        assert "Join" not in top._jdf.queryExecution().toString()
        got = {}
        for r in top.orderBy("qid", "rank").collect():
            got.setdefault(r.qid, []).append((round(r.score, 7), r.namespace, r.id))
        for q, _, _ in asked:
            every = [(-round(weights[0] * (d or 0) + weights[1] * (b or 0), 7), ns, i) for (p, ns, i), (d, b, _) in want.items() if p == q and (d is not None or b is not None)]
            assert got[q] == [(-s, ns, i) for s, ns, i in sorted(every)[:20]], q
    alone = search(rows, queries.select("qid", "sparse"), Options(namespace=None, k=15))
    assert "Join" not in alone._jdf.queryExecution().toString()
    for q, _, _ in asked:
        every = sorted((-b, ns, i) for (p, ns, i), (_, b, _) in want.items() if p == q and b is not None)
        assert [(ns, i) for _, ns, i in every[:15]] == [(r.namespace, r.id) for r in alone.where(F.col("qid") == q).orderBy("rank").collect()]
    every = bm25_scores(build_index(rows), query_terms(queries)).collect()
    assert {(r.qid, r.namespace, r.id): round(r.bm25, 7) for r in every} == {k: round(b, 7) for k, (_, b, _) in want.items() if b is not None} and len(every) == len({(r.qid, r.namespace, r.id) for r in every})


def test_matched_terms_are_found_without_moving_terms(spark):
    out, rows, asked, queries = _worded(spark)
    found = bm25.matched_terms(rows, query_terms(queries))
    plan = found._jdf.queryExecution().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    assert {(r.qid, r.namespace, r.id): r.matched for r in found.collect()} == {k: t for k, (_, _, t) in _by_hand(out, asked).items() if t}


def test_ranks_and_explanations_of_terms(spark):
    out, rows, asked, queries = _worded(spark)
    want = _by_hand(out, asked)
    for o in (Options(namespace=None, fusion="rrf", k=12), Options(namespace=None, explain=True, k=12)):
        place = {}
        for q, _, _ in asked:
            for kind in (0, 1):
                order = sorted((-round(v[kind], 9), ns, i) for (p, ns, i), v in want.items() if p == q and (v[kind] or 0) > 0)
                place |= {(kind, q, ns, i): at + 1 for at, (_, ns, i) in enumerate(order)}
        for r in search(rows, queries, o).collect():
            key = r.qid, r.namespace, r.id
            assert (r.dense_rank, r.sparse_rank) == (place.get((0, *key)), place.get((1, *key))), key
            if o.explain:
                assert (r.matched or []) == want[key][2]
                weights = next(s for q, _, s in asked if q == r.qid) or {}
                assert abs(sum(weights[t] * v for t, v in (r.term_scores or {}).items()) - (want[key][1] or 0)) < 1e-6


def test_inverted_file_scores_cells_without_moving_pairs(spark):
    x = _vectors()
    rows = records(spark, [(f"d{i:04}", [float(v) for v in x[i]]) for i in range(len(x))]).cache()
    file = InvertedFile.build(rows, cells=20)
    file.probes = 3
    got = file.search(asked(spark, *x[:30]), 5)
    assert not file.fallbacks
    assert "Join" not in got._jdf.queryExecution().toString()
    centroids = file.centroids
    cell = {r.id: r.cell for r in file.rows.collect()}
    for q in range(30):
        near = np.argsort(((x[q] - centroids) ** 2).sum(axis=1), kind="stable")[:3]
        every = sorted((-round(float(x[q] @ x[i]), 6), f"d{i:04}") for i in range(len(x)) if cell[f"d{i:04}"] in near)
        own = [r.id for r in got.where(F.col("qid") == str(q)).orderBy("rank").collect()]
        assert own == [i for _, i in every[:5]]
