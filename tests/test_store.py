import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from trawl.__main__ import main
from trawl.adapters import NodeStore, VectorStore, search_texts, search_texts_with_stats
from trawl.operators.rerank import text_match
from trawl.operators.search import ANY_TIME, Options
from trawl.schema import DuplicateIdError, RecordError, Schema, with_defaults
from trawl.sources.io import csv_records, from_arrays, read_csv, read_jsonl, write_jsonl
from trawl.plans.explain import search_with_stats
from trawl.sources.store import ClosedError, Collection, Store, Validated, open_store
from trawl.streaming.ingest import apply_ops, start_ingest


def rows(spark, *items):
    return spark.createDataFrame([(i, [float(x) for x in v], json.dumps(m)) for i, v, m in items], "id string, vector array<float>, metadata string")


@pytest.fixture
def collection(spark, tmp_path):
    c = Collection.create(spark, str(tmp_path / "c"), 2)
    c.upsert(rows(spark, *((f"doc{i}", [1, i], {"n": i}) for i in range(5))))
    return c


def test_writes_and_reads(spark, collection):
    c = collection
    assert len(c) == 5 and c.count() == 5 and c.get("doc1").id == "doc1" and c.get("doc9") is None and c.namespaces() == [""]
    c.upsert(rows(spark, ("doc1", [9, 9], {"n": 100})))
    assert len(c) == 5 and c.count(tests={"n": 100}) == 1
    with pytest.raises(DuplicateIdError):
        c.insert(rows(spark, ("doc1", [0, 0], {})))
    c.insert(rows(spark, ("doc1", [0, 1], {})), namespace="other")
    assert c.namespaces() == ["", "other"] and c.delete(["doc2", "doc2", "missing"]) == 2 and c.delete_by_filter({"n": {"$gte": 100}}) == 1 and len(c) == 4
    assert c.update_metadata("doc3", {"n": 7, "new": [1]}) and not c.update_metadata("nope", {}) and c.count(tests={"n": 7, "new": {"$size": 1}}) == 1
    with pytest.raises(RecordError):
        c.upsert(rows(spark, ("x", [1], {})))


def test_ttl(spark, collection):
    c = collection
    assert c.set_ttl("doc1", 0, now=50) and c.count(now=50) == 4 and len(c) == 5 and c.get("doc1", now=50) is None and c.get("doc1", now=49) is not None
    with pytest.raises(DuplicateIdError):
        c.insert(rows(spark, ("doc1", [0, 0], {})))
    with pytest.raises(RecordError):
        c.set_ttl("doc1", -1, now=0)
    assert c.set_ttl("doc2", float("inf"), now=0) and c.set_ttl("doc1", None, now=0) and c.count(now=1e9) == 5 and not c.set_ttl("zz", 1, now=0)
    c.set_ttl("doc1", 1, now=0)
    assert c.compact(now=10) == 1 and len(c) == 4
    page, cursor = c.list_cursor(limit=2)
    assert [r.id for r in page] == ["doc0", "doc2"]
    page, cursor = c.list_cursor(limit=2, after=cursor)
    assert [r.id for r in page] == ["doc3", "doc4"] and cursor is None


def test_pages(collection):
    seen, cursor = [], None
    while True:
        page, cursor = collection.list_cursor(limit=2, after=cursor)
        seen.append(len(page))
        if cursor is None:
            break
    assert seen == [2, 2, 1] and [r.id for r in collection.list(limit=2, offset=1).collect()] == ["doc1", "doc2"] and collection.list().count() == 5


def test_transactions(spark, collection):
    c = collection
    with c.transaction() as t:
        t.upsert(rows(spark, ("a", [1, 1], {})))
        t.delete(["doc0"])
        t.insert(rows(spark, ("b", [1, 1], {})))
        t.delete(["b"])
    assert len(c) == 5 and c.get("a") and not c.get("doc0") and not c.get("b")
    with pytest.raises(ZeroDivisionError), c.transaction() as t:
        t.upsert(rows(spark, ("z", [1, 1], {})))
        1 / 0  # noqa: B018
    with pytest.raises(ClosedError):
        t.delete(["a"])
    with pytest.raises(DuplicateIdError), c.transaction() as t:
        t.insert(rows(spark, ("a", [1, 1], {})))
    assert len(c) == 5


def test_indexes_never_change_results(collection):
    c = collection
    before = c.count(tests={"n": {"$gt": 2}})
    assert c.create_index("n", "numeric") and not c.create_index("n", "float") and c.list_indexes() == [("n", "numeric")] and c.count(tests={"n": {"$gt": 2}}) == before and c.drop_index("n") and not c.drop_index("n")


def test_store_backup_and_handles(spark, tmp_path, collection):
    store = open_store(spark, str(tmp_path))
    assert isinstance(store, Store)
    assert store.collections() == ["c"]
    store.create("d", 3, "l2")
    assert store.collections() == ["c", "d"] and store.open("d").metric == "euclidean" and store.open_or_create("d", 3, "dot").metric == "euclidean"
    with pytest.raises(RecordError):
        store.create("d", 3)
    with pytest.raises(RecordError):
        store.open("nope")
    with pytest.raises(RecordError):
        store.open_or_create("d", 4)
    assert store.drop("d") and not store.drop("d")
    collection.backup(str(tmp_path / "b"))
    assert len(Collection.restore(spark, str(tmp_path / "b"), str(tmp_path / "r"))) == 5
    only = Collection.open(spark, str(tmp_path / "c"), read_only=True)
    with pytest.raises(ClosedError):
        only.delete(["doc1"])
    stale = Collection(spark, str(tmp_path / "c"))
    collection.delete(["doc4"])
    with pytest.raises(RecordError):
        stale.delete(["doc3"])
    with collection as c:
        assert c.verify() == [] and c.stats()["records"] == 4
    with pytest.raises(ClosedError):
        collection.records()


def test_import_export(spark, tmp_path, collection):
    (tmp_path / "in.jsonl").write_text('{"id":"r1","vector":[1,0],"metadata":{"k":"v"}}\n\n{"id":"r2","vector":[0,1],"ttl":5}\n')
    got = read_jsonl(spark, str(tmp_path / "in.jsonl"), now=100.0)
    assert got.count() == 2 and got.where("id = 'r2'").first().expires_at == 105.0
    write_jsonl(collection.records(), str(tmp_path / "out"))
    assert read_jsonl(spark, str(tmp_path / "out")).count() == 5
    (tmp_path / "in.csv").write_text('id,vector,price,name,empty\na,"[1, 2.5]",3,"x ""q""",\nb,oops,1,y,\nc,"[0, 1]",2.5,7up,\n')
    good, bad = read_csv(spark, str(tmp_path / "in.csv"))
    meta = {r.id: json.loads(r.m) for r in good.select("id", F.to_json("metadata").alias("m")).collect()}
    assert bad.count() == 1 and meta == {"a": {"price": 3, "name": 'x "q"'}, "c": {"price": 2.5, "name": "7up"}}
    none, _ = csv_records(spark.createDataFrame([("[1]",)], "vector string"))
    assert none.first().id.startswith("row_")


def _ops(spark, *ops):
    full = with_defaults(spark.createDataFrame([(s, o, i, [float(s), 0.0], p) for s, o, i, p in ops], "seq bigint, op string, id string, vector array<float>, patch string"), keep=("seq", "op", "patch"))
    return full.select("seq", "op", *[c for c in full.columns if c not in ("seq", "op", "patch")], "patch")


def test_streaming_equals_batch(spark, tmp_path, collection):
    ops = _ops(spark, (1, "upsert", "doc1", None), (2, "delete", "doc1", None), (3, "upsert", "new", None), (4, "metadata", "doc2", '{"seen":true}'), (5, "delete", "new", None), (6, "upsert", "new", None))
    want = sorted((r.id, list(r.vector), r.m) for r in apply_ops(collection.records(), ops).select("id", "vector", F.to_json("metadata").alias("m")).collect())
    ops.coalesce(1).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(ops.schema).parquet(str(tmp_path / "log"))
    start_ingest(collection, stream, str(tmp_path / "ck"), availableNow=True).awaitTermination()
    collection._load()
    got = sorted((r.id, list(r.vector), r.m) for r in collection.records().select("id", "vector", F.to_json("metadata").alias("m")).collect())
    assert got == want and collection.count(tests={"seen": True}) == 1


LOG = [
    (1, "upsert", "new", None), (2, "metadata", "new", '{"k":1,"n":null}'), (3, "metadata", "new", '{"k":2,"m":[1]}'), (4, "ttl", "new", None), (5, "metadata", "doc1", '{"a":1}'), (6, "delete", "doc1", None), (7, "metadata", "doc1", '{"b":2}'),
    (8, "upsert", "doc1", None), (9, "metadata", "doc1", '{"c":3}'), (10, "ttl", "doc2", None), (11, "ttl", "doc2", None), (12, "metadata", "gone", '{"x":1}'), (13, "ttl", "gone", None), (14, "delete", "doc3", None), (15, "metadata", "doc2", '{"n":7}'),
]


def _state(df):
    return sorted((r.id, list(r.vector), r.m, r.expires_at) for r in df.select("id", "vector", F.to_json("metadata").alias("m"), "expires_at").collect())


@pytest.mark.parametrize("size", [1, 4, 15])
def test_every_op_counts_however_the_log_is_cut(spark, collection, size):
    ops = _ops(spark, *LOG).withColumn("expires_at", F.when((F.col("op") == "ttl") & (F.col("seq") != 11), F.col("seq") * 1e9))
    for a in range(0, len(LOG), size):
        collection.apply(ops.where(F.col("seq").between(a + 1, a + size)))
    want = [("doc0", [1.0, 0.0], {"n": 0}, None), ("doc1", [8.0, 0.0], {"c": 3}, None), ("doc2", [1.0, 2.0], {"n": 7}, None), ("doc4", [1.0, 4.0], {"n": 4}, None), ("new", [1.0, 0.0], {"k": 2, "m": [1], "n": None}, 4e9)]
    assert [(i, v, json.loads(m), x) for i, v, m, x in _state(collection.records())] == want
    assert collection.apply(ops, ("s", 0)) and not collection.apply(ops, ("s", 0))  # a batch that is in already
    assert len(collection.state["segments"]) == -(-15 // size) + 1
    collection.compact(now=0)
    assert [(i, v, json.loads(m), x) for i, v, m, x in _state(collection.records())] == want and collection.state["segments"] == []


def test_two_writers(spark, collection):
    other = Collection(spark, collection.path)
    before = set(collection.files.list(f"{collection.path}/data"))
    collection.upsert(rows(spark, ("mine", [1, 1], {})))
    with pytest.raises(RecordError):
        other.upsert(rows(spark, ("theirs", [2, 2], {})))
    again = Collection(spark, collection.path)
    assert again.get("mine") and not again.get("theirs") and len(set(collection.files.list(f"{collection.path}/data")) - before) == 1
    again.upsert(rows(spark, ("theirs", [2, 2], {})))
    assert len(Collection(spark, collection.path)) == 7


def test_writes_touch_only_their_rows(spark, collection):
    base, size = collection.state["base"], collection.stats()["base_bytes"]
    collection.upsert(rows(spark, ("doc1", [7, 7], {})))
    collection.set_ttl("doc2", 5, now=0)
    collection.delete_by_filter({"n": 3})
    assert collection.state["base"] == base and collection.stats()["base_bytes"] == size and collection.stats()["log_segments"] == 3
    assert spark.read.parquet(*(f"{collection.path}/{x['folder']}" for x in collection.state["segments"])).count() == 3


def test_last_row_of_a_batch_wins(spark, collection):
    collection.upsert_many(rows(spark, ("a", [1, 1], {"n": 1}), ("b", [0, 1], {}), ("a", [2, 2], {"n": 2})).coalesce(1))
    assert list(collection.get("a").vector) == [2.0, 2.0] and collection.count(tests={"n": 2}) == 2


def test_expired_rows_are_hidden(spark, collection):
    collection.set_ttl("doc0", 10, now=0)
    collection.set_ttl("doc1", 1e12)
    queries = spark.createDataFrame([("0", [1.0, 0.0])], "qid string, vector array<float>")
    assert collection.get("doc0") is None and collection.count() == 4 and collection.search(queries, Options(k=9)).count() == 4 and collection.search(queries, Options(k=9, now=5.0)).count() == 5
    assert collection.search(queries, Options(k=9, now=ANY_TIME)).count() == 5 and [r.id for r in collection.list(limit=2).collect()] == ["doc1", "doc2"]


def test_payload_columns_prune(spark, tmp_path):
    c = Collection.create(spark, str(tmp_path / "p"), 1)
    c.bulk_ingest(rows(spark, *((f"{i:03}", [1], {"n": i, "s": f"k{i % 7}", "deep": {"x": i / 2}}) for i in range(200))))
    tests = {"n": {"$gte": 10, "$lt": 30}, "$or": [{"s": "k1"}, {"s": {"$in": ["k2", "k3"]}}], "deep.x": {"$gt": 2}}
    want = sorted(r.id for r in c.list(tests=tests).collect())
    c.create_index("n", "numeric")
    c.create_index("s", "string")
    c.create_index("deep.x", "float")
    plan = c.records(tests)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(ix0,10.0)" in plan and sorted(r.id for r in c.list(tests=tests).collect()) == want
    c.update_metadata("150", {"n": 12, "s": "k1"})
    c.update_metadata("011", {"n": 500})
    got = sorted(r.id for r in c.list(tests=tests).collect())
    assert "150" in got and "011" not in got and len(c.stats()["indexes"]) == 3


def test_stored_text_index_and_inverted_file(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 8)).astype(np.float32)
    c = Collection.create(spark, str(tmp_path / "s"), 8)
    some = from_arrays(spark, [f"{i:03}" for i in range(400)], x).drop("sparse").withColumn("sparse", F.create_map(F.concat(F.lit("t"), F.col("id").cast("int") % 9), F.lit(0.5).cast("float")))
    c.bulk_ingest(some)
    queries = from_arrays(spark, ["007"], x[7:8]).select(F.col("id").alias("qid"), "vector", F.create_map(F.lit("t7"), F.lit(1.0).cast("float")).alias("sparse"))
    before = [(r.id, r.score) for r in c.search(queries).orderBy("rank").collect()]
    c.build_text_index()
    assert c._text_index() is not None and [(r.id, r.score) for r in c.search(queries).orderBy("rank").collect()] == before
    plain = queries.drop("sparse")
    exact = [r.id for r in c.search(plain).orderBy("rank").collect()]
    c.build_ann("high_recall")
    assert len(set(exact) & {r.id for r in c.search(plain).collect()}) >= 8 and c.last_search["used_ann"] and c.tombstones() == {"indexed": 400, "tombstones": 0, "fresh": 0}
    c.upsert(from_arrays(spark, ["new", "008"], np.stack([x[7], x[7]])))
    c.delete([exact[1]])
    top = [r.id for r in c.search(plain).orderBy("rank").collect()]
    assert set(top[:3]) == {"007", "new", "008"} and exact[1] not in top and c._text_index() is None and c.tombstones()["fresh"] == 2
    _, stats = search_with_stats(c, plain)
    assert stats["used_ann"] and stats["ann_loaded_from_disk"] and stats["wal_entries_replayed"] == 2 and stats["considered_count"] == 400
    few, stats = search_with_stats(c, plain, Options(filter={"none": 1}))
    assert few == [] and stats["exact_fallback"]


def test_token_index(spark, tmp_path):
    c = Collection.create(spark, str(tmp_path / "t"), 2)
    for i in range(3):
        c.upsert_multi_vectors(f"d{i}", [1, 0], {"words": [[float(i), 1.0, -1.0], [0.5, float(i), 2.0]]})
    queries = spark.createDataFrame([("0", [[2.0, 1.0, -1.0]])], "qid string, tokens array<array<float>>")
    exact = [(r.id, round(r.score, 6)) for r in c.search_multi_vector(queries, "words").orderBy("rank").collect()]
    c.build_token_index("words")
    assert [(r.id, round(r.score, 6)) for r in c.search_multi_vector(queries, "words").orderBy("rank").collect()] == exact and exact[0][0] == "d2"
    with pytest.raises(RecordError):
        c.search_multi_vector(queries, "")
    with pytest.raises(RecordError):
        c.search_multi_vector(queries.withColumn("tokens", F.array().cast("array<array<float>>")), "words")


def test_json_transactions_and_threads(spark, collection):
    ops = [{"op": "upsert", "id": "a", "vector": [1, 1], "metadata": {"n": 50}, "ttl": 1000}, {"op": "update_metadata", "id": "a", "patch": {"m": 1}}, {"op": "delete", "id": "doc0"}, {"op": "set_ttl", "id": "doc1", "ttl": None}, {"op": "insert", "namespace": "o", "id": "b", "vector": [0, 1]}]
    assert collection.transaction_execute(json.dumps(ops), now=1e9) == 5 and collection.count(tests={"m": 1, "n": 50}, now=1e9) == 1 and collection.count(now=2e9) == 5 and len(collection.state["segments"]) == 1
    with pytest.raises(RecordError):
        collection.transaction_execute([{"op": "melt", "id": "a"}])
    with pytest.raises(DuplicateIdError):
        collection.transaction_execute([{"op": "insert", "id": "doc1", "vector": [1, 1]}])
    queries = spark.createDataFrame([("0", [1.0, 0.0])], "qid string, vector array<float>")
    both = [collection.search_async(queries, Options(k=2)) for _ in range(2)]
    assert both[0].result(60) == both[1].result(60) and len(both[0].result()) == 2 and collection.run_async(collection.flush).result(60) >= 0


def test_adapters(spark, tmp_path):
    embed = lambda ts: [[1.0, float("harbour" in t)] for t in ts]
    store = VectorStore.from_texts(["harbour map", "old ledger"], embed, Collection.create(spark, str(tmp_path / "v"), 2), [{"n": 1}, {"n": 2}])
    top = store.similarity_search_with_score("harbour", k=1)
    assert top[0][0]["text"] == "harbour map" and top[0][0]["metadata"] == {"n": 1} and store.similarity_search_by_vector([1.0, 0.0], k=1)[0]["text"] == "old ledger"
    nodes = NodeStore(Collection.create(spark, str(tmp_path / "n"), 2))
    nodes.add([{"id": "a", "text": "x", "vector": [1.0, 0.0]}, {"id": "b", "text": "x", "vector": [0.0, 1.0]}])
    assert nodes.query([0.0, 1.0], 1)[0][0] == "b" and nodes.query([1.0, 0.0], 1)[0][0] == "a" and nodes.delete("b") == 1
    found, stats = search_texts_with_stats(store.collection, ["harbour map"], embed, Options(k=2), rerank=text_match(), rerank_k=1)
    assert [r.id for r in found] == [top[0][0]["id"]] and found[0].rerank_score > found[0].score and stats["rerank_applied"] and stats["rerank_count"] == 1 and stats["sparse_candidate_count"] == 1
    assert search_texts(store.collection, ["harbour map"], embed, Options(k=2), rerank=text_match()).count() == 2


def test_command_line(spark, tmp_path, capsys):
    path = str(tmp_path / "cli")
    assert main(["init", path, "--dimension", "2"]) == 0
    main(["insert", path, "a", "--query", "[1, 0]", "--metadata", '{"k": "v", "n": 3}'])
    main(["count", path, "n>2"])
    main(["search", path, "--query", "[1, 0]", "--namespace", ""])
    main(["list", path, "k=v"])
    assert main(["verify", path]) == 0
    out = capsys.readouterr().out.splitlines()
    assert out[0] == "1" and json.loads(out[1])["id"] == "a" and json.loads(out[2])["metadata"]["n"] == 3 and out[3] == "OK"


def test_quantized_collection_and_arrays(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 8)).astype(np.float32)
    c = Collection.create(spark, str(tmp_path / "q"), 8)
    with pytest.raises(RecordError):
        c.enable_quantization("int8")
    c.bulk_ingest(from_arrays(spark, [str(i) for i in range(300)], x, [{"even": i % 2 == 0} for i in range(300)]))
    queries = from_arrays(spark, ["7", "8"], x[7:9]).select(F.col("id").alias("qid"), "vector")
    exact = [(r.qid, r.id) for r in c.search(queries, Options(k=5)).orderBy("qid", "rank").collect()]
    for method in ("int8", "pq"):
        c.enable_quantization(method, 20)
        assert [(r.qid, r.id) for r in c.search(queries, Options(k=5)).orderBy("qid", "rank").collect()] == exact
    c.backup(str(tmp_path / "q2"))
    assert Collection(spark, str(tmp_path / "q2")).quantization_config() == {"method": "product", "multiplier": 20, "stale": None} and c.quantization_config()["stale"] == 0
    # codes serve later versions too: rows written since are searched exactly, replaced ones don't count
    c.upsert(from_arrays(spark, ["new", "9"], np.stack([x[7], -x[7]])))
    c.delete(["8"])
    assert c.quantization_config()["stale"] == 2
    top = c.search(queries.limit(1), Options(k=5)).orderBy("rank").collect()
    assert {top[0].id, top[1].id} == {"7", "new"} and not {"8", "9"} & {r.id for r in top}
    c.compact()
    assert c.quantization_config() == {"method": "product", "multiplier": 20, "stale": 0} and c.is_quantized() and c.valid_parts() == [1, 2, 4, 8]
    assert {int(r.id) % 2 for r in c.search(queries, Options(k=5, filter={"even": True})).collect()} == {0}
    assert c.disable_quantization() and not c.disable_quantization()
    with pytest.raises(RecordError):
        from_arrays(spark, ["a"], x)


def test_validated(spark, collection):
    v = Validated(collection, Schema({"n": "integer"}))
    with pytest.raises(RecordError):
        v.upsert(rows(spark, ("x", [1, 1], {"n": "one"})))
    with pytest.raises(RecordError):
        v.update_metadata("doc1", {"n": True})
    v.upsert(rows(spark, ("x", [1, 1], {"n": 1})))
    assert v.update_metadata("x", {"n": 2}) and len(v) == 6 and v.count(tests={"n": 2}) == 2


def test_search_through_a_collection(spark, collection):
    queries = spark.createDataFrame([("0", [1.0, 0.0])], "qid string, vector array<float>")
    assert collection.search(queries, Options(k=1)).first().id == "doc0"
