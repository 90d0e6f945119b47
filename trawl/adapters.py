"""Thin stores in the shape that retrieval frameworks expect, and text helpers; none needs the framework."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import functions as F

from .functions.text import sparse_terms
from .operators.rerank import Reranker
from .operators.search import Options
from .plans.explain import search_with_stats
from .sources.store import Collection

Embed = Callable[[list[str]], list[list[float]]]
_ROW = "id string, text string, vector array<float>, metadata string"


def upsert_texts(collection: Collection, texts: list[str], embed: Embed, ids: list[str] | None = None, metadatas: list[dict] | None = None, namespace: str = "") -> list[str]:
    """Vectors by embed, sparse terms of the text, which is also kept as metadata.text unless that is given."""
    import json

    ids = ids or [uuid.uuid4().hex for _ in texts]
    metadatas = metadatas or [{} for _ in texts]
    rows = [(i, t, [float(x) for x in v], json.dumps({"text": t} | m)) for i, t, v, m in zip(ids, texts, embed(texts), metadatas, strict=True)]
    df = collection.spark.createDataFrame(rows, _ROW).withColumn("sparse", sparse_terms(F.col("text")))
    collection.upsert(df.select("id", "vector", "metadata", "sparse"), namespace)
    return ids


def _asked(collection: Collection, texts: list[str], embed: Embed, hybrid: bool):
    rows = [(str(i), t, [float(x) for x in v]) for i, (t, v) in enumerate(zip(texts, embed(texts), strict=True))]
    queries = collection.spark.createDataFrame(rows, "qid string, text string, vector array<float>")
    if hybrid:
        queries = queries.withColumn("sparse", sparse_terms(F.col("text")))
    return queries


def _reranked(collection: Collection, found, queries, rerank: Reranker):
    """found with the stored text, title and metadata and each query's text as `query`, for a reranker."""
    kept = collection.records().select("namespace", "id", *(F.try_variant_get("metadata", f"$.{n}", "string").alias(n) for n in ("text", "title")), "metadata")
    said = queries.select("qid", F.col("text").alias("query"))
    return rerank(found.join(kept, ["namespace", "id"]).join(said, "qid"))


def search_texts(collection: Collection, texts: list[str], embed: Embed, options: Options | None = None, hybrid: bool = True, rerank: Reranker | None = None, rerank_k: int = 0):
    """queries by their number as qid. rerank: over the first rerank_k results of each query (0: all)."""
    queries = _asked(collection, texts, embed, hybrid)
    found = collection.search(queries.drop("text"), options or Options())
    if rerank is None:
        return found
    return _reranked(collection, found.where(F.col("rank") <= rerank_k) if rerank_k else found, queries, rerank)


def search_texts_with_stats(collection: Collection, texts: list[str], embed: Embed, options: Options | None = None, hybrid: bool = True, rerank: Reranker | None = None, rerank_k: int = 0) -> tuple[list, dict]:
    """The collected results of search_texts, and the statistics of the search."""
    queries = _asked(collection, texts, embed, hybrid)
    whole = (lambda df: _reranked(collection, df, queries, rerank)) if rerank is not None else None
    return search_with_stats(collection, queries.drop("text"), options, whole, rerank_k)


class VectorStore:
    """add_texts, similarity_search and so on; documents are dicts of text and metadata."""

    def __init__(self, collection: Collection, embed: Embed, namespace: str = "", hybrid: bool = True):
        self.collection, self.embed, self.namespace, self.hybrid = collection, embed, namespace, hybrid

    @classmethod
    def from_texts(cls, texts: list[str], embed: Embed, collection: Collection, metadatas: list[dict] | None = None, **how) -> VectorStore:
        own = cls(collection, embed, **how)
        own.add_texts(texts, metadatas)
        return own

    def add_texts(self, texts: list[str], metadatas: list[dict] | None = None, ids: list[str] | None = None) -> list[str]:
        return upsert_texts(self.collection, texts, self.embed, ids, metadatas, self.namespace)

    def add_documents(self, documents: list[dict], ids: list[str] | None = None) -> list[str]:
        return self.add_texts([d["text"] for d in documents], [d.get("metadata", {}) for d in documents], ids)

    def _documents(self, found) -> list[tuple[dict, float]]:
        import json

        joined = found.join(self.collection.records().select("namespace", "id", F.to_json("metadata").alias("m")), ["namespace", "id"]).orderBy("rank").collect()
        out = []
        for r in joined:
            m = json.loads(r.m)
            out.append(({"id": r.id, "text": m.pop("text", ""), "metadata": m}, r.score))
        return out

    def similarity_search_with_score(self, query: str, k: int = 4, filter: dict | None = None) -> list[tuple[dict, float]]:
        return self._documents(search_texts(self.collection, [query], self.embed, Options(k=k, namespace=self.namespace, filter=filter), self.hybrid))

    def similarity_search(self, query: str, k: int = 4, filter: dict | None = None) -> list[dict]:
        return [d for d, _ in self.similarity_search_with_score(query, k, filter)]

    def similarity_search_by_vector(self, vector: list[float], k: int = 4, filter: dict | None = None) -> list[dict]:
        queries = self.collection.spark.createDataFrame([("0", [float(x) for x in vector])], "qid string, vector array<float>")
        return [d for d, _ in self._documents(self.collection.search(queries, Options(k=k, namespace=self.namespace, filter=filter)))]

    def delete(self, ids: list[str]) -> int:
        return self.collection.delete(ids, self.namespace)

    def close(self) -> None:
        self.collection.close()


class NodeStore:
    """add, query and delete over nodes (dicts of id, text, vector, metadata)."""

    def __init__(self, collection: Collection, namespace: str = ""):
        self.collection, self.namespace = collection, namespace

    def add(self, nodes: list[dict]) -> list[str]:
        vectors = [n["vector"] for n in nodes]  # by position, as texts may be equal
        return upsert_texts(self.collection, [n["text"] for n in nodes], lambda _: vectors, [n["id"] for n in nodes], [n.get("metadata", {}) for n in nodes], self.namespace)

    def query(self, vector: list[float], k: int = 4, filter: dict | None = None) -> list[tuple[str, float]]:
        queries = self.collection.spark.createDataFrame([("0", [float(x) for x in vector])], "qid string, vector array<float>")
        found = self.collection.search(queries, Options(k=k, namespace=self.namespace, filter=filter))
        return [(r.id, r.score) for r in found.orderBy("rank").collect()]

    def delete(self, id: str) -> int:
        return self.collection.delete([id], self.namespace)

    def close(self) -> None:
        self.collection.close()
