"""Statistics of a search as one row, and spans around actions."""

from __future__ import annotations

import time
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.bm25 import bm25_scores, build_index
from ..operators.search import Options, query_terms, resolved_fetch_k, search, visible

_tracer: Callable | None = None


def configure_tracing(start_span: Callable | None) -> None:
    """start_span(name) gives a context manager whose value has set_attribute and record_exception; None turns spans off."""
    global _tracer
    _tracer = start_span


@contextmanager
def span(name: str, **attributes):
    if _tracer is None:
        yield None
        return
    with _tracer(name) as s:
        for k, v in attributes.items():
            s.set_attribute(k, v)
        try:
            yield s
        except Exception as e:
            s.record_exception(e)
            raise


def traced(action: Callable, name: str | None = None) -> Callable:
    """An action inside a span of its name: flush, upsert, count, whatever runs jobs."""

    def run(*args, **how):
        with span(name or action.__name__):
            return action(*args, **how)

    return run


def search_with_stats(target, queries: DataFrame, options: Options | None = None, rerank: Callable[[DataFrame], DataFrame] | None = None, rerank_k: int = 0) -> tuple[list, dict]:
    """The collected results and what it took to find them; times are in microseconds. target: records, or a collection, whose codes and inverted file then count.

    rerank: a reranker over the results (see rerank), of which the first rerank_k of each query are asked for, all if 0.
    """
    o = options or Options()
    began = time.perf_counter()
    is_table = isinstance(target, DataFrame)
    records = target if is_table else target.records(o.filter)
    with span("search", k=o.k, metric=o.metric, fusion=o.fusion):
        total = records.count()
        seen = visible(records, o.namespace, o.filter, o.now)
        sparse = "sparse" in queries.columns
        considered = seen.count()
        matches = bm25_scores(build_index(records), query_terms(queries), seen).count() if sparse else 0
        fetch_k = resolved_fetch_k(total, o)
        ready = time.perf_counter()
        found = search(records, queries, o) if is_table else target.search(queries, o)
        rows = found.collect()
        searched = time.perf_counter()
        if rerank is not None and rows:
            first = [r for r in rows if not rerank_k or r["rank"] <= rerank_k]
            rows = rerank(queries.sparkSession.createDataFrame(rows, found.schema).where(F.col("rank") <= (rerank_k or len(rows)))).orderBy("qid", "rank").collect()
    done = time.perf_counter()
    used = {} if is_table else target.last_search
    dimension = (queries.selectExpr("max(size(vector))").first()[0] or 0) if "vector" in queries.columns else 0
    stats = {
        "used_ann": used.get("used_ann", False), "ann_candidate_count": used.get("ann_candidate_count", 0), "exact_fallback": used.get("exact_fallback", False), "considered_count": considered, "fetch_k": fetch_k,
        "mmr_applied": o.mmr_lambda is not None and o.k > 1 and len(rows) > 1, "sparse_candidate_count": matches, "ann_loaded_from_disk": used.get("ann_loaded_from_disk", False),
        "wal_entries_replayed": 0 if is_table else len(target.state["segments"]), "fusion": o.fusion, "effective_dimension": min(o.truncate_dim or dimension, dimension), "matryoshka_truncated": bool(o.truncate_dim and o.truncate_dim < dimension),
        "rerank_applied": rerank is not None and bool(rows), "rerank_count": len(first) if rerank is not None and rows else 0, "plan_us": int((ready - began) * 1e6), "search_us": int((searched - ready) * 1e6), "rerank_us": int((done - searched) * 1e6),
        "total_us": int((done - began) * 1e6),
    }
    return rows, stats
