"""Vector metrics as Column expressions; higher is always better. Floats are stored, arithmetic is in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ALIASES = {"cosine": ("cosine",), "euclidean": ("euclidean", "l2"), "dot": ("dot", "dotproduct", "dot_product", "ip", "inner_product"), "manhattan": ("manhattan", "l1")}
_NAMES = {alias: name for name, aliases in _ALIASES.items() for alias in aliases}


def metric_name(name: str) -> str:
    """The canonical name of a metric, in any case."""
    if name.lower() not in _NAMES:
        raise ValueError(f"unknown metric {name!r}")
    return _NAMES[name.lower()]


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _pairs(a: Column, b: Column, f) -> Column:
    return F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return _sum(_pairs(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def euclidean(a: Column, b: Column) -> Column:
    """The negated distance; never -0.0."""
    return 0.0 - F.sqrt(_sum(_pairs(a, b, lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column, b: Column) -> Column:
    return 0.0 - _sum(_pairs(a, b, lambda x, y: F.abs(x - y)))


def score(metric: str, a: Column, b: Column) -> Column:
    return {"cosine": cosine, "dot": dot, "euclidean": euclidean, "manhattan": manhattan}[metric_name(metric)](a, b)


def maxsim(metric: str, query: Column, document: Column) -> Column:
    """Late interaction: the sum over query tokens of the best score over document tokens; 0 if either has none."""
    best = F.transform(query, lambda q: F.array_max(F.transform(document, lambda d: score(metric, q, d))))
    return F.when((F.size(query) < 1) | (F.size(document) < 1), F.lit(0.0)).otherwise(_sum(best))
