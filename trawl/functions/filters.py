"""Document-style metadata filters, compiled once to two-valued Column predicates over a VARIANT.

Equality is type-strict: an integer is never equal to a float, an explicit null is a value and a missing key is none. Every leaf is coalesced to false, so
that $not is plain negation and no SQL NULL gets through.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


class FilterError(ValueError):
    """A filter that isn't valid."""


def _quoted(key: str) -> str:
    return "[" + json.dumps(key, ensure_ascii=False) + "]"


def child(value: Column, *keys: str) -> Column:
    """The variant below these keys; SQL NULL if there is none, a variant null for an explicit null."""
    return F.variant_get(value, "$" + "".join(map(_quoted, keys)), "variant")


def resolve(value: Column, path: str) -> Column:
    """The literal key first, even if it has dots, then the nested one; lists aren't entered."""
    return F.coalesce(child(value, path), child(value, *path.split("."))) if "." in path else child(value, path)


def kind_of(value: Column) -> Column:
    return F.schema_of_variant(value)


def is_kind(value: Column, kind: str) -> Column:
    """kind: string, integer, float, number, boolean, null, array, object. NULL counts as none of them."""
    t = kind_of(value)
    integer = t == "BIGINT"
    real = t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT")
    tests = {"string": t == "STRING", "integer": integer, "float": real, "number": integer | real, "boolean": t == "BOOLEAN", "null": t == "VOID", "array": t.startswith("ARRAY"), "object": t.startswith("OBJECT")}
    return F.coalesce(tests[kind], F.lit(False))


def elements(value: Column) -> Column:
    return F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>"))


def _equals(value: Column, want) -> Column:
    if want is None:
        return is_kind(value, "null")
    if isinstance(want, bool):
        return is_kind(value, "boolean") & (F.try_variant_get(value, "$", "boolean") == want)
    if isinstance(want, int):
        return is_kind(value, "integer") & (F.try_variant_get(value, "$", "bigint") == want)
    if isinstance(want, float):
        return is_kind(value, "float") & (F.try_variant_get(value, "$", "double") == want)
    if isinstance(want, str):
        return is_kind(value, "string") & (F.try_variant_get(value, "$", "string") == want)
    if isinstance(want, (list, tuple)):
        test = is_kind(value, "array") & (F.size(elements(value)) == len(want))
        for i, x in enumerate(want):
            test = test & F.coalesce(_equals(F.variant_get(value, f"$[{i}]", "variant"), x), F.lit(False))
        return test
    if isinstance(want, dict):
        test = is_kind(value, "object") & (F.coalesce(F.size(F.json_object_keys(F.to_json(value))), F.lit(0)) == len(want))
        for k, x in want.items():
            test = test & F.coalesce(_equals(child(value, k), x), F.lit(False))
        return test
    raise FilterError(f"can't compare with {type(want).__name__}")


def _number(x) -> float:
    if isinstance(x, bool) or not isinstance(x, (int, float)):
        raise FilterError(f"not a number: {x!r}")
    return float(x)


def _list(x, what: str) -> list:
    if not isinstance(x, (list, tuple)):
        raise FilterError(f"{what} takes a list")
    return list(x)


Resolver = Callable[[str], Column]


def _operator(resolver: Resolver, path: str, op: str, x) -> Column:
    value = resolver(path)
    exists = value.isNotNull()
    if op == "$eq":
        return _equals(value, x)
    if op == "$ne":
        return exists & ~F.coalesce(_equals(value, x), F.lit(False))
    if op in ("$in", "$nin"):
        inside = F.lit(False)
        for w in _list(x, op):
            inside = inside | F.coalesce(_equals(value, w), F.lit(False))
        return exists & (inside if op == "$in" else ~inside)
    if op in ("$gt", "$gte", "$lt", "$lte"):
        number = F.when(is_kind(value, "number"), F.try_variant_get(value, "$", "double"))
        n = _number(x)
        return {"$gt": number > n, "$gte": number >= n, "$lt": number < n, "$lte": number <= n}[op]
    if op == "$contains":
        if not isinstance(x, str):
            raise FilterError("$contains takes a string")
        return F.when(is_kind(value, "string"), F.contains(F.try_variant_get(value, "$", "string"), F.lit(x)))
    if op == "$exists":
        if not isinstance(x, bool):
            raise FilterError("$exists takes true or false")
        return exists if x else ~exists
    if op == "$size":
        if isinstance(x, bool) or not isinstance(x, int):
            raise FilterError("$size takes an integer")
        return is_kind(value, "array") & (F.size(elements(value)) == x)
    if op == "$elemMatch":
        if not isinstance(x, dict) or not x:
            raise FilterError("$elemMatch takes a filter")
        inner = {"_": x} if all(k.startswith("$") and k not in ("$and", "$or", "$not") for k in x) else x

        def one(e: Column) -> Column:
            inside = lambda p: F.when(is_kind(e, "object"), resolve(e, p)).otherwise(e if p == "_" else F.lit(None).cast("variant"))
            return _filter(inside, inner)

        return F.when(is_kind(value, "array"), F.exists(elements(value), one))
    if op == "$not":
        return ~_field(resolver, path, x)
    raise FilterError(f"unknown operator {op}")


def _field(resolver: Resolver, path: str, test) -> Column:
    if isinstance(test, dict) and any(k.startswith("$") for k in test):
        if not all(k.startswith("$") for k in test):
            raise FilterError(f"operators and keys are mixed under {path!r}")
        out = F.lit(True)
        for op, x in test.items():
            out = out & F.coalesce(_operator(resolver, path, op, x), F.lit(False))
        return out
    if isinstance(test, dict) and not test:
        raise FilterError(f"no operator under {path!r}")
    return F.coalesce(_equals(resolver(path), test), F.lit(False))


def _filter(resolver: Resolver, tests: dict) -> Column:
    if not isinstance(tests, dict) or not tests:
        raise FilterError("a filter is a dict with at least one test")
    out = F.lit(True)
    for key, test in tests.items():
        if key in ("$and", "$or"):
            part = F.lit(key == "$and")
            for x in _list(test, key):
                inner = _filter(resolver, x)
                part = part & inner if key == "$and" else part | inner
        elif key == "$not":
            part = ~_filter(resolver, test)
        elif key.startswith("$"):
            raise FilterError(f"unknown operator {key}")
        else:
            part = _field(resolver, key, test)
        out = out & part
    return out


def compile_filter(tests: dict | None, metadata: str | Column = "metadata") -> Column:
    """A filter to a predicate that is never NULL. None matches everything."""
    if tests is None:
        return F.lit(True)
    value = F.col(metadata) if isinstance(metadata, str) else metadata
    return _filter(lambda path: resolve(value, path), tests)


def parse_terms(terms: list[str]) -> dict | None:
    """The command line's mini-language: k=v, k~text, k>n, k<n, and a bare key for existence."""
    tests = []
    for term in terms:
        for mark, op in (("=", "$eq"), ("~", "$contains"), (">", "$gt"), ("<", "$lt")):
            key, found, x = term.partition(mark)
            if found and key:
                tests.append({key: {op: float(x) if op in ("$gt", "$lt") else _typed(x) if op == "$eq" else x}})
                break
        else:
            tests.append({term: {"$exists": True}})
    return {"$and": tests} if tests else None


def _typed(x: str):
    try:
        return json.loads(x)
    except ValueError:
        return x
