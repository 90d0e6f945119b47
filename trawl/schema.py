"""The record schema and checks on what goes in."""

from __future__ import annotations

import json
import math
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECORD_DDL = "namespace string, id string, vector array<float>, vectors map<string,array<float>>, sparse map<string,float>, metadata variant, multi_vectors map<string,array<array<float>>>, expires_at double"
COLUMNS = ("namespace", "id", "vector", "vectors", "sparse", "metadata", "multi_vectors", "expires_at")
_DEFAULTS = {
    "namespace": F.lit, "vectors": lambda _: F.lit(None).cast("map<string,array<float>>"), "sparse": lambda _: F.lit(None).cast("map<string,float>"),
    "metadata": lambda _: F.parse_json(F.lit("{}")), "multi_vectors": lambda _: F.lit(None).cast("map<string,array<array<float>>>"), "expires_at": lambda _: F.lit(None).cast("double"),
}


class RecordError(ValueError):
    """A record, query or option that isn't valid."""


class DuplicateIdError(RecordError):
    """An insert of a key that is stored already."""


def with_defaults(df: DataFrame, namespace: str = "", now: float | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """df with all columns of a record; what it lacks gets its default. A column ttl (seconds) becomes expires_at, which needs now.

    metadata may be a variant, JSON text, or a struct or map; a namespace column that is null gets the given one.
    """
    types = dict(df.dtypes)
    out = []
    for name in COLUMNS:
        if name == "expires_at" and "ttl" in types and name not in types:
            if now is None:
                raise RecordError("ttl needs now")
            out.append((F.lit(float(now)) + F.col("ttl").cast("double")).alias(name))
        elif name not in types:
            out.append((F.lit(namespace) if name == "namespace" else _DEFAULTS[name](None)).alias(name))
        elif name == "metadata" and types[name] != "variant":
            text = F.col(name) if types[name] == "string" else F.to_json(F.col(name), {"ignoreNullFields": "false"})
            out.append(F.parse_json(F.coalesce(text, F.lit("{}"))).alias(name))
        elif name == "namespace":
            out.append(F.coalesce(F.col(name).cast("string"), F.lit(namespace)).alias(name))
        else:
            kind = dict(x.split(" ", 1) for x in RECORD_DDL.split(", "))[name]
            out.append((F.col(name) if kind == "variant" else F.col(name).cast(kind)).alias(name))
    return df.select(*out, *keep)


def violations(dimension: int) -> Column:
    """What is wrong with a record, as an array of texts; see the operators' limits on dimensions and names."""
    bad = lambda test, text: F.when(F.coalesce(test, F.lit(True)), F.lit(text))
    none = F.array().cast("array<string>")
    names = lambda c: F.coalesce(F.map_keys(c), none)
    sizes = F.transform(F.coalesce(F.map_values("vectors"), F.array().cast("array<array<float>>")), lambda v: F.size(v) != dimension)
    ragged = F.transform(F.coalesce(F.map_values("multi_vectors"), F.array().cast("array<array<array<float>>>")), lambda ts: F.size(F.array_distinct(F.transform(ts, lambda t: F.size(t)))) > 1)
    checks = [
        bad(F.col("id").isNull(), "id is missing"), bad(F.col("vector").isNull() | (F.size("vector") != dimension), f"vector hasn't {dimension} elements"),
        bad(F.array_contains(names("vectors"), ""), "a vector's name is empty"), bad(F.exists(sizes, lambda x: x), f"a named vector hasn't {dimension} elements"),
        bad(F.array_contains(names("multi_vectors"), ""), "a multi-vector space's name is empty"), bad(F.exists(ragged, lambda x: x), "token vectors of a space differ in size"),
    ]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def check_records(df: DataFrame, dimension: int) -> None:
    """Raises RecordError if a record is not valid, naming one."""
    bad = df.select("namespace", "id", violations(dimension).alias("v")).where("size(v) > 0").limit(1).collect()
    if bad:
        raise RecordError(f"record ({bad[0].namespace!r}, {bad[0].id!r}): {'; '.join(bad[0].v)}")


class Schema:
    """Types of metadata fields: string, number, integer, boolean, null, any, array, array<T>, object, or a nested dict.

    Missing fields and nulls always pass. Booleans are neither numbers nor integers. strict: unknown fields are violations at every level.
    """

    SIMPLE = ("string", "number", "integer", "boolean", "null", "any", "array", "object")

    def __init__(self, fields: dict, strict: bool = False):
        self.fields, self.strict = fields, strict
        for kind in fields.values():
            self._known(kind)

    def _known(self, kind) -> None:
        if isinstance(kind, dict):
            for inner in kind.values():
                self._known(inner)
        elif not (kind in self.SIMPLE or isinstance(kind, str) and kind.startswith("array<") and kind.endswith(">") and self._known(kind[6:-1]) is None):
            raise RecordError(f"unknown type {kind!r}")

    def violations(self, metadata: Column) -> Column:
        """Paths and types that a variant column breaks, as an array of texts."""
        return F.array_sort(F.filter(self._object(metadata, self.fields, ""), lambda x: x.isNotNull()))

    def _object(self, value: Column, fields: dict, at: str) -> Column:
        from .functions.filters import child

        parts = []
        for name, kind in fields.items():
            parts.append(self._check(child(value, name), kind, f"{at}{name}"))
        if self.strict:
            keys = F.coalesce(F.json_object_keys(F.to_json(value)), F.array().cast("array<string>"))
            unknown = F.filter(keys, lambda k: ~k.isin(*fields) if fields else F.lit(True))
            parts.append(F.transform(unknown, lambda k: F.concat(F.lit(at), k, F.lit(": unknown field"))))
        return F.flatten(F.array(*parts)) if parts else F.array().cast("array<string>")

    def _check(self, value: Column, kind, at: str) -> Column:
        from .functions.filters import elements, is_kind

        none = F.array().cast("array<string>")
        passes = value.isNull() | is_kind(value, "null")
        wrong = F.array(F.lit(f"{at}: not {'object' if isinstance(kind, dict) else kind}"))
        if kind == "any":
            return none
        if isinstance(kind, dict):
            return F.when(passes, none).when(~is_kind(value, "object"), wrong).otherwise(self._object(value, kind, f"{at}."))
        if kind.startswith("array<"):
            inner = F.flatten(F.transform(elements(value), lambda e: self._check(e, kind[6:-1], f"{at}[]")))
            return F.when(passes, none).when(~is_kind(value, "array"), wrong).otherwise(inner)
        return F.when(passes | is_kind(value, kind), none).otherwise(wrong)

    def check(self, df: DataFrame) -> None:
        bad = df.select("id", self.violations(F.col("metadata")).alias("v")).where("size(v) > 0").limit(1).collect()
        if bad:
            raise RecordError(f"record {bad[0].id!r}: {'; '.join(bad[0].v)}")

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps({"fields": self.fields, "strict": self.strict}, sort_keys=True))

    @classmethod
    def load(cls, path: str) -> Schema:
        said = json.loads(Path(path).read_text())
        return cls(said["fields"], said["strict"])


def check_query(vector: list[float] | None, dimension: int, metric: str, truncate_dim: int | None = None) -> None:
    """Raises RecordError for an empty, too long, wrongly sized or (cosine and dot) zero query vector."""
    if vector is None:
        return
    if not vector:
        raise RecordError("the query vector is empty")
    if len(vector) > dimension:
        raise RecordError(f"the query vector has {len(vector)} elements; the collection's dimension is {dimension}")
    if truncate_dim is not None and not 0 < truncate_dim <= len(vector):
        raise RecordError("truncate_dim is out of range")
    if truncate_dim is None and len(vector) != dimension:
        raise RecordError(f"the query vector has {len(vector)} elements and truncate_dim isn't set")
    used = vector[:truncate_dim]
    if metric in ("cosine", "dot") and not math.sqrt(sum(x * x for x in used)):
        raise RecordError("a zero query vector has no direction")
