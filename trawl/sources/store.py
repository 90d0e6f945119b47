"""Collections of records as Parquet: a base table, an append-only log of ops on it, and versions that are published one after another.

A collection is a folder with `log/` (one small JSON file for each version: dimension, metric, base, segments of ops, indexes) and `data/` (each write in a folder of its own).
A write appends a segment of ops, reads no row that it doesn't touch, and then publishes the next version by creating its log file, which only one writer can: of two
that began from one version the second fails and leaves nothing behind. Reading folds the segments over the base (see oplog); `compact` writes a new base. Files of
the version before stay for its readers.

Built beside the base, and used as long as they fit: payload columns (typed copies of metadata fields, which prune Parquet row groups), a text index (postings sorted by term, with
statistics), codes of a quantizer, and an inverted file whose rows are sorted by cell. The last two also serve later versions: rows that were written since are searched exactly,
and stored ones that they replace don't count.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import Future, ThreadPoolExecutor

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.filters import compile_filter, is_kind, resolve
from ..functions.metrics import metric_name
from ..operators.ann import InvertedFile
from ..operators.bm25 import Index, build_index
from ..operators.dense import dense_scores, ranked
from ..operators.quantize import MULTIPLIERS, Codec, ProductQuantizer, TokenIndex, default_parts, method_name, search_quantized
from ..operators.search import ANY_TIME, Options, check_queries, not_expired, resolved_fetch_k, search, search_multi_vector, visible
from ..schema import COLUMNS, RECORD_DDL, DuplicateIdError, RecordError, Schema, check_records, with_defaults
from .files import Files
from .oplog import DELETE, INSERT, KEY, METADATA, OP_COLUMNS, OP_DDL, TTL, UPSERT, apply_deletes, apply_ops, apply_patches, apply_records, fold_last, merged_metadata

__all__ = ["ClosedError", "Collection", "Store", "Transaction", "Validated", "apply_deletes", "apply_ops", "apply_patches", "apply_records", "cursor_page", "fold_last", "list_page", "merged_metadata", "open_store"]

KINDS = {"keyword": "keyword", "string": "keyword", "numeric": "numeric", "number": "numeric", "float": "numeric", "integer": "numeric"}
_POOL = ThreadPoolExecutor(8, "trawl")


class ClosedError(RuntimeError):
    """Use of a closed or read-only handle."""


class ConflictError(RecordError):
    """Another writer has published the version that this write would have been."""


class Collection:
    def __init__(self, spark: SparkSession, path: str, read_only: bool = False):
        self.spark, self.path, self.read_only, self.closed = spark, path.rstrip("/"), read_only, False
        self.files = Files(spark)
        self._load()

    # ---- versions

    @classmethod
    def exists(cls, spark: SparkSession, path: str) -> bool:
        return bool(_versions(Files(spark), path.rstrip("/")))

    @classmethod
    def create(cls, spark: SparkSession, path: str, dimension: int, metric: str = "cosine") -> Collection:
        if dimension <= 0:
            raise RecordError("the dimension is above 0")
        first = {"dimension": dimension, "metric": metric_name(metric), "version": 0, "base": None, "segments": [], "indexes": [], "columns": {}, "quantization": None, "text": None, "ann": None, "tokens": {}, "batches": {}}
        if not Files(spark).create_json(f"{path.rstrip('/')}/log/{0:020}.json", first):
            raise RecordError(f"a collection is at {path} already")
        return cls(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str, dimension: int | None = None, metric: str = "cosine", read_only: bool = False) -> Collection:
        """Opens, or with a dimension creates. For an existing collection another dimension is an error and the metric is ignored."""
        if not cls.exists(spark, path):
            if dimension is None or read_only:
                raise RecordError(f"no collection at {path}; creating one takes a dimension")
            return cls.create(spark, path, dimension, metric)
        own = cls(spark, path, read_only)
        if dimension is not None and dimension != own.dimension:
            raise RecordError(f"the collection's dimension is {own.dimension}, not {dimension}")
        return own

    def _load(self) -> None:
        found = _versions(self.files, self.path)
        if not found:
            raise RecordError(f"no collection at {self.path}")
        self.state = self.files.read_json(f"{self.path}/log/{found[-1]}")

    dimension = property(lambda self: self.state["dimension"])
    metric = property(lambda self: self.state["metric"])
    version = property(lambda self: self.state["version"])
    quantization = property(lambda self: self.state["quantization"])
    indexes = property(lambda self: [tuple(x) for x in self.state["indexes"]])

    def _publish(self, made: str | None = None, **changes) -> None:
        """The next version, with these changes; a folder that was made for it goes if another writer was first."""
        after = self.state | changes | {"version": self.version + 1}
        if not self.files.create_json(f"{self.path}/log/{after['version']:020}.json", after):
            if made:
                self.files.delete(f"{self.path}/{made}")
            raise ConflictError("another writer has changed the collection; open it again")
        self.state = after

    def _usable(self, writing: bool = False) -> None:
        if self.closed:
            raise ClosedError("the collection is closed")
        if writing and self.read_only:
            raise ClosedError("the collection was opened read-only")

    # ---- the stored rows

    def _folder(self) -> str:
        return f"data/{uuid.uuid4().hex}"

    def _base(self, *more: str) -> DataFrame:
        if self.state["base"] is None:
            return self.spark.createDataFrame([], RECORD_DDL)
        extra = [f"{c} {'string' if kind == 'keyword' else 'double'}" for f, kind in self.indexes if (c := self.state["columns"].get(f))]
        return self.spark.read.schema(", ".join([RECORD_DDL, *extra])).parquet(f"{self.path}/{self.state['base']}")

    def _ops(self, segments: list[dict]) -> DataFrame | None:
        """The ops of segments, in order of the struct `at`."""
        out = None
        for i, s in enumerate(segments):
            part = self.spark.read.schema(OP_DDL).parquet(f"{self.path}/{s['folder']}").withColumn("at", F.struct(F.lit(i).alias("segment"), "seq"))
            out = part if out is None else out.unionByName(part)
        return out

    def _kinds(self, segments: list[dict]) -> frozenset[str]:
        return frozenset(k for s in segments for k in s["kinds"])

    def records(self, tests: dict | None = None) -> DataFrame:
        """All stored rows, expired ones included; with a filter those that may pass it, told by payload columns where there are any for its fields."""
        self._usable()
        segments, base = self.state["segments"], self._base()
        may = self._may_pass(tests) if tests is not None and self.state["base"] is not None else None
        if not segments:
            return (base if may is None else base.where(may)).select(*COLUMNS)
        ops = self._ops(segments)
        if may is None:
            return apply_ops(base, ops, "at", self._kinds(segments))
        touched = ops.select(*KEY).distinct()
        same = base.where(may).join(touched, KEY, "left_anti").select(*COLUMNS)
        return same.unionByName(apply_ops(base.join(touched, KEY, "left_semi"), ops, "at", self._kinds(segments)))

    def _may_pass(self, tests: dict) -> Column | None:
        """A condition on payload columns that every base row which passes the tests meets."""
        kinds = {f: (self.state["columns"][f], kind) for f, kind in self.indexes if f in self.state["columns"]}

        def field(name: str, test) -> Column | None:
            if name not in kinds:
                return None
            column, kind = F.col(kinds[name][0]), kinds[name][1]
            fits = lambda v: isinstance(v, str) if kind == "keyword" else isinstance(v, (int, float)) and not isinstance(v, bool)
            if not isinstance(test, dict):
                return column == test if fits(test) else None
            parts = []
            for op, v in test.items():
                if op == "$eq" and fits(v):
                    parts.append(column == v)
                elif op == "$in" and isinstance(v, (list, tuple)) and v and all(map(fits, v)):
                    parts.append(column.isin(*v))
                elif kind == "numeric" and op in ("$gt", "$gte", "$lt", "$lte") and fits(v):
                    parts.append({"$gt": column >= v, "$gte": column >= v, "$lt": column <= v, "$lte": column <= v}[op])
            return _all(parts)

        def every(tests: dict) -> Column | None:
            parts = []
            for key, test in tests.items():
                if key == "$and" and isinstance(test, (list, tuple)):
                    parts += [every(t) for t in test if isinstance(t, dict)]
                elif key == "$or" and isinstance(test, (list, tuple)) and test:
                    each = [every(t) if isinstance(t, dict) else None for t in test]
                    if all(e is not None for e in each):
                        out = each[0]
                        for e in each[1:]:
                            out = out | e
                        parts.append(out)
                elif not key.startswith("$"):
                    parts.append(field(key, test))
            return _all(parts)

        return every(tests)

    # ---- writes

    def _append(self, ops: DataFrame, kinds: Iterable[str], check: Callable[[DataFrame], None] | None = None, **changes) -> None:
        """ops (seq, op, ...) as a segment, checked where they are written, and the version with it."""
        self._usable(True)
        made = self._folder()
        ops.select(*OP_COLUMNS).sortWithinPartitions(*KEY).write.parquet(f"{self.path}/{made}")
        if check is not None:
            try:
                check(self.spark.read.schema(OP_DDL).parquet(f"{self.path}/{made}"))
            except Exception:
                self.files.delete(f"{self.path}/{made}")
                raise
        self._publish(made, segments=[*self.state["segments"], {"folder": made, "kinds": sorted(kinds)}], **changes)

    def _as_ops(self, rows: DataFrame, op: str, namespace: str, now: float | None, seq: int = 0) -> DataFrame:
        """Whole records as ops; of rows with one key the last stays, by the column seq, or as they come."""
        rows = rows if "seq" in rows.columns else rows.withColumn("seq", F.monotonically_increasing_id())
        full = fold_last(with_defaults(rows, namespace, now, keep=("seq",)))
        return full.withColumns({"seq": F.lit(seq).cast("long"), "op": F.lit(op), "patch": F.lit(None).cast("string")})

    def _check_inserts(self, written: DataFrame) -> None:
        taken = written.where(F.col("op") == INSERT).select(*KEY).join(self.records().select(*KEY), KEY, "left_semi").limit(1).collect()
        if taken:
            raise DuplicateIdError(f"({taken[0].namespace!r}, {taken[0].id!r}) is stored already")

    def _check(self, written: DataFrame) -> None:
        check_records(written.where(F.col("op").isin(UPSERT, INSERT)), self.dimension)

    def upsert(self, rows: DataFrame, namespace: str = "", now: float | None = None) -> None:
        """Whole records replace those with their keys. The first rows of an empty collection are its base."""
        self._usable(True)
        if self.state["base"] is None and not self.state["segments"]:
            self._rebase(self._as_ops(rows, UPSERT, namespace, now), check=lambda df: check_records(df, self.dimension))
        else:
            self._append(self._as_ops(rows, UPSERT, namespace, now), [UPSERT], self._check)

    bulk_ingest = upsert_many = upsert

    def insert(self, rows: DataFrame, namespace: str = "", now: float | None = None) -> None:
        """As upsert, but a stored key, expired or not, is an error. Keys repeated inside the batch aren't."""
        self._usable(True)
        if self.state["base"] is None and not self.state["segments"]:
            return self.upsert(rows, namespace, now)

        def check(written: DataFrame) -> None:
            self._check(written)
            self._check_inserts(written)

        return self._append(self._as_ops(rows, INSERT, namespace, now), [INSERT], check)

    insert_many = insert

    def upsert_multi_vectors(self, id: str, vector: list[float], multi_vectors: dict[str, list[list[float]]], metadata: dict | None = None, namespace: str = "") -> None:
        row = [(id, [float(x) for x in vector], {k: [[float(x) for x in t] for t in ts] for k, ts in multi_vectors.items()}, json.dumps(metadata or {}))]
        self.upsert(self.spark.createDataFrame(row, "id string, vector array<float>, multi_vectors map<string,array<array<float>>>, metadata string"), namespace)

    def _keyed_ops(self, keys: DataFrame, op: str, **values) -> DataFrame:
        """keys (namespace, id) as ops of a kind with some values."""
        rows = with_defaults(keys.select(*KEY).withColumn("vector", F.lit(None).cast("array<float>")))
        return rows.withColumns({"seq": F.lit(0).cast("long"), "op": F.lit(op), "patch": F.lit(None).cast("string"), **values})

    def delete(self, ids: Iterable[str], namespace: str = "") -> int:
        """How many of the ids were stored, an id that is given twice counting twice."""
        self._usable(True)
        asked = self.spark.createDataFrame([(namespace, str(i)) for i in ids], "namespace string, id string")
        n = asked.join(self.records().select(*KEY), KEY, "left_semi").count()
        if n:
            self._append(self._keyed_ops(asked.distinct(), DELETE), [DELETE])
        return n

    def delete_by_filter(self, tests: dict, namespace: str | None = None) -> int:
        """Expired rows count too."""
        self._usable(True)
        hit = compile_filter(tests)
        if namespace is not None:
            hit = hit & (F.col("namespace") == namespace)
        gone: list[int] = []
        ops = self._keyed_ops(self.records(tests).where(hit), DELETE)
        try:
            self._append(ops, [DELETE], lambda written: gone.append(written.count()) or _some(gone[0]))
        except _Nothing:
            return 0
        return gone[0]

    def _stored(self, id: str, namespace: str) -> bool:
        return bool(self.records().where((F.col("namespace") == namespace) & (F.col("id") == id)).limit(1).count())

    def _one(self, id: str, namespace: str) -> DataFrame:
        return self.spark.createDataFrame([(namespace, id)], "namespace string, id string")

    def update_metadata(self, id: str, patch: dict, namespace: str = "") -> bool:
        self._usable(True)
        if not self._stored(id, namespace):
            return False
        self._append(self._keyed_ops(self._one(id, namespace), METADATA, patch=F.lit(json.dumps(patch))), [METADATA])
        return True

    def set_ttl(self, id: str, seconds: float | None, now: float | None = None, namespace: str = "") -> bool:
        """seconds None clears it. Negative and NaN are errors; infinity is not."""
        self._usable(True)
        if seconds is not None and not seconds >= 0:
            raise RecordError("a ttl isn't negative")
        if not self._stored(id, namespace):
            return False
        until = F.lit(None).cast("double") if seconds is None else F.lit((time.time() if now is None else float(now)) + float(seconds))
        self._append(self._keyed_ops(self._one(id, namespace), TTL, expires_at=until), [TTL])
        return True

    def clear_ttl(self, id: str, namespace: str = "") -> bool:
        return self.set_ttl(id, None, namespace=namespace)

    def apply(self, ops: DataFrame, batch: tuple[str, int] | None = None) -> bool:
        """A batch of an op log (see oplog) as one segment. batch: (name of a stream, number): a number that is in already changes nothing."""
        self._usable(True)
        if batch and self.state["batches"].get(batch[0], -1) >= batch[1]:
            return False
        changes = {"batches": self.state["batches"] | {batch[0]: batch[1]}} if batch else {}
        self._append(ops, [UPSERT, INSERT, DELETE, METADATA, TTL], self._check, **changes)
        return True

    def _rebase(self, rows: DataFrame, check: Callable[[DataFrame], None] | None = None, columns: list[tuple[str, str]] | None = None) -> None:
        """rows as a new base with payload columns, without segments. What neither this version nor the one before refers to goes."""
        made, columns = self._folder(), self.indexes if columns is None else columns
        names = {f: f"ix{i}" for i, (f, _) in enumerate(columns)}
        value = lambda f, kind: F.when(is_kind(resolve(F.col("metadata"), f), "string" if kind == "keyword" else "number"), F.try_variant_get(resolve(F.col("metadata"), f), "$", "string" if kind == "keyword" else "double"))
        rows = rows.select(*COLUMNS, *(value(f, kind).alias(names[f]) for f, kind in columns))
        rows.sortWithinPartitions(*KEY).write.parquet(f"{self.path}/{made}")
        if check is not None:
            try:
                check(self.spark.read.schema(RECORD_DDL).parquet(f"{self.path}/{made}"))
            except Exception:
                self.files.delete(f"{self.path}/{made}")
                raise
        before = self.state
        self._publish(made, base=made, segments=[], indexes=[list(x) for x in columns], columns=names, text=None, ann=None, tokens={}, quantization=self._without_codes())
        self._clean({*_folders(before), *_folders(self.state)})

    def _without_codes(self) -> dict | None:
        return {k: v for k, v in self.quantization.items() if k not in ("folder", "at")} if self.quantization else None

    def _clean(self, kept: set[str]) -> None:
        for name in self.files.list(f"{self.path}/data"):
            if f"data/{name}" not in kept:
                self.files.delete(f"{self.path}/data/{name}")

    def compact(self, now: float | None = None) -> int:
        """Folds the segments into a new base without expired rows; how many of these there were."""
        self._usable(True)
        rows = self.records()
        n = rows.where(~not_expired(now)).count()
        had = self.quantization and "folder" in self.quantization, self.state["text"], self.state["ann"], sorted(self.state["tokens"])
        self._rebase(rows.where(not_expired(now)))
        if had[0] and len(self):
            self.enable_quantization(self.quantization["method"], self.quantization["multiplier"])
        if had[1]:
            self.build_text_index()
        if had[2]:
            self.build_ann(had[2]["preset"])
        for space in had[3]:
            self.build_token_index(space)
        return n

    flush = compact

    # ---- reads

    def get(self, id: str, namespace: str = "", now: float | None = None):
        rows = self.records().where((F.col("namespace") == namespace) & (F.col("id") == id)).where(not_expired(now)).limit(1).collect()
        return rows[0] if rows else None

    def list(self, namespace: str | None = None, tests: dict | None = None, limit: int = 0, offset: int = 0, now: float | None = None) -> DataFrame:
        """Rows by namespace and id; limit 0 is no limit."""
        return list_page(self.records(tests), namespace, tests, limit, offset, now)

    def list_cursor(self, namespace: str | None = None, tests: dict | None = None, limit: int = 0, after: str | None = None, now: float | None = None) -> tuple[list, str | None]:
        """A page of rows after a cursor (limit 0: 100), and the next cursor, None at the end."""
        size = limit or 100
        rows = cursor_page(self.records(tests), namespace, tests, size + 1, after, now).collect()
        more = len(rows) > size
        rows = rows[:size]
        return rows, f"{rows[-1].namespace}\0{rows[-1].id}" if more and rows else None

    def count(self, namespace: str | None = None, tests: dict | None = None, now: float | None = None) -> int:
        return list_page(self.records(tests), namespace, tests, 0, 0, now, ordered=False).count()

    def __len__(self) -> int:
        return self.records().count()

    def namespaces(self) -> list[str]:
        return [r[0] for r in self.records().select("namespace").distinct().orderBy("namespace").collect()]

    # ---- searches

    def search(self, queries: DataFrame, options: Options | None = None) -> DataFrame:
        """Stored codes, else the inverted file, serve plain dense searches; named vectors, truncation, terms and diversification are searched exactly. `last_search` tells what was used."""
        o = options or Options()
        o.metric = self.metric
        plain = "sparse" not in queries.columns and not (o.spaces or o.vector_name or o.truncate_dim or o.explain) and o.mmr_lambda is None and o.fusion == "linear" and o.dense_weight == 1.0 and o.k > 0
        self.last_search = {"used_ann": False, "ann_candidate_count": 0, "exact_fallback": False, "ann_loaded_from_disk": False}
        if plain and (self.quantization or self.state["ann"]):
            check_queries(self.records(), queries, o, self.dimension)
            return self._approximate(queries, o)
        return search(self.records(o.filter), queries, o, self._text_index() if "sparse" in queries.columns else None, self.dimension)

    def search_async(self, queries: DataFrame, options: Options | None = None) -> Future:
        """The collected results, from a thread of a small pool; Spark runs the jobs of several threads beside each other."""
        return _POOL.submit(lambda: self.search(queries, options).collect())

    def run_async(self, action: Callable, *args, **how) -> Future:
        """Any action of the collection (flush, upsert, ...) from a thread of the pool. Writers exclude each other, so writes are to be awaited one after another."""
        return _POOL.submit(action, *args, **how)

    def _approximate(self, queries: DataFrame, o: Options) -> DataFrame:
        """Candidates from what is stored for an earlier version, less the rows that were written since, and those rows exactly."""
        rows = visible(self.records(o.filter), o.namespace, o.filter, o.now)
        allowed = rows.select(*KEY) if o.filter is not None or o.namespace is not None else None
        said = self.quantization if self.quantization else self.state["ann"]
        at = said.get("at")
        since = [s for s in self.state["segments"][at["segments"] :]] if at and at["base"] == self.state["base"] else None
        fetch_k = resolved_fetch_k(10**18, o)
        if since is None:  # nothing is stored, or for another base: codes are made anew
            if not self.quantization:
                return search(rows, queries, o, None, self.dimension)
            return search_quantized(rows, queries, said["method"], o.k, o.metric, said["multiplier"], codec=self._codec(), fetch_k=o.fetch_k)
        touched = self._ops(since).select(*KEY).distinct() if since else None
        live = (lambda df: df.join(touched, KEY, "left_anti")) if since else (lambda df: df)
        inside = (lambda df: df.join(allowed, KEY, "left_semi")) if allowed is not None else (lambda df: df.join(rows.select(*KEY), KEY, "left_semi"))
        if self.quantization:
            stored = live(self.spark.read.parquet(f"{self.path}/{said['folder']}"))
            found = search_quantized(rows, queries, said["method"], o.k, o.metric, said["multiplier"], codec=self._codec(), codes=inside(stored), fetch_k=o.fetch_k)
            self.last_search = {"used_ann": True, "ann_candidate_count": fetch_k * said["multiplier"], "exact_fallback": False, "ann_loaded_from_disk": True}
        else:
            file = InvertedFile(np.array(said["centroids"]), live(self.spark.read.parquet(f"{self.path}/{said['folder']}")), said["probes"])
            found = file.search(queries, o.k, o.metric, allowed=rows.select(*KEY))
            self.last_search = {"used_ann": True, "ann_candidate_count": fetch_k, "exact_fallback": bool(file.fallbacks), "ann_loaded_from_disk": True}
        if since:
            fresh = dense_scores(rows.join(touched, KEY, "left_semi"), queries, o.metric, None, o.k).withColumnRenamed("dense", "score")
            found = ranked(found.select("qid", *KEY, "score").unionByName(fresh.select("qid", *KEY, "score")), "score", o.k)
        return found.select("qid", "rank", "namespace", "id", "score")

    def search_multi_vector(self, queries: DataFrame, space: str, k: int = 10, metric: str = "cosine", namespace: str | None = None, tests: dict | None = None, now: float | None = None) -> DataFrame:
        """By late interaction; candidates come from the space's two-bit codes if there are any for this version."""
        rows, said = self.records(tests), self.state["tokens"].get(space)
        if said and said["at"] == self._at():
            shown = visible(rows, namespace, tests, now)
            codes = self.spark.read.parquet(f"{self.path}/{said['folder']}").join(shown.select(*KEY), KEY, "left_semi")
            return TokenIndex(Codec.from_json(said["codec"]), codes).search(shown, queries, space, k, metric)
        return search_multi_vector(rows, queries, space, k, metric, namespace, tests, now)

    # ---- what is built beside the rows

    def _at(self) -> dict:
        return {"base": self.state["base"], "segments": len(self.state["segments"])}

    def build_text_index(self) -> None:
        """Postings in ranges of terms, so that a search reads those of its terms, document frequencies and statistics of this version."""
        self._usable(True)
        made, index = self._folder(), build_index(self.records())
        index.postings.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{self.path}/{made}/postings")
        postings = self.spark.read.parquet(f"{self.path}/{made}/postings")
        postings.groupBy("term").agg(F.count("*").alias("df")).sortWithinPartitions("term").write.parquet(f"{self.path}/{made}/frequencies")
        self._publish(made, text={"folder": made, "n": index.n, "average": index.average, "at": self._at()})

    def _text_index(self) -> Index | None:
        said = self.state["text"]
        if not said or said["at"] != self._at():
            return None
        return Index(self.spark.read.parquet(f"{self.path}/{said['folder']}/postings"), self.spark.read.parquet(f"{self.path}/{said['folder']}/frequencies"), said["n"], said["average"])

    def build_ann(self, preset: str = "default") -> None:
        """An inverted file of this version, sorted by cell. Later writes are searched exactly beside it until it is built again."""
        self._usable(True)
        made, file = self._folder(), InvertedFile.build(self.records(), preset=preset)
        file.rows.repartitionByRange("cell").sortWithinPartitions("cell").write.parquet(f"{self.path}/{made}")
        self._publish(made, ann={"folder": made, "preset": preset, "probes": file.probes, "centroids": file.centroids.tolist(), "at": self._at()})

    def build_token_index(self, space: str) -> None:
        """Two-bit codes of a token-vector space, for this version."""
        self._usable(True)
        made, index = self._folder(), TokenIndex.build(self.records(), space)
        index.rows.write.parquet(f"{self.path}/{made}")
        self._publish(made, tokens=self.state["tokens"] | {space: {"folder": made, "codec": index.codec.to_json(), "at": self._at()}})

    def tombstones(self) -> dict:
        """Of the inverted file: rows indexed, rows of it that were replaced or deleted since, and rows written since."""
        said = self.state["ann"]
        if not said or said["at"]["base"] != self.state["base"]:
            return {"indexed": 0, "tombstones": 0, "fresh": 0}
        stored, since = self.spark.read.parquet(f"{self.path}/{said['folder']}"), self.state["segments"][said["at"]["segments"] :]
        if not since:
            return {"indexed": stored.count(), "tombstones": 0, "fresh": 0}
        touched = self._ops(since).select(*KEY).distinct()
        return {"indexed": stored.count(), "tombstones": stored.join(touched, KEY, "left_semi").count(), "fresh": self.records().join(touched, KEY, "left_semi").count()}

    def _codec(self) -> Codec:
        return Codec.from_json(self.quantization["codec"])

    def enable_quantization(self, method: str, multiplier: int | None = None, parts: int | None = None, centroids: int = 256) -> None:
        """scalar, binary, product or two_bit: fits the method and stores every row's codes. Rows that are written later are searched exactly until it is enabled again or compacted."""
        self._usable(True)
        if not len(self):
            raise RecordError("there is nothing to quantize")
        method = method_name(method)
        made, codec = self._folder(), Codec.fit(self.records(), method, parts, centroids)
        codec.codes(self.records()).write.parquet(f"{self.path}/{made}")
        self._publish(made, quantization={"method": method, "multiplier": max(1, multiplier or MULTIPLIERS[method]), "codec": codec.to_json(), "folder": made, "at": self._at()})

    def disable_quantization(self) -> bool:
        self._usable(True)
        was = self.quantization
        if was:
            self._publish(quantization=None)
        return bool(was)

    def is_quantized(self) -> bool:
        return self.quantization is not None

    def quantization_config(self) -> dict | None:
        """method, multiplier, and stale: how many segments were written since the codes were stored, None if they are of another base."""
        said = self.quantization
        if not said:
            return None
        at = said.get("at")
        stale = len(self.state["segments"]) - at["segments"] if at and at["base"] == self.state["base"] else None
        return {"method": said["method"], "multiplier": said["multiplier"], "stale": stale}

    def valid_parts(self) -> list[int]:
        """Numbers of parts that product codes of this dimension can have."""
        return [m for m in range(1, self.dimension + 1) if self.dimension % m == 0]

    def create_index(self, field: str, kind: str) -> bool:
        """keyword or numeric; true if there was none. Copies the field to a column of the base, whose row groups filters then skip. An index never changes a result."""
        kind = KINDS[kind.lower()]
        self._usable(True)
        if any(f == field for f, _ in self.indexes):
            return False
        self._rebase(self.records(), columns=[*self.indexes, (field, kind)])
        return True

    def drop_index(self, field: str) -> bool:
        self._usable(True)
        kept = [list(x) for x in self.indexes if x[0] != field]
        if len(kept) == len(self.indexes):
            return False
        self._publish(indexes=kept)
        return True

    def list_indexes(self) -> list[tuple[str, str]]:
        return sorted(self.indexes)

    # ---- copies, checks, handles

    def snapshot(self, to: str) -> None:
        """A collection of its own at another path, of this version: compacted rows, payload columns, and the quantizer's settings."""
        self._usable()
        own = Collection.create(self.spark, to, self.dimension, self.metric)
        own._publish(quantization=self._without_codes())
        own._rebase(self.records(), columns=self.indexes)

    backup = snapshot

    @classmethod
    def restore(cls, spark: SparkSession, source: str, to: str) -> Collection:
        cls(spark, source, True).snapshot(to)
        return cls(spark, to)

    def transaction(self) -> Transaction:
        return Transaction(self)

    def transaction_execute(self, ops: str | list[dict], now: float | None = None) -> int:
        """A JSON list of ops, {"op": upsert, insert, delete, update_metadata or set_ttl, "namespace", "id", and a record's fields, "patch" or "ttl"}, applied at once; how many."""
        listed = json.loads(ops) if isinstance(ops, str) else ops
        with self.transaction() as t:
            t.now = now
            for x in listed:
                kind, ns, key = x.get("op"), x.get("namespace", ""), x.get("id")
                if kind in (UPSERT, INSERT):
                    getattr(t, kind)(_record(self.spark, x), ns)
                elif kind == DELETE:
                    t.delete([key], ns)
                elif kind == "update_metadata":
                    t.update_metadata(key, x.get("patch", x.get("metadata", {})), ns)
                elif kind == "set_ttl":
                    t.set_ttl(key, x.get("ttl"), ns)
                else:
                    raise RecordError(f"unknown op {kind!r}")
        return len(listed)

    def verify(self) -> list[str]:
        """What is wrong with the stored rows: at most ten of them, by key."""
        from ..schema import violations

        bad = self.records().select(*KEY, violations(self.dimension).alias("v")).where("size(v) > 0").orderBy(*KEY).limit(10).collect()
        twice = self.records().groupBy(*KEY).count().where("count > 1").limit(10).collect()
        return [f"({r.namespace!r}, {r.id!r}): {'; '.join(r.v)}" for r in bad] + [f"({r.namespace!r}, {r.id!r}): stored {r['count']} times" for r in twice]

    def stats(self) -> dict:
        counts = {r.namespace: r["count"] for r in self.records().groupBy("namespace").count().collect()}
        size = lambda folder: self.files.size(f"{self.path}/{folder}") if folder else 0
        s = self.state
        return {
            "dimension": self.dimension, "metric": self.metric, "version": self.version, "records": sum(counts.values()), "namespaces": counts, "indexes": self.list_indexes(), "base_bytes": size(s["base"]), "log_segments": len(s["segments"]),
            "log_bytes": sum(size(x["folder"]) for x in s["segments"]), "quantization": self.quantization_config(), "text_index": bool(s["text"]) and s["text"]["at"] == self._at(), "ann": self.tombstones() if s["ann"] else None, "token_indexes": sorted(s["tokens"]),
        }

    def close(self) -> None:
        self.closed = True

    def __enter__(self) -> Collection:
        return self

    def __exit__(self, *_) -> None:
        self.close()


class _Nothing(Exception):
    """A write that would change nothing."""


def _some(n: int) -> None:
    if not n:
        raise _Nothing


def _all(parts: list[Column | None]) -> Column | None:
    out = None
    for p in parts:
        if p is not None:
            out = p if out is None else out & p
    return out


def _versions(files: Files, path: str) -> list[str]:
    return [n for n in files.list(f"{path}/log") if n.endswith(".json") and n[:-5].isdigit()]


def _folders(state: dict) -> set[str]:
    built = [state.get(k) for k in ("quantization", "text", "ann")] + list(state["tokens"].values())
    return {x for x in (state["base"], *(s["folder"] for s in state["segments"]), *(b.get("folder") for b in built if b)) if x}


def _record(spark: SparkSession, said: dict) -> DataFrame:
    """One record from a JSON object."""
    from .io import JSON_DDL

    text = json.dumps({k: v for k, v in said.items() if k not in ("op", "namespace")})
    row = spark.createDataFrame([(text,)], "value string").select(F.from_json("value", JSON_DDL).alias("r")).select("r.*").drop("namespace", "expires_at" if said.get("ttl") is not None else "ttl")
    return row.withColumn("metadata", F.coalesce("metadata", F.parse_json(F.lit("{}"))))


def list_page(records: DataFrame, namespace: str | None = None, tests: dict | None = None, limit: int = 0, offset: int = 0, now: float | None = None, ordered: bool = True) -> DataFrame:
    rows = records.where(not_expired(now))
    if namespace is not None:
        rows = rows.where(F.col("namespace") == namespace)
    rows = rows.where(compile_filter(tests)) if tests is not None else rows
    if not ordered:
        return rows
    rows = rows.orderBy(*KEY)
    rows = rows.offset(offset) if offset else rows
    return rows.limit(limit) if limit else rows


def cursor_page(records: DataFrame, namespace: str | None, tests: dict | None, limit: int, after: str | None, now: float | None = None) -> DataFrame:
    rows = list_page(records, namespace, tests, 0, 0, now, ordered=False)
    if after is not None:
        ns, _, key = after.partition("\0")
        rows = rows.where((F.col("namespace") > ns) | ((F.col("namespace") == ns) & (F.col("id") > key)))
    return rows.orderBy(*KEY).limit(limit)


class Transaction:
    """Stages operations and applies them at once, in order, as one segment; an exception inside its context drops them all."""

    def __init__(self, collection: Collection):
        self.collection, self.ops, self.done, self.now = collection, [], False, None

    def _stage(self, *op) -> None:
        if self.done:
            raise ClosedError("the transaction is over")
        self.ops.append(op)

    def upsert(self, rows: DataFrame, namespace: str = "") -> None:
        self._stage(UPSERT, rows, namespace)

    def insert(self, rows: DataFrame, namespace: str = "") -> None:
        self._stage(INSERT, rows, namespace)

    def delete(self, ids: Iterable[str], namespace: str = "") -> None:
        self._stage(DELETE, list(ids), namespace)

    def update_metadata(self, id: str, patch: dict, namespace: str = "") -> None:
        self._stage(METADATA, (id, patch), namespace)

    def set_ttl(self, id: str, seconds: float | None, namespace: str = "") -> None:
        if seconds is not None and not seconds >= 0:
            raise RecordError("a ttl isn't negative")
        self._stage(TTL, (id, seconds), namespace)

    def commit(self, now: float | None = None) -> None:
        """Inserts are checked against what was stored before the transaction."""
        if self.done:
            raise ClosedError("the transaction is over")
        self.done, now = True, self.now if now is None else now
        c = self.collection
        c._usable(True)
        every = None
        for i, (op, what, namespace) in enumerate(self.ops):
            if op == DELETE:
                part = c._keyed_ops(c.spark.createDataFrame([(namespace, str(x)) for x in what], "namespace string, id string").distinct(), DELETE)
            elif op == METADATA:
                part = c._keyed_ops(c._one(what[0], namespace), METADATA, patch=F.lit(json.dumps(what[1])))
            elif op == TTL:
                until = F.lit(None).cast("double") if what[1] is None else F.lit((time.time() if now is None else now) + float(what[1]))
                part = c._keyed_ops(c._one(what[0], namespace), TTL, expires_at=until)
            else:
                part = c._as_ops(what, op, namespace, now)
            part = part.withColumn("seq", F.lit(i).cast("long")).select(*OP_COLUMNS)
            every = part if every is None else every.unionByName(part)
        if every is None:
            return

        def check(written: DataFrame) -> None:
            c._check(written)
            if any(op == INSERT for op, _, _ in self.ops):
                c._check_inserts(written)

        c._append(every, {op for op, _, _ in self.ops}, check)

    def rollback(self) -> None:
        self.done, self.ops = True, []

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_) -> None:
        if self.done:
            return
        self.rollback() if kind else self.commit()


class Validated:
    """A collection whose upserts, inserts and metadata updates are checked against a metadata schema first; all else is the collection's own."""

    def __init__(self, collection: Collection, schema: Schema):
        self._collection, self._schema = collection, schema

    def __getattr__(self, name: str):
        return getattr(self._collection, name)

    def __len__(self) -> int:
        return len(self._collection)

    def upsert(self, rows: DataFrame, namespace: str = "", now: float | None = None) -> None:
        self._schema.check(with_defaults(rows, namespace, now))
        self._collection.upsert(rows, namespace, now)

    def insert(self, rows: DataFrame, namespace: str = "", now: float | None = None) -> None:
        self._schema.check(with_defaults(rows, namespace, now))
        self._collection.insert(rows, namespace, now)

    def update_metadata(self, id: str, patch: dict, namespace: str = "") -> bool:
        self._schema.check(self._collection.spark.createDataFrame([(id, json.dumps(patch))], "id string, metadata string").withColumn("metadata", F.parse_json("metadata")))
        return self._collection.update_metadata(id, patch, namespace)


class Store:
    """A folder of collections."""

    def __init__(self, spark: SparkSession, root: str, read_only: bool = False):
        self.spark, self.root, self.read_only = spark, root.rstrip("/"), read_only

    def _at(self, name: str) -> str:
        if not name or "/" in name or name.startswith("."):
            raise RecordError(f"not a collection's name: {name!r}")
        return f"{self.root}/{name}"

    def create(self, name: str, dimension: int, metric: str = "cosine") -> Collection:
        if self.read_only:
            raise ClosedError("the store was opened read-only")
        return Collection.create(self.spark, self._at(name), dimension, metric)

    def open(self, name: str) -> Collection:
        return Collection(self.spark, self._at(name), self.read_only)

    def open_or_create(self, name: str, dimension: int, metric: str = "cosine") -> Collection:
        return Collection.open(self.spark, self._at(name), dimension, metric, self.read_only)

    def drop(self, name: str) -> bool:
        """Everything of the collection; false if there was none."""
        if self.read_only:
            raise ClosedError("the store was opened read-only")
        return Collection.exists(self.spark, self._at(name)) and Files(self.spark).delete(self._at(name))

    def collections(self) -> list[str]:
        return [n for n in Files(self.spark).list(self.root) if Collection.exists(self.spark, f"{self.root}/{n}")]

    def close(self) -> None:
        """Nothing is held."""


def open_store(spark: SparkSession, root: str, read_only: bool = False) -> Store:
    return Store(spark, root, read_only)
