"""Command line: python -m trawl COMMAND PATH ..."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.filters import parse_terms
from .operators.search import Options
from .sources.io import read_csv, read_jsonl, write_jsonl
from .sources.store import Collection


def _shown(rows) -> None:
    for r in rows:
        print(json.dumps({"namespace": r.namespace, "id": r.id, "metadata": json.loads(r.m)}))


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("trawl")
    p.add_argument("command", choices=["init", "stats", "count", "list", "get", "insert", "delete", "dump", "import-jsonl", "import-csv", "compact", "verify", "bench", "search"])
    p.add_argument("path")
    p.add_argument("rest", nargs="*", help="ids, files, or filter terms (k=v, k~text, k>n, k<n, k)")
    p.add_argument("--dimension", type=int)
    p.add_argument("--metric", default="cosine")
    p.add_argument("--namespace")
    p.add_argument("--query", help="a JSON vector")
    p.add_argument("--metadata", default="{}")
    p.add_argument("--k", type=int, default=10)
    p.add_argument("--limit", type=int, default=0)
    p.add_argument("--offset", type=int, default=0)
    p.add_argument("--id-col", default="id")
    p.add_argument("--vector-col", default="vector")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("trawl").getOrCreate()
    if a.command == "init":
        Collection.create(spark, a.path, a.dimension, a.metric)
        return 0
    c, ns = Collection.open(spark, a.path, a.dimension, a.metric), a.namespace or ""
    tests = parse_terms(a.rest)
    if a.command == "stats":
        print(json.dumps(c.stats(), sort_keys=True))
    elif a.command == "count":
        print(c.count(a.namespace, tests))
    elif a.command == "list":
        _shown(c.list(a.namespace, tests, a.limit, a.offset).select("namespace", "id", F.to_json("metadata").alias("m")).toLocalIterator())
    elif a.command == "get":
        _shown(c.list().where((F.col("namespace") == ns) & F.col("id").isin(a.rest)).select("namespace", "id", F.to_json("metadata").alias("m")).collect())
    elif a.command == "insert":
        row = [(a.rest[0], [float(x) for x in json.loads(a.query)], a.metadata)]
        c.insert(spark.createDataFrame(row, "id string, vector array<float>, metadata string"), ns)
    elif a.command == "delete":
        print(c.delete(a.rest, ns))
    elif a.command == "dump":
        write_jsonl(c.records(), a.rest[0])
    elif a.command == "import-jsonl":
        c.upsert(read_jsonl(spark, a.rest[0], ns, time.time()))
    elif a.command == "import-csv":
        good, bad = read_csv(spark, a.rest[0], a.id_col, a.vector_col, ns)
        c.upsert(good)
        print(f"{bad.count()} rows have no vector")
    elif a.command == "compact":
        print(c.compact(time.time()))
    elif a.command == "verify":
        wrong = c.verify()
        print("OK" if not wrong else "FAIL\n" + "\n".join(wrong))
        return int(bool(wrong))
    elif a.command == "bench":
        began = time.perf_counter()
        queries = c.records().orderBy(F.xxhash64("id")).limit(100).select(F.col("id").alias("qid"), "vector")
        n = c.search(queries, Options(k=a.k, namespace=None)).count()
        print(json.dumps({"queries": 100, "rows": n, "seconds": round(time.perf_counter() - began, 3)}))
    else:
        queries = spark.createDataFrame([("0", [float(x) for x in json.loads(a.query)])], "qid string, vector array<float>")
        for r in c.search(queries, Options(k=a.k, namespace=a.namespace, filter=tests)).orderBy("rank").collect():
            print(json.dumps({"rank": r["rank"], "namespace": r.namespace, "id": r.id, "score": round(r.score, 6)}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
