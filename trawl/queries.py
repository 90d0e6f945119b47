"""The registered queries of the retrieval engine and, as an independent formulation, their DuckDB SQL.

Records: one for each row of embeddings, namespace = label, id = vec_id, joined with the document of that id for text and metadata. Searches ask with every row whose
vec_id is divisible by 100, against all rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import metrics
from .functions.filters import compile_filter
from .functions.text import Analyzer, frequencies, term_counts, tokens
from .operators.bm25 import Index, build_index, matched_terms, scored_terms
from .operators.dense import payload_scores, ranked
from .operators.quantize import METHODS, Codec, TokenIndex, calibrate_scalar, nearest, recall, scalar_codes, search_quantized, two_bit_boundaries
from .operators.rerank import compose, metadata_boost, text_match
from .operators.search import Options, not_expired, search, search_multi_vector
from .schema import Schema, with_defaults
from .sources.files import shared_folder
from .sources.io import csv_records, from_arrays, read_jsonl, write_jsonl
from .sources.oplog import apply_deletes, apply_ops, apply_patches, apply_records, fold_last
from .sources.store import Collection, cursor_page, list_page

NOW = 1000.0
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- records


def dense_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").cast("string").alias("namespace"), F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"), F.col("vec_id"))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_records(spark, sf_dir).where("vec_id % 100 = 0").select(F.col("id").alias("qid"), "vector")


def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "vec_id")
    return dense_records(spark, sf_dir).join(docs, "vec_id", "left")


def text_index(rows: DataFrame) -> Index:
    """The index of stored hybrid_records; a collection stores one (build_text_index)."""
    return build_index(rows)


def _hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(spark, sf_dir).select("namespace", "id", "vector", "vec_id", "lang", "source", frequencies(tokens(F.col("text"))).alias("sparse"))


def hybrid_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut into terms once, as a search scans them several times."""
    path = f"{shared_folder(spark)}/terms-{uuid.uuid4().hex}"
    _hybrid(spark, sf_dir).write.parquet(path)
    return spark.read.parquet(path)


def hybrid_queries(rows: DataFrame) -> DataFrame:
    """Asks with the vector and the whole text of each queried row of hybrid_records."""
    return rows.where("vec_id % 100 = 0").select(F.col("id").alias("qid"), "vector", "sparse")


def _hybrid_search(spark: SparkSession, sf_dir: str, *columns: str, **options) -> DataFrame:
    rows = hybrid_records(spark, sf_dir)
    asked = hybrid_queries(rows)
    return search(rows.select("namespace", "id", "vector", "sparse"), asked.select("qid", *columns) if columns else asked, Options(namespace=None, **options), text_index(rows))


def metadata_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records whose metadata has nested objects, lists, an explicit null and missing keys."""
    d = table(spark, sf_dir, "documents")
    meta = F.concat(
        F.lit('{"lang":"'), "lang", F.lit('","source":"'), "source", F.lit('","n_chars":'), F.col("n_chars").cast("string"), F.lit(',"ratio":'), (F.col("n_chars") % 7).cast("string"), F.lit('.5,"author":{"name":"'), "source",
        F.lit('","level":'), (F.col("n_chars") % 5).cast("string"), F.lit('},"tags":["'), "lang", F.lit('","'), "source", F.lit('",'), (F.col("n_chars") % 3).cast("string"), F.lit('],"parts":[{"n":'), (F.col("n_chars") % 4).cast("string"), F.lit('},{"n":'), (F.col("n_chars") % 6).cast("string"), F.lit("}]"),
        F.when(F.col("doc_id") % 3 == 0, F.lit(',"opt":null')).when(F.col("doc_id") % 3 == 1, F.lit(',"opt":1')).otherwise(F.lit("")), F.when(F.col("doc_id") % 3 == 1, F.lit(',"opts":["x"]')).when(F.col("doc_id") % 3 == 2, F.lit(',"opts":[]')).otherwise(F.lit("")), F.lit("}"),
    )
    expires = F.when(F.col("doc_id") % 10 == 3, F.lit(500.0)).when(F.col("doc_id") % 10 == 4, F.lit(NOW)).when(F.col("doc_id") % 10 == 5, F.lit(2000.0))
    return d.select(F.col("lang").alias("namespace"), F.col("doc_id").cast("string").alias("id"), "doc_id", "n_chars", F.parse_json(meta).alias("metadata"), expires.alias("expires_at"))


def _full_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_defaults(metadata_records(spark, sf_dir).withColumn("vector", F.array(F.col("n_chars").cast("float"))))


def _result(df: DataFrame, *more: str) -> DataFrame:
    return df.select("qid", "rank", "namespace", "id", F.round("score", 6).alias("score"), *more)


_R = "r AS (SELECT CAST(label AS VARCHAR) namespace, CAST(vec_id AS VARCHAR) id, vec_id, CAST(embedding AS DOUBLE[]) v FROM embeddings)"
_Q = "q AS (SELECT CAST(vec_id AS VARCHAR) qid, CAST(embedding AS DOUBLE[]) qv FROM embeddings WHERE vec_id % 100 = 0)"


def _top(score: str, where: str = "true", k: int = 10, with_: str = f"{_R}, {_Q}", source: str = "r, q") -> str:
    return f"WITH {with_} SELECT qid, rank, namespace, id, round(s, 6) AS score FROM (SELECT qid, namespace, id, s, row_number() OVER (PARTITION BY qid ORDER BY s DESC, namespace, id) AS rank FROM (SELECT qid, namespace, id, {score} AS s FROM {source} WHERE {where})) WHERE rank <= {k}"


# ---- dense search


@query(_top("list_cosine_similarity(v, qv)"))
def dense_cosine_topk(spark, sf_dir):
    return _result(search(dense_records(spark, sf_dir), vector_queries(spark, sf_dir), Options(namespace=None)))


@query(_top("0.0 - list_distance(v, qv)"))
def dense_euclidean_topk(spark, sf_dir):
    return _result(search(dense_records(spark, sf_dir), vector_queries(spark, sf_dir), Options(namespace=None, metric="l2")))


@query(_top("list_inner_product(v, qv)"))
def dense_dot_topk(spark, sf_dir):
    return _result(search(dense_records(spark, sf_dir), vector_queries(spark, sf_dir), Options(namespace=None, metric="ip")))


@query(_top("0.0 - list_sum(list_transform(list_zip(v, qv), lambda p: abs(p[1] - p[2])))"))
def dense_manhattan_topk(spark, sf_dir):
    return _result(search(dense_records(spark, sf_dir), vector_queries(spark, sf_dir), Options(namespace=None, metric="manhattan")))


@query(_top("list_cosine_similarity(v, qv)", "namespace = '3'"))
def dense_namespace_topk(spark, sf_dir):
    return _result(search(dense_records(spark, sf_dir), vector_queries(spark, sf_dir), Options(namespace="3")))


@query(_top("list_cosine_similarity(v, qv)", k=25))
def dense_all_namespaces(spark, sf_dir):
    return _result(search(dense_records(spark, sf_dir), vector_queries(spark, sf_dir), Options(k=25, namespace=None)))


@query(_top("list_cosine_similarity(v, qv)", "lang = 'en' AND n_chars > 1000", source="r JOIN documents ON vec_id = doc_id, q"))
def dense_filtered_topk(spark, sf_dir):
    rows = dense_records(spark, sf_dir).join(metadata_records(spark, sf_dir).select(F.col("id"), "metadata"), "id")
    return _result(search(rows, vector_queries(spark, sf_dir), Options(namespace=None, filter={"lang": "en", "n_chars": {"$gt": 1000}})))


@query(_top("list_cosine_similarity(v[1:16], qv[1:16])"))
def matryoshka_topk(spark, sf_dir):
    return _result(search(dense_records(spark, sf_dir), vector_queries(spark, sf_dir), Options(namespace=None, truncate_dim=16)))


@query(_top("list_cosine_similarity(v, qv)", k=3))
def batch_queries_topk(spark, sf_dir):
    return _result(search(dense_records(spark, sf_dir), vector_queries(spark, sf_dir), Options(k=3, namespace=None)))


def _named(spark, sf_dir):
    rows = dense_records(spark, sf_dir)
    return rows.withColumn("vectors", F.when(F.col("vec_id") % 2 == 0, F.create_map(F.lit("rev"), F.reverse("vector"))))


@query(_top("list_cosine_similarity(list_reverse(v), qv)", "vec_id % 2 = 0"))
def named_vector_topk(spark, sf_dir):
    return _result(search(_named(spark, sf_dir), vector_queries(spark, sf_dir), Options(namespace=None, vector_name="rev")))


@query(_top("0.7 * list_cosine_similarity(v, qv) + CASE WHEN vec_id % 2 = 0 THEN 0.3 * list_cosine_similarity(list_reverse(v), list_reverse(qv)) ELSE 0 END"))
def weighted_multispace_topk(spark, sf_dir):
    asked = vector_queries(spark, sf_dir).select("qid", F.create_map(F.lit(""), F.col("vector"), F.lit("rev"), F.reverse("vector")).alias("vectors"))
    return _result(search(_named(spark, sf_dir), asked, Options(namespace=None, spaces={"": 0.7, "rev": 0.3})))


@query(_top("list_cosine_similarity(v, qv)", "vec_id % 10 NOT IN (3, 4)"))
def dense_ttl_topk(spark, sf_dir):
    rows = dense_records(spark, sf_dir).withColumn("expires_at", F.when(F.col("vec_id") % 10 == 3, F.lit(500.0)).when(F.col("vec_id") % 10 == 4, F.lit(NOW)).when(F.col("vec_id") % 10 == 5, F.lit(2000.0)))
    return _result(search(rows, vector_queries(spark, sf_dir), Options(namespace=None, now=NOW)))


@query()
def ann_ivf_recall(spark, sf_dir):
    """Recall at 10 of the inverted file against exact search, for each preset; no SQL, as cells are fitted."""
    from .operators.ann import PRESETS, InvertedFile

    rows, asked = dense_records(spark, sf_dir), vector_queries(spark, sf_dir)
    exact = search(rows, asked, Options(namespace=None)).persist()
    said = [(preset, round(recall(InvertedFile.build(rows, preset=preset).search(asked), exact), 4)) for preset in PRESETS]
    exact.unpersist()
    return spark.createDataFrame(said, "preset string, recall double")


# ---- text and BM25

_TOKENS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"
_BM = f"""d AS (SELECT CAST(label AS VARCHAR) namespace, CAST(vec_id AS VARCHAR) id, vec_id, lang, source, CAST(embedding AS DOUBLE[]) v, {_TOKENS} t FROM embeddings LEFT JOIN documents ON vec_id = doc_id),
p AS (SELECT namespace, id, term, CAST(CAST(count(*)::DOUBLE / any_value(n) AS FLOAT) AS DOUBLE) w FROM (SELECT namespace, id, len(t) n, unnest(t) term FROM d) GROUP BY 1, 2, 3),
lens AS (SELECT namespace, id, sum(w) len FROM p GROUP BY 1, 2),
st AS (SELECT (SELECT count(*) FROM d) n, (SELECT sum(len) FROM lens) / (SELECT count(*) FROM d) a),
f AS (SELECT term, count(*) df FROM p GROUP BY 1),
qt AS (SELECT qid, term, CAST(CAST(count(*)::DOUBLE / any_value(n) AS FLOAT) AS DOUBLE) qw FROM (SELECT id qid, len(t) n, unnest(t) term FROM d WHERE vec_id % 100 = 0) GROUP BY 1, 2),
e AS (SELECT qid, namespace, id, term, qw, ln((n - df + 0.5) / (df + 0.5) + 1) * w * 2.2 / (w + 1.2 * (0.25 + 0.75 * len / a)) x FROM p JOIN f USING (term) JOIN qt USING (term) JOIN lens USING (namespace, id), st),
b AS (SELECT qid, namespace, id, round(sum(qw * x), 9) bm FROM e GROUP BY 1, 2, 3),
q AS (SELECT id qid, v qv FROM d WHERE vec_id % 100 = 0),
h AS (SELECT q.qid, d.namespace, d.id, d.lang, d.source, list_cosine_similarity(d.v, qv) ds, 0.0 - list_distance(d.v, qv) es, coalesce(bm, 0) bm FROM d CROSS JOIN q LEFT JOIN b ON b.qid = q.qid AND b.namespace = d.namespace AND b.id = d.id)"""


@query("WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') t FROM documents) SELECT doc_id, term, round(count(*)::DOUBLE / any_value(n), 9) AS weight FROM (SELECT doc_id, len(t) n, unnest(t) term FROM t) GROUP BY 1, 2")
def sparse_terms(spark, sf_dir):
    rows = term_counts(table(spark, sf_dir, "documents"), ["doc_id"], tokens(F.col("text")))
    return rows.select("doc_id", "term", F.round(F.col("n") / F.col("total"), 9).alias("weight"))


@query("WITH a AS (SELECT doc_id, 2.0 w, regexp_extract_all(lower(source || ' ' || lang), '[a-z0-9]+') t FROM documents UNION ALL SELECT doc_id, 1.0, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') FROM documents), u AS (SELECT doc_id, w / len(t) x, unnest(t) term FROM a) SELECT doc_id, term, round(sum(x), 9) AS weight FROM u GROUP BY 1, 2")
def sparse_terms_weighted(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    head = term_counts(d, ["doc_id"], tokens(F.concat_ws(" ", "source", "lang"))).select("doc_id", "term", (2.0 * F.col("n") / F.col("total")).alias("w"))
    body = term_counts(d, ["doc_id"], tokens(F.col("text"))).select("doc_id", "term", (F.col("n") / F.col("total")).alias("w"))
    return head.unionByName(body).groupBy("doc_id", "term").agg(F.round(F.sum("w"), 9).alias("weight"))


#: English stop words.
_STOP = "('a','an','and','are','as','at','be','by','for','from','has','he','in','is','it','its','of','on','or','that','the','to','was','were','with')"


@query(f"WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) term FROM documents) SELECT doc_id, count(*) AS n_tokens, count(DISTINCT term) AS n_terms FROM t WHERE term NOT IN {_STOP} GROUP BY 1")
def analyzer_stopwords(spark, sf_dir):
    words = Analyzer().stopwords("en").tokenize(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(words).alias("term"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.countDistinct("term").alias("n_terms"))


@query("WITH t AS (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) term FROM documents), g AS (SELECT unnest(CASE WHEN length(term) <= 3 THEN [term] ELSE list_transform(range(1, length(term) - 1), lambda i: substr(term, i, 3)) END) gram FROM t) SELECT gram, count(*) AS n FROM g GROUP BY 1")
def analyzer_ngrams(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("m"))
    cut = Analyzer(tokenizer=lambda t: F.array(t)).ngrams(3).tokenize(F.col("term"))
    return words.select("m", F.explode(cut).alias("gram")).groupBy("gram").agg(F.sum("m").alias("n"))


@query(f"WITH {_BM} SELECT n, round(a, 6) AS average, (SELECT count(*) FROM f) AS n_terms, (SELECT max(df) FROM f) AS most_df FROM st")
def bm25_stats(spark, sf_dir):
    index = build_index(hybrid_records(spark, sf_dir))
    return index.frequencies.agg(F.lit(index.n).cast("long").alias("n"), F.round(F.lit(index.average), 6).alias("average"), F.count("*").alias("n_terms"), F.max("df").alias("most_df"))


@query(_top("bm", with_=_BM, source="b"))
def bm25_topk(spark, sf_dir):
    return _result(_hybrid_search(spark, sf_dir, "sparse"))


@query(f"WITH {_BM} SELECT qid, namespace, id, term, round(x, 6) AS term_score FROM e")
def bm25_term_scores(spark, sf_dir):
    from .operators.search import query_terms

    records = hybrid_records(spark, sf_dir)
    rows = scored_terms(text_index(records), query_terms(hybrid_queries(records)), digits=6)
    return rows.select("qid", "namespace", "id", "term", F.col("score").alias("term_score"))


@query(f"WITH {_BM} SELECT qid, namespace, id, string_agg(term, ',' ORDER BY term) AS matched FROM e GROUP BY 1, 2, 3")
def matched_terms_query(spark, sf_dir):
    from .operators.search import query_terms

    records = hybrid_records(spark, sf_dir)
    rows = matched_terms(records, query_terms(hybrid_queries(records)))
    return rows.select("qid", "namespace", "id", F.array_join("matched", ",").alias("matched"))


# ---- hybrid search


@query(_top("ds + bm", with_=_BM, source="h"))
def hybrid_linear(spark, sf_dir):
    return _result(_hybrid_search(spark, sf_dir))


@query(_top("0.4 * ds + 2 * bm", with_=_BM, source="h"))
def hybrid_weighted(spark, sf_dir):
    return _result(_hybrid_search(spark, sf_dir, dense_weight=0.4, sparse_weight=2.0))


def _rrf(dense: str, where: str = "true") -> str:
    ranks = f"k AS (SELECT *, CASE WHEN {dense} > 0 THEN row_number() OVER (PARTITION BY qid ORDER BY {dense} DESC, namespace, id) END dr, CASE WHEN bm > 0 THEN row_number() OVER (PARTITION BY qid ORDER BY bm DESC, namespace, id) END sr FROM h WHERE {where})"
    return _top("coalesce(1.0 / (60 + dr), 0) + coalesce(1.0 / (60 + sr), 0)", with_=f"{_BM}, {ranks}", source="k")


@query(_rrf("ds"))
def hybrid_rrf(spark, sf_dir):
    return _result(_hybrid_search(spark, sf_dir, fusion="rrf"))


@query(_rrf("es"))
def hybrid_rrf_euclidean(spark, sf_dir):
    """Negated distances are never positive, so they get no rank and only the sparse side counts."""
    return _result(_hybrid_search(spark, sf_dir, fusion="rrf", metric="euclidean"))


@query(_top("ds + bm", "lang = 'en'", with_=_BM, source="h"))
def hybrid_filtered(spark, sf_dir):
    records = hybrid_records(spark, sf_dir)
    rows = records.withColumn("metadata", F.parse_json(F.to_json(F.struct("lang", "source"))))
    return _result(search(rows, hybrid_queries(records), Options(namespace=None, filter={"lang": "en"}), text_index(records)))


@query(f"""WITH {_BM}, k AS (SELECT *, CASE WHEN ds > 0 THEN row_number() OVER (PARTITION BY qid ORDER BY ds DESC, namespace, id) END dr, CASE WHEN bm > 0 THEN row_number() OVER (PARTITION BY qid ORDER BY bm DESC, namespace, id) END sr FROM h),
m AS (SELECT qid, namespace, id, string_agg(term, ',' ORDER BY term) x, count(*) c FROM e GROUP BY 1, 2, 3)
SELECT qid, rank, namespace, id, round(s, 6) AS score, dr AS dense_rank, sr AS sparse_rank, coalesce(x, '') AS matched, coalesce(c, 0) AS n_scores FROM (SELECT *, ds + bm s, row_number() OVER (PARTITION BY qid ORDER BY ds + bm DESC, namespace, id) rank FROM k) LEFT JOIN m USING (qid, namespace, id) WHERE rank <= 10""")
def hybrid_explain(spark, sf_dir):
    top = _hybrid_search(spark, sf_dir, explain=True)
    return _result(top, "dense_rank", "sparse_rank", F.coalesce(F.array_join("matched", ","), F.lit("")).alias("matched"), F.coalesce(F.size("term_scores"), F.lit(0)).cast("long").alias("n_scores"))


@query(f"WITH {_BM}, k AS (SELECT qid, namespace, id, row_number() OVER (PARTITION BY qid ORDER BY ds DESC, namespace, id) a FROM h), s AS (SELECT qid, namespace, id, row_number() OVER (PARTITION BY qid ORDER BY bm DESC, namespace, id) a FROM b) SELECT DISTINCT qid, namespace, id FROM (SELECT * FROM k WHERE a <= 20 UNION ALL SELECT * FROM s WHERE a <= 20)")
def candidate_union(spark, sf_dir):
    dense = search(dense_records(spark, sf_dir), vector_queries(spark, sf_dir), Options(k=20, namespace=None))
    sparse = _hybrid_search(spark, sf_dir, "sparse", k=20)
    return dense.select("qid", "namespace", "id").unionByName(sparse.select("qid", "namespace", "id")).distinct()


# ---- late interaction, diversification, reranking


def _token_records(spark, sf_dir):
    groups = dense_records(spark, sf_dir).groupBy(F.floor(F.col("vec_id") / 5).alias("g")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "vector"))).alias("t"))
    return groups.select(F.lit("").alias("namespace"), F.col("g").cast("string").alias("id"), "g", F.create_map(F.lit("colbert"), F.transform("t", lambda x: x.vector)).alias("multi_vectors"))


def _token_queries(spark, sf_dir):
    return _token_records(spark, sf_dir).where("g % 20 = 0").select(F.col("id").alias("qid"), F.col("multi_vectors")["colbert"].alias("tokens"))


_MAX = """r AS (SELECT vec_id // 5 g, CAST(embedding AS DOUBLE[]) v FROM embeddings), m AS (SELECT a.g qg, b.g, a.v, max(list_cosine_similarity(a.v, b.v)) x FROM r a, r b WHERE a.g % 20 = 0 GROUP BY a.g, b.g, a.v),
s AS (SELECT CAST(qg AS VARCHAR) qid, '' namespace, CAST(g AS VARCHAR) id, g, sum(x) s FROM m GROUP BY qg, g)"""


@query(_top("s", with_=_MAX, source="s"))
def maxsim_topk(spark, sf_dir):
    return _result(search_multi_vector(_token_records(spark, sf_dir), _token_queries(spark, sf_dir), "colbert"))


@query(_top("s", "g % 2 = 1", with_=_MAX, source="s"))
def maxsim_filtered(spark, sf_dir):
    rows = _token_records(spark, sf_dir).withColumn("metadata", F.parse_json(F.to_json(F.struct((F.col("g") % 2).alias("odd")))))
    return _result(search_multi_vector(rows, _token_queries(spark, sf_dir), "colbert", tests={"odd": 1}))


@query(f"""WITH RECURSIVE {_R}, {_Q}, c AS (SELECT qid, namespace, id, v, list_cosine_similarity(v, qv) s FROM r, q),
m AS (SELECT qid, 1 AS rank, namespace, id, s, v, [id] picked, [v] vs FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, namespace, id) n FROM c) WHERE n = 1
  UNION ALL
  SELECT qid, rank, namespace, id, s, v, picked, vs FROM (SELECT m.qid, m.rank + 1 rank, c.namespace, c.id, c.s, c.v, list_append(m.picked, c.id) picked, list_append(m.vs, c.v) vs,
    row_number() OVER (PARTITION BY m.qid ORDER BY 0.7 * c.s - (1 - 0.7) * greatest(0, list_max(list_transform(m.vs, lambda x: list_cosine_similarity(x, c.v)))) DESC, c.s DESC, c.namespace, c.id) n
    FROM m JOIN c ON c.qid = m.qid AND NOT list_contains(m.picked, c.id) WHERE m.rank < 5) WHERE n = 1)
SELECT qid, rank::BIGINT AS rank, namespace, id, round(s, 6) AS score FROM m""")
def mmr_topk(spark, sf_dir):
    return _result(search(dense_records(spark, sf_dir), vector_queries(spark, sf_dir), Options(k=5, namespace=None, mmr_lambda=0.7)))


def _ranked_texts(spark, sf_dir):
    rows = _joined(spark, sf_dir)
    top = _hybrid_search(spark, sf_dir, k=20)
    said = _joined(spark, sf_dir).where("vec_id % 100 = 0").select(F.col("id").alias("qid"), F.array_join(tokens(F.col("text")), " ").alias("query"))
    return top.join(rows.select("namespace", "id", "text", F.col("source").alias("title"), "lang"), ["namespace", "id"]).join(said, "qid")


def _reranked(df: DataFrame) -> DataFrame:
    return df.select("qid", "rank", "namespace", "id", F.round("rerank_score", 6).alias("rerank_score"))


_RR = f"""WITH {_BM}, x AS (SELECT * FROM (SELECT h.*, ds + bm s, row_number() OVER (PARTITION BY qid ORDER BY ds + bm DESC, namespace, id) rank FROM h) WHERE rank <= 20),
y AS (SELECT x.qid, x.rank, x.namespace, x.id, x.s, x.lang, d.t body, regexp_extract_all(lower(x.source), '[a-z0-9]+') title, list_distinct(a.t) asked, array_to_string(a.t, ' ') phrase, lower(coalesce(o.text, '')) low, x.source
  FROM x JOIN d ON d.namespace = x.namespace AND d.id = x.id JOIN d a ON a.id = x.qid LEFT JOIN documents o ON CAST(o.doc_id AS VARCHAR) = x.id),
z AS (SELECT *, s + CASE WHEN len(asked) > 0 THEN 1.25 * len(list_intersect(asked, body))::DOUBLE / len(asked) + 1.5 * len(list_intersect(asked, title)) / len(asked) ELSE 0 END + CASE WHEN phrase <> '' AND (contains(low, phrase) OR contains(lower(source), phrase)) THEN 1 ELSE 0 END tm, s + CASE lang WHEN 'en' THEN 0.25 WHEN 'de' THEN 0.5 ELSE 0 END mb FROM y)"""


@query(f"{_RR} SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY tm DESC, rank) AS rank, namespace, id, round(tm, 6) AS rerank_score FROM z")
def rerank_text_match(spark, sf_dir):
    return _reranked(text_match()(_ranked_texts(spark, sf_dir)))


@query(f"{_RR} SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY mb DESC, rank) AS rank, namespace, id, round(mb, 6) AS rerank_score FROM z")
def rerank_metadata_boost(spark, sf_dir):
    return _reranked(metadata_boost(F.col("lang"), {"en": 0.25, "de": 0.5})(_ranked_texts(spark, sf_dir)))


@query(f"{_RR}, w AS (SELECT *, 1.0 / (60 + row_number() OVER (PARTITION BY qid ORDER BY tm DESC, rank)) + 1.0 / (60 + row_number() OVER (PARTITION BY qid ORDER BY mb DESC, rank)) f FROM z) SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY f DESC, rank) AS rank, namespace, id, round(f, 6) AS rerank_score FROM w")
def rerank_compose_rrf(spark, sf_dir):
    return _reranked(compose(text_match(), metadata_boost(F.col("lang"), {"en": 0.25, "de": 0.5}), mode="rrf")(_ranked_texts(spark, sf_dir)))


# ---- filters


def _filter_query(name: str, tests: dict, where: str) -> None:
    def run(spark, sf_dir):
        return metadata_records(spark, sf_dir).where(compile_filter(tests)).select("namespace", "id")

    run.__name__ = name
    query(f"SELECT lang AS namespace, CAST(doc_id AS VARCHAR) AS id FROM documents WHERE {where}")(run)


_filter_query("filter_eq", {"lang": "en"}, "lang = 'en'")
_filter_query("filter_eq_strict", {"$or": [{"ratio": 2}, {"n_chars": 1000.0}, {"ratio": 2.5}]}, "n_chars % 7 = 2")
_filter_query("filter_ne", {"opt": {"$ne": 1}}, "doc_id % 3 = 0")
_filter_query("filter_null", {"opt": None}, "doc_id % 3 = 0")
_filter_query("filter_in", {"lang": {"$in": ["de", "es", 5]}}, "lang IN ('de', 'es')")
_filter_query("filter_nin", {"opt": {"$nin": [None, 7]}}, "doc_id % 3 = 1")
_filter_query("filter_range", {"n_chars": {"$gte": 500, "$lt": 2000}}, "n_chars >= 500 AND n_chars < 2000")
_filter_query("filter_range_strings", {"$or": [{"lang": {"$gt": 0}}, {"ratio": {"$gt": 4}}]}, "n_chars % 7 >= 4")
_filter_query("filter_contains", {"source": {"$contains": "c1"}}, "contains(source, 'c1')")
_filter_query("filter_exists", {"opt": {"$exists": True}}, "doc_id % 3 <> 2")
_filter_query("filter_not_exists", {"opt": {"$exists": False}}, "doc_id % 3 = 2")
_filter_query("filter_not", {"$not": {"opt": 1}}, "doc_id % 3 <> 1")
_filter_query("filter_field_not", {"n_chars": {"$not": {"$gt": 1000}}}, "n_chars <= 1000")
_filter_query("filter_and_or", {"$and": [{"lang": "en"}, {"$or": [{"n_chars": {"$lt": 800}}, {"source": "src3"}]}]}, "lang = 'en' AND (n_chars < 800 OR source = 'src3')")
_filter_query("filter_empty_or", {"$or": [{"lang": "de"}, {"$or": []}]}, "lang = 'de'")
_filter_query("filter_nested", {"author.name": "src3", "author.level": {"$gte": 2}}, "source = 'src3' AND n_chars % 5 >= 2")
_filter_query("filter_deep_equal", {"author": {"name": "src3", "level": 2}}, "source = 'src3' AND n_chars % 5 = 2")
_filter_query("filter_list_equal", {"tags": ["en", "src3", 1]}, "lang = 'en' AND source = 'src3' AND n_chars % 3 = 1")
_filter_query("filter_elem_match", {"tags": {"$elemMatch": {"$eq": "src3"}}}, "source = 'src3'")
_filter_query("filter_elem_match_object", {"parts": {"$elemMatch": {"n": {"$gt": 4}}}}, "n_chars % 6 = 5")
_filter_query("filter_size", {"tags": {"$size": 3}, "$or": [{"parts": {"$size": 1}}, {"opts": {"$size": 1}}]}, "doc_id % 3 = 1")


@query("SELECT event_type, count(*) AS n, count(*) FILTER (WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 50) AS above FROM events GROUP BY 1")
def filter_event_props(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("metadata", F.try_parse_json("props"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(compile_filter({"k": {"$gt": 50}})).alias("above"))


# ---- reads


@query("SELECT lang AS namespace, count(*) AS n FROM documents GROUP BY 1")
def count_by_namespace(spark, sf_dir):
    return metadata_records(spark, sf_dir).groupBy("namespace").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT lang AS namespace FROM documents")
def namespaces(spark, sf_dir):
    return metadata_records(spark, sf_dir).select("namespace").distinct()


@query("SELECT lang AS namespace, CAST(doc_id AS VARCHAR) AS id FROM documents WHERE n_chars > 300 ORDER BY 1, 2 LIMIT 50 OFFSET 20")
def list_page_query(spark, sf_dir):
    return list_page(metadata_records(spark, sf_dir), None, {"n_chars": {"$gt": 300}}, 50, 20, now=0.0).select("namespace", "id")


@query("SELECT lang AS namespace, CAST(doc_id AS VARCHAR) AS id FROM documents WHERE (lang, CAST(doc_id AS VARCHAR)) > ('en', '5') ORDER BY 1, 2 LIMIT 40")
def cursor_page_query(spark, sf_dir):
    return cursor_page(metadata_records(spark, sf_dir), None, None, 40, "en\0" + "5", now=0.0).select("namespace", "id")


@query("SELECT lang AS namespace, CAST(doc_id AS VARCHAR) AS id FROM documents WHERE doc_id = 42 AND lang IN (SELECT lang FROM documents WHERE doc_id = 42)")
def get_record(spark, sf_dir):
    return metadata_records(spark, sf_dir).where((F.col("id") == "42") & not_expired(NOW)).select("namespace", "id")


@query("SELECT lang AS namespace, CAST(doc_id AS VARCHAR) AS id FROM documents WHERE doc_id % 10 NOT IN (3, 4)")
def ttl_visible(spark, sf_dir):
    return metadata_records(spark, sf_dir).where(not_expired(NOW)).select("namespace", "id")


@query("SELECT lang AS namespace, count(*) AS dropped FROM documents WHERE doc_id % 10 IN (3, 4) GROUP BY 1")
def ttl_expired_gc(spark, sf_dir):
    return metadata_records(spark, sf_dir).where(~not_expired(NOW)).groupBy("namespace").agg(F.count("*").alias("dropped"))


# ---- writes


def _keyed(df: DataFrame) -> DataFrame:
    return df.select("namespace", "id", F.col("vector")[0].cast("double").alias("v"), F.variant_get("metadata", "$.n_chars", "bigint").alias("n_chars"))


def _batch(spark, sf_dir):
    """Later versions of some records and records of their own: doc_id doubled, so that even keys exist already up to the largest."""
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.col("doc_id").alias("seq"), F.lit("upsert").alias("op"), F.lit("en").alias("namespace"), (F.floor(F.col("doc_id") / 2) * 3).cast("string").alias("id"), F.array((-F.col("doc_id")).cast("float")).alias("vector"), F.parse_json(F.concat(F.lit('{"n_chars":'), F.col("doc_id").cast("string"), F.lit("}"))).alias("metadata"))
    return with_defaults(rows, keep=("seq", "op"))


_STORED = "s AS (SELECT lang namespace, CAST(doc_id AS VARCHAR) id, CAST(n_chars AS FLOAT)::DOUBLE v, n_chars FROM documents)"
_LAST = "u AS (SELECT 'en' namespace, CAST((doc_id // 2) * 3 AS VARCHAR) id, max(doc_id) m FROM documents GROUP BY 1, 2)"


@query(f"WITH {_STORED}, {_LAST} SELECT * FROM s WHERE (namespace, id) NOT IN (SELECT namespace, id FROM u) UNION ALL SELECT namespace, id, -m::DOUBLE, m FROM u")
def upsert_fold(spark, sf_dir):
    return _keyed(apply_records(_full_records(spark, sf_dir), fold_last(_batch(spark, sf_dir)).drop("seq", "op")))


@query(f"WITH {_STORED}, {_LAST} SELECT namespace, id FROM u WHERE (namespace, id) IN (SELECT namespace, id FROM s)")
def insert_duplicates(spark, sf_dir):
    return fold_last(_batch(spark, sf_dir)).select("namespace", "id").join(_full_records(spark, sf_dir).select("namespace", "id"), ["namespace", "id"], "left_semi")


@query(f"WITH {_STORED} SELECT * FROM s WHERE NOT (namespace = 'fr' AND n_chars < 1500)")
def delete_by_filter(spark, sf_dir):
    hit = compile_filter({"n_chars": {"$lt": 1500}}) & (F.col("namespace") == "fr")
    return _keyed(_full_records(spark, sf_dir).where(~hit))


@query("SELECT lang AS namespace, CAST(doc_id AS VARCHAR) AS id FROM documents WHERE doc_id % 7 <> 0")
def delete_many(spark, sf_dir):
    keys = table(spark, sf_dir, "documents").where("doc_id % 7 = 0").select(F.col("lang").alias("namespace"), F.col("doc_id").cast("string").alias("id"))
    return apply_deletes(_full_records(spark, sf_dir), keys).select("namespace", "id")


@query("SELECT lang AS namespace, CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 4 = 0 THEN 'new' ELSE source END AS source, n_chars, CASE WHEN doc_id % 4 = 0 THEN doc_id END AS added FROM documents")
def update_metadata_merge(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("doc_id % 4 = 0")
    patches = d.select(F.col("lang").alias("namespace"), F.col("doc_id").cast("string").alias("id"), F.to_json(F.struct(F.lit("new").alias("source"), F.col("doc_id").alias("added"))).alias("patch"))
    rows = apply_patches(_full_records(spark, sf_dir), patches)
    return rows.select("namespace", "id", F.variant_get("metadata", "$.source", "string").alias("source"), F.variant_get("metadata", "$.n_chars", "bigint").alias("n_chars"), F.variant_get("metadata", "$.added", "bigint").alias("added"))


@query(f"""WITH {_STORED}, o AS (SELECT doc_id seq, CASE WHEN doc_id % 3 = 0 THEN 'delete' ELSE 'upsert' END op, 'en' namespace, CAST((doc_id // 2) * 3 AS VARCHAR) id FROM documents),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY namespace, id ORDER BY seq DESC) n FROM o) WHERE n = 1)
SELECT * FROM s WHERE (namespace, id) NOT IN (SELECT namespace, id FROM l) UNION ALL SELECT namespace, id, -seq::DOUBLE, seq FROM l WHERE op = 'upsert'""")
def transaction_fold(spark, sf_dir):
    ops = _batch(spark, sf_dir).withColumn("op", F.when(F.col("seq") % 3 == 0, F.lit("delete")).otherwise("upsert")).withColumn("patch", F.lit(None).cast("string"))
    return _keyed(apply_ops(_full_records(spark, sf_dir), ops))


def _op_log(spark, sf_dir):
    """Ops of all kinds, interleaved over the same keys; the log's order is that of events."""
    e = table(spark, sf_dir, "events")
    kind = F.element_at(F.array(*map(F.lit, ("upsert", "metadata", "ttl", "metadata", "delete", "metadata", "upsert"))), (F.col("event_id") % 7 + 1).cast("int"))
    patch = F.concat(F.lit('{"k'), (F.col("event_id") % 3).cast("string"), F.lit('":'), F.col("event_id").cast("string"), F.lit("}"))
    rows = e.select(
        F.col("event_id").alias("seq"), kind.alias("op"), F.lit("en").alias("namespace"), (F.col("user_id") * 13 % 400).cast("string").alias("id"), F.array((-F.col("event_id")).cast("float")).alias("vector"),
        F.parse_json(F.concat(F.lit('{"n_chars":'), F.col("event_id").cast("string"), F.lit("}"))).alias("metadata"), F.when(F.col("event_id") % 14 == 2, F.col("event_id").cast("double")).alias("expires_at"), patch.alias("patch"),
    )
    return with_defaults(rows, keep=("seq", "op", "patch"))


@query(f"""WITH {_STORED}, o AS (SELECT event_id seq, event_id % 7 k, 'en' namespace, CAST(user_id * 13 % 400 AS VARCHAR) id FROM events),
w AS (SELECT namespace, id, max(seq) seq, arg_max(k, seq) k FROM o WHERE k IN (0, 4, 6) GROUP BY 1, 2),
h AS (SELECT s.namespace, s.id, s.v, s.n_chars, -1 since, CASE WHEN CAST(id AS BIGINT) % 10 = 3 THEN 500.0 WHEN CAST(id AS BIGINT) % 10 = 4 THEN 1000.0 WHEN CAST(id AS BIGINT) % 10 = 5 THEN 2000.0 END x FROM s WHERE (namespace, id) NOT IN (SELECT namespace, id FROM w)
  UNION ALL SELECT namespace, id, -seq::DOUBLE, seq, seq, CASE WHEN seq % 14 = 2 THEN seq::DOUBLE END FROM w WHERE k <> 4),
l AS (SELECT h.namespace, h.id, o.seq, o.k FROM h JOIN o ON o.namespace = h.namespace AND o.id = h.id AND o.seq > h.since)
SELECT h.namespace, h.id, v, n_chars, (SELECT max(seq) FROM l WHERE l.namespace = h.namespace AND l.id = h.id AND k IN (1, 3, 5) AND seq % 3 = 0) AS k0, (SELECT max(seq) FROM l WHERE l.namespace = h.namespace AND l.id = h.id AND k IN (1, 3, 5) AND seq % 3 = 1) AS k1,
  CASE WHEN t.seq IS NULL THEN x WHEN t.seq % 14 = 2 THEN t.seq::DOUBLE END AS expires_at
FROM h LEFT JOIN (SELECT namespace, id, max(seq) seq FROM l WHERE k = 2 GROUP BY 1, 2) t ON t.namespace = h.namespace AND t.id = h.id""")
def op_log_fold(spark, sf_dir):
    """Upserts, deletes, metadata patches and ttls of the same keys, folded in order."""
    rows = apply_ops(_full_records(spark, sf_dir), _op_log(spark, sf_dir))
    return rows.select("namespace", "id", F.col("vector")[0].cast("double").alias("v"), *(F.variant_get("metadata", f"$.{k}", "bigint").alias(k) for k in ("n_chars", "k0", "k1")), "expires_at")


# ---- quantization

_EL = "x AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) v, generate_subscripts(embedding, 1) - 1 dim FROM embeddings)"


@query(f"WITH {_EL} SELECT dim, round(min(v), 6) AS low, round(max(v), 6) AS high, round(255.0 / (max(v) - min(v)), 4) AS scale FROM x GROUP BY dim")
def scalar_calibration(spark, sf_dir):
    rows = calibrate_scalar(dense_records(spark, sf_dir))
    return rows.select(F.col("dim").cast("long").alias("dim"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), F.round("scale", 4).alias("scale"))


_CODES = f"{_EL}, c AS (SELECT dim, min(v) l, 255.0 / (max(v) - min(v)) s FROM x GROUP BY dim), k AS (SELECT vec_id, dim, v, l, s, CAST(trunc(least(255, greatest(0, (v - l) * s))) AS BIGINT) code FROM x JOIN c USING (dim))"


@query(f"WITH {_CODES} SELECT CAST(vec_id AS VARCHAR) AS id, string_agg(code, ',' ORDER BY dim) AS codes FROM k GROUP BY 1")
def scalar_codes_query(spark, sf_dir):
    rows = dense_records(spark, sf_dir)
    return rows.select("id", F.array_join(scalar_codes(calibrate_scalar(rows)).cast("array<string>"), ",").alias("codes"))


@query(_top("list_cosine_similarity(v, qv)", with_=f"""{_CODES}, {_R}, {_Q}, z AS (SELECT CAST(vec_id AS VARCHAR) id, list(CAST(CAST(l + code / s AS FLOAT) AS DOUBLE) ORDER BY dim) w FROM k GROUP BY 1),
a AS (SELECT qid, namespace, r.id, v, qv, row_number() OVER (PARTITION BY qid ORDER BY list_cosine_similarity(w, qv) DESC, namespace, r.id) n FROM r JOIN z ON r.id = z.id, q)""", where="n <= 40", source="a"))
def scalar_rescored_topk(spark, sf_dir):
    return _result(search_quantized(dense_records(spark, sf_dir), vector_queries(spark, sf_dir), "scalar", multiplier=4))


@query("WITH b AS (SELECT vec_id, CAST(label AS VARCHAR) namespace, CAST(vec_id AS VARCHAR) id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) b FROM embeddings), s AS (SELECT a.id qid, c.namespace, c.id, list_sum(list_transform(list_zip(a.b, c.b), lambda p: abs(p[1] - p[2])))::BIGINT d FROM b a, b c WHERE a.vec_id % 100 = 0) SELECT qid, rank, namespace, id, d AS distance FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, namespace, id) rank FROM s) WHERE rank <= 10")
def binary_hamming_topk(spark, sf_dir):
    codec = Codec("binary")
    asked = vector_queries(spark, sf_dir).select("qid", F.col("vector").alias("payload"))
    near = payload_scores(codec.codes(dense_records(spark, sf_dir)), asked, 8 * 64, lambda qs: codec.scorer("cosine", qs), 10)
    # the score is the dot product of 64 signs
    return ranked(near, "score", 10).select("qid", "rank", "namespace", "id", ((64 - F.col("score")) / 2).cast("long").alias("distance"))


_BOUNDS = f"{_EL}, o AS (SELECT dim, v, row_number() OVER (PARTITION BY dim ORDER BY v) - 1 pos, count(*) OVER (PARTITION BY dim) n FROM x), w AS (SELECT dim, max(v) FILTER (WHERE pos = n // 4) q1, max(v) FILTER (WHERE pos = n // 2) q2, max(v) FILTER (WHERE pos = 3 * n // 4) q3 FROM o GROUP BY dim)"


@query(f"WITH {_BOUNDS} SELECT dim, round(q1, 6) AS q1, round(q2, 6) AS q2, round(q3, 6) AS q3 FROM w")
def two_bit_boundaries_query(spark, sf_dir):
    return two_bit_boundaries(dense_records(spark, sf_dir)).select(F.col("dim").cast("long").alias("dim"), *(F.round(q, 6).alias(q) for q in ("q1", "q2", "q3")))


@query(f"""WITH {_BOUNDS}, l AS (SELECT vec_id, vec_id // 5 g, list(CASE WHEN v <= q1 THEN 0 WHEN v <= q2 THEN 1 WHEN v <= q3 THEN 2 ELSE 3 END ORDER BY dim) lv FROM x JOIN w USING (dim) GROUP BY vec_id),
m AS (SELECT a.g qg, b.g, a.vec_id, max(list_sum(list_transform(list_zip(a.lv, b.lv), lambda p: p[1] * p[2]))) x FROM l a, l b WHERE a.g % 20 = 0 GROUP BY 1, 2, 3)
SELECT qid, rank, id, s AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) rank FROM (SELECT CAST(qg AS VARCHAR) qid, CAST(g AS VARCHAR) id, sum(x)::BIGINT s FROM m GROUP BY 1, 2)) WHERE rank <= 10""")
def two_bit_maxsim(spark, sf_dir):
    near = TokenIndex.build(_token_records(spark, sf_dir), "colbert").scores(_token_queries(spark, sf_dir), 10)
    return ranked(near, "score", 10).select("qid", "rank", "id", F.col("score").cast("long").alias("score"))


@query("""WITH x AS (SELECT CAST(label AS VARCHAR) ns, CAST(vec_id AS VARCHAR) id, CAST(embedding AS DOUBLE[]) v FROM embeddings), f AS (SELECT *, row_number() OVER (ORDER BY ns, id) - 1 c FROM x),
p AS (SELECT unnest(range(8)) p), d AS (SELECT x.id, p, f.c, list_sum(list_transform(list_zip(x.v[8 * p + 1:8 * p + 8], f.v[8 * p + 1:8 * p + 8]), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) d FROM x, f, p WHERE f.c < 16),
b AS (SELECT id, p, arg_min(c, (d, c)) c FROM d GROUP BY 1, 2) SELECT id, string_agg(c, ',' ORDER BY p) AS codes FROM b GROUP BY 1""")
def pq_assign(spark, sf_dir):
    """Codes of eight parts against the codebook that training starts from: the first 16 vectors in key order."""
    rows = dense_records(spark, sf_dir)
    first = np.array(rows.orderBy("namespace", "id").select("vector").limit(16).toArrow().column("vector").to_pylist(), dtype=np.float64)

    @F.pandas_udf("string")
    def assign(vectors: pd.Series) -> pd.Series:
        x = np.array(vectors.tolist(), dtype=np.float64)
        codes = np.stack([nearest(x[:, 8 * p : 8 * p + 8], first[:, 8 * p : 8 * p + 8]) for p in range(8)], axis=1)
        return pd.Series([",".join(map(str, c)) for c in codes])

    return rows.select("id", assign("vector").alias("codes"))


@query()
def pq_recall(spark, sf_dir):
    """Recall at 10 of each quantizer's rescored candidates against exact search; no SQL, as codebooks are fitted."""
    rows, asked = dense_records(spark, sf_dir), vector_queries(spark, sf_dir)
    exact = search(rows, asked, Options(namespace=None)).persist()
    said = [(m, round(recall(search_quantized(rows, asked, m), exact), 4)) for m in ("scalar", "binary", "product", "two_bit")]
    exact.unpersist()
    return spark.createDataFrame(said, "method string, recall double")


# ---- schemas and import


@query("""SELECT CAST(doc_id AS VARCHAR) AS id, array_to_string(list_sort(list_filter([CASE WHEN n_chars IS NOT NULL THEN 'n_chars: not string' END, 'tags[]: not string', 'unknown: unknown field'], lambda x: x IS NOT NULL AND x <> 'unknown: unknown field')), '; ') AS wrong FROM documents""")
def schema_violations(spark, sf_dir):
    schema = Schema({"lang": "string", "n_chars": "string", "ratio": "number", "opt": "integer", "author": {"name": "string", "level": "integer"}, "tags": "array<string>", "parts": "array<object>"})
    rows = metadata_records(spark, sf_dir).select("id", schema.violations(F.col("metadata")).alias("v"))
    return rows.select("id", F.array_join("v", "; ").alias("wrong"))


@query("""WITH s AS (SELECT CAST(event_id AS VARCHAR) id, CASE WHEN event_id % 4 = 0 THEN CAST(event_id AS VARCHAR) WHEN event_id % 4 = 1 THEN CAST(event_id AS VARCHAR) || '.25' WHEN event_id % 4 = 2 THEN event_type END f, event_id FROM events)
SELECT id, CASE WHEN event_id % 4 = 0 THEN 'BIGINT' WHEN event_id % 4 = 1 THEN 'DECIMAL' WHEN event_id % 4 = 2 THEN 'STRING' ELSE 'missing' END AS kind, f AS said FROM s WHERE event_id % 5 <> 0""")
def csv_import_types(spark, sf_dir):
    e = F.col("event_id")
    field = F.when(e % 4 == 0, e.cast("string")).when(e % 4 == 1, F.concat(e.cast("string"), F.lit(".25"))).when(e % 4 == 2, F.col("event_type"))
    rows = table(spark, sf_dir, "events").select(e.cast("string").alias("id"), F.when(e % 5 == 0, F.lit("oops")).otherwise(F.lit("[1, 2.5]")).alias("vector"), field.alias("f"))
    good, _ = csv_records(rows)
    kind = F.coalesce(F.regexp_extract(F.schema_of_variant(F.variant_get("metadata", "$.f", "variant")), "^[A-Z]+", 0), F.lit("missing"))
    return good.select("id", kind.alias("kind"), F.variant_get("metadata", "$.f", "string").alias("said"))


def _collection(spark, name: str, dimension: int, metric: str = "cosine") -> Collection:
    """A new collection in a folder that all executors see."""
    return Collection.create(spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", dimension, metric)


@query("SELECT lang AS namespace, CAST(doc_id AS VARCHAR) AS id, n_chars, source, CASE WHEN doc_id % 10 = 3 THEN 500.0 WHEN doc_id % 10 = 4 THEN 1000.0 WHEN doc_id % 10 = 5 THEN 2000.0 END AS expires_at FROM documents")
def jsonl_round_trip(spark, sf_dir):
    """Records written as JSON lines and read back."""
    path = f"{shared_folder(spark)}/jsonl-{uuid.uuid4().hex}"
    write_jsonl(_full_records(spark, sf_dir), path)
    return read_jsonl(spark, path).select("namespace", "id", F.variant_get("metadata", "$.n_chars", "bigint").alias("n_chars"), F.variant_get("metadata", "$.source", "string").alias("source"), "expires_at")


def stored_collection(spark, sf_dir) -> Collection:
    """The metadata records in a collection with payload columns, of which some are written, patched and deleted afterwards."""
    c = _collection(spark, "records", 1, "euclidean")
    c.bulk_ingest(_full_records(spark, sf_dir))
    c.create_index("n_chars", "numeric")
    c.create_index("lang", "keyword")
    c.apply(_op_log(spark, sf_dir))
    return c


@query(ORACLES["op_log_fold"].replace("SELECT h.namespace, h.id, v", "SELECT * FROM (SELECT h.namespace, h.id, v", 1) + ") WHERE n_chars >= 500 AND n_chars < 3000 AND (expires_at IS NULL OR expires_at > 1000)")
def collection_reads(spark, sf_dir):
    """A filtered listing of a stored collection: payload columns prune the base, its log is folded, expired rows are hidden."""
    rows = stored_collection(spark, sf_dir).list(None, {"n_chars": {"$gte": 500, "$lt": 3000}}, now=NOW)
    return rows.select("namespace", "id", F.col("vector")[0].cast("double").alias("v"), *(F.variant_get("metadata", f"$.{k}", "bigint").alias(k) for k in ("n_chars", "k0", "k1")), "expires_at")


@query()
def approximate_recall(spark, sf_dir):
    """Whether every approximate mode that a collection stores finds 0.9 of the exact neighbours at its defaults, after writes to it; no SQL, as codes and cells are fitted."""
    rows, asked = dense_records(spark, sf_dir).drop("vec_id"), vector_queries(spark, sf_dir)
    c = _collection(spark, "vectors", 64)
    c.bulk_ingest(rows.where("id % 17 != 0"))
    said = []
    exact = search(rows, asked, Options(namespace=None)).persist()
    for mode in ("scalar", "binary", "product", "two_bit", "default", "fast", "high_recall"):
        if mode in METHODS:
            c.enable_quantization(mode)
        else:
            c.disable_quantization()
            c.build_ann(mode)
        if mode == "scalar":
            c.upsert(rows.where("id % 17 = 0"))
        said.append((mode, recall(c.search(asked, Options(namespace=None)), exact) >= 0.9))
    exact.unpersist()
    return spark.createDataFrame(said, "mode string, enough boolean")


@query()
def bulk_ingest(spark, sf_dir):
    """Ingest of 5,000 vectors of 384 elements from arrays."""
    rng = np.random.default_rng(7)
    c = _collection(spark, "ingest", 384)
    c.bulk_ingest(from_arrays(spark, [str(i) for i in range(5000)], rng.standard_normal((5000, 384)).astype(np.float32)))
    return spark.createDataFrame([(len(c),)], "n bigint")


@query()
def text_index_build(spark, sf_dir):
    """A collection's stored text index: postings in ranges of terms, and their number."""
    c = _collection(spark, "texts", 64)
    c.bulk_ingest(_hybrid(spark, sf_dir).select("namespace", "id", "vector", "sparse"))
    c.build_text_index()
    return c._text_index().postings.agg(F.count("*").alias("postings"))


@query(_top("ds + bm", with_=_BM, source="h"))
def collection_hybrid(spark, sf_dir):
    """Hybrid search through a collection and its stored text index."""
    c = _collection(spark, "hybrid", 64)
    rows = hybrid_records(spark, sf_dir)
    c.bulk_ingest(rows.select("namespace", "id", "vector", "sparse"))
    c.build_text_index()
    return _result(c.search(hybrid_queries(rows), Options(namespace=None)))


def metric_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics as plain Column expressions between each row and its reverse."""
    v, w = F.col("vector"), F.reverse("vector")
    return dense_records(spark, sf_dir).select("id", *(F.round(metrics.score(m, v, w), 6).alias(m) for m in ("cosine", "dot", "euclidean", "manhattan")))


query("SELECT CAST(vec_id AS VARCHAR) AS id, round(list_cosine_similarity(v, list_reverse(v)), 6) AS cosine, round(list_inner_product(v, list_reverse(v)), 6) AS dot, round(0.0 - list_distance(v, list_reverse(v)), 6) AS euclidean, round(0.0 - list_sum(list_transform(list_zip(v, list_reverse(v)), lambda p: abs(p[1] - p[2]))), 6) AS manhattan FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) v FROM embeddings)")(metric_expressions)
