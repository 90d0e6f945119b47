"""Rerankers over the results of a search: Column scores, hooks per query, and their composition.

Results are rows (qid, rank, namespace, id, score, ...). A reranker adds rerank_score and renumbers rank by it, ties by the rank before.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens

Reranker = Callable[[DataFrame], DataFrame]


def _renumbered(df: DataFrame, score: Column) -> DataFrame:
    df = df.withColumn("rerank_score", score)
    order = Window.partitionBy("qid").orderBy(F.col("rerank_score").desc(), F.col("rank"))
    return df.withColumn("rank", F.row_number().over(order).cast("long"))


def _base() -> Column:
    return F.col("score")


def text_match(text: str = "text", title: str = "title", query: str = "query", body_weight: float = 1.0, title_weight: float = 1.5, term_weight: float = 0.25, phrase_weight: float = 1.0, matched: str = "matched", sparse: str = "sparse") -> Reranker:
    """Adds shares of the query's tokens that body and title have, the share of matched terms (of the column `matched` of an explained search, else of the body's), and a bonus if either has
    the whole phrase. Where there is no query text, its tokens are the keys of the column `sparse`, the query's term weights.
    """

    def rerank(df: DataFrame) -> DataFrame:
        said = tokens(F.col(query)) if query in df.columns else F.array().cast("array<string>")
        terms = F.coalesce(F.array_sort(F.map_keys(sparse)), F.array().cast("array<string>")) if sparse in df.columns else F.array().cast("array<string>")
        asked = F.array_distinct(F.when(F.size(said) > 0, said).otherwise(terms))
        share = lambda other: F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, other)) / F.size(asked)).otherwise(0.0)
        has = {name: F.coalesce(F.col(name), F.lit("")) for name in (text, title)}
        phrase = F.trim(F.lower(F.coalesce(F.col(query), F.lit("")))) if query in df.columns else F.lit("")
        inside = (phrase != "") & (F.contains(F.lower(has[text]), phrase) | F.contains(F.lower(has[title]), phrase))
        base = F.coalesce(F.col("rerank_score"), _base()) if "rerank_score" in df.columns else _base()
        out = base + body_weight * share(tokens(has[text])) + title_weight * share(tokens(has[title])) + F.when(inside, phrase_weight).otherwise(0.0)
        met = F.coalesce(F.col(matched), F.array().cast("array<string>")) if matched in df.columns else tokens(has[text])
        return _renumbered(df, out + term_weight * share(met))

    return rerank


def metadata_boost(field: Column, boosts: dict) -> Reranker:
    """Adds boosts[value of the field]; 0 for others."""

    def rerank(df: DataFrame) -> DataFrame:
        base = F.coalesce(F.col("rerank_score"), _base()) if "rerank_score" in df.columns else _base()
        bonus = F.lit(0.0)
        for value, boost in boosts.items():
            bonus = F.when(field == value, F.lit(float(boost))).otherwise(bonus)
        return _renumbered(df, base + bonus)

    return rerank


def compose(*rerankers: Reranker, mode: str = "sequential", rrf_k: int = 60) -> Reranker:
    """One after another, or by the sum of 1 / (rrf_k + rank) over all of them."""

    def rerank(df: DataFrame) -> DataFrame:
        if mode == "sequential":
            for r in rerankers:
                df = r(df)
            return df
        if mode != "rrf":
            raise ValueError(f"unknown mode {mode!r}")
        key = ["qid", "namespace", "id"]
        total = None
        for r in rerankers:
            part = r(df).select(*key, (1.0 / (max(1, rrf_k) + F.col("rank"))).alias("part"))
            total = part if total is None else total.unionByName(part)
        return _renumbered(df.join(total.groupBy(*key).agg(F.sum("part").alias("__rrf")), key), F.col("__rrf")).drop("__rrf")

    return rerank


def model(score: Callable[[list[str], list[str]], list[float]], query: str = "query", text: str = "text") -> Reranker:
    """Adds what any scorer (a cross-encoder, a bi-encoder, an ONNX session) gives for (query, text) pairs, a batch at a time; rows without a query keep their score."""

    @F.pandas_udf("double")
    def scored(asked: pd.Series, body: pd.Series) -> pd.Series:
        return pd.Series(score(asked.fillna("").tolist(), body.fillna("").tolist()), dtype=float)

    def rerank(df: DataFrame) -> DataFrame:
        base = F.coalesce(F.col("rerank_score"), _base()) if "rerank_score" in df.columns else _base()
        return _renumbered(df, base + F.when(F.col(query).isNotNull(), scored(query, text)).otherwise(0.0))

    return rerank


def hook(reorder: Callable[[str, list[dict]], list[dict]], rerank_k: int = 0) -> Reranker:
    """A function of a query id and its first rerank_k results (0: all) that returns some of them in a new order.

    What it returns twice counts once; what it leaves out follows in the order before. Results of one query are one group, of k rows at most.
    """

    def rerank(df: DataFrame) -> DataFrame:
        schema = df.schema

        def one(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("rank").reset_index(drop=True)
            rows = group.to_dict("records")
            first = rows[: rerank_k or len(rows)]
            place = {(r["namespace"], r["id"]): i for i, r in enumerate(rows)}
            said = [place[(r["namespace"], r["id"])] for r in reorder(str(group["qid"][0]), first) if (r["namespace"], r["id"]) in place]
            order = list(dict.fromkeys([*said, *range(len(rows))]))
            return group.iloc[order].assign(rank=range(1, len(rows) + 1))

        return df.groupBy("qid").applyInPandas(one, schema)

    return rerank
