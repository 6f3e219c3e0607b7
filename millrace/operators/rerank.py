"""Reranking by a scorer of (query, document) pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.text import tokenize
from millrace.plans.errors import RerankingError

BATCH = 32


def overlap_scorer(query: Column, document: Column) -> Column:
    """Share of the query's distinct words that the document holds; 0 for a query without words."""
    words = F.array_distinct(tokenize(query))
    return F.when(F.size(words) > 0, F.size(F.array_intersect(words, tokenize(document))) / F.size(words)).otherwise(0.0)


def model_scorer(score: Callable[[pd.Series, pd.Series], pd.Series], load: Callable[[], None] | None = None) -> Callable[[Column, Column], Column]:
    """A scorer from a function on batches of queries and documents; ``load`` runs once per worker task before it."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        if load is not None:
            load()
        for q, d in batches:
            parts = [score(q[a : a + BATCH], d[a : a + BATCH]) for a in range(0, len(q), BATCH)]
            yield pd.concat(parts) if parts else pd.Series([], dtype="float64")

    return F.pandas_udf(run, "double", F.PandasUDFType.SCALAR_ITER)


def from_lists(rows: DataFrame, query_id: str = "query_id", query: str = "query", documents: str = "documents", ids: str = "doc_ids") -> DataFrame:
    """Candidates for :func:`rerank` out of one row a query with parallel lists.

    Without ids (null) documents are named by their place, from 0; of unlike lists the shortest counts.
    """
    n = F.size(documents)
    named = F.coalesce(F.col(ids), F.transform(F.sequence(F.lit(0), n - 1), lambda i: i.cast("string")))
    pairs = F.slice(F.arrays_zip(named.alias("pos"), F.col(documents).alias("document")), 1, F.least(n, F.size(named)))
    listed = rows.where(n > 0).select(F.col(query_id).alias("query_id"), F.col(query).alias("query"), F.posexplode(pairs).alias("rank", "p"))
    return listed.select("query_id", "query", "rank", F.col("p.pos").alias("pos"), F.col("p.document").alias("document"))


def rerank(candidates: DataFrame, scorer: Callable[[Column, Column], Column] = overlap_scorer, top_k: int | None = None, query: str = "query", document: str = "document", order: str = "rank") -> DataFrame:
    """``candidates(query_id, pos, query, document, rank)`` as ``(query_id, pos, score, rank)`` by the scorer.

    Equal scores keep their order; ``top_k`` of None or 0 keeps all. Null queries and documents count as empty.
    """
    if top_k is not None and top_k < 0:
        raise RerankingError("top_k must not be negative")
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    scored = candidates.select("query_id", "pos", F.col(order).alias("__before"), scorer(empty(query), empty(document)).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "__before", "pos")
    ranked = scored.withColumn("rank", F.row_number().over(best)).select("query_id", "pos", "score", "rank")
    return ranked.where(F.col("rank") <= top_k) if top_k else ranked
