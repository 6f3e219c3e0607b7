"""Reciprocal-rank fusion and hybrid search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators import bm25, dense, scan
from millrace.plans.errors import BM25RetrievalError, DenseRetrievalError, RetrievalError

CONSTANT = 60


def rrf_score(rank: Column, constant: int = CONSTANT) -> Column:
    return F.lit(1.0) / (F.lit(constant) + rank)


def rrf(lists: list[DataFrame], constant: int = CONSTANT, k: int | None = None) -> DataFrame:
    """``(query_id, pos, score, rank)`` of ranked lists ``(query_id, pos, rank)``, best first.

    Scores of one id are added, twice within one list too. Equal scores are in the order of the first list that
    holds them, by their rank there. One shuffle by query and id, with partial sums before it.
    """
    if not lists:
        raise RetrievalError("no lists to fuse")
    tagged = [x.select("query_id", "pos", "rank", F.lit(i).alias("list")) for i, x in enumerate(lists)]
    both = reduce(DataFrame.unionByName, tagged)
    # ranks of the lists side by side: sums of few fixed terms in a fixed order
    per = [F.sum(F.when(F.col("list") == i, rrf_score(F.col("rank"), constant))).alias(f"s{i}") for i in range(len(lists))]
    first = [F.min(F.when(F.col("list") == i, F.col("rank"))).alias(f"r{i}") for i in range(len(lists))]
    summed = both.groupBy("query_id", "pos").agg(*per, *first)
    score = reduce(lambda a, b: a + b, [F.coalesce(F.col(f"s{i}"), F.lit(0.0)) for i in range(len(lists))])
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *[F.asc_nulls_last(f"r{i}") for i in range(len(lists))])
    ranked = summed.withColumn("score", score).withColumn("rank", F.row_number().over(order)).select("query_id", "pos", "score", "rank")
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def hybrid(index: bm25.BM25Index, vectors: DataFrame, queries: DataFrame, pos: str, vector: str, k: int = 30, threshold: float | None = None, dense_k: int = 50, bm25_k: int = 50, constant: int = CONSTANT, query_id: str = "query_id", text: str = "query", query_vector: str = "query_embedding", dim: int = 64, docs_text: str | None = None) -> DataFrame:
    """Both rankings of each query, fused: vectors first, so their order decides ties.

    With ``docs_text`` (the column of ``vectors`` that holds the text, or its words) all is done in one scan (``scan.py``), for many queries.
    """
    if k < 0:
        raise RetrievalError("k must not be negative")
    if docs_text is not None:
        if dense_k < 0:
            raise DenseRetrievalError("k must not be negative")
        if bm25_k < 0:
            raise BM25RetrievalError("k must not be negative")
        return scan.hybrid(index, vectors, queries, pos, vector, docs_text, query_id, text, query_vector, k, dense_k, bm25_k, threshold, constant, dim)
    near = dense.search(vectors, queries, pos, vector, query_id, query_vector, dense_k, threshold, dim)
    return rrf([near, bm25.topk(index, queries, query_id, text, bm25_k)], constant, k)
