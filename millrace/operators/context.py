"""Contexts and prompts out of ranked chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import citations as C


def context_blocks(ranked: DataFrame, chunks: DataFrame, query_id: str = "query_id", chunk_id: str = "chunk_id", rank: str = "rank", limit: int | None = None) -> DataFrame:
    """``(query_id, context)`` out of ``ranked(query_id, chunk_id, rank)`` and the chunks' records; unknown chunks are left out.

    ``limit`` bounds the sources of a query; without it the caller has limited the ranks.
    """
    rows = ranked.where(F.col(rank) <= limit) if limit is not None else ranked
    joined = rows.select(query_id, F.col(chunk_id).alias("__c"), F.col(rank).alias("__rank")).join(chunks.select(F.col("chunk_id").alias("__c"), "text", "document_name", "page", "section"), "__c")
    listed = joined.groupBy(query_id).agg(F.array_sort(F.collect_list(F.struct("__rank", "__c", "text", "document_name", "page", "section"))).alias("s"))
    source = lambda x, i: C.context_source(i + 1, x["text"], x["document_name"], x["page"], x["section"])
    return listed.select(query_id, F.array_join(F.transform("s", source), "\n\n").alias("context"))


def prompts(queries: DataFrame, contexts: DataFrame, query_id: str = "query_id", query: str = "query") -> DataFrame:
    """``(query_id, prompt)``; queries without a context say so."""
    return queries.select(query_id, query).join(contexts, query_id, "left").select(query_id, C.answer_prompt(F.col(query), F.coalesce("context", F.lit(C.NO_CONTEXT))).alias("prompt"))
