"""Exact vector search, and the table of vectors behind it.

Search reads the vectors once. The query vectors are a stated set: they are sent to the tasks in blocks of checked
size (``BLOCK_ROWS``), each task keeps the best ``k`` of every query while its vectors stream by (one matrix product
per batch), and only those rows are shuffled. More queries than a block take one pass over the vectors per block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace.operators.topk import ROWS, StreamTopK, few_tasks
from millrace.plans.errors import DenseRetrievalError, VectorStoreError

BLOCK_ROWS = 50_000
DIGITS = 9


def search(vectors: DataFrame, queries: DataFrame, pos: str, vector: str, query_id: str = "query_id", query_vector: str = "query_embedding", k: int = 10, threshold: float | None = None, dim: int = 64) -> DataFrame:
    """``(query_id, pos, score, rank)``: cosine similarity, the ``k`` best vectors of each query, then the threshold.

    Vectors and queries that are null or of another size are left out; zero vectors score 0. Equal scores (to nine
    digits) are in the order of ``pos``. The threshold is applied after the ranks are given.
    """
    if k < 0:
        raise DenseRetrievalError("k must not be negative")
    spark = vectors.sparkSession
    asked = queries.select(F.col(query_id).alias("q"), F.col(query_vector).cast("array<float>").alias("v")).where((F.size("v") == dim) & ~F.exists("v", lambda x: x.isNull()))

    def blocks() -> Iterator[list]:
        """The queries, fetched row by row; only one block is held."""
        held: list = []
        for r in asked.toLocalIterator():
            held.append((r["q"], np.asarray(r["v"], np.float64)))
            if len(held) == BLOCK_ROWS:
                yield held
                held = []
        yield held

    rows = vectors.select(F.col(pos).alias("pos"), F.col(vector).cast("array<float>").alias("v")).where((F.size("v") == dim) & ~F.exists("v", lambda x: x.isNull()))
    kinds = T.StructType([T.StructField("query_id", queries.schema[query_id].dataType), T.StructField("pos", vectors.schema[pos].dataType), T.StructField("score", T.DoubleType())])

    def one(block: list) -> DataFrame:
        ids = [q for q, _ in block]
        matrix = _unit(np.stack([v for _, v in block])) if block else np.zeros((0, dim))
        sent = spark.sparkContext.broadcast((ids, matrix))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, matrix = sent.value
            best = StreamTopK(len(ids), k)
            for batch in batches:
                for a in range(0, batch.num_rows, ROWS):
                    part = batch.slice(a, ROWS)
                    x = _unit(part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)).T
                    best.add(lambda i, j, x=x: np.rint(matrix[i:j] @ x * 10.0**DIGITS).astype(np.int64), np.array(part.column(0).to_pylist()))
            yield from best.rows(ids, kinds, 10.0**DIGITS)

        return few_tasks(rows).mapInArrow(run, kinds)

    found = reduce(DataFrame.unionByName, map(one, blocks()))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "pos")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked if threshold is None else ranked.where(F.col("score") >= threshold)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def add_vectors(store: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """``store`` with the rows of ``new(chunk_id, vec)`` at the positions that follow; an id that stands there already stays searchable."""
    from millrace.plans.numbering import number_rows

    if set(new.columns) < {"chunk_id", "vec"}:
        raise VectorStoreError("chunk_id and vec are needed")
    start = store.agg(F.coalesce(F.max("pos") + 1, F.lit(0))).first()[0]
    numbered = number_rows(new.select("chunk_id", "vec"), order, "pos", start)
    return store.select("chunk_id", "pos", "vec", "deleted").unionByName(numbered.select("chunk_id", "pos", "vec", F.lit(False).alias("deleted")))


def delete_chunks(store: DataFrame, ids: DataFrame) -> DataFrame:
    """Marks the newest vector of each given chunk as deleted; absent ids do nothing."""
    newest = store.where(~F.col("deleted")).groupBy("chunk_id").agg(F.max("pos").alias("pos"))
    gone = newest.join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi").select("pos", F.lit(True).alias("__gone"))
    return store.join(gone, "pos", "left").select("chunk_id", "pos", "vec", (F.col("deleted") | F.coalesce("__gone", F.lit(False))).alias("deleted"))


def search_store(store: DataFrame, queries: DataFrame, k: int = 10, threshold: float | None = None, compat_post_filter: bool = False, **names) -> DataFrame:
    """:func:`search` over a table with deletions; they are left out before the ranks, or after them as in stores that keep deleted vectors in their index."""
    if not compat_post_filter:
        return search(store.where(~F.col("deleted")), queries, "pos", "vec", k=k, threshold=threshold, **names)
    ranked = search(store, queries, "pos", "vec", k=k, threshold=threshold, **names)
    return ranked.join(store.where("deleted").select("pos"), "pos", "left_anti").select("query_id", "pos", "score", "rank")


def attach_metadata(entries: DataFrame, added: DataFrame, metadata: DataFrame) -> DataFrame:
    """The metadata entries ``(chunk_id, ...)`` with those of ``metadata`` whose chunk is among ``added``; they replace older ones."""
    fresh = metadata.join(added.select("chunk_id").distinct(), "chunk_id", "left_semi").select(*entries.columns)
    return entries.join(fresh.select("chunk_id"), "chunk_id", "left_anti").unionByName(fresh)


def store_stats(store: DataFrame, entries: DataFrame | None = None, path: str | None = None) -> DataFrame:
    """One row: vectors with the deleted ones, live chunks, the size of the vectors, metadata entries and the store's path."""
    counted = store.agg(F.count("*").alias("total_vectors"), F.count_distinct(F.when(~F.col("deleted"), F.col("chunk_id"))).alias("unique_chunks"), F.max(F.size("vec")).alias("dimension"))
    named = (entries.agg(F.count("*").alias("metadata_entries")) if entries is not None else store.sparkSession.range(1).select(F.lit(0).cast("long").alias("metadata_entries")))
    return counted.crossJoin(F.broadcast(named)).withColumn("index_path", F.lit(path).cast("string"))
