"""Documents to chunks by a sliding window of words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import chunk_id, split_words
from millrace.plans.errors import ChunkingError


def window_chunks(docs: DataFrame, document_id: str, text: str, size: int = 500, overlap: int = 50, least: int = 100) -> DataFrame:
    """``(document_id, chunk_index, total_chunks, chunk_id, token_count, text)``: windows of ``size`` words, ``overlap`` shared.

    A last window of fewer than ``least`` new words is joined to the one before. Blank texts have no chunk.
    """
    if not 0 <= overlap < size:
        raise ChunkingError("overlap must be smaller than size")
    step = size - overlap
    words = docs.select(F.col(document_id).alias("document_id"), split_words(F.coalesce(F.col(text), F.lit(""))).alias("w")).where(F.size("w") > 0)
    n = F.size("w")
    whole = F.greatest(F.lit(1), F.ceil((n - overlap) / step)).cast("int")
    rest = n - (whole - 1) * step - overlap
    count = F.when((whole > 1) & (rest < least), whole - 1).otherwise(whole)
    cut = words.withColumn("total_chunks", count).select("document_id", "w", "total_chunks", F.explode(F.sequence(F.lit(0), F.col("total_chunks") - 1)).alias("chunk_index"))
    length = F.when(F.col("chunk_index") == F.col("total_chunks") - 1, F.size("w")).otherwise(F.lit(size))
    part = F.slice("w", F.col("chunk_index") * step + 1, length)
    return cut.select("document_id", "chunk_index", "total_chunks", chunk_id(F.col("document_id").cast("string"), F.col("chunk_index")).alias("chunk_id"), F.size(part).alias("token_count"), F.array_join(part, " ").alias("text"))
