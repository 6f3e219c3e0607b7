"""The metadata table of chunks: a record per chunk id, last write wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(df: DataFrame, key: str, seq: str, columns: list[str]) -> DataFrame:
    """One row per key: that of the greatest ``seq`` (of equal ones the greatest row), whole records."""
    return df.groupBy(key).agg(F.max(F.struct(seq, *[c for c in columns if c != seq])).alias("__r")).select(key, *[F.col(f"__r.{c}").alias(c) for c in columns])


def merge(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the records of ``new`` put in their place; ``new`` has each key once."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new.select(*old.columns))


def filter_equal(df: DataFrame, column: str, value) -> DataFrame:
    """Rows whose column equals the value, exactly; None finds nulls."""
    return df.where(F.col(column).eqNullSafe(F.lit(value) if not isinstance(value, Column) else value))


def lookup(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The record of each key, nulls where there is none."""
    return keys.select(key).join(df, key, "left")


def delete(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Without the given keys; absent keys do nothing."""
    return df.join(keys.select(key).distinct(), key, "left_anti")


def delete_equal(df: DataFrame, column: str, value) -> DataFrame:
    """Without the rows that :func:`filter_equal` finds."""
    return df.where(~F.col(column).eqNullSafe(F.lit(value) if not isinstance(value, Column) else value))


def stats(df: DataFrame, document: str = "document_id", language: str = "language") -> DataFrame:
    """One row: chunks, documents (null is one) and the sorted languages (null last, as null)."""
    none = lambda c: F.max(F.col(c).isNull().cast("int"))
    languages = F.sort_array(F.collect_set(language))
    return df.agg(
        F.count("*").alias("total_chunks"),
        (F.count_distinct(document) + F.coalesce(none(document), F.lit(0))).alias("unique_documents"),
        F.when(none(language) == 1, F.concat(languages, F.array(F.lit(None).cast("string")))).otherwise(languages).alias("languages"),
    )


def citation_fields(df: DataFrame) -> DataFrame:
    return df.select("document_name", "page", "section", "subsection", "chunk_id", "title")


def iso_record(df: DataFrame, columns: list[str]) -> list[Column]:
    """The columns of a record, times as ISO texts, all else as it stands."""
    from millrace.functions.text import iso

    kinds = dict(df.dtypes)
    return [iso(F.col(c)).alias(c) if kinds[c].startswith("timestamp") else F.col(c) for c in columns]


# Fields of the records as they leave the engine, in order.
RECORDS = {
    "chunk": ("document_id", "document_name", "chunk_id", "page", "chapter", "section", "subsection", "title", "chunk_index", "total_chunks", "source_type", "language", "ocr_used", "ocr_confidence", "table_id", "figure_id", "related_chunks", "parent_chunk_id", "token_count", "character_count", "embedding_model", "embedding_version", "ingestion_timestamp", "last_updated", "custom_metadata"),
    "document": ("document_id", "document_name", "file_path", "file_size_mb", "page_count", "language", "ingestion_timestamp", "chunk_count", "total_tokens", "source_type", "encoding", "custom_metadata"),
    "answer": ("answer", "citations", "query", "query_id", "answer_id", "timestamp", "retrieval_latency_ms", "generation_latency_ms", "total_latency_ms", "context_chunks_count", "context_tokens_count", "confidence_score", "has_sufficient_context"),
    "query": ("query", "query_id", "timestamp", "user_id", "session_id", "metadata"),
    "metric": ("operation_name", "duration_ms", "timestamp", "metadata"),
}


def records(df: DataFrame, kind: str) -> DataFrame:
    """The fields of a record of one ``kind``, times as ISO texts; fields that the table lacks are left out."""
    return df.select(*iso_record(df, [c for c in RECORDS[kind] if c in df.columns]))


def record_json(df: DataFrame) -> DataFrame:
    """Every record as JSON with ISO times; nulls are kept."""
    return df.select(F.to_json(F.struct(*iso_record(df, df.columns)), {"ignoreNullFields": "false"}).alias("record"))


def mark_indexed(df: DataFrame, ids: DataFrame, key: str = "document_id", flag: str = "is_indexed") -> DataFrame:
    """``df`` with the flag set for the given ids; other rows keep theirs (false where they have none)."""
    marked = ids.select(key).where(F.col(key).isNotNull()).distinct().withColumn("__marked", F.lit(True))
    before = F.col(flag) if flag in df.columns else F.lit(False)
    joined = df.join(marked, key, "left")
    return joined.withColumn(flag, F.coalesce("__marked", before, F.lit(False))).drop("__marked")


def dedup_by_content(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(content_hash, key, copies)``: texts once, with the smallest key; null texts are one text."""
    return df.groupBy(F.sha2(F.col(text), 256).alias("content_hash")).agg(F.min(key).alias(key), F.count("*").alias("copies"))
