"""Queries of the training-data operators, named after their problem."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.runtime import checkpoint, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from millrace.llm.pairs import broken_pairs

    return broken_pairs(table(spark, d, "answers"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from millrace.llm.neighbors import mutual_pairs

    return mutual_pairs(table(spark, d, "chunks"), "chunk_id", "embedding", k=10, min_cosine=0.9, dim=64)


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of each operation by day, and of all its days (null day), merged from the days' summaries."""
    from millrace.llm.quantiles import EPSILON, merge_summaries, once, percentiles, summarize, tuples

    log = table(spark, d, "latency_metrics").withColumn("day", F.to_date("timestamp"))
    rows = once(log, "metric_id", ["operation_name", "day", "duration_ms"])
    days = checkpoint(summarize(rows, "duration_ms", ["operation_name", "day"]))
    total = merge_summaries(days, ["operation_name"], tuples(EPSILON)).withColumn("day", F.lit(None).cast("date"))
    return percentiles(days.unionByName(total), ["operation_name", "day"])


def p3_operations(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of each operation over the whole log, summarised without a division by days."""
    from millrace.llm.quantiles import once, percentiles, summarize

    rows = once(table(spark, d, "latency_metrics"), "metric_id", ["operation_name", "duration_ms"])
    return percentiles(summarize(rows, "duration_ms", ["operation_name"]), ["operation_name"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from millrace.llm.language import label_issues

    return label_issues(table(spark, d, "chunks"), table(spark, d, "document_metadata"), table(spark, d, "lang_samples"))


def p4_languages(spark: SparkSession, d: str) -> DataFrame:
    """Language, confidence and passages of every chunk."""
    from millrace.llm.language import chunk_languages, fit

    return chunk_languages(table(spark, d, "chunks"), fit(table(spark, d, "lang_samples"))).select("chunk_id", "language", "confidence", "passages")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from millrace.llm.ocr import find_noise

    return find_noise(table(spark, d, "chunks"))


def p5_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk's text in its repaired form."""
    from millrace.llm.ocr import repair

    return repair(table(spark, d, "chunks"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    from millrace.llm.encode import encode_corpus

    return encode_corpus(table(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    from millrace.llm.leakage import leaks

    return leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    from millrace.llm.lookalike import same_look_pairs

    return same_look_pairs(table(spark, d, "documents"))


def p8_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every document that looks like another stored text, with its class and the number of its links."""
    from millrace.llm.lookalike import same_look_classes

    return same_look_classes(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p2_found, p3_percentiles, p3_operations, p4_found, p4_languages, p5_found, p5_repaired, p6_ids, p7_found, p8_found, p8_classes)}


#: Every pair of vectors compared; the small tables allow it, and the approximate search finds the same pairs there.
_P2 = """WITH v AS (SELECT chunk_id, any_value(CAST(embedding AS DOUBLE[])) AS v FROM chunks WHERE len(embedding) = 64 AND chunk_id IS NOT NULL GROUP BY chunk_id),
u AS (SELECT chunk_id, v, sqrt(list_inner_product(v, v)) AS n FROM v WHERE list_inner_product(v, v) > 0),
s AS (SELECT a.chunk_id AS x, b.chunk_id AS y, list_inner_product(a.v, b.v) / (a.n * b.n) AS c FROM u a JOIN u b ON a.chunk_id <> b.chunk_id),
r AS (SELECT x, y FROM s WHERE c >= 0.9 QUALIFY row_number() OVER (PARTITION BY x ORDER BY c DESC, y) <= 10)
SELECT a.x AS chunk_id_a, a.y AS chunk_id_b FROM r a JOIN r b ON a.x = b.y AND a.y = b.x WHERE a.x < a.y"""


def oracle_sql() -> dict[str, str]:
    return {"p2_found": _P2}
