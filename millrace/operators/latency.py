"""Summaries of a latency log ``(operation_name, duration_ms)``; rows without a duration are left out."""

from __future__ import annotations

import contextlib
import time
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLOW_MS = 1000.0
#: Sums are taken in fixed-point numbers, so they do not depend on the order of addition.
MONEY = "decimal(24,4)"


def summary(log: DataFrame) -> DataFrame:
    """``operation_name, count, total_ms, average_ms, min_ms, max_ms``; a null name is a group of its own."""
    d = F.col("duration_ms")
    total = F.sum(d.cast(MONEY)).cast("double")
    return log.where(d.isNotNull()).groupBy("operation_name").agg(F.count("*").alias("count"), total.alias("total_ms"), F.round(total / F.count("*"), 6).alias("average_ms"), F.min(d).alias("min_ms"), F.max(d).alias("max_ms"))


def average(log: DataFrame, operation: str) -> DataFrame:
    """One row with the mean of one operation, null without rows."""
    d = F.col("duration_ms")
    return log.where(F.col("operation_name") == operation).agg(F.round(F.sum(d.cast(MONEY)).cast("double") / F.count(d), 6).alias("average_ms"))


def by_operation(log: DataFrame, operation: str) -> DataFrame:
    return log.where(F.col("operation_name") == operation)


def slow(log: DataFrame, limit_ms: float = SLOW_MS) -> DataFrame:
    return log.where(F.col("duration_ms") > limit_ms)


class Tracker:
    """Times blocks on the driver and gives the log as a DataFrame."""

    def __init__(self):
        self.metrics: list[tuple] = []

    @contextlib.contextmanager
    def track(self, operation: str, **metadata: str) -> Iterator[None]:
        start = time.perf_counter()
        try:
            yield
        finally:
            self.record(operation, (time.perf_counter() - start) * 1000, **metadata)

    def record(self, operation: str, duration_ms: float, **metadata: str) -> None:
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        self.metrics.append((operation, float(duration_ms), now, {k: str(v) for k, v in metadata.items()}))

    def clear(self) -> None:
        self.metrics.clear()

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.metrics, "operation_name string, duration_ms double, timestamp timestamp_ntz, metadata map<string,string>")
