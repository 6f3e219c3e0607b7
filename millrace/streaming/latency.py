"""The latency summary over a stream of metrics."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import latency
from millrace.plans.runtime import shared_folder

SCHEMA = "metric_id long, operation_name string, duration_ms double, timestamp timestamp_ntz, metadata map<string,string>, received_at timestamp_ntz"


def read_metrics(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of the metric files under ``path``."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def running_summary(metrics: DataFrame) -> DataFrame:
    """The summary of all metrics so far (complete or update mode); the state is one row per operation."""
    return latency.summary(metrics)


def drain(summary: DataFrame, name: str) -> DataFrame:
    """Runs a summary over what the stream holds now and gives its table; the result is one row per operation."""
    spark = summary.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    checkpoint = f"{shared_folder(spark)}/millrace-{spark.sparkContext.applicationId}/{table}"
    query = summary.writeStream.outputMode("complete").format("memory").queryName(table).trigger(availableNow=True).option("checkpointLocation", checkpoint).start()
    query.awaitTermination()
    return spark.table(table)


def windowed_summary(metrics: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Summaries by operation and time window, each id counted once among those that come at most ``late`` after."""
    timed = metrics.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["metric_id"])
    d = F.col("duration_ms")
    return timed.where(d.isNotNull()).groupBy(F.window("timestamp", window), "operation_name").agg(F.count("*").alias("count"), F.sum(d).alias("total_ms"), F.min(d).alias("min_ms"), F.max(d).alias("max_ms"))
