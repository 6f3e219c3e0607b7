"""Contiguous row numbers without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.plans.runtime import checkpoint


def number_rows(df: DataFrame, order: list[str], name: str = "pos", start: int = 0) -> DataFrame:
    """``df`` with ``name``: start, start + 1, ... in the order of ``order``.

    The rows are range-partitioned and checkpointed, numbered within each partition, and shifted by the
    sizes of the partitions before (one row each). An empty input gives an empty result.
    """
    parts = checkpoint(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    within = parts.withColumn("__n", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = parts.groupBy("__part").count().withColumn("__shift", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    return within.join(F.broadcast(shift), "__part").withColumn(name, F.col("__shift") + F.col("__n") - 1 + start).drop("__part", "__n", "__shift")
