"""Session helpers: table loading, durable checkpoints and partition counts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``directory`` (a file or a folder of files)."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: what the session names in ``spark.checkpoint.dir``.

    Only where that is unset and the session is purely local (tests) a temporary folder is used; on a
    cluster without the setting the call fails rather than write to one machine's disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="millrace-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return _local[0]


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` computed once, written to the shared folder, and read back: a cut lineage that survives lost executors.

    Unlike ``DataFrame.checkpoint`` it computes the last stage once, is compressed, and lets the planner know its size.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/millrace-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_checkpoints(spark: SparkSession) -> None:
    """Deletes what this application has written to the shared folder; results that still read it must be done."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(f"{shared_folder(spark)}/millrace-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it is small and comes from fewer files than there are cores.

    Work per row on a table of one file would run in one task. Larger tables are split by the scan and left alone.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().optimizedPlan()
    part = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    if int(str(plan.stats().sizeInBytes())) > cores * part:
        return df
    files = len(df.inputFiles())
    return df.repartition(cores) if 0 < files < cores else df


def shuffle_partitions(spark: SparkSession) -> int:
    """Number of shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
