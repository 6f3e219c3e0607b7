"""Reading and writing of indexes, metadata, files and cached values."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

VECTORS = "chunk_id string, pos long, vec array<float>, deleted boolean"
#: Time to live that marks a deleted entry, and the file that names a table's version.
GONE, POINTER = -2_000_000_000, "CURRENT"
CACHE = "layer string, key string, value string, created_at timestamp_ntz, ttl_seconds int"


def _file_system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    place = hadoop.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current(spark: SparkSession, path: str) -> str:
    """The folder that holds the table at ``path`` now: the version its pointer names, or ``path`` itself without one."""
    pointer, fs = _file_system(spark, f"{path.rstrip('/')}/{POINTER}")
    if not fs.exists(pointer):
        return path
    stream = fs.open(pointer)
    try:
        return f"{path.rstrip('/')}/{spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, 'UTF-8').strip()}"
    finally:
        stream.close()


def replace(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Puts a new version in the place of the table at ``path``.

    ``write`` fills a new folder beside the versions before it; when it is complete the pointer is changed in one
    step. A failure at any point leaves the old version in use, and readers of it are not disturbed: the one before stays.
    """
    path = path.rstrip("/")
    before, name = current(spark, path), f"v-{uuid.uuid4().hex}"
    write(f"{path}/{name}")
    place, fs = _file_system(spark, path)
    fresh, pointer = (_file_system(spark, f"{path}/{x}")[0] for x in (f".{name}", POINTER))
    out = fs.create(fresh, True)
    out.write(bytearray(name.encode()))
    out.close()
    hadoop, gateway = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._gateway
    option = gateway.new_array(hadoop.Options.Rename, 1)
    option[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fresh, pointer, option)
    for status in fs.listStatus(place):
        old = status.getPath()
        if old.getName().lstrip(".").startswith("v-") and old.getName() not in (name, before.rsplit("/", 1)[-1]):
            fs.delete(old, True)


def load_or_create(spark: SparkSession, path: str, schema: str = VECTORS) -> DataFrame:
    """The table at ``path``, or an empty one of ``schema`` where none stands."""
    try:
        return spark.read.schema(schema).parquet(current(spark, path))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def save(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Replaces the table at ``path`` (see :func:`replace`)."""
    replace(df.sparkSession, path, lambda to: (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(to))


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(current(df.sparkSession, path))


def load_metadata_json(spark: SparkSession, path: str, record: str) -> DataFrame:
    """JSON objects keyed by chunk id as rows ``chunk_id, <record fields>``; a missing or broken file gives no rows.

    Read are files of one object a line, as :func:`save_metadata_json` writes them (by many tasks), and a file that is one
    object over many lines.
    """
    kind = T._parse_datatype_string(record)
    empty = spark.createDataFrame([], T.StructType([T.StructField("chunk_id", T.StringType()), *kind.fields]))
    keyed = F.from_json("value", T.MapType(T.StringType(), kind))
    try:
        place = current(spark, path)
        lines = spark.read.text(place)
        first = lines.where(F.length(F.trim("value")) > 0).select(keyed.alias("m")).first()
        text = lines if first is not None and first["m"] is not None else spark.read.text(place, wholetext=True)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return empty
    rows = text.select(F.explode(keyed).alias("chunk_id", "r"))
    return rows.select("chunk_id", *[F.col(f"r.{f.name}").alias(f.name) for f in kind.fields])


def save_metadata_json(df: DataFrame, path: str, key: str = "chunk_id") -> None:
    """One object a line, keyed by the chunk id, nulls kept, times as ISO texts; :func:`load_metadata_json` reads it back.

    Rows without an id are left out, as an object has no null key.
    """
    from millrace.operators.metadata import iso_record

    rest = [c for c in df.columns if c != key]
    record = F.struct(*[c for c in iso_record(df, rest)])
    lines = df.where(F.col(key).isNotNull()).select(F.to_json(F.create_map(F.col(key).cast("string"), record), {"ignoreNullFields": "false"}).alias("value"))
    replace(df.sparkSession, path, lines.write.text)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, sha256`` of every file under a path."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    """Text files as ``document_id, file_name, file_path, file_size_bytes, text_content``; blank files are left out."""
    files = spark.read.format("binaryFile").load(path)
    text = F.decode("content", "UTF-8")
    return files.where(F.length(F.trim(text)) > 0).select(F.concat(F.lit("doc_"), F.substring(F.sha2("content", 256), 1, 12)).alias("document_id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), F.col("path").alias("file_path"), F.col("length").alias("file_size_bytes"), text.alias("text_content"))


class CacheTable:
    """Cached values by layer and md5 of the key, each layer a table of its own; expired rows count as missing and go at :meth:`compact`.

    A layer has one writer at a time; layers do not touch each other.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _layer(self, layer: str) -> str:
        return f"{self.path}/{hashlib.md5(layer.encode()).hexdigest()}"

    def rows(self, layer: str) -> DataFrame:
        return load_or_create(self.spark, self._layer(layer), CACHE)

    def put(self, values: DataFrame, layer: str, ttl_seconds: int) -> None:
        """Appends ``values(key, value)``; the latest row of a key counts."""
        stamped = values.select(F.lit(layer).alias("layer"), F.md5("key").alias("key"), "value", F.current_timestamp().cast("timestamp_ntz").alias("created_at"), F.lit(ttl_seconds).alias("ttl_seconds"))
        append(stamped, self._layer(layer))

    def delete(self, keys: DataFrame, layer: str) -> None:
        """Marks ``keys(key)`` as gone; absent keys do nothing."""
        self.put(keys.select("key", F.lit(None).cast("string").alias("value")), layer, GONE)

    def clear(self, layer: str) -> None:
        """Leaves the layer empty."""
        save(self.spark.createDataFrame([], CACHE), self._layer(layer))

    def live(self, layer: str) -> DataFrame:
        """``(key, value)`` of the entries that are not expired; ``key`` is the md5."""
        latest = self.rows(layer).groupBy("key").agg(F.max_by(F.struct("value", "created_at", "ttl_seconds"), "created_at").alias("r"))
        age = F.unix_micros(F.current_timestamp()) - F.unix_micros(F.col("r.created_at").cast("timestamp"))
        return latest.where((F.col("r.ttl_seconds") != GONE) & (age <= F.col("r.ttl_seconds") * F.lit(1_000_000))).select("key", F.col("r.value").alias("value"))

    def get(self, keys: DataFrame, layer: str) -> DataFrame:
        """``key, value`` of the given keys, null where nothing live stands."""
        return keys.select("key", F.md5("key").alias("__k")).join(self.live(layer).withColumnRenamed("key", "__k"), "__k", "left").select("key", "value")

    def exists(self, keys: DataFrame, layer: str) -> DataFrame:
        """``key, exists`` of the given keys."""
        live = self.live(layer).select(F.col("key").alias("__k"), F.lit(True).alias("__live"))
        return keys.select("key", F.md5("key").alias("__k")).join(live, "__k", "left").select("key", F.coalesce("__live", F.lit(False)).alias("exists"))

    def compact(self, layer: str) -> None:
        """Puts the layer's live rows in the place of all its rows."""
        rows = self.rows(layer)
        latest = rows.groupBy("key").agg(F.max("created_at").alias("created_at"))
        save(rows.join(latest, ["key", "created_at"], "left_semi").join(self.live(layer).select("key"), "key", "left_semi"), self._layer(layer))
