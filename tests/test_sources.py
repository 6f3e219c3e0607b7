import json
import logging
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.plans import config, errors
from millrace.sources import embedding, logs, store
from millrace.streaming import latency as stream_latency
from millrace.streaming import ttl_cache


def test_vectors_round_trip(spark, tmp_path):
    path = str(tmp_path / "v")
    assert store.load_or_create(spark, path).count() == 0
    df = spark.createDataFrame([("a", 0, [1.0], False)], store.VECTORS)
    store.save(df, path)
    store.append(df, path)
    assert store.load_or_create(spark, path).count() == 2


def test_metadata_json(spark, tmp_path):
    p = tmp_path / "m.json"
    p.write_text(json.dumps({"c1": {"document_id": "d", "page": 2}, "c2": {"document_id": None, "page": None}}))
    kind = "document_id string, page int"
    assert {tuple(r) for r in store.load_metadata_json(spark, str(p), kind).collect()} == {("c1", "d", 2), ("c2", None, None)}
    assert store.load_metadata_json(spark, str(tmp_path / "none.json"), kind).count() == 0
    p.write_text("broken")
    assert store.load_metadata_json(spark, str(p), kind).count() == 0
    df = spark.createDataFrame([("c", datetime(2025, 1, 1))], "chunk_id string, at timestamp_ntz")
    store.save_metadata_json(df, str(tmp_path / "out"))
    for _ in range(3):  # written anew over itself
        store.save_metadata_json(df, str(tmp_path / "out"))
        assert [tuple(r) for r in store.load_metadata_json(spark, str(tmp_path / "out"), "at timestamp_ntz, none string").collect()] == [("c", datetime(2025, 1, 1), None)]
    p.write_text(json.dumps({"c1": {"document_id": "d", "page": 2}, "c2": {"document_id": None, "page": None}}, indent=2))
    assert {tuple(r) for r in store.load_metadata_json(spark, str(p), kind).collect()} == {("c1", "d", 2), ("c2", None, None)}


def test_replacing_keeps_the_old_until_the_new_is_whole(spark, tmp_path):
    path = str(tmp_path / "v")
    one, two = (spark.createDataFrame([(x, i, [1.0], False) for i in range(n)], store.VECTORS) for x, n in (("a", 1), ("b", 2)))
    store.save(one, path)
    reader = store.load_or_create(spark, path)

    def broken(to):
        two.write.parquet(to)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        store.replace(spark, path, broken)
    assert store.load_or_create(spark, path).count() == 1
    store.save(two, path)
    assert reader.count() == 1 and store.load_or_create(spark, path).count() == 2
    store.save(store.load_or_create(spark, path).unionByName(one), path)  # out of itself
    assert store.load_or_create(spark, path).count() == 3


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "b.txt").write_text("  ")
    assert {r.sha256 for r in store.file_hashes(spark, str(tmp_path)).collect()} >= {"2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824"}
    assert [(r.file_name, r.text_content) for r in store.load_documents(spark, str(tmp_path)).collect()] == [("a.txt", "hello")]


def test_cache_table(spark, tmp_path):
    c = store.CacheTable(spark, str(tmp_path / "cache"))
    keys = spark.createDataFrame([("k",), ("gone",)], "key string")
    c.put(spark.createDataFrame([("k", "1")], "key string, value string"), "embedding", 1000)
    c.put(spark.createDataFrame([("k", "2")], "key string, value string"), "embedding", 1000)
    c.put(spark.createDataFrame([("k", "x")], "key string, value string"), "context", -1)
    assert {tuple(r) for r in c.get(keys, "embedding").collect()} == {("k", "2"), ("gone", None)}
    assert {tuple(r) for r in c.get(keys, "context").collect()} == {("k", None), ("gone", None)}
    assert {tuple(r) for r in c.exists(keys, "embedding").collect()} == {("k", True), ("gone", False)}
    c.compact("context")
    c.compact("embedding")
    assert (c.rows("context").count(), c.rows("embedding").count()) == (0, 1)
    c.delete(keys, "embedding")
    assert not any(r.exists for r in c.exists(keys, "embedding").collect())
    c.put(spark.createDataFrame([("k", "3")], "key string, value string"), "embedding", 1000)
    assert {tuple(r) for r in c.get(keys, "embedding").collect()} == {("k", "3"), ("gone", None)}
    c.clear("embedding")
    assert c.rows("embedding").count() == 0


def test_embed(spark):
    df = spark.createDataFrame([(1, " ab "), (2, None), (3, " "), (4, "abc")], "i int, text string").coalesce(1)
    got = {r.i: r.embedding for r in embedding.embed(df, lambda ts: [[float(len(t))] for t in ts], batch=1).collect()}
    assert got == {1: [4.0], 2: None, 3: [1.0], 4: [3.0]}
    got = {r.i: r.embedding for r in embedding.embed(df, lambda ts: [[float(len(t))] for t in ts], batch=1, clean=True).collect()}
    assert got == {1: [2.0], 2: None, 3: None, 4: [3.0]}
    waits = []

    def fail(_):
        raise ValueError("x")

    with pytest.raises(errors.EmbeddingAPIError) as e:
        embedding.with_retries(fail, None, 3, waits.append)
    assert waits == [1, 2] and e.value.error_code == "EMBEDDING_API_ERROR"


def test_settings(tmp_path):
    (tmp_path / ".env").write_text("# c\nBM25_TOP_K = 7\nindex_dir='x'\n")
    s = config.load_settings({"RRF_CONSTANT": "10", "rrf_CONSTANT": "11"}, str(tmp_path / ".env"))
    assert (s.bm25_top_k, s.rrf_constant, s.index_dir, s.dense_top_k) == (7, 11, "x", 50)
    with pytest.raises(ValueError):
        config.load_settings({"dense_top_k": "many"}, None)


def test_logs(spark, tmp_path):
    path = tmp_path / "log"
    logger = logs.get_logger("t1", path=str(path))
    assert logs.get_logger("t1") is logger and len(logger.handlers) == 1
    logs.log(logger, logging.INFO, "hi", count=3, level="custom")
    line = json.loads(path.read_text())
    assert (line["message"], line["count"], line["level"], line["function"]) == ("hi", 3, "custom", "test_logs")
    try:
        raise KeyError("gone")
    except KeyError:
        logger.exception("failed 100%")
    with path.open("a") as f:
        f.write("no json\n")
    got = [(r.level, r.message, (r.exception or "").split("\n")[-1]) for r in logs.read_logs(spark, str(path)).orderBy("timestamp").collect()]
    assert got == [("custom", "hi", ""), ("ERROR", "failed 100%", "KeyError: 'gone'")]


def test_errors():
    assert issubclass(errors.BM25RetrievalError, errors.RetrievalError) and errors.EngineError("x").error_code == "UNKNOWN_ERROR"


def test_streams(spark, tmp_path):
    rows = [(1, "a", 2.0, datetime(2025, 1, 1)), (2, "a", 4.0, datetime(2025, 1, 1)), (3, None, 1.0, datetime(2025, 1, 1))]
    df = spark.createDataFrame(rows, "metric_id long, operation_name string, duration_ms double, timestamp timestamp_ntz").select("*", F.lit(None).cast("map<string,string>").alias("metadata"), F.col("timestamp").alias("received_at"))
    df.write.parquet(str(tmp_path / "log"))
    q = stream_latency.running_summary(stream_latency.read_metrics(spark, str(tmp_path / "log"))).writeStream.outputMode("complete").format("memory").queryName("summed").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination()
    assert {(r.operation_name, r.average_ms) for r in spark.table("summed").collect()} == {("a", 3.0), (None, 1.0)}
    w = stream_latency.windowed_summary(stream_latency.read_metrics(spark, str(tmp_path / "log"))).writeStream.outputMode("update").format("memory").queryName("windows").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    w.awaitTermination()
    assert {(r.operation_name, r["count"]) for r in spark.table("windows").collect()} == {("a", 2), (None, 1)}


def test_ttl_stream(spark, tmp_path):
    ops = [("k", datetime(2025, 1, 1, 0, 0, s), s, op) for s, op in ((1, "set"), (5, "get"), (20, "get"))]
    spark.createDataFrame(ops, "key string, ts timestamp, seq long, op string").write.parquet(str(tmp_path / "ops"))
    stream = spark.readStream.schema("key string, ts timestamp, seq long, op string").parquet(str(tmp_path / "ops"))
    q = ttl_cache.stream_hits(stream, 10).writeStream.outputMode("append").format("memory").queryName("hits").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert {(r.seq, r.hit) for r in spark.table("hits").collect()} == {(5, True), (20, False)}
