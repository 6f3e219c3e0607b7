import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.operators import bm25, cache, dense, documents, fusion, latency, metadata, queryproc, rerank
from millrace.plans import errors, numbering, runtime


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(0, "raw milk kept cold"), (1, "cold cold milk"), (2, None), (3, "rice"), (4, "raw milk kept cold"), (5, "...")]
    return spark.createDataFrame(rows, "pos long, text string")


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([("a", "cold milk"), ("b", "milk milk rice"), ("c", "unknownword"), ("d", "?!"), ("e", None)], "query_id string, query string")


def model(rows, query, k):
    toks = [(p, (t or "").replace(".", "").split()) for p, t in rows]
    n, avgdl = len(toks), sum(len(w) for _, w in toks) / len(toks)
    df = {t: sum(t in w for _, w in toks) for _, w in toks for t in w}
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: 0.25 * mean if v < 0 else v for t, v in raw.items()}
    score = {p: sum(idf.get(t, 0) * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / avgdl)) for t in query.split()) for p, w in toks}
    return sorted(score, key=lambda p: (-round(score[p], 7), p))[:k]


@pytest.mark.parametrize("k", [0, 1, 3, 10])
def test_bm25(spark, docs, asked, k):
    index = bm25.build(docs, "pos", "text")
    joined = {(r.query_id, r["rank"]): (r.pos, round(r.score, 8)) for r in bm25.topk(index, asked, k=k).collect()}
    scanned = {(r.query_id, r["rank"]): (r.pos, round(r.score, 8)) for r in bm25.topk_scan(index, docs, asked, "pos", "text", k=k).collect()}
    assert joined == scanned
    rows = [tuple(r) for r in docs.collect()]
    for q, text in (("a", "cold milk"), ("b", "milk milk rice"), ("c", "unknownword")):
        assert [joined[q, i + 1][0] for i in range(min(k, 6))] == model(rows, text, k)
    assert not any(q in "de" for q, _ in joined)


def test_bm25_reads_the_postings_of_its_words_only(spark, docs, asked):
    """The words reach the scan of the postings, and these are not shuffled to meet them."""
    plan = bm25.scores(bm25.build(docs, "pos", "text"), asked, "query_id", "query")._jdf.queryExecution().executedPlan().toString()
    postings = next(line for line in plan.split("\n") if "FileScan" in line and "tf" in line)
    assert "PushedFilters: [" in postings and "In(term" in postings
    exchanges = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert all("query_id" in line for line in exchanges if "pos" in line) and "SortMergeJoin" not in plan.split("FileScan")[0]


def test_bm25_saved(spark, docs, asked, tmp_path):
    index = bm25.build(docs, "pos", "text")
    index.save(str(tmp_path / "ix"))
    again = bm25.BM25Index.load(spark, str(tmp_path / "ix"))
    assert sorted(map(tuple, bm25.topk(again, asked, k=3).collect())) == sorted(map(tuple, bm25.topk(index, asked, k=3).collect()))
    with pytest.raises(errors.BM25RetrievalError):
        bm25.topk(index, asked, k=-1)


def test_dense(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [2.0, 2.0]), (3, [1.0, 1.0]), (4, None), (5, [1.0]), (6, [None, 1.0])], "pos int, vec array<float>")
    q = spark.createDataFrame([("x", [1.0, 1.0]), ("y", [0.0, 0.0]), ("z", None)], "query_id string, query_embedding array<float>")
    got = [(r.query_id, r.pos, round(r.score, 6), r["rank"]) for r in dense.search(v, q, "pos", "vec", k=3, dim=2).orderBy("query_id", "rank").collect()]
    assert got == [("x", 2, 1.0, 1), ("x", 3, 1.0, 2), ("x", 0, 0.707107, 3), ("y", 0, 0.0, 1), ("y", 1, 0.0, 2), ("y", 2, 0.0, 3)]
    assert dense.search(v, q, "pos", "vec", k=3, dim=2, threshold=0.9).count() == 2
    assert dense.search(v.limit(0), q, "pos", "vec", k=3, dim=2).count() == 0
    assert dense.search(v, q.limit(0), "pos", "vec", k=3, dim=2).count() == 0


def test_store(spark):
    empty = spark.createDataFrame([], "chunk_id string, pos long, vec array<float>, deleted boolean")
    one = dense.add_vectors(empty, spark.createDataFrame([("b", [1.0, 0.0]), ("a", [0.0, 1.0])], "chunk_id string, vec array<float>"), ["chunk_id"])
    two = runtime.checkpoint(dense.add_vectors(one, spark.createDataFrame([("a", [1.0, 1.0])], "chunk_id string, vec array<float>"), ["chunk_id"]))
    assert sorted((r.chunk_id, r.pos) for r in two.collect()) == [("a", 0), ("a", 2), ("b", 1)]
    gone = dense.delete_chunks(two, spark.createDataFrame([("a",), ("nobody",)], "chunk_id string"))
    assert {(r.pos, r.deleted) for r in gone.collect()} == {(0, False), (1, False), (2, True)}
    q = spark.createDataFrame([("q", [1.0, 1.0])], "query_id string, query_embedding array<float>")
    assert dense.search_store(gone, q, k=2, dim=2).count() == 2
    assert dense.search_store(gone, q, k=2, dim=2, compat_post_filter=True).count() == 1
    assert dense.store_stats(gone).first()["total_vectors"] == 3


def test_rrf(spark):
    a = spark.createDataFrame([("q", 1, 1), ("q", 2, 2), ("q", 7, 3), ("q", 7, 4)], "query_id string, pos int, rank int")
    b = spark.createDataFrame([("q", 2, 1), ("q", 1, 2), ("q", 9, 3)], "query_id string, pos int, rank int")
    got = [(r.pos, round(r.score, 9), r["rank"]) for r in fusion.rrf([a, b]).orderBy("rank").collect()]
    both = round(1 / 61 + 1 / 62, 9)
    assert got == [(1, both, 1), (2, both, 2), (7, round(1 / 63 + 1 / 64, 9), 3), (9, round(1 / 63, 9), 4)]
    assert fusion.rrf([a, b.limit(0)], k=2).count() == 2
    assert max(r.score for r in fusion.rrf([b, b.where("pos = 0")]).collect()) <= 2 / 61


def test_rerank(spark):
    c = spark.createDataFrame([("q", i, "raw milk", d, i + 1) for i, d in enumerate(["rice", "milk", None, "milk raw", "milk"])], "query_id string, pos int, query string, document string, rank int")
    order = lambda **o: [r.pos for r in rerank.rerank(c, **o).orderBy("rank").collect()]
    assert order() == [3, 1, 4, 0, 2] and order(top_k=0) == order() and order(top_k=2) == [3, 1]
    scorer = rerank.model_scorer(lambda q, d: d.str.len().astype("float64"))
    assert order(scorer=scorer, top_k=1) == [3]
    with pytest.raises(errors.RerankingError):
        rerank.rerank(c, top_k=-1)


def test_lists_of_unlike_length(spark):
    rows = spark.createDataFrame([("a", "milk", ["milk", "rice"], None), ("b", "rice", ["milk", "rice", "x"], ["m", "r"]), ("c", "x", [], ["y"]), ("d", "x", None, None)], "query_id string, query string, documents array<string>, doc_ids array<string>")
    got = [(r.query_id, r.pos, r.score) for r in rerank.rerank(rerank.from_lists(rows)).orderBy("query_id", "rank").collect()]
    assert got == [("a", "0", 1.0), ("a", "1", 0.0), ("b", "r", 1.0), ("b", "m", 0.0)]


def test_marks_and_metadata_of_vectors(spark):
    docs = spark.createDataFrame([("a", True), ("b", None), ("c", False), (None, False)], "document_id string, is_indexed boolean")
    ids = spark.createDataFrame([("b",), ("b",), ("x",), (None,)], "document_id string")
    assert {r.document_id: r.is_indexed for r in metadata.mark_indexed(docs, ids).collect()} == {"a": True, "b": True, "c": False, None: False}
    entries = spark.createDataFrame([("c1", 1), ("c2", 1)], "chunk_id string, page int")
    added, given = spark.createDataFrame([("c2",), ("c3",)], "chunk_id string"), spark.createDataFrame([("c2", 2), ("c9", 2)], "chunk_id string, page int")
    assert sorted(map(tuple, dense.attach_metadata(entries, added, given).collect())) == [("c1", 1), ("c2", 2)]


def test_cache_clear_and_exists(spark):
    at = lambda s: datetime(2025, 1, 1) + timedelta(seconds=s)
    ops = spark.createDataFrame([("a", at(0), 0, "set"), ("a", at(1), 1, "get"), ("a", at(2), 2, "clear"), ("a", at(3), 3, "get"), ("b", at(700), 4, "set"), ("b", at(1400), 5, "get"), ("c", at(1401), 6, "set"), ("c", at(1402), 7, "delete")], "key string, ts timestamp, seq long, op string")
    s = cache.stats(cache.since_clear(ops), 800).first()
    assert (s.hits, s.misses, s.size) == (1, 1, 1)
    assert {r.key: r.exists for r in cache.exists(ops, 800, F.lit(at(1600))).collect()} == {"a": False, "b": False, "c": False}
    assert {r.key: r.exists for r in cache.exists(ops, 900, F.lit(at(1600))).collect()} == {"a": False, "b": True, "c": False}


def test_route(spark):
    cases = {"HACCP what is": "hybrid", "what is rice": "dense", "whyever": "dense", "a and b and c and d": "bm25", "a and b or c": "x", 'say "rice"': "bm25", "rice": "x", "cross-contamination": "hybrid"}
    df = spark.createDataFrame([(k,) for k in cases], "q string")
    assert {r.q: r.r for r in df.select("q", queryproc.route(F.col("q"), "x").alias("r")).collect()} == cases


def test_expand(spark):
    df = spark.createDataFrame([(1, "How to show what?"), (2, "how now"), (3, "rice!")], "query_id int, query string")
    got = {r.query_id: r.expanded for r in queryproc.expand(df).collect()}
    assert got[1] == ["How to show what?", "How to swhat is the method for what".replace("swhat is the method for", "swhat is the method for"), "How to show explain"]
    assert got[2] == ["how now?", "what is the method for now"] and got[3] == ["rice?"]
    assert [r.expanded for r in queryproc.expand(df, n=0).collect()] == [[], [], []]
    u = [r.query for r in queryproc.unique_queries(queryproc.expand(df)).where("query_id = 2").orderBy("ord").collect()]
    assert u == ["how now", "how now?", "what is the method for now"]


def test_model_expand(spark):
    df = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "fail")], "query_id int, query string")

    def ask(t):
        if t == "fail":
            raise RuntimeError
        return '["a", null, " b "]' if t == "good" else "no list"

    got = {r.query_id: (r.expanded, r.method) for r in queryproc.expand(df, model=ask).collect()}
    assert got == {1: (["a", "b"], "llm"), 2: (["bad?"], "llm"), 3: ([], "fallback")}


@pytest.mark.parametrize(("text", "want"), [('["a", 1, null, "", {"x": 1}, true]', ["a", "1", "{'x': 1}", "True"]), ("x [1] y [2] z", None), ('```\n["a",\n"b"]\n```', ["a", "b"]), ("none", None), (None, None)])
def test_parse(text, want):
    assert queryproc.parse_array(text) == want


def test_metadata(spark):
    t = spark.createDataFrame([("a", 1, "d1", "en"), ("a", 2, "d2", None), ("b", 1, None, "fr")], "k string, seq int, document_id string, language string")
    m = metadata.upsert(t, "k", "seq", ["document_id", "language"])
    assert {tuple(r) for r in m.collect()} == {("a", "d2", None), ("b", None, "fr")}
    s = metadata.stats(m).first()
    assert (s.total_chunks, s.unique_documents, s.languages) == (2, 2, ["fr", None])
    assert metadata.stats(m.limit(0)).first().unique_documents == 0
    assert metadata.filter_equal(m, "language", None).count() == 1
    assert metadata.delete_equal(m, "document_id", "d2").count() == 1
    assert metadata.delete(m, spark.createDataFrame([("zz",), ("a",)], "k string"), "k").count() == 1
    assert metadata.merge(m, spark.createDataFrame([("b", "d9", "de")], m.schema), "k").where("document_id = 'd9'").count() == 1


def test_cache(spark):
    t0 = datetime(2025, 1, 1, 23, 59, 50)
    ops = [("k", 0, "get"), ("k", 1, "set"), ("k", 11, "get"), ("k", 12, "get"), ("k", 13, "set"), ("k", 14, "delete"), ("k", 15, "get"), ("z", 0, "set"), (None, 0, "set"), (None, 1, "get")]
    df = spark.createDataFrame([(k, t0 + timedelta(seconds=s), i, op) for i, (k, s, op) in enumerate(ops)], "key string, ts timestamp_ntz, seq int, op string")
    assert [(r.seq, r.hit) for r in cache.replay(df, 10).orderBy("seq").collect()] == [(0, False), (2, True), (3, False), (6, False), (9, True)]
    s = cache.stats(df, 10).first()
    assert (s.hits, s.misses, s.total, s.hit_rate_percent, s["size"]) == (2, 3, 5, 40.0, 2)
    assert cache.stats(df.limit(0), 10).first().hit_rate_percent == 0.0


def test_latency(spark):
    tracker = latency.Tracker()
    tracker.record("a", 1.5)
    tracker.record("a", 2.5, user=1)
    with tracker.track("b"):
        pass
    log = tracker.frame(spark)
    s = {r.operation_name: r for r in latency.summary(log).collect()}
    assert (s["a"]["count"], s["a"].total_ms, s["a"].average_ms) == (2, 4.0, 2.0)
    assert latency.average(log, "none").first().average_ms is None
    assert latency.slow(log, 2.0).count() == 1 and latency.by_operation(log, "b").count() == 1


def test_numbering(spark):
    df = spark.range(100).select((F.col("id") * 37 % 101).alias("v"))
    got = sorted((r.v, r.pos) for r in numbering.number_rows(df, ["v"]).collect())
    assert [p for _, p in got] == list(range(100)) and [v for v, _ in got] == sorted(v for v, _ in got)
    assert numbering.number_rows(df.limit(0), ["v"]).count() == 0


def test_window_chunks(spark):
    df = spark.createDataFrame([("d", " ".join(map(str, range(25)))), ("e", " "), ("f", None), ("g", "one")], "id string, t string")
    got = documents.window_chunks(df, "id", "t", size=10, overlap=2, least=4).orderBy("document_id", "chunk_index").collect()
    assert [(r.chunk_id, r.token_count) for r in got] == [("d_chunk_0000", 10), ("d_chunk_0001", 10), ("d_chunk_0002", 9), ("g_chunk_0000", 1)]
    with pytest.raises(errors.ChunkingError):
        documents.window_chunks(df, "id", "t", size=5, overlap=5)
