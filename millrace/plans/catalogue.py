"""Registered queries of the engine's own operators, and their equivalents in SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import citations as C
from millrace.functions import text as X
from millrace.functions import vectors as V
from millrace.operators import bm25, cache, context, dense, documents, fusion, latency, metadata, queryproc, rerank
from millrace.plans.runtime import checkpoint, table
from millrace.streaming import latency as stream_latency

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: White space for the SQL engine's patterns.
W = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: A query log with each query once.
_Q = "q AS (SELECT query_id, max(query) AS query FROM queries WHERE query_id IS NOT NULL GROUP BY query_id)"
CACHE_TTL = 3600


def register(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "queries").where("query_id is not null").groupBy("query_id").agg(F.max("query").alias("query"))


def _chunks(spark: SparkSession, d: str, columns: list[str]) -> DataFrame:
    """The chunks, each once, in their latest form."""
    return metadata.upsert(table(spark, d, "chunks").where("chunk_id is not null"), "chunk_id", "last_updated", columns)


# ---- keyword search

_TOKENS = f"""tok AS (SELECT pos, unnest(list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9{W}]', '', 'g'), '[{W}]+'), lambda x: x <> '')) AS term FROM corpus)"""
_BM25 = f"""{_TOKENS}, post AS (SELECT term, pos, count(*) AS tf FROM tok GROUP BY ALL),
len AS (SELECT c.pos, count(t.term) AS dl FROM corpus c LEFT JOIN tok t ON t.pos = c.pos GROUP BY c.pos),
size AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM len),
raw AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, size GROUP BY term),
mean AS (SELECT avg(raw) AS avg_idf FROM raw),
terms AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * avg_idf ELSE raw END AS idf FROM raw, mean)"""
_TOPK = f"""qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(query, '')), '[^a-z0-9{W}]', '', 'g'), '[{W}]+'), lambda x: x <> '')) AS term FROM asked) GROUP BY ALL),
hit AS (SELECT query_id, p.pos, sum(CAST(round(qtf * idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) * 1e9) AS BIGINT)) / 1e9 AS score
  FROM qt JOIN terms USING (term) JOIN post p USING (term) JOIN len l ON l.pos = p.pos CROSS JOIN size GROUP BY ALL),
scored AS (SELECT a.query_id, c.pos, coalesce(h.score, 0.0) AS score FROM (SELECT DISTINCT query_id FROM qt) a CROSS JOIN corpus c LEFT JOIN hit h ON h.query_id = a.query_id AND h.pos = c.pos)"""


def _docs(spark: SparkSession, d: str, statistics_only: bool = True) -> bm25.BM25Index:
    return bm25.build(table(spark, d, "documents"), "doc_id", "text", statistics_only=statistics_only)


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


_CORPUS = "corpus AS (SELECT doc_id AS pos, text FROM documents)"
_ITEMS = "asked AS (SELECT item_id AS query_id, text AS query FROM benchmark)"


@register(f"WITH {_CORPUS}, {_TOKENS} SELECT c.pos AS doc_id, count(t.term) AS tokens, count(DISTINCT t.term) AS terms FROM corpus c LEFT JOIN tok t ON t.pos = c.pos GROUP BY c.pos")
def tokenize_counts(spark, d):
    words = X.tokenize(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(words).cast("long").alias("tokens"), F.size(F.array_distinct(words)).cast("long").alias("terms"))


@register(f"WITH {_CORPUS}, {_BM25} SELECT term, df, round(idf, 8) AS idf FROM terms")
def bm25_term_stats(spark, d):
    return _docs(spark, d).terms.select("term", "df", F.round("idf", 8).alias("idf"))


@register(f"WITH {_CORPUS}, {_BM25} SELECT n, round(avgdl, 8) AS avgdl, round(avg_idf, 8) AS avg_idf FROM size, mean")
def bm25_corpus_stats(spark, d):
    return _docs(spark, d).corpus.select("n", F.round("avgdl", 8).alias("avgdl"), F.round("avg_idf", 8).alias("avg_idf"))


@register(f"WITH {_CORPUS}, {_ITEMS}, {_BM25}, {_TOPK} SELECT query_id, pos, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank FROM scored QUALIFY rank <= 50")
def bm25_batch_topk(spark, d):
    return bm25.topk_scan(_docs(spark, d), table(spark, d, "documents"), _items(spark, d), "doc_id", "text", k=50).select("query_id", "pos", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_ONE = "How long may oyster meat stay in the cold store, and who signs the form for the oyster meat?"


@register(f"WITH {_CORPUS}, asked AS (SELECT 1 AS query_id, '{_ONE}' AS query), {_BM25}, {_TOPK} SELECT pos, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, pos) AS rank FROM scored QUALIFY rank <= 50")
def bm25_topk(spark, d):
    one = spark.createDataFrame([(1, _ONE)], "query_id int, query string")
    return bm25.topk(_docs(spark, d, False), one, k=50).select("pos", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@register("SELECT doc_id AS pos, CAST(0 AS DOUBLE) AS score, row_number() OVER (ORDER BY doc_id) AS rank FROM documents QUALIFY rank <= 10")
def bm25_oov_padding(spark, d):
    """A query of unknown words gets the first documents with 0; one without any word gets none."""
    two = spark.createDataFrame([(1, "zzzunknownzzz qqqxxqq"), (2, "!!! ...")], "query_id int, query string")
    return bm25.topk(_docs(spark, d, False), two, k=10).select("pos", "score", F.col("rank").cast("long").alias("rank"))


# ---- vector search

_VECTORS = """v AS (SELECT vec_id AS pos, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE len(embedding) = 64),
qv AS (SELECT query_id, CAST(any_value(query_embedding) AS DOUBLE[]) AS v FROM queries WHERE len(query_embedding) = 64 AND query_id IS NOT NULL GROUP BY query_id)"""
_COS = """round(CASE WHEN list_inner_product(a.v, a.v) > 0 AND list_inner_product(b.v, b.v) > 0 THEN list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v)) / sqrt(list_inner_product(b.v, b.v)) ELSE 0.0 END, 9)"""
_NEAR = f"near AS (SELECT query_id, b.pos, {_COS} AS score FROM qv a CROSS JOIN v b)"


def _query_vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "queries").where("query_id is not null").groupBy("query_id").agg(F.max("query").alias("query"), F.max("query_embedding").alias("query_embedding"))


def _near(spark: SparkSession, d: str, **options) -> DataFrame:
    found = dense.search(table(spark, d, "embeddings"), _query_vectors(spark, d), "vec_id", "embedding", **options)
    return found.select("query_id", "pos", "score", F.col("rank").cast("long").alias("rank"))


@register(f"WITH {_VECTORS}, {_NEAR} SELECT query_id, pos, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank FROM near QUALIFY rank <= 50")
def dense_batch_topk(spark, d):
    return _near(spark, d, k=50)


@register("""WITH v AS (SELECT vec_id AS pos, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), a AS (SELECT v FROM v WHERE pos = (SELECT min(pos) FROM v))
SELECT b.pos, round(list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v)) / sqrt(list_inner_product(b.v, b.v)), 9) AS score, row_number() OVER (ORDER BY round(list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v)) / sqrt(list_inner_product(b.v, b.v)), 9) DESC, b.pos) AS rank FROM a, v b QUALIFY rank <= 10""")
def dense_topk(spark, d):
    """The first vector's neighbours; it is its own nearest."""
    vectors = table(spark, d, "embeddings")
    one = vectors.orderBy("vec_id").limit(1).select(F.lit("q").alias("query_id"), F.col("embedding").alias("query_embedding"))
    return dense.search(vectors, one, "vec_id", "embedding", k=10).select("pos", "score", F.col("rank").cast("long").alias("rank"))


@register(f"WITH {_VECTORS}, {_NEAR} SELECT query_id, pos, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank FROM near) WHERE rank <= 50 AND score >= 0.3")
def dense_threshold(spark, d):
    return _near(spark, d, k=50, threshold=0.3)


def _store(spark: SparkSession, d: str) -> DataFrame:
    """The vectors as a store in which every fifth is deleted."""
    return table(spark, d, "embeddings").select(F.concat(F.lit("c"), F.col("vec_id").cast("string")).alias("chunk_id"), F.col("vec_id").alias("pos"), F.col("embedding").alias("vec"), (F.col("label") % 5 == 0).alias("deleted"))


@register(f"""WITH {_VECTORS}, gone AS (SELECT vec_id AS pos FROM embeddings WHERE label % 5 = 0), {_NEAR},
before AS (SELECT query_id, pos, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank FROM near WHERE pos NOT IN (SELECT pos FROM gone) QUALIFY rank <= 10),
after AS (SELECT query_id, pos, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank FROM near QUALIFY rank <= 10)
SELECT 'before' AS filter, query_id, pos, score, rank FROM before
UNION ALL SELECT 'after', query_id, pos, score, rank FROM after WHERE pos NOT IN (SELECT pos FROM gone)""")
def dense_with_tombstones(spark, d):
    """Deletions left out before the ranks, and after them."""
    store, asked = _store(spark, d), _query_vectors(spark, d)
    shown = lambda df, how: df.select(F.lit(how).alias("filter"), "query_id", "pos", "score", F.col("rank").cast("long").alias("rank"))
    return shown(dense.search_store(store, asked), "before").unionByName(shown(dense.search_store(store, asked, compat_post_filter=True), "after"))


@register("SELECT count(*) AS total_vectors, count(DISTINCT CASE WHEN label % 5 <> 0 THEN vec_id END) AS unique_chunks, max(len(embedding)) AS dimension, count(CASE WHEN label % 3 = 0 THEN 1 END) AS metadata_entries, 'index/chunks' AS index_path FROM embeddings")
def index_stats(spark, d):
    """Statistics of a store in which every third vector came with metadata."""
    store = _store(spark, d)
    entries = spark.createDataFrame([], "chunk_id string, label int")
    given = table(spark, d, "embeddings").where("label % 3 = 0").select(F.concat(F.lit("c"), F.col("vec_id").cast("string")).alias("chunk_id"), F.col("label").cast("int").alias("label"))
    return dense.store_stats(store, dense.attach_metadata(entries, store, given), "index/chunks").withColumn("dimension", F.col("dimension").cast("long"))


@register(f"""WITH {_VECTORS}, gone AS (SELECT max(vec_id) AS pos FROM embeddings WHERE label % 7 = 0 GROUP BY vec_id // 2), {_NEAR}
SELECT query_id, pos, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank FROM near WHERE pos NOT IN (SELECT pos FROM gone) QUALIFY rank <= 10""")
def dense_after_delete(spark, d):
    """Chunks of two vectors each; of every chunk with a vector of some label the newest such vector is deleted, then searched."""
    vectors = table(spark, d, "embeddings")
    chunk = F.concat(F.lit("c"), F.floor(F.col("vec_id") / 2).cast("string"), F.when(F.col("label") % 7 == 0, "x").otherwise("y")).alias("chunk_id")
    store = vectors.select(chunk, F.col("vec_id").alias("pos"), F.col("embedding").alias("vec"), F.lit(False).alias("deleted"))
    left = dense.delete_chunks(store, store.where(F.col("chunk_id").endswith("x")))
    return dense.search_store(left, _query_vectors(spark, d)).select("query_id", "pos", "score", F.col("rank").cast("long").alias("rank"))


@register("""WITH base AS (SELECT count(*) AS n FROM embeddings WHERE len(embedding) = 64)
SELECT chunk_id, n + row_number() OVER (ORDER BY chunk_id) - 1 AS pos FROM (SELECT DISTINCT chunk_id FROM chunks WHERE len(embedding) = 64 AND chunk_id IS NOT NULL), base""")
def index_append(spark, d):
    """Chunk vectors appended to the store at contiguous positions."""
    store = _store(spark, d)
    new = _chunks(spark, d, ["embedding"]).where(F.size("embedding") == 64).select("chunk_id", F.col("embedding").alias("vec"))
    both = dense.add_vectors(store, new, ["chunk_id"])
    return both.where(~F.col("chunk_id").startswith("c")).select("chunk_id", "pos")


# ---- fusion, hybrid search, reranking


@register("SELECT range AS rank, round(1.0 / (60 + range), 12) AS score FROM range(1, 101)")
def rrf_score_table(spark, d):
    return spark.range(1, 101).select(F.col("id").alias("rank"), F.round(fusion.rrf_score(F.col("id")), 12).alias("score"))


_CHUNKS = "latest AS (SELECT * FROM chunks WHERE chunk_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY last_updated DESC NULLS LAST) = 1)"
_HYBRID = f"""WITH {_CHUNKS}, corpus AS (SELECT chunk_id AS pos, text FROM latest),
asked AS (SELECT query_id, max(query) AS query FROM queries WHERE query_id IS NOT NULL GROUP BY query_id), {_BM25}, {_TOPK},
v AS (SELECT chunk_id AS pos, CAST(embedding AS DOUBLE[]) AS v FROM latest WHERE len(embedding) = 64),
qv AS (SELECT query_id, CAST(any_value(query_embedding) AS DOUBLE[]) AS v FROM queries WHERE len(query_embedding) = 64 AND query_id IS NOT NULL GROUP BY query_id), {_NEAR},
words AS (SELECT query_id, pos, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank FROM scored QUALIFY rank <= 50),
vecs AS (SELECT query_id, pos, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank FROM near QUALIFY rank <= 50),
both_ AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.pos, b.pos) AS pos, a.rank AS r0, b.rank AS r1, coalesce(1.0 / (60 + a.rank), 0.0) + coalesce(1.0 / (60 + b.rank), 0.0) AS score FROM vecs a FULL JOIN words b ON a.query_id = b.query_id AND a.pos = b.pos)"""


@register(f"{_HYBRID} SELECT query_id, pos, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r0 NULLS LAST, r1 NULLS LAST) AS rank FROM both_ QUALIFY rank <= 30")
def hybrid_topk(spark, d):
    latest = _chunks(spark, d, ["text", "embedding"]).select("chunk_id", "embedding", X.tokenize(F.col("text")).alias("words"))
    chunks = checkpoint(latest)  # read for the statistics and for the scan
    index = bm25.build(chunks, "chunk_id", "words", statistics_only=True)
    found = fusion.hybrid(index, chunks, _query_vectors(spark, d), "chunk_id", "embedding", k=30, docs_text="words")
    return found.select("query_id", "pos", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


@register(f"""WITH {_CORPUS}, {_ITEMS}, {_BM25}, {_TOPK}, a AS (SELECT query_id, pos, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank FROM scored QUALIFY rank <= 50),
b AS (SELECT item_id AS query_id, doc_id AS pos, row_number() OVER (PARTITION BY item_id ORDER BY coalesce(n_chars, 0) DESC, doc_id) AS rank FROM benchmark, documents QUALIFY rank <= 50),
f AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.pos, b.pos) AS pos, a.rank AS r0, b.rank AS r1, coalesce(1.0 / (60 + a.rank), 0.0) + coalesce(1.0 / (60 + b.rank), 0.0) AS score FROM a FULL JOIN b ON a.query_id = b.query_id AND a.pos = b.pos)
SELECT query_id, pos, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r0 NULLS LAST, r1 NULLS LAST) AS rank FROM f""")
def rrf_fuse(spark, d):
    """Keyword ranks fused with a ranking of all documents by length."""
    docs = table(spark, d, "documents")
    words = bm25.topk_scan(_docs(spark, d), docs, _items(spark, d), "doc_id", "text", k=50)
    longest = docs.select(F.col("doc_id").alias("pos"), F.coalesce("n_chars", F.lit(0)).alias("n")).orderBy(F.desc("n"), "pos").limit(50)
    from pyspark.sql.window import Window

    ranked = longest.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "pos"))).select("pos", "rank")
    other = _items(spark, d).select("query_id").crossJoin(F.broadcast(ranked))
    return fusion.rrf([words, other]).select("query_id", "pos", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


@register(f"""WITH {_CORPUS}, {_ITEMS}, {_BM25}, {_TOPK}, a AS (SELECT query_id, pos, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank FROM scored QUALIFY rank <= 30),
n AS (SELECT query_id, count(*) AS n FROM qt GROUP BY query_id), o AS (SELECT a.query_id, a.pos, a.rank AS before, count(p.term) AS hits FROM a JOIN qt USING (query_id) LEFT JOIN post p ON p.pos = a.pos AND p.term = qt.term GROUP BY ALL)
SELECT query_id, pos, round(hits / n, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY hits / n DESC, before) AS rank FROM o JOIN n USING (query_id) QUALIFY rank <= 6""")
def rerank_topk(spark, d):
    docs, items = table(spark, d, "documents"), _items(spark, d)
    found = bm25.topk_scan(_docs(spark, d), docs, items, "doc_id", "text", k=30)
    pairs = found.join(docs.select(F.col("doc_id").alias("pos"), F.col("text").alias("document")), "pos").join(items, "query_id")
    return rerank.rerank(pairs, top_k=6).select("query_id", "pos", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


_WORDS = lambda c: f"list_filter(regexp_split_to_array(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9{W}]', '', 'g'), '[{W}]+'), lambda x: x <> '')"


@register(f"""WITH a AS (SELECT answer_id, any_value(query) AS query, any_value(citations) AS c, any_value(context_chunks_count) AS n FROM answers WHERE answer_id IS NOT NULL GROUP BY answer_id),
l AS (SELECT answer_id AS query_id, query, list_transform(c, lambda x: x.title) AS docs, CASE WHEN n % 2 = 0 THEN list_transform(c[1:2], lambda x: x.chunk_id) END AS ids FROM a WHERE len(c) > 0),
p AS (SELECT query_id, query, unnest(range(CASE WHEN ids IS NULL THEN len(docs) ELSE least(len(docs), len(ids)) END)) AS i, docs, ids FROM l),
s AS (SELECT query_id, i, coalesce(ids[i + 1], CAST(i AS VARCHAR)) AS pos, list_distinct({_WORDS('query')}) AS q, {_WORDS('docs[i + 1]')} AS w FROM p),
r AS (SELECT query_id, i, pos, CASE WHEN len(q) > 0 THEN len(list_intersect(q, w)) / len(q) ELSE 0.0 END AS score FROM s)
SELECT query_id, pos, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, i) AS rank FROM r""")
def rerank_lists(spark, d):
    """The titles of each answer's sources against its query, with the ids of the first two where their number is even, else by place."""
    rows = _answers(spark, d, ["query", "citations", "context_chunks_count"])
    ids = F.when(F.col("context_chunks_count") % 2 == 0, F.transform(F.slice("citations", 1, 2), lambda x: x["chunk_id"]))
    lists = rows.select(F.col("answer_id").alias("query_id"), "query", F.transform("citations", lambda x: x["title"]).alias("documents"), ids.alias("doc_ids"))
    return rerank.rerank(rerank.from_lists(lists)).select("query_id", "pos", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


# ---- query processing

_S = lambda c: f"regexp_replace({c}, '^[{W}]+|[{W}]+$', '', 'g')"
_N = lambda c: _S(f"regexp_replace({c}, '[{W}]+', ' ', 'g')")
_ERR = f"CASE WHEN length({_S("coalesce(query, '')")}) = 0 THEN 'Query cannot be empty' WHEN length({_S('query')}) < 3 THEN 'Query too short' WHEN length({_S('query')}) > 2000 THEN 'Query too long' END"


@register(f"WITH {_Q} SELECT query_id, CASE WHEN {_ERR} IS NULL THEN regexp_replace(regexp_replace({_S('query')}, '[{W}]+', ' ', 'g'), '[\\x00-\\x1f]', '', 'g') END AS normalized, {_ERR} AS error FROM q")
def query_normalize(spark, d):
    q = F.col("query")
    return _asked(spark, d).select("query_id", X.query_normalize(q).alias("normalized"), X.query_error(q).alias("error"))


@register(f"WITH {_Q} SELECT query_id, coalesce(length({_S('query')}) >= 3 AND length(query) <= 2000, false) AS valid FROM q")
def query_validate(spark, d):
    return _asked(spark, d).select("query_id", X.query_valid(F.col("query")).alias("valid"))


_STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)


@register(f"WITH {_Q} SELECT query_id, array_to_string(list_filter(regexp_split_to_array(lower(query), '[{W}]+'), lambda x: x <> '' AND x NOT IN ({_STOP})), ' ') AS kept FROM q")
def query_stopwords(spark, d):
    return _asked(spark, d).select("query_id", X.remove_stopwords(F.col("query")).alias("kept"))


@register(f"WITH {_Q} SELECT query_id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(regexp_replace(query, '[^a-zA-Z0-9{W}]', '', 'g')), '[{W}]+'), lambda x: length(x) > 3))), ' ') AS keywords FROM q")
def query_keywords(spark, d):
    return _asked(spark, d).select("query_id", F.array_join(X.keywords(F.col("query")), " ").alias("keywords"))


@register(f"WITH {_Q} SELECT query_id, {_N('query')} AS request, {_S(f"regexp_replace({_N('query')}, '[.?!]+$', '')")} AS expander FROM q")
def request_and_expander_normalize(spark, d):
    q = F.col("query")
    return _asked(spark, d).select("query_id", X.request_normalize(q).alias("request"), X.expander_normalize(q).alias("expander"))


_HAS = lambda parts: " OR ".join(f"contains(lower(query), '{p}')" for p in parts)


@register(f"""WITH {_Q} SELECT query_id, CASE WHEN {_HAS(queryproc.DOMAIN_TERMS)} THEN 'hybrid' WHEN {_HAS(queryproc.CONCEPTS)} THEN 'dense'
WHEN (length(query) - length(replace(lower(query), ' and ', ''))) // 5 + (length(query) - length(replace(lower(query), ' or ', ''))) // 4 > 2 OR contains(query, '"') THEN 'bm25' ELSE 'hybrid' END AS route FROM q""")
def query_route(spark, d):
    return _asked(spark, d).select("query_id", queryproc.route(F.col("query")).alias("route"))


_EXP = f"""{_Q}, n AS (SELECT query_id, {_S(f"regexp_replace({_N('query')}, '[.?!]+$', '')")} AS normalized FROM q),
e AS (SELECT query_id, normalized, list_filter([CASE WHEN NOT suffix(normalized, '?') THEN normalized || '?' END, CASE WHEN suffix(normalized, '?') THEN normalized[:-2] END, CASE WHEN contains(lower(normalized), 'how') THEN replace(normalized, 'how', 'what is the method for') END, CASE WHEN contains(lower(normalized), 'what') THEN replace(normalized, 'what', 'explain') END], lambda x: x IS NOT NULL)[1:3] AS expanded FROM n)"""


@register(f"WITH {_EXP} SELECT query_id, normalized, array_to_string(expanded, '|') AS expanded FROM e")
def fallback_expand(spark, d):
    return queryproc.expand(_asked(spark, d)).select("query_id", "normalized", F.array_join("expanded", "|").alias("expanded"))


@register(f"""WITH {_EXP}, u AS (SELECT query_id, unnest([normalized] || expanded) AS query, generate_subscripts([normalized] || expanded, 1) AS nth FROM e),
k AS (SELECT query_id, query, nth FROM u QUALIFY row_number() OVER (PARTITION BY query_id, lower({_S('query')}) ORDER BY nth) = 1)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY nth) AS ord, query FROM k""")
def unique_queries(spark, d):
    return queryproc.unique_queries(queryproc.expand(_asked(spark, d))).select("query_id", F.col("ord").cast("long").alias("ord"), "query")


@register("""WITH a AS (SELECT answer_id, max(answer) AS answer FROM answers GROUP BY answer_id), m AS (SELECT answer_id, nullif(regexp_extract(answer, '(?s)\\[.*\\]'), '') AS m FROM a)
SELECT answer_id, CASE WHEN m IS NOT NULL AND json_valid(m) THEN array_to_string(list_filter(list_transform(CAST(m AS JSON[]), lambda x: trim(x->>'$')), lambda y: y NOT IN ('', '0', 'false')), '|') END AS parsed FROM m""")
def parse_expansions(spark, d):
    """JSON lists in the answers' texts (their source numbers)."""
    answers = table(spark, d, "answers").groupBy("answer_id").agg(F.max("answer").alias("answer"))
    return answers.select("answer_id", F.array_join(queryproc.parse_expansions("answer"), "|").alias("parsed"))


# ---- metadata


@register("SELECT DISTINCT chunk_id FROM chunks WHERE document_id = (SELECT min(document_id) FROM chunks)")
def metadata_filter_document(spark, d):
    chunks = _chunks(spark, d, ["document_id"])
    return metadata.filter_equal(chunks, "document_id", table(spark, d, "chunks").agg(F.min("document_id")).first()[0]).select("chunk_id")


@register(f"WITH {_CHUNKS} SELECT chunk_id FROM latest WHERE language = 'en'")
def metadata_filter_language(spark, d):
    return metadata.filter_equal(_chunks(spark, d, ["language"]), "language", "en").select("chunk_id")


@register(f"WITH {_CHUNKS} SELECT chunk_id FROM latest WHERE language IS NULL")
def metadata_filter_no_language(spark, d):
    return metadata.filter_equal(_chunks(spark, d, ["language"]), "language", None).select("chunk_id")


@register(f"""WITH {_CHUNKS} SELECT count(*) AS total_chunks, count(DISTINCT document_id) + coalesce(max(CASE WHEN document_id IS NULL THEN 1 ELSE 0 END), 0) AS unique_documents,
array_to_string(list_transform(list_sort(list(DISTINCT language) FILTER (language IS NOT NULL)), lambda x: x), ',') || CASE WHEN max(CASE WHEN language IS NULL THEN 1 ELSE 0 END) = 1 THEN ',NULL' ELSE '' END AS languages FROM latest""")
def metadata_stats(spark, d):
    s = metadata.stats(_chunks(spark, d, ["document_id", "language"]))
    return s.select("total_chunks", F.col("unique_documents").cast("long").alias("unique_documents"), F.array_join("languages", ",", "NULL").alias("languages"))


@register(f"WITH {_CHUNKS} SELECT chunk_id, document_id, chunk_index, last_updated FROM latest")
def metadata_upsert(spark, d):
    return _chunks(spark, d, ["document_id", "chunk_index", "last_updated"])


@register(f"WITH {_CHUNKS} SELECT chunk_id, document_id FROM latest WHERE document_id IS DISTINCT FROM (SELECT min(document_id) FROM chunks)")
def metadata_delete_document(spark, d):
    first = table(spark, d, "chunks").agg(F.min("document_id")).first()[0]
    return metadata.delete_equal(_chunks(spark, d, ["document_id"]), "document_id", first)


@register(f"WITH {_CHUNKS}, asked AS (SELECT DISTINCT unnest(citations).chunk_id AS chunk_id FROM answers) SELECT a.chunk_id, l.document_name, l.page FROM asked a LEFT JOIN latest l ON l.chunk_id = a.chunk_id")
def metadata_lookup(spark, d):
    """The records of all cited chunks."""
    cited = table(spark, d, "answers").select(F.explode("citations").alias("c")).select("c.chunk_id").distinct()
    return metadata.lookup(_chunks(spark, d, ["document_name", "page"]), cited, "chunk_id")


@register(f"WITH {_CHUNKS} SELECT document_name, page, section, subsection, chunk_id, title FROM latest")
def citation_fields(spark, d):
    return metadata.citation_fields(_chunks(spark, d, ["document_name", "page", "section", "subsection", "title"]))


_ISO = lambda c: f"strftime({c}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us({c}) % 1000000 = 0 THEN '' ELSE strftime({c}, '.%f') END"


@register(f"SELECT document_id, document_name, file_path, file_size_mb, page_count, language, {_ISO('ingestion_timestamp')} AS ingestion_timestamp, chunk_count, total_tokens, source_type, encoding, custom_metadata FROM document_metadata")
def document_record(spark, d):
    return metadata.records(table(spark, d, "document_metadata"), "document")


@register(f"SELECT chunk_id, document_id, page, chunk_index, total_chunks, len(related_chunks) AS related, token_count, {_ISO('ingestion_timestamp')} AS ingestion_timestamp, {_ISO('last_updated')} AS last_updated, custom_metadata FROM chunks")
def chunk_record(spark, d):
    r = metadata.records(table(spark, d, "chunks"), "chunk")
    related = F.when(F.col("related_chunks").isNotNull(), F.size("related_chunks").cast("long"))
    return r.select("chunk_id", "document_id", "page", "chunk_index", "total_chunks", related.alias("related"), "token_count", "ingestion_timestamp", "last_updated", "custom_metadata")


@register(f"SELECT answer_id, answer, query, query_id, len(citations) AS cited, {_ISO('timestamp')} AS timestamp, retrieval_latency_ms, generation_latency_ms, total_latency_ms, context_chunks_count, context_tokens_count, confidence_score, has_sufficient_context FROM answers")
def answer_record(spark, d):
    r = metadata.records(table(spark, d, "answers"), "answer")
    return r.withColumn("cited", F.when(F.col("citations").isNotNull(), F.size("citations").cast("long"))).drop("citations")


@register(f"SELECT query, query_id, {_ISO('timestamp')} AS timestamp, user_id, session_id, metadata FROM queries")
def query_record(spark, d):
    return metadata.records(table(spark, d, "queries"), "query")


@register(f"SELECT metric_id, operation_name, duration_ms, {_ISO('timestamp')} AS timestamp FROM latency_metrics")
def metric_record(spark, d):
    log = table(spark, d, "latency_metrics")
    return log.select("metric_id", *metadata.iso_record(log, ["operation_name", "duration_ms", "timestamp"]))


@register("""SELECT d.document_id, max(d.chunk_count) AS chunk_count, CAST(max(CASE WHEN c.document_id IS NOT NULL THEN 1 ELSE 0 END) AS BOOLEAN) AS is_indexed
FROM document_metadata d LEFT JOIN (SELECT DISTINCT document_id FROM chunks WHERE len(embedding) = 64) c ON c.document_id = d.document_id WHERE d.document_id IS NOT NULL GROUP BY d.document_id""")
def mark_indexed(spark, d):
    """Documents with a vector of the right size are marked."""
    docs = table(spark, d, "document_metadata").where("document_id is not null").groupBy("document_id").agg(F.max("chunk_count").alias("chunk_count"))
    return metadata.mark_indexed(docs, table(spark, d, "chunks").where(F.size("embedding") == 64).select("document_id"))


@register(f"WITH {_CHUNKS}, gone AS (SELECT DISTINCT unnest(citations).chunk_id AS chunk_id FROM answers) SELECT chunk_id, document_id FROM latest WHERE chunk_id NOT IN (SELECT chunk_id FROM gone WHERE chunk_id IS NOT NULL)")
def metadata_delete_chunks(spark, d):
    """The chunks without those that an answer cites."""
    cited = table(spark, d, "answers").select(F.explode("citations").alias("c")).select("c.chunk_id")
    return metadata.delete(_chunks(spark, d, ["document_id"]), cited, "chunk_id")


@register()
def record_json(spark, d):
    return metadata.record_json(table(spark, d, "document_metadata"))


@register("SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def content_hash_dedup(spark, d):
    return metadata.dedup_by_content(table(spark, d, "documents"), "doc_id", "text")


# ---- scalar functions


@register("SELECT doc_id, length(text) // 4 AS tokens FROM documents")
def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", X.estimate_tokens(F.col("text")).alias("tokens"))


@register("SELECT doc_id, CASE WHEN length(text) <= 80 THEN text ELSE substring(text, 1, 77) || '...' END AS short FROM documents")
def truncate_text(spark, d):
    return table(spark, d, "documents").select("doc_id", X.truncate(F.col("text"), 80).alias("short"))


@register(f"SELECT doc_id, {_N('text')} AS text FROM documents")
def normalize_whitespace(spark, d):
    return table(spark, d, "documents").select("doc_id", X.normalize_whitespace(F.col("text")).alias("text"))


@register(f"WITH {_CHUNKS} SELECT chunk_id, coalesce(len(embedding) > 0, false) AS embedded FROM latest")
def chunk_embedded(spark, d):
    """Whether each chunk has a vector."""
    return _chunks(spark, d, ["embedding"]).select("chunk_id", V.has_embedding(F.col("embedding")).alias("embedded"))


@register(f"WITH {_CHUNKS} SELECT chunk_id, printf('%s_chunk_%04d', document_id, chunk_index) AS made, md5(chunk_id) || '.cache' AS cache_file FROM latest")
def chunk_ids(spark, d):
    return _chunks(spark, d, ["document_id", "chunk_index"]).select("chunk_id", X.chunk_id(F.col("document_id"), F.col("chunk_index")).alias("made"), X.cache_file(F.col("chunk_id")).alias("cache_file"))


@register(f"WITH {_CHUNKS} SELECT chunk_id, (len(related_chunks) + 1) // 2 AS batches, array_to_string(related_chunks[1:2], ',') AS first_batch FROM latest WHERE len(related_chunks) > 0")
def batch_list(spark, d):
    cut = X.batches(F.col("related_chunks"), 2)
    return _chunks(spark, d, ["related_chunks"]).where(F.size("related_chunks") > 0).select("chunk_id", F.size(cut).cast("long").alias("batches"), F.array_join(cut[0], ",").alias("first_batch"))


@register("SELECT doc_id, strlen(text) AS bytes, strlen(text) / 1048576.0 AS mb FROM documents")
def file_sizes(spark, d):
    """Sizes of the texts as files: bytes of UTF-8, and megabytes."""
    size = F.octet_length("text").cast("long")
    return table(spark, d, "documents").select("doc_id", size.alias("bytes"), X.file_size_mb(size).alias("mb"))


@register(f"""WITH {_Q} SELECT 'query' AS kind, query_id AS id, CASE WHEN length({_S("coalesce(query, '')")}) = 0 THEN 'Query cannot be empty' WHEN length({_S('query')}) < 3 THEN 'Query must be at least 3 characters' END AS error FROM q
UNION ALL SELECT 'document', CAST(doc_id AS VARCHAR), CASE WHEN length({_S("coalesce(text, '')")}) = 0 THEN 'Document text content cannot be empty' END FROM documents
UNION ALL SELECT 'chunk', chunk_id, CASE WHEN length({_S("coalesce(text, '')")}) = 0 THEN 'Chunk text cannot be empty' END FROM (SELECT chunk_id, max(text) AS text FROM chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id)""")
def record_checks(spark, d):
    """What keeps a query, a document or a chunk from being made; null if nothing does."""
    rows = [("query", _asked(spark, d).select(F.col("query_id").alias("id"), X.request_error(F.col("query")).alias("error"))),
            ("document", table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), X.document_error(F.col("text")).alias("error"))),
            ("chunk", _chunks(spark, d, ["text"]).select(F.col("chunk_id").alias("id"), X.chunk_error(F.col("text")).alias("error")))]
    return reduce(DataFrame.unionByName, [df.select(F.lit(kind).alias("kind"), "id", "error") for kind, df in rows])


@register("SELECT doc_id, 'doc_' || substring(sha256(CAST(doc_id AS VARCHAR) || chr(31) || coalesce(source, '')), 1, 12) AS stable FROM documents WHERE source IS NOT NULL")
def stable_ids(spark, d):
    """Ids that depend on a row's keys only, so that they are the same after a lost task is run again."""
    docs = table(spark, d, "documents").where("source is not null")
    return docs.select("doc_id", X.stable_id("doc_", F.col("doc_id").cast("string"), F.col("source")).alias("stable"))


@register(f"""WITH w AS (SELECT CAST(doc_id AS VARCHAR) AS doc, list_filter(regexp_split_to_array(coalesce(text, ''), '[{W}]+'), lambda x: x <> '') AS w FROM documents),
n AS (SELECT doc, w, len(w) AS n, CAST(greatest(1, ceil((len(w) - 10) / 50.0)) AS BIGINT) AS whole FROM w WHERE len(w) > 0),
c AS (SELECT doc, w, n, CASE WHEN whole > 1 AND n - (whole - 1) * 50 - 10 < 20 THEN whole - 1 ELSE whole END AS total_chunks FROM n),
i AS (SELECT *, unnest(range(total_chunks)) AS chunk_index FROM c),
p AS (SELECT *, w[chunk_index * 50 + 1 : CASE WHEN chunk_index = total_chunks - 1 THEN n ELSE chunk_index * 50 + 60 END] AS part FROM i)
SELECT printf('%s_chunk_%04d', doc, chunk_index) AS chunk_id, total_chunks, len(part) AS token_count, array_to_string(part, ' ') AS text FROM p""")
def window_chunks(spark, d):
    """Documents cut into windows of 60 words that share 10."""
    cut = documents.window_chunks(table(spark, d, "documents"), "doc_id", "text", size=60, overlap=10, least=20)
    return cut.select("chunk_id", F.col("total_chunks").cast("long").alias("total_chunks"), F.col("token_count").cast("long").alias("token_count"), "text")


# ---- citations, contexts, prompts

_G = lambda c: f"({c} IS NOT NULL AND CAST({c} AS VARCHAR) NOT IN ('', '0'))"
_CIT = lambda x: f"concat_ws(' | ', {x}.document_name, CASE WHEN {_G(x + '.page')} THEN 'p. ' || {x}.page END, CASE WHEN {_G(x + '.section')} THEN {x}.section END)"
_ANS = "a AS (SELECT * FROM answers WHERE answer_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY answer_id ORDER BY timestamp DESC) = 1)"


def _answers(spark: SparkSession, d: str, columns: list[str]) -> DataFrame:
    return metadata.upsert(table(spark, d, "answers").where("answer_id is not null"), "answer_id", "timestamp", columns)


@register(f"""WITH {_CHUNKS} SELECT chunk_id, concat_ws(' | ', 'Document: ' || document_name, CASE WHEN {_G('page')} THEN 'Page: ' || page END, CASE WHEN {_G('section')} THEN 'Section: ' || section END, 'ID: ' || chunk_id) AS citation,
'Citation Format:' || chr(10) || '- Document: ' || document_name || chr(10) || '- Page: ' || CASE WHEN {_G('page')} THEN CAST(page AS VARCHAR) ELSE 'N/A' END || chr(10) || '- Section: ' || CASE WHEN {_G('section')} THEN section ELSE 'N/A' END || chr(10) || '- Reference ID: ' || chunk_id AS card FROM latest""")
def chunk_citation(spark, d):
    c = _chunks(spark, d, ["document_name", "page", "section"])
    args = [F.col(x) for x in ("document_name", "page", "section", "chunk_id")]
    return c.select("chunk_id", C.chunk_citation(*args).alias("citation"), C.citation_card(*args).alias("card"))


@register(f"""WITH {_ANS} SELECT answer_id, CASE WHEN len(citations) > 0 THEN array_to_string(list_transform(citations, lambda x, i: '[' || i || '] ' || {_CIT('x')}), chr(10)) ELSE 'No citations available' END AS listed,
CASE WHEN len(citations) > 0 THEN chr(10) || chr(10) || 'Citations:' || chr(10) || array_to_string(list_transform(citations, lambda x, i: '[' || i || '] ' || x.document_name || CASE WHEN {_G('x.page')} THEN ', p. ' || x.page ELSE '' END || CASE WHEN {_G('x.section')} THEN ' - ' || x.section ELSE '' END || CASE WHEN {_G('x.chunk_id')} THEN ' (ID: ' || x.chunk_id || ')' ELSE '' END), chr(10)) ELSE '' END AS block FROM a""")
def citation_block(spark, d):
    return _answers(spark, d, ["citations"]).select("answer_id", C.citation_list(F.col("citations")).alias("listed"), C.citation_block(F.col("citations")).alias("block"))


_CTX = f"""{_ANS}, {_CHUNKS}, r AS (SELECT answer_id, unnest(citations).chunk_id AS chunk_id, generate_subscripts(citations, 1) AS rank FROM a),
j AS (SELECT answer_id, row_number() OVER (PARTITION BY answer_id ORDER BY rank) AS i, l.* FROM r JOIN latest l USING (chunk_id)),
ctx AS (SELECT answer_id, string_agg('[Source ' || i || ']' || chr(10) || text || chr(10) || 'Document: ' || document_name || CASE WHEN {_G('page')} THEN ', Page: ' || page ELSE '' END || CASE WHEN {_G('section')} THEN ', Section: ' || section ELSE '' END, chr(10) || chr(10) ORDER BY i) AS context FROM j GROUP BY answer_id)"""


def _contexts(spark: SparkSession, d: str) -> DataFrame:
    ranked = _answers(spark, d, ["citations"]).select("answer_id", F.posexplode("citations").alias("rank", "c")).select("answer_id", "rank", "c.chunk_id")
    return context.context_blocks(ranked, _chunks(spark, d, ["text", "document_name", "page", "section"]), "answer_id")


@register(f"WITH {_CTX} SELECT answer_id, context FROM ctx")
def context_block(spark, d):
    """The cited chunks of every answer as its context."""
    return _contexts(spark, d)


_P = [p.replace("\n", "' || chr(10) || '") for p in C.ANSWER_PROMPT]


@register(f"WITH {_CTX} SELECT a.answer_id, '{_P[0]}' || coalesce(context, '{C.NO_CONTEXT}') || '{_P[1]}' || a.query || '{_P[2]}' AS prompt FROM a LEFT JOIN ctx ON ctx.answer_id = a.answer_id")
def answer_prompt(spark, d):
    return context.prompts(_answers(spark, d, ["query"]), _contexts(spark, d), "answer_id")


# ---- latency and cache

_LOG = "log AS (SELECT metric_id, max(operation_name) AS operation_name, max(duration_ms) AS duration_ms FROM latency_metrics GROUP BY metric_id)"


def _log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "latency_metrics").groupBy("metric_id").agg(F.max("operation_name").alias("operation_name"), F.max("duration_ms").alias("duration_ms"))


@register(f"WITH {_LOG} SELECT operation_name, count(*) AS count, CAST(sum(CAST(duration_ms AS DECIMAL(24,4))) AS DOUBLE) AS total_ms, round(CAST(sum(CAST(duration_ms AS DECIMAL(24,4))) AS DOUBLE) / count(*), 6) AS average_ms, min(duration_ms) AS min_ms, max(duration_ms) AS max_ms FROM log WHERE duration_ms IS NOT NULL GROUP BY operation_name")
def latency_summary(spark, d):
    return latency.summary(_log(spark, d))


@register("SELECT operation_name, count(*) AS count, CAST(sum(CAST(duration_ms AS DECIMAL(24,4))) AS DOUBLE) AS total_ms, round(CAST(sum(CAST(duration_ms AS DECIMAL(24,4))) AS DOUBLE) / count(*), 6) AS average_ms, min(duration_ms) AS min_ms, max(duration_ms) AS max_ms FROM latency_metrics WHERE duration_ms IS NOT NULL GROUP BY operation_name")
def latency_summary_stream(spark, d):
    """The summary of all deliveries (repeated ones too), run as a stream over the files."""
    stream = stream_latency.read_metrics(spark, f"{d}/latency_metrics.parquet*")  # a file or a folder of files
    return stream_latency.drain(stream_latency.running_summary(stream), "latency_summary")


@register(f"WITH {_LOG} SELECT round(CAST(sum(CAST(duration_ms AS DECIMAL(24,4))) AS DOUBLE) / count(duration_ms), 6) AS average_ms FROM log WHERE operation_name = 'dense_retrieval'")
def latency_average(spark, d):
    return latency.average(_log(spark, d), "dense_retrieval")


@register(f"WITH {_LOG} SELECT metric_id, operation_name, duration_ms FROM log WHERE duration_ms > 1000")
def slow_operations(spark, d):
    return latency.slow(_log(spark, d)).select("metric_id", "operation_name", "duration_ms")


_OPS = "ops AS (SELECT user_id AS key, ts, event_id AS seq, CASE WHEN event_type IN ('purchase', 'signup') THEN 'set' WHEN event_type = 'error' THEN 'delete' ELSE 'get' END AS op FROM events)"
_HITS = f"""{_OPS}, st AS (SELECT key, ts, seq, op, last_value(CASE WHEN op <> 'get' THEN {{'ts': ts, 'op': op}} END IGNORE NULLS) OVER (PARTITION BY key ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS state FROM ops),
gets AS (SELECT key, ts, seq, coalesce(state.op = 'set' AND epoch_us(ts) - epoch_us(state.ts) <= {CACHE_TTL * 1000000}, false) AS hit FROM st WHERE op = 'get')"""


def _ops(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type").isin("purchase", "signup"), "set").when(F.col("event_type") == "error", "delete").otherwise("get")
    return table(spark, d, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"), kind.alias("op"))


@register(f"WITH {_HITS} SELECT key, ts, seq, hit FROM gets")
def cache_ttl_sim(spark, d):
    """The events as a log of cache operations: purchases and signups set, errors delete, the rest get."""
    return cache.replay(_ops(spark, d), CACHE_TTL)


@register(f"""WITH {_HITS}, s AS (SELECT key, max({{'ts': ts, 'seq': seq, 'op': op}}) FILTER (op <> 'get') AS s, max(ts) FILTER (op = 'get') AS g FROM ops GROUP BY key),
z AS (SELECT count(*) AS size FROM s WHERE s.s.op = 'set' AND NOT coalesce(g > s.s.ts AND epoch_us(g) - epoch_us(s.s.ts) > {CACHE_TTL * 1000000}, false))
SELECT sum(hit::BIGINT)::BIGINT AS hits, count(*) - sum(hit::BIGINT)::BIGINT AS misses, count(*) AS total, round(100.0 * sum(hit::BIGINT) / count(*), 6) AS hit_rate_percent, any_value(size) AS size FROM gets, z""")
def cache_stats(spark, d):
    return cache.stats(_ops(spark, d), CACHE_TTL)


@register(f"WITH {_LOG} SELECT metric_id, duration_ms, 'dense_retrieval' || ': ' || printf('%.2f', duration_ms) || 'ms' AS shown FROM log WHERE operation_name = 'dense_retrieval' AND duration_ms IS NOT NULL")
def latency_by_operation(spark, d):
    """The metrics of one operation, in words."""
    found = latency.by_operation(_log(spark, d), "dense_retrieval").where("duration_ms is not null")
    return found.select("metric_id", "duration_ms", X.metric_text(F.col("operation_name"), F.col("duration_ms")).alias("shown"))


_LAYERS = ("embedding", "retrieval", "context", "llm_response")
_LAYER = f"CASE key % 4 {' '.join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_LAYERS))} END"
_AT_END = "s AS (SELECT key, max({'ts': ts, 'seq': seq, 'op': op}) FILTER (op <> 'get') AS s, max(ts) FILTER (op = 'get') AS g FROM ops GROUP BY key)"
_STALE = f"coalesce(g > s.s.ts AND epoch_us(g) - epoch_us(s.s.ts) > {CACHE_TTL * 1000000}, false)"


@register(f"""WITH {_HITS}, {_AT_END}, z AS (SELECT {_LAYER} AS layer, count(CASE WHEN s.s.op = 'set' AND NOT {_STALE} THEN 1 END) AS size FROM s GROUP BY 1),
h AS (SELECT {_LAYER} AS layer, sum(hit::BIGINT)::BIGINT AS hits, count(*) AS total FROM gets GROUP BY 1)
SELECT layer, coalesce(hits, 0) AS hits, coalesce(total - hits, 0) AS misses, coalesce(total, 0) AS total, coalesce(round(100.0 * hits / total, 6), 0.0) AS hit_rate_percent, size FROM z LEFT JOIN h USING (layer)""")
def cache_stats_by_layer(spark, d):
    """The same log, its users divided over four layers."""
    layer = F.element_at(F.array(*[F.lit(x) for x in _LAYERS]), (F.col("key") % 4 + 1).cast("int"))
    return cache.stats(_ops(spark, d).withColumn("layer", layer), CACHE_TTL, ("layer",))


@register(f"WITH {_OPS}, {_AT_END}, t AS (SELECT max(ts) AS now FROM ops) SELECT key, coalesce(s.s.op = 'set' AND epoch_us(now) - epoch_us(s.s.ts) <= {24 * CACHE_TTL * 1000000}, false) AS found FROM s, t")
def cache_exists(spark, d):
    """Whether each key stands in the cache when the log ends, with a day to live."""
    ops = _ops(spark, d)
    now = ops.agg(F.max("ts")).first()[0]
    return cache.exists(ops, 24 * CACHE_TTL, F.lit(now)).withColumnRenamed("exists", "found")


@register(f"""WITH all_ops AS (SELECT user_id AS key, ts, event_id AS seq, CASE WHEN event_type IN ('purchase', 'signup') THEN 'set' WHEN event_type = 'error' THEN 'delete' ELSE 'get' END AS op FROM events),
c AS (SELECT max({{'ts': ts, 'seq': event_id}}) AS c FROM events WHERE event_id % 1000 = 0),
{_HITS.replace(_OPS, "ops AS (SELECT all_ops.* FROM all_ops, c WHERE {'ts': ts, 'seq': seq} > c.c)")}, {_AT_END},
z AS (SELECT count(*) AS size FROM s WHERE s.s.op = 'set' AND NOT {_STALE})
SELECT coalesce(sum(hit::BIGINT), 0)::BIGINT AS hits, count(*) - coalesce(sum(hit::BIGINT), 0)::BIGINT AS misses, count(*) AS total, coalesce(round(100.0 * sum(hit::BIGINT) / count(*), 6), 0.0) AS hit_rate_percent, any_value(z.size) AS size FROM z LEFT JOIN gets ON true""")
def cache_stats_after_clear(spark, d):
    """The cache is cleared at every thousandth event; the statistics are those since the last of them."""
    ops = _ops(spark, d)
    return cache.stats(cache.since_clear(ops.withColumn("op", F.when(F.col("seq") % 1000 == 0, "clear").otherwise(F.col("op")))), CACHE_TTL)
