"""BM25 over an inverted index held in DataFrames.

The index is four tables: ``postings(term, pos, dl, tf)``, ``lengths(pos, dl)``, ``terms(term, df, idf)`` and the
one-row ``corpus(n, avgdl, avg_idf)``. The postings are range-partitioned and sorted by term and position, and carry the
documents' lengths. The words of a query are pushed down to their scan, which skips the row groups without
them, and meet them in a broadcast join (more than ``SENT_WORDS`` in a shuffled one), so the postings of other words
are neither read nor shuffled, and those of a stopword lie in many partitions. Partial scores are summed before the shuffle, as
whole numbers of 1e-9, which makes ties and ranks independent of the order of addition.
"""

from __future__ import annotations

import dataclasses
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace.functions.text import tokenize
from millrace.operators.topk import ROWS, StreamTopK, few_tasks
from millrace.plans.errors import BM25RetrievalError
from millrace.plans.runtime import checkpoint, spread
from millrace.sources.store import current, save

K1, B, EPSILON = 1.5, 0.75, 0.25
SCALE = 10**9
#: Queries that are sent to the tasks at once.
QUERY_BLOCK = 50_000
#: Rows (query and word) that are broadcast, and different words that are pushed down, at most.
SENT_WORDS, PUSHED_WORDS = 200_000, 1_000


@dataclasses.dataclass
class BM25Index:
    postings: DataFrame
    lengths: DataFrame
    terms: DataFrame
    corpus: DataFrame

    def save(self, path: str) -> None:
        for f in dataclasses.fields(self):
            save(getattr(self, f.name), f"{path}/{f.name}")

    @staticmethod
    def load(spark, path: str) -> BM25Index:
        return BM25Index(*(spark.read.parquet(current(spark, f"{path}/{f.name}")) for f in dataclasses.fields(BM25Index)))


def words(docs: DataFrame, column: str) -> Column:
    """The words of a column of texts, or of one that holds words already."""
    return F.col(column) if isinstance(docs.schema[column].dataType, T.ArrayType) else tokenize(F.col(column))


def build(docs: DataFrame, pos: str, text: str, keep: bool = True, statistics_only: bool = False) -> BM25Index:
    """Index of ``docs``; ``pos`` is unique and orders equal scores. Null texts are documents without words.
    ``text`` may hold the words of :func:`tokenize` instead of texts.

    With ``keep`` the postings and the small tables are checkpointed, so that queries do not read the texts again;
    ``statistics_only`` leaves the postings out of that, for :func:`topk_scan`, which does not use them.
    """
    rows = spread(docs.select(F.col(pos).alias("pos"), F.col(text).alias("text")))
    split = rows.select("pos", words(rows, "text").alias("words"))
    lengths = split.select("pos", F.size("words").alias("dl"))
    postings = split.select("pos", F.size("words").alias("dl"), F.explode("words").alias("term")).groupBy("term", "pos", "dl").agg(F.count("*").alias("tf"))
    if keep and not statistics_only:
        postings, lengths = checkpoint(postings.repartitionByRange("term", "pos").sortWithinPartitions("term", "pos")), checkpoint(lengths)
        df = postings.groupBy("term").agg(F.count("*").alias("df"))
    else:  # one row per document and word, counted before the shuffle
        df = split.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    size = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    if keep:
        size = checkpoint(size)
    raw = df.crossJoin(F.broadcast(size.select("n"))).select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    if keep:
        raw = checkpoint(raw)
    mean = raw.agg(F.avg("raw").alias("avg_idf"))
    terms = raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, F.lit(EPSILON) * F.col("avg_idf")).otherwise(F.col("raw")).alias("idf"))
    return BM25Index(postings, lengths, terms, size.crossJoin(F.broadcast(mean)))


def scores(index: BM25Index, queries: DataFrame, query_id: str, text: str) -> DataFrame:
    """``(query_id, pos, score)`` of all documents that share a word with the query; repeated words count again."""
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(tokenize(F.col(text))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    distinct = asked.select("term").distinct()
    some = [r["term"] for r in distinct.limit(PUSHED_WORDS + 1).collect()]
    few = len(some) <= PUSHED_WORDS
    terms = index.terms.select("term", "idf")
    weighed = asked.join(terms.where(F.col("term").isin(some)) if few else terms, "term")
    if asked.limit(SENT_WORDS + 1).count() <= SENT_WORDS:
        weighed = F.broadcast(weighed)
    avgdl = F.broadcast(index.corpus.select("avgdl"))
    postings = index.postings.where(F.col("term").isin(some)) if few else index.postings
    hits = postings.crossJoin(avgdl).select("term", "pos", (F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))).alias("w"))
    part = F.round(F.col("qtf") * F.col("idf") * F.col("w") * SCALE).cast("long")
    return hits.join(weighed, "term").groupBy("query_id", "pos").agg(F.sum(part).alias("s")).select("query_id", "pos", (F.col("s") / SCALE).alias("score"))


def topk(index: BM25Index, queries: DataFrame, query_id: str = "query_id", text: str = "query", k: int = 50) -> DataFrame:
    """``(query_id, pos, score, rank)``, the ``k`` best documents of each query, equal scores in the order of ``pos``.

    As documents without a common word score 0 and still take places, the first ``k`` documents by ``pos`` are
    added with 0 where they have no positive score: with m positive ones, the last k - m places are among them.
    Queries without a word have no result; a null query id is a query of its own.
    """
    if k < 0:
        raise BM25RetrievalError("k must not be negative")
    hit = scores(index, queries, query_id, text).where("score > 0")
    first = index.lengths.orderBy("pos").limit(k).select("pos")  # k rows
    some = queries.select(F.col(query_id).alias("query_id")).where(F.size(tokenize(queries[text])) > 0).distinct()
    zero = some.crossJoin(F.broadcast(first)).join(hit.select("query_id", "pos"), ["query_id", "pos"], "left_anti").withColumn("score", F.lit(0.0))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "pos")
    return hit.unionByName(zero).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def topk_scan(index: BM25Index, docs: DataFrame, queries: DataFrame, pos: str, text: str, query_id: str = "query_id", query: str = "query", k: int = 50) -> DataFrame:
    """:func:`topk` for many queries: one pass over the documents instead of a join with their postings.

    With thousands of queries nearly every document shares a word with each of them, and a join would shuffle the
    product. Here the queries, a stated set, are sent in blocks of ``QUERY_BLOCK``; each task scores its documents
    against them block by block and shuffles the best ``k`` of each query only. The result is the same.
    """
    if k < 0:
        raise BM25RetrievalError("k must not be negative")
    spark = docs.sparkSession
    asked = queries.select(F.col(query_id).alias("q"), tokenize(F.col(query)).alias("w")).where(F.size("w") > 0)
    wanted = asked.select(F.explode("w").alias("term")).distinct()
    idf = {r["term"]: r["idf"] for r in index.terms.join(wanted, "term", "left_semi").toLocalIterator()}  # words of the queries
    avgdl = index.corpus.first()["avgdl"] or 1.0

    def blocks() -> Iterator[list]:
        """The queries, fetched row by row; only one block is held."""
        held: list = []
        for r in asked.toLocalIterator():
            held.append((r["q"], r["w"]))
            if len(held) == QUERY_BLOCK:
                yield held
                held = []
        yield held

    kinds = T.StructType([T.StructField("query_id", queries.schema[query_id].dataType), T.StructField("pos", docs.schema[pos].dataType), T.StructField("score", T.DoubleType())])
    rows = spread(docs.select(F.col(pos).alias("pos"), F.col(text).alias("text"))).select("pos", tokenize(F.col("text")).alias("words"))

    def one(block: list) -> DataFrame:
        term_of: dict[str, int] = {}
        hits: list[list[tuple[int, float]]] = []
        for i, (_, words) in enumerate(block):
            for w, n in Counter(words).items():
                if w in idf:
                    t = term_of.setdefault(w, len(term_of))
                    if t == len(hits):
                        hits.append([])
                    hits[t].append((i, n * idf[w]))
        by_term = [(np.array([i for i, _ in h]), np.array([v for _, v in h])) for h in hits]
        sent = spark.sparkContext.broadcast(([q for q, _ in block], term_of, by_term))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, term_of, by_term = sent.value
            best = StreamTopK(len(ids), k)
            for batch in batches:
                for a in range(0, batch.num_rows, ROWS):
                    part = batch.slice(a, ROWS)
                    _score_block(best, np.array(part.column(0).to_pylist()), part.column(1).to_pylist(), term_of, by_term, avgdl)
            yield from best.rows(ids, kinds, SCALE)

        return few_tasks(rows).mapInArrow(run, kinds)

    found = reduce(DataFrame.unionByName, map(one, blocks()))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "pos")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _score_block(best: StreamTopK, names: np.ndarray, words: list[list[str]], term_of: dict[str, int], by_term: list, avgdl: float) -> None:
    n = len(names)
    get = term_of.get
    cells = np.array([t * n + d for d, ws in enumerate(words) for w in ws if (t := get(w)) is not None], np.int64)
    cells, tf = np.unique(cells, return_counts=True)
    term, doc = cells // n, cells % n
    dl = np.array([len(ws) for ws in words], np.float64)
    weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[doc] / avgdl))
    starts = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.zeros(0, int)
    runs = list(zip(starts, [*starts[1:], len(term)]))

    def scores(a: int, b: int) -> np.ndarray:
        s = np.zeros((b - a, n), np.int64)
        for x, y in runs:
            q, v = by_term[term[x]]
            i, j = np.searchsorted(q, (a, b))
            if i < j:
                s[(q[i:j] - a)[:, None], doc[x:y]] += np.rint(v[i:j, None] * weight[x:y] * SCALE).astype(np.int64)
        return s

    best.add(scores, names)
