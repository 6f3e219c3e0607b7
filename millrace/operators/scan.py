"""Vector and keyword rankings of many queries over many documents, and their fusion, without a shuffle of candidates.

The documents are written once to the shared folder, in the order of their positions: vector, length, and the words
that any query holds, as numbers. The queries are divided into slices, sorted by their words. Each task streams all
documents past its slice, so its rankings are complete and fused in place; only the result leaves it, and memory
is bounded by a slice, its held rows and a block of documents. Every query meets every document.

Both scores are first computed in single precision; a pair is left out only where that score, with the bound of its
error, can't reach the k-th exact one held. The others are scored as in ``dense`` and ``bm25``, as whole numbers
of 1e-9. As documents come in the order of their positions, a later one of equal score never takes a place.
Queries with the same known words share one ranking by words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import tokenize
from millrace.operators import bm25, dense
from millrace.plans.runtime import checkpoint, shuffle_partitions, spread

#: Queries of a slice; documents read at once; rows and columns of a block of scores, by vectors and by words.
SLICE, READ, NEAR, WORDS = 16_000, 16_384, (256, 2_048), (256, 8_192)
#: Candidates that are held before they are merged, and scored at once.
HELD, EXACT = 3_000_000, 50_000
#: Single against double precision: vectors of length 1 and up to ``dense.DIGITS`` digits; a sum of words, of its terms' sizes, a word.
NEAR_ERROR, WORD_ERROR = 1e-5, 2.0**-22
#: A product of matrices handles so many cells in the time of one cell that is added by its index.
CHEAPER = 240
NONE = np.iinfo(np.int64).min


class Best:
    """The best k (query, position) pairs of each query; candidates come in the order of their positions."""

    def __init__(self, queries: int, k: int):
        self.n, self.k = queries, k
        self.q, self.s, self.p = (np.zeros(0, np.int64) for _ in range(3))
        self.floor = np.full(queries, NONE)
        self.new: list[tuple] = []
        self.count = self.seen = 0

    def add(self, q: np.ndarray, s: np.ndarray, p: np.ndarray) -> None:
        good = s > self.floor[q]
        if good.any():
            self.new.append((q[good], s[good], p[good]))
            self.count += len(self.new[-1][0])

    def block_done(self, end: int) -> bool:
        """Merges when the documents seen have doubled or many candidates wait; whether the floors may have risen."""
        if end < 2 * self.seen and self.count < HELD:
            return False
        self.seen = end
        return self.merge()

    def merge(self) -> bool:
        if not self.new:
            return False
        q, s, p = (np.concatenate(x) for x in zip((self.q, self.s, self.p), *self.new))
        order = np.lexsort((-s, q.astype(np.uint16) if self.n <= 65536 else q))  # stable: equal scores stay in the order of positions
        q, s, p = q[order], s[order], p[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < self.k
        self.q, self.s, self.p = q[keep], s[keep], p[keep]
        last = place == self.k - 1
        self.floor[q[last]] = s[last]
        self.new, self.count = [], 0
        return True

    def ranks(self) -> np.ndarray:
        return np.arange(len(self.q)) - np.searchsorted(self.q, self.q) + 1


def _found(scores: np.ndarray, least: np.ndarray, k: int, slack: np.ndarray | float, first: bool, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of a block that may be among the best; ``least`` is what each row's must reach. ``first``: nothing is held yet."""
    if first and scores.shape[1] > k:
        least = np.maximum(least, np.partition(scores, -k, axis=1)[:, -k, None] - 2 * slack)
    np.greater_equal(scores, least, out=mask)
    if mask.size % 8:
        at = np.flatnonzero(mask)
    else:  # few cells are true: eight at once
        some = np.flatnonzero(mask.reshape(-1).view(np.uint64))
        row, bit = np.nonzero(mask.reshape(-1, 8)[some])
        at = some[row] * 8 + bit
    return np.divmod(at, scores.shape[1])


class Near:
    """The ranking by vectors."""

    def __init__(self, vectors: np.ndarray, k: int):
        self.unit = dense._unit(vectors)
        self.single = self.unit.astype(np.float32)
        self.best = Best(len(vectors), k)
        self.scores, self.mask = np.empty(NEAR[0] * NEAR[1], np.float32), np.empty(NEAR[0] * NEAR[1], bool)
        self._raise()

    def _raise(self) -> None:
        f = self.best.floor
        self.least = np.where(f == NONE, -np.inf, f / 10.0**dense.DIGITS - NEAR_ERROR).astype(np.float32)[:, None]

    def add(self, unit: np.ndarray, at: np.ndarray, end: int) -> None:
        if not self.best.k or not len(self.unit):
            return
        first = not self.best.seen
        turned = [np.ascontiguousarray(unit[c : c + NEAR[1]].T, np.float32) for c in range(0, len(unit), NEAR[1])]
        for a in range(0, len(self.unit), NEAR[0]):
            part, least = self.single[a : a + NEAR[0]], self.least[a : a + NEAR[0]]
            i, j = [], []
            for c, x in enumerate(turned):
                shape = len(part), x.shape[1]
                scores, mask = (b[: shape[0] * shape[1]].reshape(shape) for b in (self.scores, self.mask))
                np.matmul(part, x, out=scores)
                row, col = _found(scores, least, self.best.k, NEAR_ERROR, first, mask)
                i.append(row + a)
                j.append(col + c * NEAR[1])
            if not i:
                continue
            i, j = np.concatenate(i), np.concatenate(j)
            for z in range(0, len(i), EXACT):
                y = slice(z, z + EXACT)
                s = np.rint(np.einsum("ij,ij->i", self.unit[i[y]], unit[j[y]]) * 10.0**dense.DIGITS).astype(np.int64)
                self.best.add(i[y], s, at[j[y]])
        if self.best.block_done(end):
            self._raise()


class Words:
    """The ranking by words of different bags of words, each a sorted tuple of numbers below ``len(idf)``."""

    def __init__(self, bags: list[tuple[int, ...]], idf: np.ndarray, avgdl: float, k: int):
        self.idf, self.avgdl, self.k = idf, avgdl, k
        self.best = Best(len(bags), k)
        counted = [Counter(b) for b in bags]
        self.width = max(map(len, counted), default=0)
        self.term, self.value = np.full((len(bags), self.width), -1, np.int64), np.zeros((len(bags), self.width))
        for i, c in enumerate(counted):
            for x, (t, n) in enumerate(c.items()):
                self.term[i, x], self.value[i, x] = t, n * idf[t]
        #: Without a negative word, documents that share none are left to :meth:`filled`.
        self.positive = not (self.value < 0).any()
        sizes = np.abs(self.value).sum(axis=1) * (bm25.K1 + 1)
        self.slack = (sizes * (self.width + 8) * WORD_ERROR + self.width / bm25.SCALE)[:, None]
        self.by_term = []
        for a in range(0, len(bags), WORDS[0]):
            row, x = np.nonzero(self.term[a : a + WORDS[0]] >= 0)
            t = self.term[row + a, x]
            order = np.argsort(t, kind="stable")
            terms, start = np.unique(t[order], return_index=True)
            self.by_term.append((terms, np.append(start, len(t)), row[order], self.value[row + a, x][order].astype(np.float32)))
        self.scores, self.mask = np.empty(WORDS[0] * WORDS[1], np.float32), np.empty(WORDS[0] * WORDS[1], bool)
        self._raise()

    def _raise(self) -> None:
        f = self.best.floor[:, None]
        least = np.where(f == NONE, -np.inf, f / bm25.SCALE - self.slack)
        self.least = np.maximum(least, 1e-30 if self.positive else -np.inf).astype(np.float32)

    def add(self, term: np.ndarray, tf: np.ndarray, doc: np.ndarray, dl: np.ndarray, start: int) -> None:
        if not self.k or not len(self.term):
            return
        for c in range(0, len(dl), WORDS[1]):
            x, y = np.searchsorted(doc, (c, c + WORDS[1]))
            self._block(term[x:y], tf[x:y], doc[x:y] - c, dl[c : c + WORDS[1]].astype(np.float64), start + c, not self.best.seen and not c)
        if self.best.block_done(start + len(dl)):
            self._raise()

    def _block(self, term: np.ndarray, tf: np.ndarray, doc: np.ndarray, dl: np.ndarray, start: int, first: bool) -> None:
        n = len(dl)
        order = np.argsort(term, kind="stable")
        term, tf, doc = term[order].astype(np.int64), tf[order], doc[order]
        weight = tf * (bm25.K1 + 1) / (tf + bm25.K1 * (1 - bm25.B + bm25.B * dl[doc] / self.avgdl)) if len(tf) else np.zeros(0)
        cells, single = term * n + doc, weight.astype(np.float32)
        for s, (terms, starts, rows, values) in enumerate(self.by_term):
            a = s * WORDS[0]
            height = min(WORDS[0], len(self.term) - a)
            shape = height, n
            scores, mask = (b[: height * n].reshape(shape) for b in (self.scores, self.mask))
            x, y = np.searchsorted(term, terms), np.searchsorted(term, terms, "right")
            work = (y - x) * np.diff(starts)
            whole = np.flatnonzero(work * CHEAPER > height * n)
            left, right = np.zeros((height, len(whole)), np.float32), np.zeros((len(whole), n), np.float32)
            for w, t in enumerate(whole):
                left[rows[starts[t] : starts[t + 1]], w] = values[starts[t] : starts[t + 1]]
                right[w, doc[x[t] : y[t]]] = single[x[t] : y[t]]
            np.matmul(left, right, out=scores)
            flat = scores.reshape(-1)
            for t in np.flatnonzero((work > 0) & (work * CHEAPER <= height * n)):
                r, v, d, u = rows[starts[t] : starts[t + 1]], values[starts[t] : starts[t + 1]], doc[x[t] : y[t]], single[x[t] : y[t]]
                flat[(r[:, None] * n + d).reshape(-1)] += (v[:, None] * u).reshape(-1)
            i, j = _found(scores, self.least[a : a + height], self.k, self.slack[a : a + height], first, mask)
            for z in range(0, len(i), EXACT):
                row, col = i[z : z + EXACT] + a, j[z : z + EXACT]
                total = np.zeros(len(row), np.int64)
                for w in range(self.width):
                    t = self.term[row, w]
                    if len(cells):
                        cell = t * n + col
                        hit = np.minimum(np.searchsorted(cells, cell), len(cells) - 1)
                        good = (cells[hit] == cell) & (t >= 0)
                        total += np.where(good, np.rint(self.value[row, w] * weight[hit] * bm25.SCALE), 0).astype(np.int64)
                if self.positive:
                    row, col, total = (v[total > 0] for v in (row, col, total))
                self.best.add(row, total, col + start)

    def filled(self, documents: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bag, position, rank), with the first documents at 0 where fewer than k share a word."""
        b = self.best
        b.merge()
        if self.positive and self.k:
            short = np.flatnonzero(np.bincount(b.q, minlength=b.n) < self.k)
            m = min(self.k, documents)
            q, p = np.repeat(short, m), np.tile(np.arange(m), len(short))
            fresh = ~np.isin(q * (documents + 1) + p, b.q * (documents + 1) + b.p)
            b.new, b.count = [(q[fresh], np.zeros(fresh.sum(), np.int64), p[fresh])], 1
            b.merge()
        return b.q, b.p, b.ranks()


def fuse(lists: list[tuple[np.ndarray, np.ndarray, np.ndarray]], documents: int, constant: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, position, score, rank) of two lists (query, position, rank): ``fusion.rrf`` on arrays."""
    (q0, p0, r0), (q1, p1, r1) = lists
    pairs, at = np.unique(np.concatenate((q0, q1)) * max(documents, 1) + np.concatenate((p0, p1)), return_inverse=True)
    none = np.iinfo(np.int64).max
    rank = np.full((2, len(pairs)), none)
    rank[0, at[: len(q0)]], rank[1, at[len(q0) :]] = r0, r1
    per = [np.where(r == none, 0.0, 1.0 / (constant + r.astype(np.float64))) for r in rank]
    score = per[0] + per[1]
    q, p = np.divmod(pairs, max(documents, 1))
    order = np.lexsort((rank[1], rank[0], -score, q))
    q, p, score = q[order], p[order], score[order]
    place = np.arange(len(q)) - np.searchsorted(q, q) + 1
    keep = place <= k
    return q[keep], p[keep], score[keep], place[keep]


def _batches(files: list[str], columns: list[str]) -> Iterator[pa.RecordBatch]:
    import pyarrow.parquet as pq
    from pyarrow.fs import FileSystem

    for f in files:
        system, path = FileSystem.from_uri(f)
        with system.open_input_file(path) as opened:
            yield from pq.ParquetFile(opened).iter_batches(READ, columns=columns, use_threads=False)


def _growing(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Each batch and the documents before it; the first ones are cut, so that there soon is something to compare with."""
    n = 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, max(NEAR[1], n))
            yield n, part
            at, n = at + part.num_rows, n + part.num_rows


def _vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a vector, and those."""
    has = np.asarray(column.is_valid().to_numpy(zero_copy_only=False))
    return np.flatnonzero(has), column.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _usable(vector: str, dim: int) -> F.Column:
    v = F.col(vector).cast("array<float>")
    return F.when((F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull()), v)


def hybrid(index: bm25.BM25Index, docs: DataFrame, queries: DataFrame, pos: str, vector: str, text: str, query_id: str, query: str, query_vector: str, k: int, near_k: int, words_k: int, threshold: float | None, constant: int, dim: int) -> DataFrame:
    """``(query_id, pos, score, rank)``: the ``k`` best of both rankings of each query, fused as in ``fusion.rrf``."""
    spark = docs.sparkSession
    asked = queries.select(F.col(query_id).alias("query_id"), _usable(query_vector, dim).alias("v"), tokenize(F.col(query)).alias("words"))
    wanted = asked.select(F.explode("words").alias("term")).distinct()
    known = index.terms.join(wanted, "term", "left_semi").orderBy(F.desc("df"), "term").select("term", "idf")  # words of the queries, the commonest first
    terms, idf = [], []
    for r in known.toLocalIterator():
        terms.append(r["term"])
        idf.append(r["idf"])
    sent = spark.sparkContext.broadcast((pa.array(terms, pa.string()), np.array(idf, np.float64)))
    avgdl = index.corpus.first()["avgdl"] or 1.0
    name, kind = asked.schema["query_id"].dataType, docs.schema[pos].dataType
    floats, ints = T.ArrayType(T.FloatType()), T.ArrayType(T.IntegerType())

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, _ = sent.value
        for batch in batches:
            words = batch.column(2)
            size = words.value_lengths().to_numpy()
            t = pc.fill_null(pc.index_in(words.flatten(), value_set=terms), -1).to_numpy()
            row, t = np.repeat(np.arange(len(size)), size)[t >= 0], t[t >= 0]
            ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(size))))).astype(np.int32)
            bags = pa.ListArray.from_arrays(pa.array(ends), pa.array(t[np.lexsort((t, row))], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), bags, pa.array(size, pa.int32())], ["id", "v", "bag", "dl"])

    shape = lambda t: T.StructType([T.StructField("id", t), T.StructField("v", floats), T.StructField("bag", ints), T.StructField("dl", T.IntegerType())])
    cores = spark.sparkContext.defaultParallelism
    rows = docs.select(F.col(pos).alias("id"), _usable(vector, dim).alias("v"), F.col(text).alias("text")).repartitionByRange(max(4 * cores, shuffle_partitions(spark)), "id").sortWithinPartitions("id")
    files = sorted(checkpoint(rows.select("id", "v", bm25.words(rows, "text").alias("words")).mapInArrow(numbered, shape(kind))).inputFiles())
    slices = checkpoint(spread(asked).mapInArrow(numbered, shape(name)))
    parts = cores * max(1, -(-slices.count() // (SLICE * cores)))
    out = T.StructType([T.StructField("query_id", name), T.StructField("pos", kind), T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 2 * SLICE:
                yield from _slice(pa.Table.from_batches(held), files, sent.value[1], avgdl, near_k, words_k, threshold, constant, k, dim, out)
                held = []
        if held:
            yield from _slice(pa.Table.from_batches(held), files, sent.value[1], avgdl, near_k, words_k, threshold, constant, k, dim, out)

    return slices.repartitionByRange(parts, "bag", "id").sortWithinPartitions("bag", "id").mapInArrow(run, out)


def _slice(asked: pa.Table, files: list[str], idf: np.ndarray, avgdl: float, near_k: int, words_k: int, threshold: float | None, constant: int, k: int, dim: int, out: T.StructType) -> Iterator[pa.RecordBatch]:
    from pyspark.sql.pandas.types import to_arrow_schema

    asked = asked.combine_chunks()
    ids, v, bag, dl = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in asked.columns)
    with_vector, vectors = _vectors(v, dim)
    with_words = np.flatnonzero(dl.to_numpy() > 0)
    bag_of: dict[tuple, int] = {}
    all_bags = bag.to_pylist()
    mine = np.array([bag_of.setdefault(tuple(all_bags[i]), len(bag_of)) for i in with_words], np.int64)
    near, words = Near(vectors, near_k), Words(list(bag_of), idf, avgdl, words_k)
    documents = 0
    for start, batch in _growing(_batches(files, ["v", "bag", "dl"])):
        has, x = _vectors(batch.column(0), dim)
        documents = start + batch.num_rows
        near.add(dense._unit(x), has + start, documents)
        terms, sizes = batch.column(1).flatten().to_numpy(), batch.column(1).value_lengths().to_numpy()
        cells, tf = np.unique(np.repeat(np.arange(batch.num_rows), sizes) * len(idf) + terms, return_counts=True)
        words.add(cells % max(len(idf), 1), tf, cells // max(len(idf), 1), batch.column(2).to_numpy(), start)
    near.best.merge()
    q, p, rank = near.best.q, near.best.p, near.best.ranks()
    if threshold is not None:
        good = near.best.s / 10.0**dense.DIGITS >= threshold
        q, p, rank = q[good], p[good], rank[good]
    b, bp, brank = words.filled(documents)
    first, last = np.searchsorted(b, mine), np.searchsorted(b, mine, "right")
    size = last - first
    at = np.repeat(first - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum()) if len(size) else np.zeros(0, np.int64)
    q, p, score, rank = fuse([(with_vector[q], p, rank), (np.repeat(with_words, size), bp[at], brank[at])], documents, constant, k)
    needed, at = np.unique(p, return_inverse=True)
    kinds = to_arrow_schema(out)
    names, n = [], 0
    for batch in _batches(files, ["id"]):
        x, y = np.searchsorted(needed, (n, n + batch.num_rows))
        names.append(batch.column(0).take(pa.array(needed[x:y] - n)))
        n += batch.num_rows
    named = pa.concat_arrays(names) if names else pa.array([], kinds.field(1).type)
    for z in range(0, len(q), 100_000):
        y = slice(z, z + 100_000)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(q[y])).cast(kinds.field(0).type), named.take(pa.array(at[y])).cast(kinds.field(1).type), pa.array(score[y]), pa.array(rank[y], pa.int32())], schema=kinds)
