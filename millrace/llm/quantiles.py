"""Mergeable percentiles with a tracked rank error (problem 3).

Method: deterministic rank-interval tuple summaries. A summary of n values is a sorted list of tuples
``(v, lo, hi)``: ``v`` is a value of the data and its rank (1..n, after sorting) lies in ``[lo, hi]``.
Summaries are made per task while the rows stream by, compressed to the permitted uncertainty, and
merged hierarchically (task, then salt, then group); each step adds its uncertainty to the intervals,
so the error of every answer is known exactly instead of being assumed.

* merge: a tuple's bounds add up with those of its neighbours in the other summary:
  ``lo = lo_a + lo_b(predecessor)``, ``hi = hi_a + hi_b(successor) - 1`` (no successor: ``n_b``).
* compress: keep the tuples nearest to ``size`` evenly spaced ranks and both ends. Keeping a tuple
  never changes its interval, only the gaps between the tuples grow.
* query: the answer for rank r is the tuple with the least ``max(r - lo, hi - r)``; that number is
  returned as ``rank_error`` (in rows). Every compression adds at most ``1 / (2 * size)`` of the rows it
  has seen to the error, and a value passes one when it is buffered, one a level of each merge tree, and one at the end of each
  tree. ``LEVELS`` of them stay below ``epsilon * n`` with ``size = LEVELS / (2 * epsilon)``; all trees are balanced, so that
  is enough for 2^24 buffers of ``BUFFER_ROWS`` values (4 * 10^12) in three stages and two further merges of days or parts.

Groups of at most ``size`` values are exact. Defined cases: null values are left out, NaN counts as
the largest value, infinities are values like any other; a null group is a group of its own; a group
without values and an empty table give no row; ties keep their order by value; columns other than
those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPSILON = 0.002
#: Compressions a value may pass for the bound to hold.
LEVELS = 32
#: Values buffered per task before they become summaries.
BUFFER_ROWS = 262_144
PERCENTILES = (0.5, 0.9, 0.95, 0.99)

Summary = tuple[np.ndarray, np.ndarray, np.ndarray]  # values, lo, hi


def exact(values: np.ndarray) -> Summary:
    """The summary of raw values: every value with its own rank."""
    v = np.sort(values)  # NaN last
    r = np.arange(1, len(v) + 1, dtype=np.int64)
    return v, r, r


def count(s: Summary) -> int:
    return int(s[2][-1])


def merge(a: Summary, b: Summary) -> Summary:
    """The summary of both inputs together; interval widths add up, none is lost."""
    na, nb = count(a), count(b)
    out = []
    for (v, lo, hi), (w, wlo, whi), n, side in ((a, b, nb, "left"), (b, a, na, "right")):
        # ties: the first input's values stand before equal ones of the second
        k = np.searchsorted(w, v, side=side)
        pad_lo, pad_hi = np.concatenate(([0], wlo)), np.concatenate((whi - 1, [n]))
        out.append((v, lo + pad_lo[k], hi + pad_hi[k]))
    v, lo, hi = (np.concatenate(x) for x in zip(*out))
    order = np.lexsort((hi, lo, v))
    return v[order], lo[order], hi[order]


def compress(s: Summary, size: int) -> Summary:
    """At most ``size + 2`` tuples: those nearest to evenly spaced ranks, and both ends."""
    v, lo, hi = s
    if len(v) <= size + 2:
        return s
    n, mid = count(s), (lo + hi) / 2
    want = np.linspace(1, n, size)
    k = np.clip(np.searchsorted(mid, want), 1, len(mid) - 1)
    k -= (want - mid[k - 1]) < (mid[k] - want)
    keep = np.unique(np.concatenate(([0], k, [len(v) - 1])))
    return v[keep], lo[keep], hi[keep]


def query(s: Summary, q: float) -> tuple[float, int, int]:
    """``(value, rank, rank_error)`` of quantile ``q``: rank ``max(1, ceil(q * n))``, as percentile_disc has it."""
    v, lo, hi = s
    r = max(1, int(np.ceil(round(q * count(s), 9))))
    worst = np.maximum(r - lo, hi - r)
    i = int(np.argmin(worst))
    return float(v[i]), r, max(0, int(worst[i]))


def _schema(df: DataFrame, groups: Sequence[str]) -> T.StructType:
    own = [T.StructField(g, df.schema[g].dataType) for g in groups]
    return T.StructType([*own, T.StructField("values", T.ArrayType(T.DoubleType())), T.StructField("lo", T.ArrayType(T.LongType())), T.StructField("hi", T.ArrayType(T.LongType()))])


def _rows(schema: T.StructType, keys: list[tuple], summaries: list[Summary]) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema)
    own = len(schema) - 3
    columns = [pa.array([k[i] for k in keys], kinds.field(i).type) for i in range(own)]
    columns += [pa.array([s[j] for s in summaries], kinds.field(own + j).type) for j in range(3)]
    return pa.RecordBatch.from_arrays(columns, schema=kinds)


class _Running:
    """Summaries by group of the rows seen so far; memory is bounded by groups * size plus the buffer."""

    def __init__(self, size: int):
        self.size, self.by = size, {}

    def add(self, key: tuple, s: Summary) -> None:
        s = compress(s, self.size)
        self.by[key] = compress(merge(self.by[key], s), self.size) if key in self.by else s


def partial_summaries(df: DataFrame, value: str, groups: Sequence[str], size: int) -> DataFrame:
    """One summary per group and task, made while the rows stream by; no shuffle."""
    narrow = df.select(*groups, F.col(value).cast("double").alias("__value")).where(F.col("__value").isNotNull())
    schema = _schema(narrow, groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a buffer is summarised by a tree of doubling sizes, so a value passes log2(buffers) compressions at most
        levels: list[dict] = []

        def flush(held: list[pa.RecordBatch]) -> None:
            t = pa.Table.from_batches(held)
            codes, keys = None, []
            for i in range(len(groups)):
                d = t.column(i).combine_chunks().dictionary_encode("encode")
                d = d.combine_chunks() if isinstance(d, pa.ChunkedArray) else d
                c, names = d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary.to_pylist()
                codes = c if codes is None else codes * len(names) + c
                keys.append(names)
            v = t.column(len(groups)).to_numpy()
            codes = np.zeros(len(v), np.int64) if codes is None else codes
            order = np.lexsort((v, codes))
            codes, v = codes[order], v[order]
            starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
            run_: dict = {}
            for a, b in zip(starts, [*starts[1:], len(v)]):
                code, key = int(codes[a]), []
                for names in reversed(keys):
                    code, k = divmod(code, len(names))
                    key.append(names[k])
                run_[tuple(reversed(key))] = compress(exact(v[a:b]), size)
            level = 0
            while level < len(levels) and levels[level]:
                run_ = _join(levels[level], run_, size)
                levels[level] = {}
                level += 1
            if level == len(levels):
                levels.append({})
            levels[level] = run_

        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= BUFFER_ROWS:
                flush(held)
                held, rows = [], 0
        if rows:
            flush(held)
        total: dict = {}
        for level in levels:
            total = _join(total, level, size)
        if total:
            yield _rows(schema, list(total), list(total.values()))

    return narrow.mapInArrow(run, schema)


def _join(a: dict, b: dict, size: int) -> dict:
    out = dict(a)
    for k, s in b.items():
        out[k] = compress(merge(out[k], s), size) if k in out else s
    return out


def merge_summaries(summaries: DataFrame, groups: Sequence[str], size: int, fan_in: int = 64) -> DataFrame:
    """One summary per group out of many, by a tree of ``fan_in``: salted first, then by group.

    Summaries of separate days, parts or runs are merged the same way.
    """
    schema = _schema(summaries, groups)
    n = len(groups)

    def tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _Running(size)
        pending: dict = {}
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(n)]
            for i in range(batch.num_rows):
                key = tuple(c[i] for c in columns)
                s = (np.asarray(batch.column(n)[i].values, dtype=float), np.asarray(batch.column(n + 1)[i].values), np.asarray(batch.column(n + 2)[i].values))
                level = pending.setdefault(key, [])
                depth = 0
                while depth < len(level) and level[depth] is not None:  # binary counter: balanced merges
                    s, level[depth] = compress(merge(level[depth], s), size), None
                    depth += 1
                level[depth : depth + 1] = [s]
        for key, level in pending.items():
            for s in level:
                if s is not None:
                    got.add(key, s)
        if got.by:
            yield _rows(schema, list(got.by), list(got.by.values()))

    columns = [*groups, "values", "lo", "hi"]
    salted = summaries.select(*columns).withColumn("__salt", F.spark_partition_id() % F.lit(fan_in))
    first = salted.repartition(*groups, "__salt").select(*columns).mapInArrow(tree, schema)
    if not n:
        return first.repartition(1).mapInArrow(tree, schema)
    return first.repartition(*groups).mapInArrow(tree, schema)


def tuples(epsilon: float, levels: int = LEVELS) -> int:
    """Tuples a summary keeps for an error of ``epsilon`` after ``levels`` compressions."""
    return int(np.ceil(levels / (2 * epsilon)))


def summarize(df: DataFrame, value: str, groups: Sequence[str], epsilon: float = EPSILON) -> DataFrame:
    """``groups + (values, lo, hi)``: the rank-interval summary of each group."""
    size = tuples(epsilon)
    return merge_summaries(partial_summaries(df, value, groups, size), groups, size)


def percentiles(summaries: DataFrame, groups: Sequence[str], quantiles: Sequence[float] = PERCENTILES) -> DataFrame:
    """``groups + (n, quantile, value, rank, rank_error)``, one row per group and quantile; map-only."""
    narrow = summaries.select(*groups, "values", "lo", "hi")
    own = [narrow.schema[g] for g in groups]
    schema = T.StructType([*own, T.StructField("n", T.LongType()), T.StructField("quantile", T.DoubleType()), T.StructField("value", T.DoubleType()), T.StructField("rank", T.LongType()), T.StructField("rank_error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, (flat, lo, hi) = len(groups), (batch.column(len(groups) + i).flatten().to_numpy(zero_copy_only=False) for i in range(3))
            ends = np.cumsum(batch.column(at).value_lengths().to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros(0, int)
            found = []
            for a, b in zip([0, *ends[:-1]], ends):
                s = flat[a:b], lo[a:b], hi[a:b]
                found += [(count(s), q, *query(s, q)) for q in quantiles]
            row = pa.array(np.repeat(np.arange(batch.num_rows), len(quantiles)))
            columns = [batch.column(i).take(row) for i in range(at)] + [pa.array(list(x), k) for x, k in zip(zip(*found) if found else [()] * 5, (pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return narrow.mapInArrow(run, schema)


def once(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``key + columns`` with each ``key`` counted once, of unlike rows the greatest; a row without a key is a row of its own."""
    named = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*columns)).alias("__row")).select(key, *[F.col(f"__row.{c}").alias(c) for c in columns])
    return named.unionByName(df.where(F.col(key).isNull()).select(key, *columns))
