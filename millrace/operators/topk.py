"""The best k rows of many queries at once, while the rows stream by.

Scores are whole numbers, and equal ones are in the order of the rows' positions, so the result does not depend on
how the rows are split. Memory is bounded by queries * k held rows and one block of queries * rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Queries and rows of one block of scores, and tasks of a scan for each core.
QUERIES, ROWS = 1_000, 2_048
TASKS_PER_CORE = 4


def few_tasks(rows: DataFrame) -> DataFrame:
    """``rows`` in few, long tasks: each gives its best k of every query, so what is shuffled is bounded by the
    cores and not by the number of the files' pieces."""
    return rows.coalesce(TASKS_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism)


class StreamTopK:
    """Held rows of each query: ``q`` (sorted), ``score`` (descending within a query) and ``pos``."""

    def __init__(self, queries: int, k: int):
        self.n, self.k = queries, k
        self.q, self.score, self.pos = np.zeros(0, np.int64), np.zeros(0, np.int64), None

    def add(self, scores: Callable[[int, int], np.ndarray], names: np.ndarray) -> None:
        """A block of at most ``ROWS`` rows named ``names``; ``scores(a, b)`` gives those of queries a..b as whole numbers."""
        if not len(names) or not self.k:
            return
        held = 0 if self.pos is None else len(self.pos)
        both = names if self.pos is None else np.concatenate((self.pos, names))
        _, rank = np.unique(both, return_inverse=True)
        mine, fresh = rank[:held], rank[held:]
        column = np.argsort(fresh, kind="stable")  # rows of the block in the order of their positions
        back = (ROWS - 1 - np.argsort(column, kind="stable")).astype(np.int64)
        floor, floor_rank = np.full(self.n, np.iinfo(np.int64).min), np.full(self.n, -1)
        if held:
            first = np.searchsorted(self.q, np.arange(self.n))
            full = np.flatnonzero(np.bincount(self.q, minlength=self.n) >= self.k)
            last = first[full] + self.k - 1
            floor[full], floor_rank[full] = self.score[last], mine[last]
        parts = [(self.q, self.score, np.arange(held))]
        for a in range(0, self.n, QUERIES):
            b = min(a + QUERIES, self.n)
            s = scores(a, b)
            key = s * ROWS + back  # unique within a query: the score, then the position
            if key.shape[1] > self.k:
                least = np.partition(key, key.shape[1] - self.k, axis=1)[:, -self.k, None]
                good = key >= least
            else:
                good = np.ones(key.shape, bool)
            f = floor[a:b, None]
            good &= (s > f) | (s == f) & (fresh[None, :] < floor_rank[a:b, None])
            i, j = np.nonzero(good)
            parts.append((i + a, s[i, j], j + held))
        q, s, at = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((rank[at], -s, q))
        q, s, at = q[order], s[order], at[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < self.k
        self.q, self.score, self.pos = q[keep], s[keep], both[at[keep]]

    def rows(self, ids: list, schema: T.StructType, scale: float, piece: int = 100_000) -> Iterator[pa.RecordBatch]:
        """The held rows as batches ``(query id, position, score)``."""
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        for a in range(0, len(self.q), piece):
            z = slice(a, a + piece)
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in self.q[z]], kinds.field(0).type), pa.array(self.pos[z].tolist(), kinds.field(1).type), pa.array(self.score[z] / scale)], schema=kinds)
