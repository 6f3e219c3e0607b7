"""Evaluation passages inside training documents (problem 7).

Method: a window of ``WINDOW`` words is embedded by a CGK random walk (Chakraborty, Goldenberg and
Koucky, 2016): at each of ``3 * WINDOW`` steps the current word is written out, and a random bit that
depends on the step and the word says whether the walk moves on. Few edits between two windows become
few differing positions. ``REPEATS`` walks are sampled at ``SAMPLED`` positions each; windows of an item
and of a document that agree in one sample make the pair a candidate. With p the chance that a window
with one edit agrees in a sample, a passage is missed with (1 - p) ** REPEATS per window it covers.

Every candidate is then verified exactly on word level: at least ``RUN`` words of the item in a row with
at most one edit, or ``LONG_RUN`` with at most one in ``ONE_IN``. Windows of the document that cannot
agree with any item's are skipped by counts that no passage within these limits fails to meet.

Verified are stretches of document and item around the windows that agree, never whole texts: a passage of 60 item words or
more has a half that is within the limits too, so one of 59 words at most lies around a window, within ``REACH``.

The items are a stated set of fixed size: their index is broadcast in blocks of ``MAX_INDEX_WORDS`` words (640 bytes a
word at most, with the walks' steps), which are made one after another. The corpus is read once a block, map-only.

Words are cut at white space after look-alikes, accents, case and punctuation are folded.
Defined cases: null and empty texts hold no passage and are none; items with fewer than ``RUN`` words
cannot leak by this rule; repeated ids and items give one row; the document's other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.lookalike import mapping
from millrace.plans.runtime import spread

WINDOW = 15
RUN, LONG_RUN, ONE_IN = 15, 30, 7
REPEATS = 10
SAMPLED = 5
MAX_INDEX_WORDS = 250_000
#: Words around an agreeing window in which a shortest passage lies; document and item words of one verification, overlaps apart.
REACH = 2 * LONG_RUN + 2 * LONG_RUN // ONE_IN + 2
DOC_PIECE, ITEM_PIECE = 512, 1024
BATCH_WORDS = 400_000

_DROP = re.compile(r"[^\w\s]|_")
_table: dict[int, str] = {}


def words(text: str) -> list[str]:
    """Folded words of a text."""
    if not text:
        return []
    if not text.isascii():
        if not _table:
            import unicodedata

            _table.update({ord(c): "".join(x for x in s if not unicodedata.combining(x)) for c, s in mapping()[0].items()})
            _table.update({0x200C: "", 0x200D: "", 0x2013: " ", 0x2014: " "})
            _table.update({k: v.replace("\u2013", " ").replace("\u2014", " ") for k, v in _table.items()})
        mapped = [c for c in set(text) if ord(c) in _table]
        if len(mapped) > 64:
            text = text.translate(_table)
        else:  # a few replacements cost less than a look-up a character; no replacement holds a mapped character
            for c in mapped:
                text = text.replace(c, _table[ord(c)])
    return _DROP.sub("", text.lower()).split()


class Index:
    """The items' words as ids, their windows' samples, and the walks that made them."""

    def __init__(self, items: list[tuple], seed: int = 7):
        rng = np.random.default_rng(seed)
        by: dict[str, int] = {}
        self.keys, self.items = [], []
        for key, text in items:
            w = [by.setdefault(x, len(by) + 1) for x in words(text)]
            if len(w) >= RUN:
                self.keys.append(key)
                self.items.append(np.array(w, np.int32))
        self.vocabulary = by
        size = len(by) + 1
        self.flat = np.concatenate([*self.items, np.zeros(0, np.int32)])
        self.owner = np.repeat(np.arange(len(self.items)), [len(x) for x in self.items])
        self.starts = np.concatenate(([0], np.cumsum([len(x) for x in self.items]))).astype(np.int64)
        self.steps = rng.integers(0, 2, (REPEATS, 3 * WINDOW, size), dtype=np.uint8)
        self.places = np.sort(np.array([rng.choice(2 * WINDOW, SAMPLED, replace=False) for _ in range(REPEATS)]), axis=1)
        self.weights = rng.integers(1, 2**62, (REPEATS, SAMPLED), dtype=np.int64) | 1
        first = np.concatenate([np.arange(a, b - WINDOW + 1) for a, b in zip(self.starts[:-1], self.starts[1:])] or [np.zeros(0, np.int64)])
        self.samples = []
        for r in range(REPEATS):
            s = self.sample(self.flat, first, r)
            order = np.argsort(s, kind="stable")
            self.samples.append((s[order], first[order]))

    def sample(self, ids: np.ndarray, first: np.ndarray, r: int) -> np.ndarray:
        """Hashes of the sampled positions of walk ``r`` over the windows that begin at ``first``."""
        out = np.zeros(len(first), np.int64)
        at = first.astype(np.int64)
        end = at + WINDOW
        k = 0
        for step in range(int(self.places[r][-1]) + 1):
            here = np.where(at < end, ids[np.minimum(at, len(ids) - 1)], -1)
            if step == self.places[r][k]:
                out = (out ^ (here + 1)) * self.weights[r][k]
                out ^= out >> 29
                k += 1
            at += self.steps[r][step][here] & (here >= 0)
        return out

    def items_of(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Candidate (window number, place among all items' words) pairs."""
        got = []
        for r in range(REPEATS):
            s, place = self.samples[r]
            h = self.sample(ids, first, r)
            lo, hi = np.searchsorted(s, h, "left"), np.searchsorted(s, h, "right")
            n = hi - lo
            w = np.repeat(np.arange(len(h)), n)
            inner = np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)
            got.append((w, place[np.repeat(lo, n) + inner]))
        return tuple(np.concatenate(x) for x in zip(*got))


def _enough(known: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Owners whose words, of which these stand in the document, could hold a long passage: some run of ``n`` words of one
    owner, at least ``LONG_RUN``, with ``n // ONE_IN`` unknown at most. Runs of twice that have a half that could too."""
    at = np.concatenate(([0], np.cumsum(known)))
    found = []
    for n in range(LONG_RUN, min(2 * LONG_RUN, len(known) + 1)):
        first = np.flatnonzero((at[n:] - at[:-n] >= n - n // ONE_IN) & (owner[n - 1 :] == owner[: len(owner) - n + 1]))
        found.append(owner[first])
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def holds(item: np.ndarray, doc: np.ndarray) -> bool:
    """Exact verification: does the document hold a passage of the item within the limits?"""
    same = item[:, None] == doc[None, :]
    n, m = same.shape
    run = np.zeros((n + 2, m + 2), np.int32)  # exact words from (i, j) on
    for i in range(n - 1, -1, -1):
        run[i, :m] = np.where(same[i], run[i + 1, 1 : m + 1] + 1, 0)
    a = run[:n, :m]
    if a.max(initial=0) >= RUN:
        return True
    i, j = np.nonzero(a >= 1)
    i, j = i[keep := (i == 0) | (j == 0) | ~same[np.maximum(i - 1, 0), np.maximum(j - 1, 0)]], j[keep]
    x = a[i, j]
    e, f = i + x, j + x
    at = lambda p, q: run[np.minimum(p, n + 1), np.minimum(q, m + 1)]
    changed = np.where((e < n) & (f < m), x + 1 + at(e + 1, f + 1), 0)
    dropped = np.where(e < n, x + 1 + at(e + 1, f), 0)
    added = np.where(f < m, x + at(e, f + 1), 0)
    if max(v.max(initial=0) for v in (changed, dropped, added)) >= RUN:
        return True
    if not len(_enough(same.any(axis=1), np.zeros(n, np.int64))):
        return False
    # longest[e][i, j]: most item words of an alignment that ends before (i, j) with e edits
    columns = np.flatnonzero(same.any(axis=0))
    lo, hi = max(0, columns[0] - 2), columns[-1] + 3
    same = same[:, lo:hi]
    m = same.shape[1]
    before = np.zeros((n + 1, m + 1), np.int32)
    for i in range(1, n + 1):
        before[i, 1:] = np.where(same[i - 1], before[i - 1, :-1] + 1, 0)
    for e in range(1, n // ONE_IN + 1):
        now = np.zeros_like(before)
        for i in range(1, n + 1):
            best = np.maximum(before[i - 1, :-1], before[i - 1, 1:]) + 1  # changed, dropped
            best = np.maximum(best, before[i, :-1])  # added
            now[i, 1:] = np.maximum(best, np.where(same[i - 1], now[i - 1, :-1] + 1, 0))
        if now.max() >= max(LONG_RUN, ONE_IN * e):
            return True
        before = now
    return False


def _possible(index: Index, doc: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Of the candidate items those of which enough words stand in the document at all."""
    present = np.zeros(len(index.vocabulary) + 1, bool)
    present[doc] = True
    present[0] = False
    if not len(candidates):
        return np.zeros(0, np.int64)
    known = present[np.concatenate([index.items[c] for c in candidates])]
    owner = np.repeat(np.asarray(candidates), [len(index.items[c]) for c in candidates])
    at = np.concatenate(([0], np.cumsum(known)))
    short = np.flatnonzero((at[RUN:] - at[:-RUN] >= RUN - 1) & (owner[RUN - 1 :] == owner[: len(owner) - RUN + 1]))
    return np.union1d(owner[short], _enough(known, owner)).astype(np.int64)


def scan(index: Index, docs: list[tuple[object, str]]) -> Iterator[tuple[object, object]]:
    """``(document, item)`` pairs of one batch of documents."""
    get = index.vocabulary.get
    parts, starts, n = [], [], 0
    gap = [0] * WINDOW
    for _, text in docs:
        w = [get(x, 0) for x in words(text)]
        starts.append(n)
        parts.append(w)
        parts.append(gap)
        n += len(w) + WINDOW
    if not n:
        return
    ids = np.fromiter((x for p in parts for x in p), np.int32, n)
    known = np.concatenate(([0], np.cumsum(ids > 0)))
    # the best window of a passage has three edits at most (6 in 42 words can leave no better one), so WINDOW - 3 known words
    first = np.flatnonzero(known[WINDOW:] - known[:-WINDOW] >= WINDOW - 3)
    if not len(first):
        return
    window, place = index.items_of(ids, first)
    if not len(window):
        return
    starts = np.array(starts)
    ends = np.concatenate((starts[1:], [n])) - WINDOW
    doc, item = np.searchsorted(starts, first[window], "right") - 1, index.owner[place]
    order = np.lexsort((first[window], item, doc))
    doc, item, at, place = doc[order], item[order], first[window][order], place[order]
    new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]))))
    possible: tuple[int, set] = (-1, set())
    for a, b in zip(new, [*new[1:], len(doc)]):
        d, c = int(doc[a]), int(item[a])
        own = ids[starts[d] : ends[d]]
        if possible[0] != d:
            possible = d, set(_possible(index, own, np.unique(item[doc.searchsorted(d) : doc.searchsorted(d, "right")])).tolist())
        if c in possible[1] and any(holds(x, y) for x, y in _stretches(index.items[c], own, at[a:b] - starts[d], place[a:b] - index.starts[c])):
            yield docs[d][0], index.keys[c]


def _stretches(item: np.ndarray, doc: np.ndarray, at: np.ndarray, place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Stretches of item and document around windows that agree, of bounded length; ``at`` is sorted."""
    piece = at // DOC_PIECE
    for p in np.unique(piece):
        mine = piece == p
        lo, hi = at[mine][0], at[mine][-1] + WINDOW
        y = doc[max(0, lo - REACH) : hi + REACH]
        q = np.unique(place[mine])
        for run in np.split(q, np.flatnonzero(np.diff(q) > 2 * REACH) + 1):
            for first in range(int(run[0]), int(run[-1]) + 1, ITEM_PIECE):
                inside = run[(run >= first) & (run < first + ITEM_PIECE)]
                if len(inside):
                    yield item[max(0, inside[0] - REACH) : inside[-1] + WINDOW + REACH], y


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = MAX_INDEX_WORDS) -> DataFrame:
    """``(doc_id, item_id)``: every document that holds a passage of an item, with that item."""
    spark = docs.sparkSession
    stated = items.select(F.col(item_id).alias("k"), F.col(item_text).cast("string").alias("t")).where("k is not null and t is not null").distinct()
    kinds = T.StructType([T.StructField(doc_id, docs.schema[doc_id].dataType), T.StructField(item_id, items.schema[item_id].dataType)])

    def blocks() -> Iterator[list[tuple]]:
        """The items, fetched row by row; only one block of checked size is held."""
        held, filled = [], 0
        for r in stated.toLocalIterator():
            n = len(r["t"].split())
            if held and filled + n > block_words:
                yield held
                held, filled = [], 0
            held.append((r["k"], r["t"]))
            filled += n
        yield held

    narrow = spread(docs.select(F.col(doc_id), F.col(doc_text).cast("string").alias("__text")).where("__text is not null"))

    def one(block: list[tuple]) -> DataFrame:
        index = spark.sparkContext.broadcast(Index(sorted(block, key=repr)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                docs_, held = [], 0
                found: list[tuple] = []
                for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    docs_.append((k, t))
                    held += len(t) // 5
                    if held > BATCH_WORDS:
                        found += scan(index.value, docs_)
                        docs_, held = [], 0
                found += scan(index.value, docs_)
                if found:
                    a, b = zip(*found)
                    from pyspark.sql.pandas.types import to_arrow_schema

                    s = to_arrow_schema(kinds)
                    yield pa.RecordBatch.from_arrays([pa.array(a, s.field(0).type), pa.array(b, s.field(1).type)], schema=s)

        return narrow.mapInArrow(run, kinds)

    return reduce(DataFrame.unionByName, map(one, blocks())).distinct()
