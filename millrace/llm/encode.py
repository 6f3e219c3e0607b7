"""Corpus encoding with a public byte-level BPE vocabulary (problem 6).

Method: monoid tree reduction. A text is cut into leaves, the leaves are encoded on their own and
neighbours are joined pairwise up a tree. Joining re-encodes a window around the border; the window
grows (doubling) until both of its ends are positions where the pre-tokeniser always cuts, whatever
stands around them. Tokens outside such a window cannot change, so the join is exact.

A position is such a *safe cut* when a non-space character stands before it and a white-space
character after it: of the alternatives of the pre-tokeniser pattern (contractions, optional space
plus letters / digits / other marks, white-space runs) none can match across that position. Where a
text has no safe cut, the window grows to the whole text, which is still exact.

Defined cases: null and empty texts give an empty list; white space and unpaired surrogates are
encoded as the tokenizer does; the id is passed through as it stands, repeated ids give repeated rows.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.plans.runtime import spread

#: The pre-tokenising pattern that belongs to the vocabulary file (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LEAF_CHARS = 256
WINDOW_CHARS = 64

_SAFE = re.compile(r"(?<=\S)(?=\s)")
_encoders: dict[int, object] = {}


def read_ranks(path: str = DEFAULT_VOCABULARY) -> bytes:
    """The vocabulary file as it stands; about 0.8 MB whatever the corpus."""
    with open(path, "rb") as f:
        return f.read()


def encoder(raw: bytes, pattern: str = PATTERN):
    """The encoder of a rank file, made once per process."""
    key = hash((raw, pattern))
    if key not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in raw.splitlines() if x)}
        _encoders[key] = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def _last_cut(text: str, window: int = WINDOW_CHARS) -> int:
    """Last safe cut of a left part, 0 if there is none."""
    while True:
        start = max(0, len(text) - window)
        found = 0
        for m in _SAFE.finditer(text, start):
            found = m.start()
        if found or start == 0:
            return found
        window *= 2


def _first_cut(text: str, before: str, window: int = WINDOW_CHARS) -> int:
    """First safe cut of a right part, its length if there is none.

    The border itself counts when the left part ends in a non-space and the right part begins with white space.
    """
    if before and not before[-1].isspace() and text[:1].isspace():
        return 0
    while True:
        m = _SAFE.search(text, 0, min(len(text), window))
        if m:
            return m.start()
        if window >= len(text):
            return len(text)
        window *= 2


def join(encode, left: tuple[str, list[int]], right: tuple[str, list[int]]) -> tuple[str, list[int]]:
    """The monoid's operation: the node of ``left + right`` from the nodes of its parts.

    ``([], "")`` is the unit, and the operation is associative, as every node equals the encoding of its text.
    """
    if not left[0]:
        return right
    if not right[0]:
        return left
    p, q = _last_cut(left[0]), _first_cut(right[0], left[0])
    if q == 0:  # the border is a safe cut
        return left[0] + right[0], left[1] + right[1]
    tail, head = left[0][p:], right[0][:q]
    kept = len(left[1]) - len(encode(tail))
    return left[0] + right[0], left[1][:kept] + encode(tail + head) + right[1][len(encode(head)) :]


def tree_encode(encode, text: str, leaf: int = LEAF_CHARS) -> list[int]:
    """Token ids of one text by tree reduction over leaves of ``leaf`` characters."""
    if len(text) <= leaf:
        return encode(text)
    nodes = [(part, encode(part)) for part in (text[i : i + leaf] for i in range(0, len(text), leaf))]
    while len(nodes) > 1:
        nodes = [join(encode, *nodes[i : i + 2]) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
    return nodes[0][1]


def tree_decode(pieces: list[bytes]) -> bytes:
    """Bytes of a token sequence, concatenated pairwise up the same tree."""
    while len(pieces) > 1:
        pieces = [b"".join(pieces[i : i + 2]) for i in range(0, len(pieces), 2)]
    return pieces[0] if pieces else b""


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY, leaf: int = LEAF_CHARS, pattern: str = PATTERN) -> DataFrame:
    """``(id_col, ids array<int>)``, one row per input row; map-only, so it scales with the number of files."""
    raw = df.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(raw.value, pattern).encode_ordinary
        for batch in batches:
            ids = [tree_encode(encode, t, leaf) if t else [] for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(ids) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in ids], out=offsets[1:])
            flat = np.fromiter((i for x in ids for i in x), dtype=np.int32, count=int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[id_col, "ids"])

    narrow = spread(df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")))
    schema = T.StructType([narrow.schema[0], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return narrow.mapInArrow(run, schema)


def decode_corpus(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``(id_col, text)``: the inverse of :func:`encode_corpus`; null and empty lists give an empty text."""
    raw = df.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoder(raw.value).decode_single_token_bytes
        for batch in batches:
            texts = [tree_decode([one(i) for i in x or []]).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    narrow = df.select(F.col(id_col), F.col(ids_col))
    return narrow.mapInArrow(run, T.StructType([narrow.schema[0], T.StructField("text", T.StringType())]))
