"""Adapter for models that turn texts into vectors: any callable on a list of texts."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.plans.errors import EmbeddingAPIError

BATCH = 100
RETRIES = 3


def with_retries(call: Callable, argument, retries: int = RETRIES, wait: Callable[[float], None] = time.sleep):
    """The call's result; after each failure but the last it waits 1, 2, 4 ... seconds."""
    for attempt in range(retries):
        try:
            return call(argument)
        except Exception as e:  # noqa: BLE001 - whatever the model raises
            if attempt == retries - 1:
                raise EmbeddingAPIError(f"no result after {retries} attempts: {e}") from e
            wait(2**attempt)


def embed(df: DataFrame, model: Callable[[list[str]], list[list[float]]], text: str = "text", name: str = "embedding", batch: int = BATCH, retries: int = RETRIES, clean: bool = False) -> DataFrame:
    """``df`` with a vector column; texts go in batches, in order and as they stand, null ones get null.

    With ``clean``, as for single texts, they are stripped first and blank ones get null.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.FloatType()))])
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            out: list = [None] * len(texts)
            texts = [t.strip() or None if clean and t else t for t in texts]
            asked = [i for i, t in enumerate(texts) if t is not None and not (clean and not t)]
            for a in range(0, len(asked), batch):
                part = asked[a : a + batch]
                for i, v in zip(part, with_retries(model, [texts[i] for i in part], retries)):
                    out[i] = v
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.float32()))], names=[*b.schema.names, name])

    return df.select(*[F.col(c) for c in df.columns]).mapInArrow(run, schema)
