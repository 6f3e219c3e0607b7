"""Routing, expansion and merging of queries."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace.functions.text import contains_any, expander_normalize, occurrences, strip

# Terms and phrases that decide the route.
DOMAIN_TERMS = ("haccp", "pathogen", "bacteria", "contamination", "temperature", "storage", "hygiene", "allergen", "cross-contamination", "sanitization", "shelf-life")
CONCEPTS = ("what is", "how do", "why", "explain", "understand")
ROUTES = ("hybrid", "dense", "bm25")


def route(query: Column, default: str = "hybrid") -> Column:
    """``hybrid`` for a domain term, else ``dense`` for a concept, else ``bm25`` for more than two and/or or a quotation mark, else the default."""
    q = F.lower(query)
    heavy = (occurrences(q, " and ") + occurrences(q, " or ") > 2) | query.contains('"')
    return F.when(contains_any(q, DOMAIN_TERMS), "hybrid").when(contains_any(q, CONCEPTS), "dense").when(heavy, "bm25").otherwise(default)


def fallback_expand(query: Column, n: int = 3) -> Column:
    """At most ``n`` other wordings without a model; the words how and what are found in any case but replaced in lower case only."""
    low = F.lower(query)
    asked = query.endswith("?")
    options = F.array(
        F.when(~asked, F.concat(query, F.lit("?"))),
        F.when(asked, F.substring(query, F.lit(1), F.length(query) - 1)),
        F.when(low.contains("how"), F.replace(query, F.lit("how"), F.lit("what is the method for"))),
        F.when(low.contains("what"), F.replace(query, F.lit("what"), F.lit("explain"))),
    )
    return F.slice(F.filter(options, lambda x: x.isNotNull()), 1, n) if n else F.expr("cast(array() as array<string>)")


def expand(queries: DataFrame, query: str = "query", n: int = 3, model: Callable[[str], str] | None = None) -> DataFrame:
    """``queries`` with ``normalized``, ``expanded`` and ``method``.

    With a ``model`` (query to response) its wordings are used; where its response cannot be parsed the fallback
    fills in and the method stays ``llm``; where it fails there are none and the method is ``fallback``.
    """
    base = queries.withColumn("normalized", expander_normalize(F.col(query)))
    if model is None:
        return base.withColumn("expanded", fallback_expand(F.col("normalized"), n)).withColumn("method", F.lit("fallback"))

    kind = T.StructType([T.StructField("said", T.ArrayType(T.StringType())), T.StructField("ok", T.BooleanType())])

    def ask(texts: pd.Series) -> pd.DataFrame:
        said, ok = [], []
        for t in texts:
            try:
                response = model(t)
            except Exception:  # noqa: BLE001 - any failure of the model gives no wordings
                said.append(None)
                ok.append(False)
                continue
            said.append(parse_array(response))
            ok.append(True)
        return pd.DataFrame({"said": pd.Series(said, dtype=object), "ok": ok})

    got = base.withColumn("__got", F.pandas_udf(ask, kind)("normalized"))
    nothing = F.expr("cast(array() as array<string>)")
    expanded = F.when(~F.col("__got.ok"), nothing).otherwise(F.slice(F.coalesce("__got.said", fallback_expand(F.col("normalized"), n)), 1, n) if n else nothing)
    return got.withColumn("expanded", expanded).withColumn("method", F.when(F.col("__got.ok"), "llm").otherwise("fallback")).drop("__got")


def parse_array(response: str | None) -> list[str] | None:
    """Texts of the JSON list in a response (from its first to its last bracket), without empty values; None if there is none."""
    m = re.search(r"\[.*\]", response or "", re.S)
    if not m:
        return None
    try:
        got = json.loads(m.group())
    except ValueError:
        return None
    return [str(x).strip() for x in got if x] if isinstance(got, list) else None


def parse_expansions(response: Column | str) -> Column:
    """:func:`parse_array` as a column function."""

    def run(responses: pd.Series) -> pd.Series:
        return pd.Series([parse_array(r) for r in responses], dtype=object)

    return F.pandas_udf(run, T.ArrayType(T.StringType()))(response)


def all_queries(normalized: Column, expanded: Column) -> Column:
    """The normalised query and then its other wordings."""
    return F.concat(F.array(normalized), F.coalesce(expanded, F.expr("cast(array() as array<string>)")))


def unique_queries(df: DataFrame, query_id: str = "query_id", normalized: str = "normalized", expanded: str = "expanded") -> DataFrame:
    """``(query_id, ord, query)``: the wordings of each query once, whatever their case and outer spaces; the first spelling stays."""
    rows = df.select(F.col(query_id).alias("query_id"), F.posexplode(all_queries(F.col(normalized), F.col(expanded))).alias("at", "query"))
    seen = Window.partitionBy("query_id", F.lower(strip(F.col("query")))).orderBy("at")
    kept = rows.withColumn("__n", F.row_number().over(seen)).where("__n = 1")
    return kept.withColumn("ord", F.row_number().over(Window.partitionBy("query_id").orderBy("at"))).select("query_id", "ord", "query")
