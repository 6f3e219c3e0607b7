import re

import pytest
from pyspark.sql import functions as F

from millrace.functions import citations as C
from millrace.functions import text as X
from millrace.functions import vectors as V

TEXTS = ["", " ", "...", "Cross-contamination", "café  au lait", "سلام عليكم", "a b\x1cc　d", "The, the THE", "x" * 2001, " " + "y" * 2000 + " ", "ab", "abc", "\x00 abc", "How do I?", "what is\t\n this?!", "🙂 emoji É", None]


def run(spark, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    return [r[1] for r in df.select("i", column(F.col("t"))).orderBy("i").collect()]


def python_tokens(t):
    return [w for w in (re.sub(r"[^a-z0-9]", "", x) for x in (t or "").lower().split()) if w]


def test_tokenize(spark):
    assert run(spark, X.tokenize) == [python_tokens(t) for t in TEXTS]


def test_whitespace(spark):
    assert run(spark, X.normalize_whitespace) == [None if t is None else " ".join(t.split()) for t in TEXTS]
    assert run(spark, X.strip) == [None if t is None else t.strip() for t in TEXTS]


def test_expander(spark):
    assert run(spark, X.expander_normalize) == [None if t is None else " ".join(t.split()).rstrip(".?!").strip() for t in TEXTS]


def test_normalize(spark):
    def model(t):
        s = (t or "").strip()
        if not 3 <= len(s) <= 2000:
            return None
        return "".join(c for c in re.sub(r"\s+", " ", s) if ord(c) >= 32)

    assert run(spark, X.query_normalize) == [model(t) for t in TEXTS]
    errors = run(spark, X.query_error)
    assert [e is None for e in errors] == [model(t) is not None for t in TEXTS]


def test_validate(spark):
    assert run(spark, X.query_valid) == [bool(t) and len(t.strip()) >= 3 and len(t) <= 2000 for t in TEXTS]


def test_stopwords_keywords(spark):
    assert run(spark, X.remove_stopwords) == [None if t is None else " ".join(w for w in t.lower().split() if w not in X.STOPWORDS) for t in TEXTS]
    assert run(spark, X.keywords) == [None if t is None else sorted({w for w in re.sub(r"[^a-zA-Z0-9\s]", "", t).lower().split() if len(w) > 3}) for t in TEXTS]


def test_truncate_estimate(spark):
    assert run(spark, lambda c: X.truncate(c, 10)) == [None if t is None else t if len(t) <= 10 else t[:7] + "..." for t in TEXTS]
    assert run(spark, X.estimate_tokens) == [None if t is None else len(t) // 4 for t in TEXTS]
    with pytest.raises(ValueError):
        X.truncate(F.col("t"), 2)


def test_ids(spark):
    r = spark.range(1).select(X.chunk_id(F.lit("doc"), F.lit(7)), X.random_id("qry_"), X.stable_id("a_", F.lit("x")), X.stable_id("a_", F.lit("x"))).first()
    assert r[0] == "doc_chunk_0007" and re.fullmatch(r"qry_[0-9a-f]{12}", r[1]) and r[2] == r[3]


def test_batches(spark):
    df = spark.createDataFrame([([],), (["a"],), (["a", "b", "c", "d", "e"],)], "x array<string>")
    assert [r[0] for r in df.select(X.batches(F.col("x"), 2)).collect()] == [[], [["a"]], [["a", "b"], ["c", "d"], ["e"]]]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    assert [r[0] for r in df.select(V.l2_normalize(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0]]


def test_citations(spark):
    r = spark.range(1).select(
        C.chunk_citation(F.lit("d.pdf"), F.lit(0), F.lit(""), F.lit("c1")),
        C.citation(F.lit("d.pdf"), F.lit(3), F.lit("S")),
        C.citation_card(F.lit("d.pdf"), F.lit(None).cast("int"), F.lit(None).cast("string"), F.lit("c1")),
        C.answer_prompt(F.lit("{context}?"), F.lit("{query}")),
    ).first()
    assert r[0] == "Document: d.pdf | ID: c1" and r[1] == "d.pdf | p. 3 | S"
    assert "Page: N/A" in r[2] and "Section: N/A" in r[2]
    assert r[3].count("{context}") == 1 and r[3].count("{query}") == 1


def test_hundredths(spark):
    """Two decimals as the exact binary value rounds."""
    import random

    rng = random.Random(2)
    values = [0.145, 1.515, 13.225, 0.125, 0.375, 2.5, -0.001, 0.0, 1e9 + 0.005, 999.995] + [round(rng.uniform(-3000, 3000), 3) for _ in range(2000)] + [rng.randrange(40000) / 8 for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(values)), "i int, x double")
    got = [r.t for r in df.select("i", X.metric_text(F.lit("op"), F.col("x")).alias("t")).orderBy("i").collect()]
    assert got == [f"op: {x:.2f}ms" for x in values]
