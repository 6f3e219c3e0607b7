import numpy as np
import pytest

from millrace.operators import bm25, dense, fusion, scan


def test_hybrid_scan_equals_the_lists_and_shuffles_no_candidates(spark):
    r = np.random.default_rng(5)
    word = lambda n: " ".join(f"w{int(x)}" for x in r.zipf(1.4, n) % 60)
    vec = lambda: [float(x) for x in r.integers(-2, 3, 4)]
    docs = [(f"d{i:05d}", word(i % 9) if i % 7 else "w1 w2", None if i % 11 == 0 else vec()[: 3 if i % 13 == 0 else 4]) for i in range(5000)]
    queries = [(f"q{i:03d}", ["zzz", "!!", None, "w1 w1 zzz"][i % 4] if i % 5 == 0 else word(4), None if i % 9 == 0 else vec()) for i in range(300)]
    d = spark.createDataFrame(docs, "pos string, text string, vec array<float>").repartition(3)
    q = spark.createDataFrame(queries, "query_id string, query string, query_embedding array<float>")
    index = bm25.build(d, "pos", "text", statistics_only=True)
    for threshold in (None, 0.9):
        got = fusion.hybrid(index, d, q, "pos", "vec", k=9, threshold=threshold, dense_k=12, bm25_k=12, dim=4, docs_text="text")
        lists = [dense.search(d, q, "pos", "vec", k=12, threshold=threshold, dim=4), bm25.topk_scan(index, d, q, "pos", "text", k=12)]
        want = fusion.rrf(lists, k=9)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert got.columns == want.columns
        assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("ties", [False, True])
def test_near_is_exact_over_blocks(ties):
    r = np.random.default_rng(1)
    x, q = (r.integers(-1, 2, (n, 6)).astype(float) if ties else r.standard_normal((n, 6)) for n in (30_000, 300))
    near, n = scan.Near(q, 20), 0
    while n < len(x):
        m = max(2048, min(n, scan.READ))
        near.add(dense._unit(x[n : n + m]), np.arange(n, min(n + m, len(x))), min(n + m, len(x)))
        n += m
    near.best.merge()
    s = np.rint(dense._unit(q) @ dense._unit(x).T * 1e9).astype(np.int64)
    want = np.stack([np.lexsort((np.arange(len(x)), -row))[:20] for row in s])
    assert (near.best.p.reshape(300, 20) == want).all()


@pytest.mark.parametrize("sign", [1, -1])
def test_words_are_exact_over_blocks(sign):
    r = np.random.default_rng(2)
    idf = np.where(np.arange(40) < 5, 0.3 * sign, 3.0)
    bags = sorted({tuple(sorted(int(t) for t in r.zipf(1.5, n) % 40)) for n in r.integers(0, 7, 400)} | {(39,), ()})
    docs = [sorted(int(t) for t in r.zipf(1.5, n) % 39) for n in r.integers(0, 6, 20_000)]
    dl = np.array([len(d) + 1 for d in docs])
    tf = np.zeros((40, len(docs)))
    for j, d in enumerate(docs):
        for t in d:
            tf[t, j] += 1
    words, n = scan.Words(bags, idf, 4.0, 15), 0
    while n < len(docs):
        m = max(2048, min(n, scan.READ))
        doc, term = np.nonzero(tf[:, n : n + m].T)
        words.add(term, tf[term, doc + n], doc, dl[n : n + m], n)
        n += m
    bag, p, rank = words.filled(len(docs))
    weight = tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / 4.0))
    for i, b in enumerate(bags):
        s = np.zeros(len(docs), np.int64)
        for t in set(b):
            s += np.rint(b.count(t) * idf[t] * weight[t] * 1e9).astype(np.int64)
        assert (p[bag == i] == np.lexsort((np.arange(len(docs)), -s))[:15]).all()
        assert (rank[bag == i] == np.arange(1, 16)).all()


def test_fewer_documents_than_places():
    words = scan.Words([(0,), (1,)], np.array([2.0, 2.0]), 1.0, 5)
    words.add(np.array([0]), np.array([1]), np.array([2]), np.array([1, 1, 1]), 0)
    bag, p, rank = words.filled(3)
    assert list(zip(bag, p, rank)) == [(0, 2, 1), (0, 0, 2), (0, 1, 3), (1, 0, 1), (1, 1, 2), (1, 2, 3)]
