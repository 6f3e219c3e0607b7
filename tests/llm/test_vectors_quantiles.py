import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import neighbors as N
from millrace.llm import quantiles as Q


def test_hilbert_is_a_curve():
    grid = np.array(np.meshgrid(*[range(8)] * 3, indexing="ij")).reshape(3, -1).T
    order = np.argsort(N.hilbert_keys(grid, 3))
    assert (np.abs(np.diff(grid[order], axis=0)).sum(axis=1) == 1).all()


def test_sketch_error():
    x = np.random.default_rng(1).normal(size=(500, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x + np.random.default_rng(2).normal(size=x.shape).astype(np.float32) * 0.03
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    assert np.abs((N.unsketch(N.sketch(x)) * N.unsketch(N.sketch(y))).sum(1) - (x * y).sum(1)).max() < N.SKETCH_SLACK


def clustered(rng, groups, copies, dim=64, spread=0.035):
    base = rng.normal(size=(groups, dim))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    x = np.repeat(base, copies, axis=0) + rng.normal(size=(groups * copies, dim)) * spread
    return (x * rng.uniform(0.3, 4, size=(len(x), 1))).astype(np.float32)


def near_lists(x, k, least):
    """The k most similar others of every row, by comparison with all."""
    u = x / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    out = []
    for a in range(0, len(x), 1000):
        s = u[a : a + 1000] @ u.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -2
        near = np.argpartition(-s, k, axis=1)[:, :k]
        out += [[int(j) for j in n if v[j] >= least] for n, v in zip(near, s)]
    return out


def mutual(ids, lists):
    return {tuple(sorted((ids[i], ids[j]))) for i, near in enumerate(lists) for j in near if i in lists[j]}


def frame(spark, folder, ids, x):
    pq.write_table(pa.table({"chunk_id": ids, "embedding": list(x)}), folder / "vectors.parquet")
    return spark.read.parquet(str(folder / "vectors.parquet"))


def test_mutual_pairs_recall(spark, tmp_path):
    x = clustered(np.random.default_rng(0), 900, 4)
    ids = [f"c{i:05d}" for i in range(len(x))]
    got = {(r[0], r[1]) for r in N.mutual_pairs(frame(spark, tmp_path, ids, x), "chunk_id", "embedding").collect()}
    want = mutual(ids, near_lists(x, 10, 0.9))
    assert len(want) > 1000 and got <= want and len(got) >= 0.99 * len(want)


def test_dense_groups(spark, tmp_path, monkeypatch):
    """Groups of 200, 1,000 and 3,000 rows at cosines of about 0.95 and 0.997: recall by set, with several centres and tiles."""
    for name, value in (("PIVOTS", 5), ("TILE", 700), ("SLICE", 900)):
        monkeypatch.setattr(N, name, value)
    rng = np.random.default_rng(7)
    shapes = [(200, 0.0286), (200, 0.0068), (1000, 0.0286), (3000, 0.0068)]
    x = np.concatenate([clustered(rng, 1, size, spread=spread) for size, spread in shapes] + [clustered(rng, 400, 3)])
    group = np.repeat(np.arange(len(shapes) + 1), [size for size, _ in shapes] + [1200])
    ids = [f"c{i:05d}" for i in rng.permutation(len(x))]
    of = dict(zip(ids, group))
    want = mutual(ids, near_lists(x, 10, 0.9))
    got = {(r[0], r[1]) for r in N.mutual_pairs(frame(spark, tmp_path, ids, x), "chunk_id", "embedding").collect()}
    for g in range(len(shapes) + 1):
        mine = {p for p in want if of[p[0]] == g}
        assert len(mine) > 200 and len(mine & got) >= 0.99 * len(mine)
    assert len(got - want) <= 0.001 * len(got)  # ties of the last digit


def test_lists_without_a_threshold(spark, tmp_path):
    """Every id has its k most similar others whatever their cosine."""
    x = np.random.default_rng(3).normal(size=(700, 64)).astype(np.float32)
    df = frame(spark, tmp_path, list(range(len(x))), x)
    got = {(r.chunk_id, r.neighbour) for r in N.nearest(df, "chunk_id", "embedding", k=5, min_cosine=-1.0).withColumnRenamed("id", "chunk_id").collect()}
    want = {(i, j) for i, near in enumerate(near_lists(x, 5, -1)) for j in near}
    assert len(got) == len(want) and len(got & want) >= 0.999 * len(want)


def test_exact_comparison_breaks_ties_by_id():
    x = np.repeat(np.eye(1, 64, dtype=np.float32), 30, axis=0) * 2.0 ** np.arange(30, dtype=np.float32)[:, None]
    i, j, c = N._exact(x[:5], x, np.arange(5), np.arange(30)[::-1], 3, 0.9)
    assert list(zip(i, j)) == [(a, b) for a in range(5) for b in (29, 28, 27)] and (c == 1).all()


def test_copies_and_odd_vectors(spark):
    one, other = [1.0] + [0.0] * 63, [1.0, 0.2] + [0.0] * 62
    rows = [(f"a{i:02d}", one) for i in range(30)] + [("b", other), ("a00", one), (None, one), ("n", None), ("s", [1.0]), ("e", []), ("z", [0.0] * 64), ("nan", [float("nan")] * 64), ("inf", [float("inf")] + [0.0] * 63), ("null", [None] + [1.0] * 63)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "chunk_id string, embedding array<float>, h string, ids int")
    got = sorted((r[0], r[1]) for r in N.mutual_pairs(df, "chunk_id", "embedding", k=3).collect())
    assert got == [(f"a{i:02d}", f"a{j:02d}") for i in range(4) for j in range(i + 1, 4)]
    assert N.mutual_pairs(df.limit(0), "chunk_id", "embedding").count() == 0


def test_every_copy_has_neighbours(spark):
    rows = [(f"a{i:02d}", [1.0] + [0.0] * 63) for i in range(30)] + [("b", [1.0, 0.2] + [0.0] * 62)]
    got = N.nearest(spark.createDataFrame(rows, "chunk_id string, embedding array<float>"), "chunk_id", "embedding", k=3).collect()
    lists = {i: [r.neighbour for r in sorted(got, key=lambda r: r["rank"]) if r.id == i] for i, _ in rows}
    assert lists == {i: [f"a{j:02d}" for j in range(5) if f"a{j:02d}" != i][:3] for i, _ in rows} and len(got) == 3 * len(rows)


def rank_of(values, v):
    s = np.sort(values)
    return np.searchsorted(s, v, "left") + 1, np.searchsorted(s, v, "right")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.floats(-1e6, 1e6).map(lambda x: round(x, 1)), min_size=1, max_size=200), min_size=1, max_size=6), st.integers(3, 40))
def test_summary_bounds(parts, size):
    s = None
    for p in parts:
        t = Q.compress(Q.exact(np.array(p)), size)
        s = t if s is None else Q.compress(Q.merge(s, t), size)
    whole = np.concatenate([np.array(p) for p in parts])
    assert Q.count(s) == len(whole)
    for v, lo, hi in zip(*s):
        a, b = rank_of(whole, v)
        assert lo <= b and hi >= a
    for q in (0.0, 0.25, 0.5, 0.99, 1.0):
        v, r, e = Q.query(s, q)
        a, b = rank_of(whole, v)
        assert max(0, a - r, r - b) <= e


def test_percentiles(spark):
    rng = np.random.default_rng(3)
    rows = [(i, ["a", "b", None][i % 3], float(np.round(rng.lognormal(), 2))) for i in range(6000)]
    rows += [(7000, "tiny", 5.0), (7001, "nothing", None), (7001, "nothing", None), (5, *rows[5][1:])]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "metric_id long, name string, d double, values string, lo double").repartition(7)
    once = Q.once(df, "metric_id", ["name", "d"])
    epsilon = 0.01
    got = Q.percentiles(Q.summarize(once, "d", ["name"], epsilon), ["name"]).collect()
    assert {r.name for r in got} == {"a", "b", None, "tiny"}
    for r in got:
        values = np.array([d for i, n, d in rows[:6001] if n == r.name])
        assert r.n == len(values)
        a, b = rank_of(values, r.value)
        assert max(0, a - r["rank"], r["rank"] - b) <= r.rank_error <= epsilon * r.n + 1
    assert Q.percentiles(Q.summarize(once.limit(0), "d", ["name"]), ["name"]).count() == 0


def test_parts_combine(spark):
    values = np.random.default_rng(4).normal(size=5000)
    df = spark.createDataFrame([(i % 5, float(v)) for i, v in enumerate(values)], "day int, d double")
    days = Q.summarize(df, "d", ["day"], 0.02)
    total = Q.percentiles(Q.merge_summaries(days, [], Q.tuples(0.02)), [], [0.5]).first()
    a, b = rank_of(values, total.value)
    assert total.n == 5000 and max(0, a - total["rank"], total["rank"] - b) <= total.rank_error <= 100


def test_bound_holds_for_deep_trees():
    """4,096 parts merged pairwise: the tracked error, and the true one, stay within epsilon of the rows."""
    rng = np.random.default_rng(8)
    epsilon, parts, rows = 0.01, 1 << 12, 400
    data = np.round(rng.lognormal(size=(parts, rows)), 3)
    size = Q.tuples(epsilon)
    level = [Q.compress(Q.exact(x), size // 8) for x in data]  # an eighth of the size, so that every level compresses
    depth = 0
    while len(level) > 1:
        level = [Q.compress(Q.merge(a, b), size) for a, b in zip(level[::2], level[1::2])]
        depth += 1
    whole, n = np.sort(data.ravel()), parts * rows
    assert depth == 12 and Q.count(level[0]) == n and len(level[0][0]) <= size + 2
    for q in np.linspace(0, 1, 101):
        v, r, e = Q.query(level[0], q)
        a, b = np.searchsorted(whole, v, "left") + 1, np.searchsorted(whole, v, "right")
        assert max(0, a - r, r - b) <= e <= epsilon * n


def test_rows_without_an_id(spark):
    """Rows without an id are rows of their own."""
    df = spark.createDataFrame([(None, "a", 1.0), (None, "a", 1.0), (None, "a", 3.0), (1, "a", 2.0), (1, "a", 2.0)], "metric_id long, name string, d double")
    assert sorted(r.d for r in Q.once(df, "metric_id", ["name", "d"]).collect()) == [1.0, 1.0, 2.0, 3.0]


def test_special_values():
    v, r, e = Q.query(Q.exact(np.array([np.inf, -np.inf, np.nan, 0.0])), 0.5)
    assert (v, r, e) == (0.0, 2, 0)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_few_values_are_exact(n):
    s = Q.compress(Q.exact(np.arange(n, dtype=float)), 5)
    assert Q.query(s, 1.0) == (n - 1.0, n, 0)
