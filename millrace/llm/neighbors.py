"""The most similar vectors for every vector of a collection (problem 2).

Method: shifted space-filling curves. Each ordering projects the unit vectors on a few random
orthogonal directions, maps every projection to the unit interval by the normal distribution function,
shifts the cube and gives each vector its Hilbert key. All orderings are range-partitioned by
``(ordering, key)`` and sorted in one shuffle; within a partition each vector is compared with the rows
of its key window by one matrix product per block. What travels is a sketch of four bits a dimension.
The windows' candidates are merged over the orderings and reranked with the full vectors. A row with more
than ``CROWD`` candidates, in a window or in all orderings, lies in a dense group, where windows and sketches
cannot tell the nearest: it, and with a crowded window those candidates, are compared exactly with all rows that can be
similar enough, which the triangle inequality of angles to a few centres tells, tile by tile (``_crowded_lists``).

Copies of one vector are folded before (a third of all rows may be copies of one vector) and expanded
after: of equal vectors only the ``k + 1`` smallest ids can be in any list of k, so the expansion is
bounded and still exact; all later ids have the list of the last of these. Cost: rows * orderings * (block + window) multiply-adds a dimension; shuffled
are one copy of the vectors and ``orderings`` sketches a row. No pair of windows is ever broadcast. Crowded
rows cost crowded rows * rows near their centre multiply-adds a dimension on top, and a copy of their vectors a slice:
a dense group costs the square of its size, which no curve avoids where a group has no structure of few dimensions.

Accuracy: a pair without a crowded row is lost only if no ordering brings it within a window; rows at the ends of a range
partition see one side only, which another ordering makes up for.

Defined cases: a vector counts if it is not null, has ``dim`` numbers, none of them null, NaN or
infinite, and is not all zero; others have no neighbours and are nobody's. A row repeated under one id
counts once; a null id is left out. Ties in similarity go to the smaller id. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace.plans.runtime import checkpoint

ORDERINGS = 10
CURVE_DIMS = 8
CURVE_BITS = 5
WINDOW = 512
BLOCK = 256
#: Allowance for the error of the four-bit sketches when candidates are cut by similarity.
SKETCH_SLACK = 0.08
#: A row with more candidates than this, in one window or altogether, is compared with all rows.
CROWD = 64
#: Centres among the crowded rows; crowded rows and other rows of one tile of the exact comparison.
PIVOTS = 64
TILE, SLICE = 32_768, 65_536
#: Allowance for the rounding of cosines in single precision.
SINGLE = 2e-6


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Keys of integer points ``(rows, dims) < 2 ** bits`` on the Hilbert curve (Skilling, 2004), for all rows at once."""
    x = [np.ascontiguousarray(cells[:, i]).astype(np.uint8) for i in range(cells.shape[1])]
    q = 1 << (bits - 1)
    while q > 1:
        p = np.uint8(q - 1)
        for i in range(len(x)):
            high = -((x[i] >> np.uint8(q.bit_length() - 1)) & np.uint8(1))  # 0 or 255
            swap = (x[0] ^ x[i]) & p & ~high
            x[0] ^= swap | (p & high)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.uint8(q - 1) & -((x[-1] >> np.uint8(q.bit_length() - 1)) & np.uint8(1))
        q >>= 1
    key = np.zeros(len(cells), np.int64)
    for b in range(bits - 1, -1, -1):
        for c in x:
            key = (key << 1) | (((c ^ t) >> np.uint8(b)) & np.uint8(1))
    return key


def _normal(x: np.ndarray) -> np.ndarray:
    """Distribution function of the normal law, to about 1e-3 (the curve needs no more)."""
    return 1 / (1 + np.exp(-x * (1.5976 + 0.070566 * x * x)))


def curves(dim: int, orderings: int = ORDERINGS, dims: int = CURVE_DIMS, seed: int = 20) -> list[tuple[np.ndarray, np.ndarray]]:
    """Directions and shift of each ordering; a function of its arguments only."""
    rng = np.random.default_rng(seed)
    dims = min(dims, dim)
    return [(np.linalg.qr(rng.normal(size=(dim, dim)))[0][:, :dims].astype(np.float32), rng.random(dims).astype(np.float32) / 2) for _ in range(orderings)]


def curve_keys(unit: np.ndarray, curve: tuple[np.ndarray, np.ndarray], bits: int = CURVE_BITS) -> np.ndarray:
    """Hilbert keys of unit vectors in one ordering."""
    directions, shift = curve
    u = _normal(unit @ directions * np.float32(np.sqrt(unit.shape[1])))
    return hilbert_keys(np.minimum(((u / 2 + shift) * (1 << bits)).astype(np.int64), (1 << bits) - 1), bits)


def sketch(unit: np.ndarray) -> np.ndarray:
    """Four bits a dimension: ``(rows, ceil(dim / 2))`` bytes; the scale is a row's own largest number."""
    top = np.abs(unit).max(axis=1, keepdims=True)
    level = np.rint(unit / top * 7 + 7).astype(np.uint8)
    if level.shape[1] % 2:
        level = np.pad(level, ((0, 0), (0, 1)), constant_values=7)
    return level[:, ::2] << 4 | level[:, 1::2]


def unsketch(packed: np.ndarray) -> np.ndarray:
    """Unit vectors near those that were sketched."""
    out = np.empty((len(packed), packed.shape[1] * 2), np.float32)
    out[:, ::2], out[:, 1::2] = packed >> 4, packed & 15
    out -= 7
    out /= np.maximum(np.sqrt(np.einsum("ij,ij->i", out, out)), 1e-9)[:, None]
    return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)


def _pairs(rows: np.ndarray, first: int, last: int, cut: float, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs of rows first..last with the rows of their window whose similarity is at least ``cut``, and the crowded rows:
    those with more than ``most`` such rows, whose pairs are left to the exact comparison, and the other rows of these pairs."""
    left, right, crowded = [], [], []
    for a in range(first, last, BLOCK):
        b = min(a + BLOCK, last)
        end = min(len(rows), b + WINDOW)
        s = rows[a:b] @ rows[a:end].T
        s[np.tri(b - a, end - a, dtype=bool)] = -2  # each pair once
        i, j = np.nonzero(s >= cut)
        full = np.bincount(i, minlength=b - a)[i] > most
        if full.any():
            crowded.append(np.unique(np.concatenate((i[full], j[full]))) + a)
            i, j = i[~full], j[~full]
        left.append(i + a)
        right.append(j + a)
    return tuple(np.concatenate(x) if x else np.empty(0, int) for x in (left, right, crowded))


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, added up in the order of the column expression, so that both give the same number."""
    x, y = x.astype(np.float64), y.astype(np.float64)

    def dot(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        s = np.zeros(len(p))
        for d in range(p.shape[1]):
            s = s + p[:, d] * q[:, d]
        return s

    return dot(x, y) / np.sqrt(dot(x, x) * dot(y, y))


def _units(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    m /= np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _exact(x: np.ndarray, y: np.ndarray, same: np.ndarray, order: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of ``x`` the ``k`` most similar rows of ``y``: two index arrays and the cosines.
    ``same`` is the row of ``y`` that is the row of ``x`` itself, or -1; ties go to the smaller ``order``.
    Products in single precision leave what may be among them, and those are computed in double precision."""
    u, v = _units(x).astype(np.float32), np.ascontiguousarray(_units(y).T, np.float32)
    left, right, cosines = [], [], []
    for a in range(0, len(x), BLOCK):
        s = u[a : a + BLOCK] @ v
        own = same[a : a + BLOCK]
        s[np.flatnonzero(own >= 0), own[own >= 0]] = -2
        low = np.full(len(s), least) if len(y) <= k else np.maximum(np.partition(s, -k, axis=1)[:, -k], least)
        i, j = np.nonzero(s >= (low[:, None] - SINGLE).astype(np.float32))
        for part in np.array_split(np.arange(len(i)), len(i) // 1_000_000 + 1):
            c = _cosines(x[a + i[part]], y[j[part]])
            left.append(a + i[part]), right.append(j[part]), cosines.append(c)
    i, j, c = (np.concatenate(z) if z else np.empty(0, t) for z, t in ((left, int), (right, int), (cosines, float)))
    by = np.lexsort((order[j], -c, i))
    i, j, c = i[by], j[by], c[by]
    place = np.arange(len(i)) - np.searchsorted(i, i, "left")
    kept = (place < k) & (c >= least)
    return i[kept], j[kept], c[kept]


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_units(x) @ pivots.T, -1, 1))


def _crowded_lists(unique: DataFrame, crowded: DataFrame, k: int, least: float, dim: int) -> DataFrame:
    """``(ha, ga, hb, gb, cosine)``: the ``k`` most similar different vectors of each crowded one, by comparison with all it can be similar to.

    At most ``PIVOTS`` crowded vectors serve as centres. A crowded row goes to its nearest centre; another row is compared
    with a centre's rows only if its angle to the centre is at most the greatest of theirs and the angle of ``least``
    together, as no other can be similar enough. Tiles of both meet, of ``TILE`` rows and ``SLICE`` rows at most; without crowded rows nothing is sent.
    """
    spark = unique.sparkSession
    names = ["ha", "ga", "hb", "gb", "idb", "cosine"]
    kinds = T.StructType(list(map(T.StructField, names, [T.LongType()] * 4 + [unique.schema["id"].dataType, T.DoubleType()])))
    crowded = checkpoint(crowded)
    if crowded.isEmpty():
        return spark.createDataFrame([], kinds).drop("idb")
    asks = checkpoint(unique.join(crowded, ["h", "g"]).select("h", "g", "id", "v"))
    chosen = asks.orderBy("h", "g").limit(PIVOTS).select("v").collect()  # h is a hash, so these are any rows
    pivots = _units(np.array([r["v"] for r in chosen], np.float32))
    tagged = T.StructType([*asks.schema.fields, T.StructField("pivot", T.IntegerType()), T.StructField("angle", T.DoubleType())])
    reach = float(np.arccos(max(-1.0, min(1.0, least)))) + 1e-6

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                angle = _angles(_matrix(b.column(3), dim), pivots)
                best = angle.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best.astype(np.int32)), pa.array(angle[np.arange(len(best)), best])], names=tagged.names)

    asked = checkpoint(asks.mapInArrow(near, tagged))
    sizes = {r["pivot"]: (r["n"], r["radius"]) for r in asked.groupBy("pivot").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()}  # PIVOTS rows at most
    radius = np.array([sizes.get(p, (0, -1e9))[1] for p in range(len(pivots))]) + reach

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                i, p = np.nonzero(_angles(_matrix(b.column(3), dim), pivots) <= radius)
                yield pa.RecordBatch.from_arrays([*[c.take(pa.array(i)) for c in b.columns], pa.array(p.astype(np.int32))], names=tagged.names[:-1])

    told = checkpoint(unique.select("h", "g", "id", "v").mapInArrow(reached, T.StructType(tagged.fields[:-1])))
    others = {r["pivot"]: r["count"] for r in told.groupBy("pivot").count().collect()}
    pieces, slices = {p: -(-n // TILE) for p, (n, _) in sizes.items()}, {p: -(-n // SLICE) for p, n in others.items()}
    of = lambda d: F.element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), F.col("pivot"))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    ask = asked.withColumn("piece", F.pmod("h", of(pieces)).cast("int")).select(F.lit(True).alias("asks"), "h", "g", "id", "v", "pivot", "piece", numbers(of(slices)).alias("slice"))
    tell = told.withColumn("slice", F.pmod("h", of(slices)).cast("int")).select(F.lit(False).alias("asks"), "h", "g", "id", "v", "pivot", numbers(of(pieces)).alias("piece"), "slice")

    def tile(t: pa.Table) -> pa.Table:
        a, b = t.filter(t["asks"]), t.filter(pc.invert(t["asks"]))
        x, y = (_matrix(z["v"].combine_chunks(), dim) for z in (a, b))
        place = {key: i for i, key in enumerate(zip(b["h"].to_pylist(), b["g"].to_pylist()))}
        same = np.array([place.get(key, -1) for key in zip(a["h"].to_pylist(), a["g"].to_pylist())], np.int64)
        order = np.empty(len(y), np.int64)
        order[pc.sort_indices(b["id"]).to_numpy()] = np.arange(len(y))
        i, j, c = _exact(x, y, same, order, k, least) if len(x) and len(y) else (np.empty(0, int), np.empty(0, int), np.empty(0))
        return pa.table([a["h"].take(i), a["g"].take(i), b["h"].take(j), b["g"].take(j), b["id"].take(j), pa.array(c)], names=names)

    met = ask.unionByName(tell).groupBy("pivot", "piece", "slice").applyInArrow(tile, kinds)
    best = Window.partitionBy("ha", "ga").orderBy(F.desc("cosine"), "idb")
    return met.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).drop("n", "idb")


def _lists(df: DataFrame, id_col: str, vector_col: str, k: int = 10, min_cosine: float = 0.9, dim: int = 64, orderings: int = ORDERINGS, seed: int = 20) -> tuple[DataFrame, DataFrame]:
    """The sound rows, and the lists of the ``k + 1`` smallest ids of every vector."""
    vector = F.col(vector_col).cast("array<float>")
    top, low = F.array_max("v"), F.array_min("v")
    sound = ~F.isnan(top) & (top < float("inf")) & (low > float("-inf")) & ((top > 0) | (low < 0)) & ~F.exists("v", lambda x: x.isNull())
    rows = df.select(F.col(id_col).alias("id"), vector.alias("v")).where(F.col("id").isNotNull() & (F.size("v") == dim)).where(sound)
    rows = rows.withColumn("h", F.xxhash64("v")).withColumn("g", F.xxhash64(F.lit(1), "v"))
    # one row per different vector under a key of 128 bits; every later use has this partitioning and reuses this shuffle
    unique = rows.groupBy("h", "g").agg(F.min(F.struct("id", "v")).alias("m")).select("h", "g", "m.v", "m.id")
    shapes = curves(dim, orderings, seed=seed)

    def orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(2), dim)
            if not len(x):
                continue
            x /= np.abs(x).max(axis=1, keepdims=True)  # else the squares of tiny or huge numbers leave float32
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            packed = sketch(x)
            width = packed.shape[1]
            s = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(x), [None, pa.py_buffer(packed.tobytes())]).cast(pa.binary())
            for o, curve in enumerate(shapes):
                key = curve_keys(x, curve) | (o << (CURVE_DIMS * CURVE_BITS))
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0), batch.column(1), s], names=["key", "h", "g", "s"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, g, m = np.empty(0, np.int64), np.empty(0, np.int64), None

        def found(first: int, last: int) -> pa.RecordBatch:
            i, j, crowded = _pairs(m, first, last, min_cosine - SKETCH_SLACK, max(CROWD, 2 * k))
            differ = (h[i] != h[j]) | (g[i] != g[j])
            i, j = np.concatenate((i[differ], crowded)), np.concatenate((j[differ], crowded))  # a pair with itself marks a crowded row
            swap = (h[i] > h[j]) | (h[i] == h[j]) & (g[i] > g[j])
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (h[i], g[i], h[j], g[j])], names=["ha", "ga", "hb", "gb"])

        for batch in batches:
            raw = batch.column(3)
            x = unsketch(np.frombuffer(b"".join(raw.to_pylist()), np.uint8).reshape(len(raw), -1))
            h, g = np.concatenate((h, batch.column(1).to_numpy())), np.concatenate((g, batch.column(2).to_numpy()))
            m = x if m is None else np.concatenate((m, x))
            if len(h) >= 4096 + WINDOW:
                done = len(h) - WINDOW
                yield found(0, done)
                h, g, m = h[done:], g[done:], m[done:]
        if len(h):
            yield found(0, len(h))

    keyed = unique.mapInArrow(orders, "key long, h long, g long, s binary")
    ranged = keyed.repartitionByRange("key").sortWithinPartitions("key")
    met = ranged.mapInArrow(windows, "ha long, ga long, hb long, gb long").distinct()
    marked = (F.col("ha") == F.col("hb")) & (F.col("ga") == F.col("gb"))
    met = checkpoint(met)
    candidates = met.where(~marked)
    # groups that are spread thinner fill no single window, but the candidates of all orderings together
    ends = met.select(F.explode(F.array(F.struct(F.col("ha").alias("h"), F.col("ga").alias("g"), marked.alias("m")), F.struct(F.col("hb").alias("h"), F.col("gb").alias("g"), marked.alias("m")))).alias("e")).select("e.*")
    crowded = ends.groupBy("h", "g").agg(F.count("*").alias("n"), F.max("m").alias("m")).where(F.col("m") | (F.col("n") > max(CROWD, 2 * k))).select("h", "g")

    # of equal vectors the k + 1 smallest ids; the rank is cut before the shuffle, so a hot vector sends few rows
    copies = Window.partitionBy("h", "g").orderBy("id")
    members = rows.select("h", "g", "id").withColumn("n", F.dense_rank().over(copies)).where(F.col("n") <= k + 1)
    lists = members.groupBy("h", "g").agg(F.array_sort(F.collect_set("id")).alias("ids"))

    side = lambda df, x: df.select(*[F.col(c).alias(c + x) for c in df.columns])
    vectors = unique.drop("id")
    a_side = candidates.join(side(vectors, "a"), ["ha", "ga"]).join(side(lists, "a"), ["ha", "ga"])
    full = a_side.join(side(vectors, "b"), ["hb", "gb"]).join(side(lists, "b"), ["hb", "gb"])
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    cosine = dot("va", "vb") / F.sqrt(dot("va", "va") * dot("vb", "vb"))
    sure = _crowded_lists(unique, crowded, k, min_cosine, dim)
    sure = sure.join(side(lists, "a"), ["ha", "ga"]).join(side(lists, "b"), ["hb", "gb"])
    exact = full.withColumn("cosine", cosine).where(F.col("cosine") >= min_cosine).select("idsa", "idsb", "cosine").unionByName(sure.select("idsa", "idsb", "cosine"))

    one_way = exact.select("idsa", "idsb", "cosine")
    twins = lists.where(F.size("ids") > 1).select(F.col("ids").alias("idsa"), F.col("ids").alias("idsb"), F.lit(1.0).alias("cosine"))
    both = one_way.unionByName(exact.select(F.col("idsb").alias("idsa"), F.col("idsa").alias("idsb"), "cosine")).unionByName(twins)
    edges = both.select(F.explode("idsa").alias("id"), "idsb", "cosine").select("id", F.explode("idsb").alias("neighbour"), "cosine").where("id <> neighbour")
    best = Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")
    grouped = edges.repartition("id").groupBy("id", "neighbour").agg(F.max("cosine").alias("cosine"))
    return rows, grouped.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def nearest(df: DataFrame, id_col: str, vector_col: str, k: int = 10, min_cosine: float = 0.9, dim: int = 64, orderings: int = ORDERINGS, seed: int = 20) -> DataFrame:
    """``(id, neighbour, cosine, rank)``: for every id its at most ``k`` most similar others with a cosine of at least ``min_cosine``."""
    rows, lists = _lists(df, id_col, vector_col, k, min_cosine, dim, orderings, seed)
    # k equal ids come before the (k + 1)-th of a vector, so it is in no list of its own, and all later ids have its list
    ids = F.slice(F.array_sort(F.collect_set("id")), 1, k + 1)
    copies = Window.partitionBy("h", "g").orderBy("id")
    few = rows.select("h", "g", "id").withColumn("n", F.dense_rank().over(copies)).where(F.col("n") <= k + 1)
    owners = few.groupBy("h", "g").agg(ids.alias("ids")).where(F.size("ids") == k + 1).select("h", "g", F.element_at("ids", -1).alias("owner"))
    later = rows.join(owners, ["h", "g"]).where(F.col("id") > F.col("owner")).select(F.col("id").alias("later"), "owner").distinct()
    rest = later.join(lists, F.col("owner") == F.col("id")).select(F.col("later").alias("id"), "neighbour", "cosine", "rank")
    return lists.unionByName(rest)


def mutual_pairs(df: DataFrame, id_col: str, vector_col: str, k: int = 10, min_cosine: float = 0.9, **options) -> DataFrame:
    """``(id_a, id_b)``, smaller id first: each among the other's ``k`` most similar, with a cosine of at least ``min_cosine``."""
    near = _lists(df, id_col, vector_col, k, min_cosine, **options)[1]  # later copies are in nobody's list
    pair = near.select(F.least("id", "neighbour").alias(f"{id_col}_a"), F.greatest("id", "neighbour").alias(f"{id_col}_b"))
    return pair.groupBy(f"{id_col}_a", f"{id_col}_b").count().where("count = 2").drop("count")
