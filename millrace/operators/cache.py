"""A cache with time to live, replayed over a log of operations.

``ops(key, ts, seq, op)`` with op in set, get, delete. A get is a hit if the key's last change before it is a set
that is not older than the time to live (strictly older is expired). Expired entries leave the cache with the get
that finds them; entries that are never asked for stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def expired(created, now, ttl: int):
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(created.cast("timestamp"))) > F.lit(ttl * 1_000_000).cast("long")


#: Seconds of one bucket of a key's operations.
BUCKET = 600


def since_clear(ops: DataFrame) -> DataFrame:
    """The log after its last ``clear``, which empties the cache and sets its counts back; all of it without one."""
    last = ops.where("op = 'clear'").agg(F.max(F.struct("ts", "seq")).alias("__clear"))
    later = F.col("__clear").isNull() | (F.struct("ts", "seq") > F.col("__clear"))
    return ops.crossJoin(F.broadcast(last)).where(later).drop("__clear")


def replay(ops: DataFrame, ttl: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The gets of the log with ``hit``; ``by`` names columns that divide the log into caches of their own.

    As one key may hold a third of the log, the last change before a get is looked for within a bucket of ``BUCKET``
    seconds first and carried over from the buckets before by a second, small window over one row per key and bucket.
    """
    own = [*by, "key"]
    bucket = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (BUCKET * 1_000_000))
    change = F.when(F.col("op").isin("set", "delete"), F.struct("ts", "seq", "op"))
    rows = ops.select(*own, "ts", "seq", "op", bucket.alias("bucket"))
    last = rows.groupBy(*own, "bucket").agg(F.max(change).alias("at_end"))
    before = Window.partitionBy(*own).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*own, "bucket", F.last("at_end", ignorenulls=True).over(before).alias("carried"))
    within = Window.partitionBy(*own, "bucket").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.withColumn("own", F.last(change, ignorenulls=True).over(within)).where("op = 'get'")
    joined = seen.join(carried, [seen[c].eqNullSafe(carried[c]) for c in (*own, "bucket")], "left").select(*[seen[c] for c in own], seen["ts"], seen["seq"], F.coalesce("own", "carried").alias("state"))
    live = (F.col("state.op") == "set") & ~expired(F.col("state.ts"), F.col("ts"), ttl)
    return joined.select(*own, "ts", "seq", F.coalesce(live, F.lit(False)).alias("hit"))


def _ends(ops: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Last change and last get of every key."""
    return ops.groupBy(*by, "key").agg(F.max(F.when(F.col("op").isin("set", "delete"), F.struct("ts", "seq", "op"))).alias("s"), F.max(F.when(F.col("op") == "get", F.col("ts"))).alias("g"))


def exists(ops: DataFrame, ttl: int, now, by: tuple[str, ...] = ()) -> DataFrame:
    """Every key of the log with ``exists``: whether an entry stands at the time ``now`` that is not expired."""
    live = (F.col("s.op") == "set") & ~expired(F.col("s.ts"), now, ttl)
    return _ends(ops, by).select(*by, "key", F.coalesce(live, F.lit(False)).alias("exists"))


def size(ops: DataFrame, ttl: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Entries at the end of the log, those that expired unasked included."""
    evicted = F.coalesce((F.col("g") > F.col("s.ts")) & expired(F.col("s.ts"), F.col("g"), ttl), F.lit(False))
    held = _ends(ops, by).withColumn("__held", F.coalesce((F.col("s.op") == "set") & ~evicted, F.lit(False)).cast("long"))
    return held.groupBy(*by).agg(F.coalesce(F.sum("__held"), F.lit(0)).alias("size"))


def stats(ops: DataFrame, ttl: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Hits, misses, gets, hit rate in percent (0 without gets) and size: one row, or one for each value of ``by``."""
    gets = replay(ops, ttl, by)
    total = F.count("*")
    hits = F.coalesce(F.sum(F.col("hit").cast("long")), F.lit(0))
    counted = gets.groupBy(*by).agg(hits.alias("hits"), (total - hits).alias("misses"), total.alias("total"), F.when(total > 0, F.round(100.0 * hits / total, 6)).otherwise(0.0).alias("hit_rate_percent"))
    sizes = size(ops, ttl, by)
    if not by:
        return counted.crossJoin(sizes)
    none = {"hits": 0, "misses": 0, "total": 0, "hit_rate_percent": 0.0}
    return sizes.join(counted, list(by), "left").fillna(none).select(*by, *none, "size")
