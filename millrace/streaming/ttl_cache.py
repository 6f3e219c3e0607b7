"""The cache with time to live as a stateful stream: one entry of state per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "key string, ts timestamp, seq long, hit boolean"


def stream_hits(ops: DataFrame, ttl: int) -> DataFrame:
    """Gets with ``hit`` out of a stream ``ops(key, ts, seq, op)`` whose micro-batches come in the order of time."""
    limit = pd.Timedelta(seconds=ttl)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since = pd.Timestamp(state.get[0]) if state.exists and state.get[0] is not None else None
        for b in batches:  # each batch is one piece of the key's rows; none is held
            b = b.sort_values(["ts", "seq"])
            changes = b["ts"].where(b["op"] == "set")  # a delete is a change to nothing
            known = b["op"].isin(["set", "delete"])
            place = known.cumsum()
            states = pd.concat([pd.Series([since], dtype=b["ts"].dtype), changes[known]], ignore_index=True)
            at = states.iloc[place].set_axis(b.index)  # the state before a get is that of the last change
            gets = b[b["op"] == "get"]
            age = gets["ts"] - at[gets.index]
            if len(gets):
                yield pd.DataFrame({"key": key[0], "ts": gets["ts"], "seq": gets["seq"], "hit": age.notna() & (age <= limit)})
            since = states.iloc[-1] if pd.notna(states.iloc[-1]) else None
        state.update((since.to_pydatetime() if since is not None else None,))

    return ops.groupBy("key").applyInPandasWithState(step, OUTPUT, "since timestamp", "append", GroupStateTimeout.NoTimeout)
