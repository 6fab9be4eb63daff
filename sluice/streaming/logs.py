"""Stateful streams of operation logs.

A batch's rows of a key are applied in the order of their sequence numbers; batches are expected in that order too. The
state of a key is its value, or its stack, kept by the state store and so recovered from the query's checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_final_state(log: DataFrame) -> DataFrame:
    """From a stream (key long, seq long, op, value long): after each batch, each touched key's (key, seq, present, value)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, present, value = state.get if state.exists else (-1, False, 0)
        rows = pd.concat(list(batches)).sort_values("seq")
        for s, op, v in rows[["seq", "op", "value"]].itertuples(index=False, name=None):
            if op == "insert":
                seq, present, value = int(s), True, int(v)
            elif op == "delete":
                seq, present, value = int(s), False, 0
        state.update((seq, present, value))
        yield pd.DataFrame({"key": [key[0]], "seq": [seq], "present": [present], "value": pd.array([value if present else None], dtype="Int64")})

    return log.groupBy("key").applyInPandasWithState(step, "key long, seq long, present boolean, value long", "seq long, present boolean, value long", "update", GroupStateTimeout.NoTimeout)


def stream_stacks(log: DataFrame) -> DataFrame:
    """From a stream (stack long, seq long, op, value long): each pop's (stack, seq, value, underflow)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        out = []
        rows = pd.concat(list(batches)).sort_values("seq")
        for s, op, v in rows[["seq", "op", "value"]].itertuples(index=False, name=None):
            if op == "push":
                held.append(int(v))
            else:
                out.append((key[0], int(s), held.pop(), False) if held else (key[0], int(s), None, True))
        state.update((held,))
        yield pd.DataFrame({"stack": [o[0] for o in out], "seq": [o[1] for o in out], "value": pd.array([o[2] for o in out], dtype="Int64"), "underflow": [o[3] for o in out]}).astype({"stack": "int64", "seq": "int64", "underflow": "bool"})

    return log.groupBy("stack").applyInPandasWithState(step, "stack long, seq long, value long, underflow boolean", "held array<long>", "append", GroupStateTimeout.NoTimeout)
