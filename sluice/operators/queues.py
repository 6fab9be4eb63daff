"""Priority queues: drained, peeked at, and replayed. Equal priorities leave in the order of their arrival."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators.sorting import top_k
from sluice.plans.numbering import number_rows, running_sum


def drain(rows: DataFrame, priority: str = "priority", seq: str = "seq", name: str = "rank") -> DataFrame:
    """All elements with their 0-based place of leaving."""
    return number_rows(rows, [priority, seq], name)


def smallest(rows: DataFrame, k: int, priority: str = "priority", seq: str = "seq") -> DataFrame:
    """The k elements that leave first."""
    return top_k(rows, [priority, seq], k)


def peek(rows: DataFrame, priority: str = "priority", seq: str = "seq", value: str = "value") -> DataFrame:
    """One row with the first to leave, nulls if there is none."""
    first = F.struct(priority, seq)
    return rows.agg(F.min(priority).alias(priority), F.min_by(value, first).alias(value))


def replay(log: DataFrame, *, queue: str = "queue", seq: str = "seq", op: str = "op", priority: str = "priority", value: str = "value") -> DataFrame:
    """Each extract, peek and size of a log (queue, seq, op, priority, value) with what it gave: (queue, seq, op, priority, value, size).

    A queue's operations depend on each other, so a task replays whole queues, one heap each; queues run in parallel.
    Empty queues give nulls. size: elements after the operation.
    """
    kinds = {f.name: f.dataType.simpleString() for f in log.schema}

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        heap, out = [], []
        for q, s, o, p, v in pdf.sort_values("__s")[["__q", "__s", "__o", "__p", "__v"]].itertuples(index=False, name=None):
            if o == "insert":
                heapq.heappush(heap, (p, s, v))
            else:
                got = None
                if heap and o in ("extract", "peek"):
                    got = heapq.heappop(heap) if o == "extract" else heap[0]
                out.append((q, s, o, got and got[0], got and got[2], len(heap)))
        return pd.DataFrame(out, columns=["__q", "__s", "__o", "__p", "__v", "size"], dtype=object)

    slim = log.select(*[F.col(c).alias(n) for c, n in ((queue, "__q"), (seq, "__s"), (op, "__o"), (priority, "__p"), (value, "__v"))])
    done = slim.groupBy("__q").applyInPandas(one, f"__q {kinds[queue]}, __s {kinds[seq]}, __o string, __p {kinds[priority]}, __v {kinds[value]}, size long")
    return done.select(*[F.col(n).alias(c) for c, n in ((queue, "__q"), (seq, "__s"), (op, "__o"), (priority, "__p"), (value, "__v"))], "size")


def sizes(log: DataFrame, *, queue: str = "queue", seq: str = "seq", op: str = "op") -> DataFrame:
    """The log with the exact number of elements after each operation, extracts from empty queues counted as nothing."""
    step = F.when(F.col(op) == "insert", 1).when(F.col(op) == "extract", -1).otherwise(0)
    running = running_sum(log.withColumn("__step", step), [queue], [seq], "__step", "__r", low="__low")
    return running.withColumn("size", F.col("__r") - F.least(F.lit(0), "__low")).drop("__r", "__low", "__step")
