"""The block-I/O cost model: traces of accesses replayed against a write-back LRU cache, and a first-fit allocator."""

from __future__ import annotations

from collections import OrderedDict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def simulate_block_io(trace: DataFrame, block: int, memory: int, *, flush: bool = True, steps: bool = False) -> DataFrame:
    """Costs of each trace (trace_id, seq, flat_index, is_write): reads, dirty evictions, flush writes, total.

    The cache holds max(1, memory // block) blocks. A write reads its block first if it isn't held; evicting a dirty
    block and, at the flush, every held block cost one write. steps: a row for each access, with the total up to it.
    A trace's accesses depend on each other, so a task replays whole traces.
    """
    if block < 1 or memory < 1:
        raise ValueError("a block and the memory hold a cell")
    capacity = max(1, memory // block)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        cache: OrderedDict[int, bool] = OrderedDict()
        reads = dirty = 0
        totals = []
        pdf = pdf.sort_values("seq")
        for index, write in zip(pdf["flat_index"].tolist(), pdf["is_write"].tolist(), strict=True):
            b = index // block
            if b in cache:
                cache.move_to_end(b)
            else:
                if len(cache) >= capacity:
                    dirty += cache.popitem(last=False)[1]
                reads += 1
                cache[b] = False
            cache[b] = cache[b] or write
            totals.append(reads + dirty)
        if steps:
            return pd.DataFrame({"trace_id": pdf["trace_id"], "seq": pdf["seq"], "total": totals})
        held = len(cache) if flush else 0
        return pd.DataFrame({"trace_id": pdf["trace_id"].iloc[:1], "reads": [reads], "dirty_evictions": [dirty], "flush_writes": [held], "total": [reads + dirty + held]})

    kind = trace.schema["trace_id"].dataType.simpleString()
    schema = f"trace_id {kind}, seq long, total long" if steps else f"trace_id {kind}, reads long, dirty_evictions long, flush_writes long, total long"
    return trace.select("trace_id", "seq", "flat_index", "is_write").groupBy("trace_id").applyInPandas(one, schema)


def replay_allocator(log: DataFrame, size: int) -> DataFrame:
    """First-fit allocation from a disk of so many cells: log (disk, seq, op, start, length) gives (disk, seq, op, start, length, free).

    alloc takes the first free segment that is long enough (start null and free unchanged if there is none: out of
    memory); free gives a segment back, joined with those beside it. free: free cells after the operation.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        segments, out = [(0, size)], []
        for disk, seq, op, start, length in pdf.sort_values("seq")[["disk", "seq", "op", "start", "length"]].itertuples(index=False, name=None):
            if op == "alloc":
                start = None
                for k, (at, n) in enumerate(segments):
                    if n >= length:
                        start = at
                        segments[k : k + 1] = [(at + length, n - length)] if n > length else []
                        break
            else:
                joined: list[tuple[int, int]] = []
                for at, n in sorted([*segments, (int(start), length)]):
                    if joined and joined[-1][0] + joined[-1][1] == at:
                        joined[-1] = (joined[-1][0], joined[-1][1] + n)
                    else:
                        joined.append((at, n))
                segments = joined
            out.append((disk, seq, op, start, length, sum(n for _, n in segments)))
        return pd.DataFrame(out, columns=["disk", "seq", "op", "start", "length", "free"]).astype({"start": "Int64"})

    kind = log.schema["disk"].dataType.simpleString()
    return log.select("disk", "seq", "op", "start", "length").groupBy("disk").applyInPandas(one, f"disk {kind}, seq long, op string, start long, length long, free long")


def free_segments(log: DataFrame, size: int) -> DataFrame:
    """Free segments (disk, start, length) at the end of a replayed log, from its gaps and islands: no replay."""
    now = log.filter("op = 'free' or start is not null")
    # A cell range is used if it was allocated once more than it was freed; events at both ends add up to that.
    step = F.when(F.col("op") == "alloc", 1).otherwise(-1)
    ends = now.select("disk", F.explode(F.array(F.struct(F.col("start").alias("at"), step.alias("d")), F.struct((F.col("start") + F.col("length")).alias("at"), (-step).alias("d")))).alias("e")).select("disk", "e.*")
    bounds = log.select("disk").distinct().select("disk", F.explode(F.expr(f"array(0L, {size}L)")).alias("at"), F.lit(0).alias("d"))
    marks = ends.unionByName(bounds).groupBy("disk", "at").agg(F.sum("d").alias("d"))
    w = Window.partitionBy("disk").orderBy("at")
    used = marks.withColumn("used", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("to", F.lead("at").over(w)).filter("to is not null")
    runs = used.withColumn("new", (F.col("used") != F.coalesce(F.lag("used").over(w), F.lit(-1))).cast("long"))
    runs = runs.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("used = 0")
    return runs.groupBy("disk", "run").agg(F.min("at").alias("start"), F.max("to").alias("end")).select("disk", "start", (F.col("end") - F.col("start")).alias("length"))


def measure(steps: DataFrame, spans: DataFrame) -> DataFrame:
    """The cost of spans (span, trace_id, first, last) of a replay's steps, both ends included; spans may nest and overlap."""
    after = steps.select("trace_id", F.col("seq").alias("last"), F.col("total").alias("__a"))
    w = Window.partitionBy("trace_id").orderBy("seq")
    before = steps.select("trace_id", F.col("seq").alias("first"), F.coalesce(F.lag("total").over(w), F.lit(0)).alias("__b"))
    return spans.join(after, ["trace_id", "last"]).join(before, ["trace_id", "first"]).select("span", (F.col("__a") - F.col("__b")).alias("total"))
