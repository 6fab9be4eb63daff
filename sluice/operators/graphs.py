"""Graphs as vertices (id, label) and edges (u, v): neighbours, time-forward processing, maximal independent sets."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.plans.numbering import prefix_sum
from sluice.plans.shared import materialize

#: Incoming edges, about, of the vertices that one task goes through in the order of ids.
CHUNK = 200_000
#: A round takes all vertices that are ready if they are at least so many; else a chunk of the lowest ids goes ahead.
WIDE = 50_000


def canonical(edges: DataFrame) -> DataFrame:
    """Edges (lo, hi) with lo < hi; loops go, parallel edges stay."""
    return edges.filter("u <> v").select(F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi"))


def neighbours(edges: DataFrame) -> DataFrame:
    """Rows (id, neighbour, direction): out to higher ids, in from lower ones."""
    e = canonical(edges)
    return e.select(F.col("lo").alias("id"), F.col("hi").alias("neighbour"), F.lit("out").alias("direction")).unionByName(e.select(F.col("hi").alias("id"), F.col("lo").alias("neighbour"), F.lit("in").alias("direction")))


def process_dag(vertices: DataFrame, edges: DataFrame, function: Callable[[int, object, list[float]], float], *, chunk: int = CHUNK, wide: int = WIDE) -> DataFrame:
    """Rows (id, value): function(id, label, incoming values in the order of their senders) for each vertex, ids unique.

    Values travel along edges from lower to higher ids. Where many vertices have all their values, a round computes them
    in parallel. Where few have, the lowest open ids with about ``chunk`` incoming edges go through one task in their
    order, which is topological: all that they wait for is done or among them. So neither depth nor size is limited, and
    a task holds a chunk or a vertex's own values.
    """
    e = materialize(canonical(edges), "edges")
    need = e.groupBy(F.col("hi").alias("id")).agg(F.count("*").alias("need"))
    open_ = materialize(vertices.select("id", "label").join(need, "id", "left").select("id", "label", F.coalesce("need", F.lit(0)).cast("long").alias("need")), "open")
    waiting = None  # messages of done vertices to open ones: (id, sender, value)
    done = []
    while True:
        if waiting is None:
            state = open_.withColumn("got", F.lit(0).cast("long"))
        else:
            state = open_.join(waiting.groupBy("id").agg(F.count("*").alias("got")), "id", "left").withColumn("got", F.coalesce("got", F.lit(0)))
        state = materialize(state, "state")
        told = state.agg(F.count("*").alias("n"), F.count(F.when(F.col("got") == F.col("need"), 1)).alias("ready")).first()
        if not told["n"]:
            break
        if told["ready"] == told["n"] or told["ready"] >= max(1, wide):
            taken = state.filter("got = need").select("id", "label")
            values = materialize(_apply(_gathered(taken, waiting), function), "values")
        else:
            taken = materialize(_lowest(state, chunk).select("id", "label"), "chunk")
            inner = e.join(taken.select(F.col("id").alias("hi")), "hi", "left_semi").join(taken.select(F.col("id").alias("lo")), "lo", "left_semi")
            values = materialize(_in_order(_gathered(taken, waiting), inner, function), "values")
        done.append(values)
        open_ = state.join(values.select("id"), "id", "left_anti").select("id", "label", "need")
        sent = values.join(e, values["id"] == e["lo"]).select(F.col("hi").alias("id"), F.col("lo").alias("sender"), "value")
        left = sent if waiting is None else waiting.unionByName(sent)
        waiting = materialize(left.join(values.select("id"), "id", "left_anti"), "messages")
    out = done[0] if done else vertices.select("id", F.lit(0.0).alias("value")).limit(0)
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _lowest(state: DataFrame, chunk: int) -> DataFrame:
    """Rows of the lowest ids with, together, about ``chunk`` incoming edges, at least one row."""
    summed = prefix_sum(state.withColumn("__cost", F.col("need") + 1), ["id"], "__cost", "__sum")
    return summed.filter((F.col("__sum") <= chunk) | (F.col("__sum") == F.col("__cost")))


def _gathered(taken: DataFrame, waiting: DataFrame | None) -> DataFrame:
    """(id, label, incoming): array of (sender, value), sorted."""
    none = F.expr("cast(array() as array<struct<sender:bigint,value:double>>)")
    if waiting is None:
        return taken.withColumn("incoming", none)
    lists = waiting.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("sender", "value"))).alias("incoming"))
    return taken.join(lists, "id", "left").withColumn("incoming", F.coalesce("incoming", none))


def _apply(ready: DataFrame, function: Callable) -> DataFrame:
    def work(batches):
        for b in batches:
            rows = zip(*(b.column(k).to_pylist() for k in range(3)), strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([float(function(i, x, [m["value"] for m in got])) for i, x, got in rows], pa.float64())], ["id", "value"])

    return ready.select("id", "label", "incoming").mapInArrow(work, "id long, value double")


def _in_order(rows: DataFrame, inner: DataFrame, function: Callable) -> DataFrame:
    """The values of a chunk, whose own edges are ``inner``, by one task."""
    lists = inner.groupBy(F.col("hi").alias("id")).agg(F.collect_list("lo").alias("near"))

    def work(table: pa.Table) -> pa.Table:
        values: dict[int, float] = {}
        for i, label, got, near in sorted(zip(*(table.column(c).to_pylist() for c in ("id", "label", "incoming", "near")), strict=True), key=lambda r: r[0]):
            told = sorted([(m["sender"], m["value"]) for m in got] + [(s, values[s]) for s in near or []])
            values[i] = float(function(i, label, [v for _, v in told]))
        return pa.table({"id": pa.array(list(values), pa.int64()), "value": pa.array(list(values.values()), pa.float64())})

    return rows.join(lists, "id", "left").withColumn("__one", F.lit(0)).groupBy("__one").applyInArrow(work, "id long, value double")


def process_dag_native(vertices: DataFrame, edges: DataFrame, combine: Callable[[Column], Column], finish: Callable[[Column], Column]) -> DataFrame:
    """process_dag for functions of an aggregate of the incoming values: finish(combine(values)), combine's result null without any.

    No Python runs. There are as many rounds as the longest way has vertices; process_dag is for deep graphs.
    """
    e = materialize(canonical(edges), "edges")
    need = e.groupBy(F.col("hi").alias("id")).agg(F.count("*").alias("need"))
    todo = materialize(vertices.select("id").join(need, "id", "left").select("id", F.coalesce("need", F.lit(0)).alias("need")), "todo")
    now = materialize(todo.filter("need = 0").select("id", finish(F.lit(None).cast("double")).cast("double").alias("value")), "values")
    done, sent = now, None
    while True:
        more = now.join(e, now["id"] == e["lo"]).select(F.col("hi").alias("id"), "value")
        sent = materialize(more if sent is None else sent.unionByName(more), "messages")
        got = sent.groupBy("id").agg(combine(F.col("value")).alias("c"), F.count("*").alias("n"))
        ready = todo.filter("need > 0").join(got, "id").filter("n = need").select("id", finish(F.col("c")).cast("double").alias("value"))
        now = materialize(ready, "values")
        if now.isEmpty():
            return done
        done = done.unionByName(now)
        sent = sent.join(now.select("id"), "id", "left_anti")


def independent_set(vertices: DataFrame, edges: DataFrame, *, chunk: int = CHUNK, wide: int = WIDE) -> DataFrame:
    """Vertices (id) of the set that takes each vertex, in the order of ids, unless a lower neighbour is in.

    Vertices without open lower neighbours join the set and drop their higher ones, all in one round where they are many.
    Where they are few, the lowest open ids with about ``chunk`` edges to lower ones are decided by one task in their
    order. Neither the graph's size nor the longest chain of dependent vertices is limited.
    """
    left = materialize(canonical(edges).distinct(), "edges")
    open_ = materialize(vertices.select("id").distinct(), "open")
    chosen = []
    while True:
        lower = left.groupBy(F.col("hi").alias("id")).agg(F.count("*").alias("need"))
        state = materialize(open_.join(lower, "id", "left").select("id", F.coalesce("need", F.lit(0)).cast("long").alias("need")), "state")
        told = state.agg(F.count("*").alias("n"), F.count(F.when(F.col("need") == 0, 1)).alias("ready")).first()
        if not told["n"]:
            break
        if told["ready"] == told["n"] or told["ready"] >= max(1, wide):
            fresh = taken = state.filter("need = 0").select("id")
        else:
            taken = materialize(_lowest(state, chunk).select("id"), "chunk")
            near = left.join(taken.select(F.col("id").alias("hi")), "hi", "left_semi").groupBy(F.col("hi").alias("id")).agg(F.collect_list("lo").alias("lower"))
            fresh = taken.join(near, "id", "left").withColumn("__one", F.lit(0)).groupBy("__one").applyInArrow(_greedy, "id long")
        fresh = materialize(fresh, "chosen")
        chosen.append(fresh)
        out = left.join(fresh.select(F.col("id").alias("lo")), "lo", "left_semi").select(F.col("hi").alias("id")).distinct()
        open_ = materialize(open_.join(taken, "id", "left_anti").join(out, "id", "left_anti"), "open")
        left = left.join(open_.select(F.col("id").alias("lo")), "lo", "left_semi").join(open_.select(F.col("id").alias("hi")), "hi", "left_semi")
        left = materialize(left.select("lo", "hi"), "edges")
    result = vertices.select("id").limit(0)
    for c in chosen:
        result = result.unionByName(c)
    return result


def _greedy(table: pa.Table) -> pa.Table:
    chosen: set[int] = set()
    for i, lower in sorted(zip(table.column("id").to_pylist(), table.column("lower").to_pylist(), strict=True), key=lambda r: r[0]):
        if not any(x in chosen for x in lower or []):
            chosen.add(i)
    return pa.table({"id": pa.array(sorted(chosen), pa.int64())})


def dependent_edges(vertices: DataFrame, edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges inside the set, and chosen ids that are no vertices (as hi, with lo null)."""
    s = chosen.select("id").distinct()
    inside = canonical(edges).join(s.select(F.col("id").alias("lo")), "lo", "left_semi").join(s.select(F.col("id").alias("hi")), "hi", "left_semi").select("lo", "hi")
    return inside.unionByName(s.join(vertices.select("id"), "id", "left_anti").select(F.lit(None).cast("long").alias("lo"), F.col("id").alias("hi")))


def uncovered_vertices(vertices: DataFrame, edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Vertices that are neither in the set nor next to it."""
    s = chosen.select("id").distinct()
    beside = neighbours(edges).join(s, "id", "left_semi").select(F.col("neighbour").alias("id"))
    return vertices.select("id").join(s, "id", "left_anti").join(beside, "id", "left_anti")


def is_independent(vertices: DataFrame, edges: DataFrame, chosen: DataFrame) -> bool:
    return dependent_edges(vertices, edges, chosen).isEmpty()


def is_maximal(vertices: DataFrame, edges: DataFrame, chosen: DataFrame) -> bool:
    return uncovered_vertices(vertices, edges, chosen).isEmpty()
