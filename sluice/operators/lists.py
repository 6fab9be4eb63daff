"""List ranking: the sum of weights on the way from a list's head to each node."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions import coin
from sluice.operators.joining import anti_head
from sluice.plans.shared import materialize

#: Nodes that one task ranks in memory, once contraction has left so few.
BASE = 20_000


def find_head(nodes: DataFrame) -> DataFrame:
    """The nodes that no other points to, as (node_id)."""
    return anti_head(nodes).select("node_id")


def contract(nodes: DataFrame) -> DataFrame:
    """One round of (node_id, next_id, weight): nodes with coin 1 whose successor has 0 go, and their predecessors skip them.

    A head keeps coin 0 and a tail counts its successor's as 1, so both stay.
    """
    heads = anti_head(nodes).select(F.col("node_id").alias("__h"))
    tossed = nodes.join(heads, F.col("node_id") == F.col("__h"), "left").withColumn("bit", F.when(F.col("__h").isNotNull(), 0).otherwise(coin("node_id"))).drop("__h")
    other = tossed.select(F.col("node_id").alias("__n"), F.col("bit").alias("__b"))
    marked = tossed.join(other, F.col("next_id") == F.col("__n"), "left").withColumn("gone", (F.col("bit") == 1) & (F.coalesce("__b", F.lit(1)) == 0)).drop("__n", "__b", "bit")
    gone = marked.filter("gone").select(F.col("node_id").alias("__g"), F.col("next_id").alias("__next"), F.col("weight").alias("__w"))
    left = marked.filter("not gone").join(gone, F.col("next_id") == F.col("__g"), "left")
    return left.select("node_id", F.when(F.col("__g").isNotNull(), F.col("__next")).otherwise(F.col("next_id")).alias("next_id"), (F.col("weight") + F.coalesce("__w", F.lit(0))).alias("weight"))


def _in_memory(table: pa.Table) -> pa.Table:
    node, weight = table.column("node_id").to_numpy(), table.column("weight").to_numpy()
    ends = table.column("next_id").is_null().to_numpy(zero_copy_only=False)
    order = np.argsort(node)
    source = np.flatnonzero(~ends)
    target = order[np.searchsorted(node[order], table.column("next_id").to_numpy()[source].astype(np.int64)).clip(0, len(node) - 1)]
    at, rank = np.arange(len(node)), np.zeros(len(node), np.int64)
    at[target], rank[target] = source, weight[source]
    done = at == np.arange(len(node))
    if len(target):
        done[target[target == source]] = False  # a loop of one has no head
    for _ in range(len(node).bit_length() + 1):  # pointer doubling
        rank = rank + np.where(done, 0, rank[at])
        done, at = done | done[at], at[at]
    return pa.table({"node_id": pa.array(node), "rank": pa.array(rank, mask=~done)})


def list_rank(nodes: DataFrame, *, base: int = BASE) -> DataFrame:
    """Rows (node_id, rank) of lists (node_id, next_id, weight); next_id null ends a list, and every list has its own head.

    A round takes out an independent set, about a quarter of the nodes, in one join that also bridges what is left. Heads
    stay, and a list of a head alone is done. Once at most ``base`` nodes are left, one task ranks them; then the rounds'
    nodes come back in the opposite order, each with the rank of its predecessor and the weight between them. Rows
    written add up to a multiple of the nodes. A cycle is an error.
    """
    heads = anti_head(nodes).select(F.col("node_id").alias("__h"))
    start = nodes.select("node_id", "next_id", F.col("weight").cast("long").alias("weight")).join(heads, F.col("node_id") == F.col("__h"), "left")
    now = materialize(start.select("node_id", "next_id", "weight", F.col("__h").isNotNull().alias("head")), "list")
    removed, single = [], []
    toss = lambda c, k: F.pmod(F.xxhash64(c, F.lit(k)), F.lit(2))
    while True:
        told = now.agg(F.count(F.when(F.col("head") & F.col("next_id").isNull(), 1)).alias("single"), F.count("*").alias("n"), F.max(F.col("next_id") == F.col("node_id")).alias("loop")).first()
        if told["loop"]:
            raise ValueError("a list that has no head")
        if told["single"]:
            single.append(now.filter("head and next_id is null").select("node_id", F.lit(0).cast("long").alias("rank")))
            now = now.filter("not (head and next_id is null)")
        if told["n"] - told["single"] <= base:
            break
        turn = len(removed)
        goes = ~F.col("head") & (toss("node_id", turn) == 1) & (F.col("next_id").isNull() | (toss("next_id", turn) == 0))
        marked = now.withColumn("goes", goes)
        out = marked.filter("goes").select(F.col("node_id").alias("__g"), F.col("next_id").alias("__next"), F.col("weight").alias("__w"))
        both = materialize(marked.join(out, F.col("next_id") == F.col("__g"), "left"), "round")
        removed.append(both.filter("__g is not null").select(F.col("__g").alias("node_id"), F.col("node_id").alias("parent"), F.col("weight").alias("step")))
        bridged = F.col("__g").isNotNull()
        now = both.filter("not goes").select("node_id", F.when(bridged, F.col("__next")).otherwise(F.col("next_id")).alias("next_id"), (F.col("weight") + F.coalesce("__w", F.lit(0))).alias("weight"), "head")
    ranks = materialize(now.withColumn("__one", F.lit(0)).groupBy("__one").applyInArrow(_in_memory, "node_id long, rank long"), "ranks")
    if not ranks.filter("rank is null").isEmpty():
        raise ValueError("a list that has no head")
    for s in single:
        ranks = ranks.unionByName(s)
    for r in reversed(removed):
        back = r.join(ranks.select(F.col("node_id").alias("parent"), "rank"), "parent").select("node_id", (F.col("rank") + F.col("step")).alias("rank"))
        ranks = ranks.unionByName(materialize(back, "ranks"))
    return ranks


def same_ranks(ranks: DataFrame, expected: DataFrame) -> bool:
    """Whether both hold the same (node_id, rank) rows, repeats counted."""
    a, b = ranks.select("node_id", "rank"), expected.select("node_id", "rank")
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def random_list(spark, n: int, seed: int = 42) -> DataFrame:
    """A shuffled list of ids 1..n with weights 1..10, for tests and demonstrations."""
    rng = np.random.default_rng(seed)
    ids = rng.permutation(np.arange(1, n + 1)).tolist()
    return spark.createDataFrame([(a, b, w) for a, b, w in zip(ids, [*ids[1:], None], rng.integers(1, 11, n).tolist(), strict=True)], "node_id long, next_id long, weight long")
