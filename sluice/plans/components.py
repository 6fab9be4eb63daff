"""Connected components of a graph given as edges, by alternating large-star and small-star steps.

Each step is a min-aggregation by node and a join of the edges with its result, so no task gathers a node's neighbours:
the aggregation combines before it shuffles, and the join's large keys can be split at run time. The rounds grow with
the logarithm of the longest path. Every round's edges go to a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.plans.shared import discard, materialize


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """edges: u > v. Large: every larger neighbour of a node goes to the least of its neighbourhood; small: the others do."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u"))).toDF("n", "x")
        least = both.groupBy("n").agg(F.min("x").alias("m")).select("n", F.least("n", "m").alias("m"))
        return both.filter("x > n").join(least, "n").select(F.col("x").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter("u > v").distinct()


def components(edges: DataFrame, a: str, b: str, *, max_rounds: int = 60) -> DataFrame:
    """Rows (node, root): each node that has an edge, with the least node it reaches. Loops and nulls are left out."""
    now = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        large = _stars(now, True)
        after = materialize(_stars(large, False), "edges")
        discard(now)
        now = after
        seen = now.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x"), F.max("u").alias("u")).first()
        if seen == mark or seen["n"] == 0:
            break
        mark = seen
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
