"""Merge joins: SQL's, and the one that pairs the k-th left row of a key with its k-th right row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.plans.numbering import occurrences


def merge_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner", *, default: int = 1, mode: str = "sql", left_order: list[str] | None = None, right_order: list[str] | None = None) -> DataFrame:
    """All left columns, then the right ones but the key. Null keys match nothing.

    how: inner, or left_outer, which gives unmatched left rows the default in every right column; nulls of matched rows
    stay. mode: sql pairs all rows of a key; zip pairs them one to one by place in left_order and right_order, drops
    (inner) or pads (left_outer) what is left over on the left, and skips it on the right.
    """
    if how not in ("inner", "left_outer"):
        raise ValueError(f"no such join: {how}")
    if mode not in ("sql", "zip"):
        raise ValueError(f"no such mode: {mode}")
    own = [c for c in right.columns if c != right_key]
    if clash := set(own) & set(left.columns):
        raise ValueError(f"both sides have {sorted(clash)}")
    r = right.withColumnRenamed(right_key, "__k").withColumn("__hit", F.lit(True))
    on = F.col(left_key) == F.col("__k")
    if mode == "zip":
        if not left_order or not right_order:
            raise ValueError("a one-to-one join needs both orders")
        # The occurrence is part of the key, so a hot key's pairs spread over the join's tasks.
        left = occurrences(left, left_key, left_order, "__o")
        r = occurrences(r, "__k", right_order, "__ro")
        on = on & (F.col("__o") == F.col("__ro"))
    joined = left.join(r, on, "inner" if how == "inner" else "left")
    names = [c for c in left.columns if c != "__o"]
    pad = lambda c: F.col(c) if how == "inner" else F.when(F.col("__hit").isNull(), F.lit(default)).otherwise(F.col(c)).alias(c)
    return joined.select(*names, *[pad(c) for c in own])


def anti_head(nodes: DataFrame, node: str = "node_id", successor: str = "next_id") -> DataFrame:
    """Nodes that no other points to."""
    targets = nodes.select(F.col(successor).alias("__t")).filter("__t is not null")
    return nodes.join(targets, F.col(node) == F.col("__t"), "left_anti")


def merge_streams(first: DataFrame, second: DataFrame, time: str) -> DataFrame:
    """Both streams' rows (missing columns null) with __order: 0 for first, which ties go to, 1 for second."""
    return first.withColumn("__order", F.lit(0)).unionByName(second.withColumn("__order", F.lit(1)), allowMissingColumns=True)
