"""Linked lists with pointers that stay valid, as logs of inserts and removals.

An insert after a pointer makes it a child of that element; the list is the tree's preorder, the newest child first. A
tour of the tree is a list, so list ranking orders it in rounds that grow with the logarithm of its length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators.lists import BASE, list_rank
from sluice.plans.numbering import number_rows
from sluice.plans.shared import materialize

#: The pointer of the head, before all elements.
HEAD = 0


def order(inserts: DataFrame, removed: DataFrame | None = None, *, base: int = BASE) -> DataFrame:
    """Elements (pointer, value, place) of inserts (pointer, after, seq, value) without the removed pointers, places from 0.

    after null inserts at the head. Pointers are positive and unique; an insert after one that does not exist earlier is
    an error.
    """
    rows = inserts.select("pointer", F.coalesce("after", F.lit(HEAD)).alias("parent"), "seq", "value")
    known = rows.select(F.col("pointer").alias("parent"), F.col("seq").alias("__s"))
    bad = rows.filter(F.col("parent") != HEAD).join(known, "parent", "left").filter("__s is null or __s >= seq")
    if not bad.isEmpty():
        raise ValueError("an insert after a pointer that does not exist")
    # Siblings, the newest first, from places in one order of all: an element may have any number of children.
    placed = materialize(number_rows(rows.select("pointer", "parent", (-F.col("seq")).alias("__age")), ["parent", "__age"], "__g"), "siblings")
    after = placed.select((F.col("__g") - 1).alias("__g"), F.col("pointer").alias("__n"), F.col("parent").alias("__np"))
    told = placed.join(after, "__g", "left").select("pointer", "parent", F.when(F.col("__np") == F.col("parent"), F.col("__n")).alias("next_sibling"))
    first = rows.groupBy(F.col("parent").alias("__p")).agg(F.max_by("pointer", "seq").alias("child"))
    # Each element is entered (2p) and left (2p + 1); entering weighs 1.
    enter = told.join(first, F.col("pointer") == F.col("__p"), "left").select((F.col("pointer") * 2).alias("node_id"), F.coalesce(F.col("child") * 2, F.col("pointer") * 2 + 1).alias("next_id"), F.lit(1).cast("long").alias("weight"))
    leave = told.select((F.col("pointer") * 2 + 1).alias("node_id"), F.coalesce(F.col("next_sibling") * 2, F.when(F.col("parent") != HEAD, F.col("parent") * 2 + 1)).alias("next_id"), F.lit(0).cast("long").alias("weight"))
    ranks = list_rank(enter.unionByName(leave), base=base).filter("node_id % 2 = 0").select(F.shiftright("node_id", 1).alias("pointer"), "rank")
    placed = rows.select("pointer", "value").join(ranks, "pointer")
    if removed is None:
        return placed.select("pointer", "value", F.col("rank").alias("place"))
    return number_rows(placed.join(removed.select("pointer"), "pointer", "left_anti"), ["rank"], "place").select("pointer", "value", "place")


def traverse(ordered: DataFrame, pointer: int | None = None, count: int | None = None) -> DataFrame:
    """Elements from a pointer (None: the head) on, at most count of them, with their places."""
    start = 0
    if pointer is not None:
        at = ordered.filter(F.col("pointer") == pointer).select("place").first()
        if at is None:
            raise ValueError(f"no element {pointer}")
        start = at["place"]
    rows = ordered.filter(F.col("place") >= start)
    return rows if count is None else rows.filter(F.col("place") < start + count)


def lookup(inserts: DataFrame, pointer: int, removed: DataFrame | None = None):
    """The value at a pointer; an error if it was never there or is gone."""
    row = inserts.filter(F.col("pointer") == pointer)
    if removed is not None:
        row = row.join(removed.select("pointer"), "pointer", "left_anti")
    got = row.select("value").first()
    if got is None:
        raise ValueError(f"no element {pointer}")
    return got["value"]


def lookups(inserts: DataFrame, probes: DataFrame, removals: DataFrame | None = None) -> DataFrame:
    """Each probe (pointer, seq) as of its place in the log, with found and value."""
    rows = probes.join(inserts.select("pointer", F.col("seq").alias("__i"), "value"), "pointer", "left")
    if removals is not None:
        rows = rows.join(removals.groupBy("pointer").agg(F.min("seq").alias("__r")), "pointer", "left")
    else:
        rows = rows.withColumn("__r", F.lit(None).cast("long"))
    there = F.col("__i").isNotNull() & (F.col("__i") < F.col("seq")) & (F.col("__r").isNull() | (F.col("__r") > F.col("seq")))
    return rows.select("pointer", "seq", there.alias("found"), F.when(there, F.col("value")).alias("value"))
