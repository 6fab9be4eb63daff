"""Ordered dictionaries: multisets of keys, keyed values, and logs of batched operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.operators.overlay import last_writes
from sluice.plans.numbering import last_known, occurrences, repeat


def search(keys: DataFrame, probes: DataFrame, key: str = "key") -> DataFrame:
    """Each probe once for each time it is asked, with found."""
    there = keys.select(key).distinct().withColumn("__hit", F.lit(True))
    return probes.select(key).join(there, key, "left").select(key, F.col("__hit").isNotNull().alias("found"))


def insert(keys: DataFrame, more: DataFrame, key: str = "key") -> DataFrame:
    """A multiset: equal keys are kept again."""
    return keys.select(key).unionByName(more.select(key))


def insert_pairs(pairs: DataFrame, more: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Pairs (key, value, order) with more behind them: a key that is there already keeps its values and gets another.

    The places of ``more`` are moved behind the largest one before, so ``order`` tells the insertions' order.
    """
    last = pairs.agg(F.coalesce(F.max(order) + 1, F.lit(0)).alias("__last"))
    moved = more.crossJoin(F.broadcast(last)).select(key, value, (F.col(order) + F.col("__last")).alias(order))  # one row
    return pairs.select(key, value, order).unionByName(moved)


def delete(keys: DataFrame, gone: DataFrame, key: str = "key") -> DataFrame:
    """Takes one copy away for each row of gone; keys that are not there are left alone.

    Copies are alike, so counting decides how many stay: both sides are combined before the shuffle.
    """
    have = keys.groupBy(key).agg(F.count("*").alias("__n"))
    less = gone.groupBy(key).agg(F.count("*").alias("__d"))
    stay = have.join(less, key, "left").withColumn("__s", F.greatest(F.col("__n") - F.coalesce("__d", F.lit(0)), F.lit(0))).filter("__s > 0")
    return repeat(stay, "__s").select(key)


def delete_rows(rows: DataFrame, gone: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Like delete, for rows with more columns: the first ones in the order go."""
    counts = gone.groupBy(F.col(key).alias("__k")).agg(F.count("*").alias("__d"))
    numbered = occurrences(rows, key, order, "__o").join(counts, F.col(key) == F.col("__k"), "left")
    return numbered.filter(F.col("__d").isNull() | (F.col("__o") >= F.col("__d"))).select(*rows.columns)


def min_max(keys: DataFrame, key: str = "key") -> DataFrame:
    """One row; nulls if there is no key."""
    return keys.agg(F.min(key).alias("min_key"), F.max(key).alias("max_key"))


def neighbours(keys: DataFrame, probes: DataFrame, key: str = "key") -> DataFrame:
    """Each distinct probe with the largest key below it and the smallest above, or null.

    Keys and probes are sorted together by range; the ends of each range come from the ranges beside it.
    """
    from sluice.plans.numbering import _ordered

    both = keys.select(key).distinct().withColumn("__is", F.lit(1)).unionByName(probes.select(key).distinct().withColumn("__is", F.lit(0)))
    merged = both.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max("__is").alias("__is"), F.max(1 - F.col("__is")).alias("__ask"))
    placed = _ordered(merged, [key]).withColumn("__p", F.shiftright("__m", 33))
    real = F.when(F.col("__is") == 1, F.col(key))
    ends = placed.groupBy("__p").agg(F.min(real).alias("__lo"), F.max(real).alias("__hi"))
    along = Window.orderBy("__p")  # a row a range
    ends = F.broadcast(ends.select("__p", F.max("__hi").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"), F.min("__lo").over(Window.orderBy(F.desc("__p")).rowsBetween(Window.unboundedPreceding, -1)).alias("__after")))
    inside = Window.partitionBy("__p").orderBy("__m")
    below = F.max(real).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    # From the other end: a frame that grows costs a row, one that shrinks is summed up anew for each.
    above = F.min(real).over(Window.partitionBy("__p").orderBy(F.desc("__m")).rowsBetween(Window.unboundedPreceding, -1))
    out = placed.withColumn("__b", below).withColumn("__a", above).join(ends, "__p").filter("__ask = 1")
    return out.select(key, F.coalesce("__b", "__before").alias("predecessor"), F.coalesce("__a", "__after").alias("successor"))


def lookup(pairs: DataFrame, probes: DataFrame, key: str, value: str, *, policy: str = "all", order: list[str] | None = None) -> DataFrame:
    """Each probe with its values, null if there is none. policy: all of a key's, or the first or last by the order."""
    if policy not in ("all", "first", "last"):
        raise ValueError(f"no such policy: {policy}")
    own = pairs.select(key, value)
    if policy != "all":
        pick = F.min_by if policy == "first" else F.max_by
        own = pairs.groupBy(key).agg(pick(value, F.struct(*order)).alias(value))
    return probes.join(own, key, "left")


def final_state(log: DataFrame, *, key: str = "key", seq: str = "seq", op: str = "op", value: str = "value") -> DataFrame:
    """(key, value) after all operations insert, delete and search of a log; inserts overwrite."""
    done = log.filter(F.col(op).isin("insert", "delete")).select(key, seq, op, value)
    return last_writes(done, [key], [seq]).filter(F.col(op) == "insert").select(key, value)


def search_results(log: DataFrame, *, key: str = "key", seq: str = "seq", op: str = "op", value: str = "value") -> DataFrame:
    """Each search (seq, key, found, value) as of its place in the log."""
    state = F.when(F.col(op) != "search", F.struct(F.col(op).alias("op"), F.col(value).alias("value")))
    seen = last_known(log.withColumn("__state", state), [key], [seq], "__state", "__s").filter(F.col(op) == "search")
    there = F.coalesce(F.col("__s.op") == "insert", F.lit(False))
    return seen.select(seq, key, there.alias("found"), F.when(there, F.col("__s.value")).alias(value))


def last_search_results(log: DataFrame, **names: str) -> DataFrame:
    """For each key that was searched, what the last search saw."""
    seen = search_results(log, **names)
    return last_writes(seen, [names.get("key", "key")], [names.get("seq", "seq")])
