"""Range-sum queries: static over prefix or block sums, and dynamic over a log of updates and queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions import floor_div
from sluice.operators.overlay import block_sums
from sluice.plans.numbering import last_known, number_rows, prefix_sum, running_sum
from sluice.plans.shared import discard, materialize

RELATIVE, QUERY, ABSOLUTE = 0, 1, 2


def check_ranges(queries: DataFrame, size: int, i: str = "i", j: str = "j") -> None:
    """Raises unless 0 <= i <= j < size holds for all."""
    if not queries.filter((F.col(i) < 0) | (F.col(j) >= size) | (F.col(i) > F.col(j))).isEmpty():
        raise ValueError(f"a range outside [0, {size - 1}] or upside down")


class StaticRangeSums:
    """Point-in-time queries on an array (idx, val) of contiguous indices.

    With a block size, only block sums are kept and the edges are read by range; without one, all prefix sums are.
    """

    def __init__(self, array: DataFrame, block: int | None = None):
        self.size = array.count()
        self.block = block
        self.array = array.select("idx", "val")
        self.sums = materialize(block_sums(self.array, block, "val", "idx") if block else prefix_sum(self.array, ["idx"], "val").select("idx", "prefix"), "sums")

    def query(self, i: int, j: int) -> int:
        if i < 0 or j >= self.size or i > j:
            raise ValueError(f"a range outside [0, {self.size - 1}] or upside down")
        if self.block:
            first, last = -(-i // self.block), (j + 1) // self.block  # whole blocks, if first < last
            if first >= last:
                return self.array.filter(F.col("idx").between(i, j)).agg(F.sum("val")).first()[0]
            middle = self.sums.filter((F.col("block") >= first) & (F.col("block") < last)).agg(F.sum("total")).first()[0]
            edges = self.array.filter(F.col("idx").between(i, first * self.block - 1) | F.col("idx").between(last * self.block, j))
            return middle + (edges.agg(F.sum("val")).first()[0] or 0)
        got = {r["idx"]: r["prefix"] for r in self.sums.filter(F.col("idx").isin(i - 1, j)).collect()}
        return got[j] - got.get(i - 1, 0)

    def query_many(self, queries: DataFrame) -> DataFrame:
        """Rows (query_id, sum) for all queries (query_id, i, j): lookups in the kept prefix sums, by two equi-joins."""
        if self.block:
            raise ValueError("without prefix sums, static_blocks answers many queries")
        check_ranges(queries, self.size)
        return _from_sums(self.sums, queries)

    def close(self) -> None:
        discard(self.sums)


def static_offline(array: DataFrame, queries: DataFrame) -> DataFrame:
    """Rows (query_id, sum) for all queries (query_id, i, j) on an array (idx, val): two equi-joins with prefix sums."""
    return _from_sums(prefix_sum(array.select("idx", "val"), ["idx"], "val").select("idx", "prefix"), queries)


def _from_sums(sums: DataFrame, queries: DataFrame) -> DataFrame:
    upper = sums.select(F.col("idx").alias("j"), F.col("prefix").alias("__s"))
    lower = sums.select((F.col("idx") + 1).alias("i"), F.col("prefix").alias("__b"))
    joined = queries.join(upper, "j").join(lower, "i", "left")
    return joined.select("query_id", (F.col("__s") - F.coalesce("__b", F.lit(0))).alias("sum"))


def static_blocks(array: DataFrame, queries: DataFrame, block: int) -> DataFrame:
    """The same by block sums: the block table, one row a block, and prefix sums within the block of each end."""
    w = Window.partitionBy("block").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    inside = array.select("idx", floor_div("idx", block).alias("block"), "val").withColumn("part", F.sum("val").over(w))
    before = block_sums(array, block, "val", "idx").select("block", (F.col("prefix") - F.col("total")).alias("before"))
    sums = inside.join(before, "block").select("idx", (F.col("part") + F.col("before")).alias("s"))
    upper, lower = sums.select(F.col("idx").alias("j"), F.col("s").alias("__s")), sums.select((F.col("idx") + 1).alias("i"), F.col("s").alias("__b"))
    return queries.join(upper, "j").join(lower, "i", "left").select("query_id", (F.col("__s") - F.coalesce("__b", F.lit(0))).alias("sum"))


def absolute_to_relative(updates: DataFrame) -> DataFrame:
    """Updates (time_id, op_type, idx, val) with rel: what each adds to its place. An absolute one sets it, from zero at first."""
    sums = running_sum(updates, ["idx"], ["time_id"], "val", "__s")
    # What counts begins with the latest absolute update: the sum before it falls away.
    sums = sums.withColumn("__cut", F.when(F.col("op_type") == ABSOLUTE, F.col("__s") - F.col("val")))
    since = last_known(sums, ["idx"], ["time_id"], "__cut", "__base", with_row=True)
    since = since.withColumn("__after", F.col("__s") - F.coalesce("__base", F.lit(0)))
    before = last_known(since, ["idx"], ["time_id"], "__after", "__before")
    return before.withColumn("rel", F.col("__after") - F.coalesce("__before", F.lit(0))).drop("__s", "__cut", "__base", "__after", "__before")


def dynamic_offline(log: DataFrame, size: int) -> DataFrame:
    """Rows (query_id, sum): query_id counts the log's queries by time; each sees the updates of smaller times.

    log: (time_id, op_type, arg1, arg2), times unique; updates have index and value, queries i and j. A segment tree of
    2 * 2^levels nodes turns a range into at most 2 * levels node lookups, so it is one running sum and one aggregation
    and never a join by range; the root's log, which is the whole one, spreads over the ranges of the running sum.
    """
    levels = max(0, (size - 1).bit_length())
    leaf = 1 << levels
    log = log.select(*[F.col(c).cast("long") for c in ("time_id", "op_type", "arg1", "arg2")])
    queries = materialize(number_rows(log.filter(F.col("op_type") == QUERY), ["time_id"], "query_id").select("query_id", "time_id", F.col("arg1").alias("i"), F.col("arg2").alias("j")), "queries")
    check_ranges(queries, size)
    changes = log.filter(F.col("op_type").isin(RELATIVE, ABSOLUTE)).select("time_id", "op_type", F.col("arg1").alias("idx"), F.col("arg2").alias("val"))
    if not changes.filter((F.col("idx") < 0) | (F.col("idx") >= size)).isEmpty():
        raise ValueError(f"an update outside [0, {size - 1}]")
    level = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("k")
    up = absolute_to_relative(changes).select("time_id", "idx", "rel", level).select(F.expr(f"shiftright(idx + {leaf}, k)").alias("node"), "time_id", "rel", F.lit(None).cast("long").alias("query_id"))
    # On level k the cover's left end is ceil((i + leaf) / 2^k), its right end floor((j + 1 + leaf) / 2^k).
    at = queries.select("query_id", "time_id", "i", "j", level)
    at = at.select("query_id", "time_id", F.expr(f"shiftright(i + {leaf} + shiftleft(1L, k) - 1, k)").alias("l"), F.expr(f"shiftright(j + 1 + {leaf}, k)").alias("r")).filter("l < r")
    cover = at.select("query_id", "time_id", F.explode(F.expr("filter(array(if(l % 2 = 1, l, null), if(r % 2 = 1, r - 1, null)), x -> x is not null)")).alias("node"))
    down = cover.select("node", "time_id", F.lit(0).cast("long").alias("rel"), "query_id")
    both = up.unionByName(down).withColumn("__asks", F.col("query_id").isNotNull())
    seen = running_sum(both, ["node"], ["time_id", "__asks", "query_id"], "rel", "s").filter("query_id is not null")
    sums = seen.groupBy("query_id").agg(F.sum("s").alias("sum"))
    return queries.select("query_id").join(sums, "query_id", "left").select("query_id", F.coalesce("sum", F.lit(0)).alias("sum"))
