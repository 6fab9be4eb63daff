"""Global positions and running sums without a single-partition window.

Rows are range-partitioned and sorted by their order, written once, and each partition's count (or sum) gives the next
one's start. The table of starts has a row for each partition, whatever the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.plans.shared import materialize


def _ordered(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows with __m, which holds the partition in its upper bits and the place in it below them."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()), "ordered")


def _starts(ordered: DataFrame, amount: Column, name: str) -> DataFrame:
    per = ordered.groupBy(F.shiftright("__m", 33).alias("__p")).agg(amount.alias(name))
    # One row a partition: bounded by the number of shuffle partitions.
    return per.select("__p", F.coalesce(F.sum(name).over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias(name))


def number_rows(df: DataFrame, order: list[str], name: str = "pos") -> DataFrame:
    """Adds the row's 0-based place in the order, which should be total: equal rows get places in any order."""
    ordered = _ordered(df, order)
    starts = F.broadcast(_starts(ordered, F.count("*"), "__n"))
    place = F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.withColumn("__p", F.shiftright("__m", 33)).join(starts, "__p").withColumn(name, F.col("__n") + place).drop("__m", "__n", "__p")


def prefix_sum(df: DataFrame, order: list[str], value: str, name: str = "prefix") -> DataFrame:
    """Adds the sum of an integer column up to and with the row; null counts as zero."""
    ordered = _ordered(df, order)
    starts = F.broadcast(_starts(ordered, F.sum(F.coalesce(value, F.lit(0))), "__s"))
    within = F.sum(F.coalesce(value, F.lit(0))).over(Window.partitionBy("__p").orderBy("__m").rowsBetween(Window.unboundedPreceding, 0))
    return ordered.withColumn("__p", F.shiftright("__m", 33)).withColumn("__w", within).join(starts, "__p").withColumn(name, F.col("__s") + F.col("__w")).drop("__m", "__p", "__s", "__w")


def _placed(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return _ordered(df, [*keys, *order]).withColumn("__p", F.shiftright("__m", 33))


def _with_carry(inner: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    """Joins each range's share of a key with what the ranges before it leave; keys may be null."""
    own = carried.select(F.col("__p").alias("__q"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__carry")
    same = F.col("__p") == F.col("__q")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return inner.join(own, same, "left").drop("__q", *[f"__k{i}" for i in range(len(keys))])


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, *, low: str | None = None, prior: str | None = None) -> DataFrame:
    """Adds the sum of an integer column over the rows of the same keys up to and with each row.

    low: name of the least such sum so far; prior: of the least one before the row, null if it is the first.

    Rows are sorted by range, keys first, so the rows of one key spread over the ranges: sums are made within a range's
    share of a key, and a share's start comes from those before it, a row for each range and key.
    """
    placed = _placed(df, keys, order)
    share = Window.partitionBy("__p", *keys).orderBy("__m").rowsBetween(Window.unboundedPreceding, 0)
    inner = placed.withColumn("__w", F.sum(F.coalesce(value, F.lit(0))).over(share).cast("long"))
    inner = inner.withColumn("__l", F.min("__w").over(share)).withColumn("__b", F.min("__w").over(share.rowsBetween(Window.unboundedPreceding, -1)))
    per = inner.groupBy("__p", *keys).agg(F.sum(F.coalesce(value, F.lit(0))).cast("long").alias("__t"), F.min("__l").alias("__low"))
    past = Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("__s", F.coalesce(F.sum("__t").over(past), F.lit(0)))
    per = per.withColumn("__carry", F.struct(F.col("__s").alias("s"), F.min(F.col("__s") + F.col("__low")).over(past).alias("l")))
    out = _with_carry(inner, per, keys).withColumn(name, F.col("__w") + F.col("__carry.s"))
    if low:
        out = out.withColumn(low, F.least(F.col("__l") + F.col("__carry.s"), F.col("__carry.l")))
    if prior:
        out = out.withColumn(prior, F.least(F.col("__b") + F.col("__carry.s"), F.col("__carry.l")))
    return out.drop("__m", "__p", "__w", "__l", "__b", "__carry")


def last_known(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, *, with_row: bool = False) -> DataFrame:
    """Adds the latest value that is not null among the rows of the same keys before each row, or up to and with it. No task holds a whole key."""
    placed = _placed(df, keys, order)
    rows = Window.partitionBy("__p", *keys).orderBy("__m").rowsBetween(Window.unboundedPreceding, 0 if with_row else -1)
    inner = placed.withColumn("__w", F.last(value, ignorenulls=True).over(rows))
    known = F.when(F.col(value).isNotNull(), F.col("__m"))
    per = inner.groupBy("__p", *keys).agg(F.max_by(value, known).alias("__t"))
    past = Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("__carry", F.last("__t", ignorenulls=True).over(past))
    return _with_carry(inner, per, keys).withColumn(name, F.coalesce("__w", "__carry")).drop("__m", "__p", "__w", "__carry")


def occurrences(df: DataFrame, key: str, order: list[str], name: str = "occ") -> DataFrame:
    """Adds the row's 0-based place among the rows of its key; rows without a key get null.

    From global places and each key's first one, so no task holds a whole key.
    """
    placed = number_rows(df, [key, *order], "__g")
    first = placed.groupBy(F.col(key).alias("__key")).agg(F.min("__g").alias("__first"))
    return placed.join(first, F.col(key) == F.col("__key"), "left").withColumn(name, F.col("__g") - F.col("__first")).drop("__g", "__key", "__first")


#: Copies that one array names at a time.
CHUNK = 1 << 16


def repeat(df: DataFrame, times: str, name: str = "__copy") -> DataFrame:
    """Each row as often as a column of longs says, its copies numbered from 0 in ``name``.

    In two steps, of chunks and of at most CHUNK copies in each, so no array grows with the count beyond a long for
    every CHUNK copies; the copies themselves only stream by.
    """
    n = F.col(times)
    chunks = df.withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.greatest(n, F.lit(1)) - 1) / CHUNK).cast("long")))).filter(n > 0)
    first = F.col("__chunk") * CHUNK
    return chunks.withColumn(name, F.explode(F.sequence(first, F.least(first + CHUNK, n) - 1))).drop("__chunk")
