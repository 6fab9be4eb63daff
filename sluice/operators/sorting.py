"""Stable sorts and multiway range partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions import subrange
from sluice.plans.numbering import number_rows, prefix_sum, repeat


def external_sort(records: DataFrame, key: str, pos: str = "pos", name: str = "rank") -> DataFrame:
    """Ascending by key, equal keys by their position before; name is the position after. Empty in, empty out."""
    return number_rows(records, [key, pos], name)


def sort_values(values: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """Bare values in ascending order, by counting: equal values need no order among them, so their places are a range.

    The distinct values are numbered, not the rows; rows come back by their count.
    """
    counts = values.groupBy(value).agg(F.count("*").alias("__c"))
    ended = prefix_sum(counts, [value], "__c", "__e")
    return repeat(ended, "__c").select(value, (F.col("__e") - F.col("__c") + F.col("__copy")).alias(name))


def check_range(values: DataFrame, value: str, low: int, high: int) -> None:
    """Raises if a value lies outside."""
    if not values.filter((F.col(value) < low) | (F.col(value) > high)).isEmpty():
        raise ValueError(f"a value outside [{low}, {high}]")


def partition_histogram(values: DataFrame, value: str, low: int, high: int, parts: int) -> DataFrame:
    """Rows (bucket, n, start): counts of the equal-width subranges, empty ones left out, and where each begins."""
    counts = values.groupBy(subrange(value, low, high, parts).alias("bucket")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    return counts.withColumn("start", F.coalesce(before, F.lit(0)).cast("long"))


def partition_sort(values: DataFrame, value: str, low: int, high: int, parts: int, name: str = "rank") -> DataFrame:
    """Values of [low, high] in ascending order with their subrange and place; a value outside is an error."""
    check_range(values, value, low, high)
    return sort_values(values, value, name).withColumn("bucket", subrange(value, low, high, parts))


def top_k(rows: DataFrame, order: list[str], k: int) -> DataFrame:
    """The first k rows of an order; planned as a bounded heap in each task."""
    if k < 0:
        raise ValueError("k is not negative")
    return rows.orderBy(*order).limit(k)
