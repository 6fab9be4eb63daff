"""Writes to records and blocks as overlays: the last write to a place wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions import floor_div
from sluice.plans.numbering import prefix_sum


def last_writes(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key. As an aggregation, so that a hot key is combined before the shuffle."""
    rest = [c for c in log.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return log.groupBy(*keys).agg(best.alias("__last")).select(*keys, "__last.*")


def overlay(base: DataFrame, writes: DataFrame, keys: list[str]) -> DataFrame:
    """The base with the rows of writes in place of those with their keys, and added where there were none."""
    names = base.columns
    return base.join(writes.select(*keys), keys, "left_anti").select(*names).unionByName(writes.select(*names))


def read_block(records: DataFrame, block: int, size: int, pos: str = "pos") -> DataFrame:
    """The rows whose positions fall into a block, as a range that reaches the scan."""
    return records.filter((F.col(pos) >= block * size) & (F.col(pos) < (block + 1) * size))


def block_sums(records: DataFrame, size: int, value: str, pos: str = "pos") -> DataFrame:
    """Rows (block, total, prefix): each block's sum and the sum up to and with it. One row a block."""
    per = records.groupBy(floor_div(pos, size).alias("block")).agg(F.sum(value).alias("total"))
    return prefix_sum(per, ["block"], "total", "prefix")
