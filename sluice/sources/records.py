"""Record files: DataFrames with an explicit position, stored as Parquet. Filters and columns reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def open_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_record(records: DataFrame, index: int, pos: str = "pos") -> DataFrame:
    """The record at a position; a position that no record has gives no row, a negative one is an error."""
    if index < 0:
        raise ValueError("a position is not negative")
    return records.filter(F.col(pos) == index)


def read_batch(records: DataFrame, wanted: DataFrame, pos: str = "pos") -> DataFrame:
    """The records at all positions in column pos of wanted, once for each time it is named."""
    return records.join(wanted.select(pos), pos)


def write_records(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    records.write.mode(mode).parquet(path)


def close_records(records: DataFrame) -> None:
    """Frees what is cached; closing twice is fine."""
    records.unpersist()
