"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.plans.shared import discard, fresh_path, materialize, shared_dir

__all__ = ["BATCH_BYTES", "among", "arrow_rows", "discard", "fresh_path", "map_rows", "materialize", "read_table", "shared_dir", "utf8"]

#: Bytes of one Arrow batch that goes to a Python worker; a single longer row makes a batch of its own.
BATCH_BYTES = 8 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: str) -> F.Column:
    """A text column as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def map_rows(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with batches bounded by bytes as well as by rows."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    return df.mapInArrow(work, schema)


def arrow_rows(batch: pa.RecordBatch, *names: str) -> list[list]:
    """Columns of a batch as Python lists."""
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def among(rows: DataFrame, ids: DataFrame, column: str, *, absent: bool = False) -> DataFrame:
    """The rows whose long in a column is in the same one of ids, or is absent there.

    Ids go as words of 64 bits, far smaller than their list where many follow each other. Whether the words are sent to
    the rows or both are shuffled is left to the words' size.
    """
    place = F.expr(f"shiftleft(1L, cast(`{column}` & 63 as int))")
    words = ids.groupBy(F.shiftright(column, 6).alias("__word")).agg(F.bit_or(place).alias("__bits"))
    told = rows.withColumn("__word", F.shiftright(column, 6)).join(materialize(words, "words"), "__word", "left" if absent else "inner")
    there = F.col("__bits").bitwiseAND(place) != 0
    return told.filter(~F.coalesce(there, F.lit(False)) if absent else there).select(rows.columns)
