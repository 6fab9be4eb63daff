"""Matrices as cells (i, j, v); cells that are not there are zero."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions import floor_div
from sluice.operators.overlay import overlay


def from_rows(rows: DataFrame, i: str, values: str) -> DataFrame:
    """Cells of rows that hold arrays."""
    return rows.select(F.col(i).cast("long").alias("i"), F.posexplode(values).alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))


def check_cell(i: int, j: int, rows: int, cols: int) -> None:
    if not (0 <= i < rows and 0 <= j < cols):
        raise IndexError(f"({i}, {j}) is outside a matrix of {rows} x {cols}")


def get_element(cells: DataFrame, i: int, j: int, rows: int, cols: int) -> float:
    check_cell(i, j, rows, cols)
    got = cells.filter((F.col("i") == i) & (F.col("j") == j)).first()
    return got["v"] if got else 0.0


def set_element(cells: DataFrame, i: int, j: int, value: float, rows: int, cols: int) -> DataFrame:
    check_cell(i, j, rows, cols)
    return overlay(cells, cells.sparkSession.createDataFrame([(i, j, float(value))], "i long, j long, v double"), ["i", "j"])


def submatrix(cells: DataFrame, r0: int, r1: int, c0: int, c1: int) -> DataFrame:
    """Cells of [r0, r1) x [c0, c1), counted from its corner. The ranges reach the scan."""
    return cells.filter((F.col("i") >= r0) & (F.col("i") < r1) & (F.col("j") >= c0) & (F.col("j") < c1)).select((F.col("i") - r0).alias("i"), (F.col("j") - c0).alias("j"), "v")


def set_submatrix(cells: DataFrame, block: DataFrame, r0: int, c0: int) -> DataFrame:
    """The matrix with the block's cells from (r0, c0) on."""
    return overlay(cells, block.select((F.col("i") + r0).alias("i"), (F.col("j") + c0).alias("j"), "v"), ["i", "j"])


def transpose(cells: DataFrame, *, require_square: bool = False) -> DataFrame:
    """Rows and columns swapped: a projection, no shuffle. require_square raises unless both have as many."""
    if require_square:
        d = cells.agg(F.max("i").alias("i"), F.max("j").alias("j")).first()
        if d["i"] != d["j"]:
            raise ValueError("the matrix is not square")
    return cells.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def tiles(cells: DataFrame, size: int) -> DataFrame:
    """Dense square tiles (bi, bj, tile), tile an array of size * size values by rows, at the edges filled with zeros."""

    def fill(table: pa.Table) -> pa.Table:
        tile = np.zeros(size * size)
        tile[table.column("i").to_numpy() % size * size + table.column("j").to_numpy() % size] = table.column("v").to_numpy()
        return pa.table({"bi": table.column("bi")[:1], "bj": table.column("bj")[:1], "tile": pa.array([tile])})

    placed = cells.select("i", "j", "v", floor_div("i", size).alias("bi"), floor_div("j", size).alias("bj"))
    return placed.groupBy("bi", "bj").applyInArrow(fill, "bi long, bj long, tile array<double>")


def transpose_tiles(tiled: DataFrame, size: int) -> DataFrame:
    """Each tile transposed and the tiles' places swapped. No shuffle."""

    def turn(batches):
        for b in batches:
            own = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, size, size).swapaxes(1, 2)
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(0), pa.array(list(own.reshape(len(own), -1)), pa.list_(pa.float64()))], ["bi", "bj", "tile"])

    return tiled.select("bi", "bj", "tile").mapInArrow(turn, "bi long, bj long, tile array<double>")


def untile(tiled: DataFrame, size: int) -> DataFrame:
    """The cells of tiles, zeros included."""
    at = tiled.select("bi", "bj", F.posexplode("tile").alias("p", "v"))
    return at.select((F.col("bi") * size + F.call_function("div", F.col("p"), F.lit(size))).alias("i"), (F.col("bj") * size + F.col("p") % size).alias("j"), "v")
