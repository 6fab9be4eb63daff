"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Fit: principal axes and an iterative rotation that brings a bounded sample's projections close to signs; the signs of a
vector's rotated projections are its code of at most 64 bits. The Hamming radius is learned too: ``calibrate`` vectors
are searched exactly in one linear pass over all rows, and the radius is the smallest that holds ``recall`` of their
neighbours. Index: every row's code, written once.

Search: codes are cut into substrings of 16 bits, each with a table from value to rows. By the pigeonhole principle a
code within radius r of the query agrees with it, in some substring, up to its share of r; those values are probed, the
rows they hold checked by their whole codes, and those within the radius ranked by their vectors' cosines in double
precision. A stated set of queries meets all rows in a grid of blocks: a task holds one block of each, so memory is
bounded, and gives the nearest k of each query; the blocks' answers are ranked together. A block in which a query finds
fewer than k is searched whole, so no query lacks neighbours that exist.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do those of
another length than most (the shortest of the most frequent lengths counts). A row is no neighbour of itself, but rows
that repeat its id or vector are neighbours like others. Rows with a null id are candidates, last among equals, and no
queries. Too few rows give what there is; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import map_rows, materialize

PIECE = 16
#: All substrings by their number of ones, and how many have at most so many.
BY_ONES = np.argsort(np.bitwise_count(np.arange(1 << PIECE, dtype=np.uint32)), kind="stable").astype(np.int64)
UP_TO = np.cumsum(np.bincount(np.bitwise_count(np.arange(1 << PIECE, dtype=np.uint32)), minlength=PIECE + 1))
#: Rows and queries in a task, about.
ROWS, QUERIES = 16_384, 4_096
LAST = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Codes:
    """A learned rotation: signs of (unit vector - mean) @ axes are the bits."""

    mean: np.ndarray
    axes: np.ndarray

    @property
    def bits(self) -> int:
        return self.axes.shape[1]

    def of(self, unit: np.ndarray) -> np.ndarray:
        signs = (unit - self.mean) @ self.axes > 0
        full = np.zeros((len(unit), 64), np.uint8)
        full[:, : self.bits] = signs
        return np.packbits(full, axis=1, bitorder="little").view("<u8").reshape(-1)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square overflows."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def learn(sample: np.ndarray, rounds: int = 30, seed: int = 7) -> Codes:
    """Principal axes of a sample of unit vectors, rotated to shrink the distance to signs."""
    dim = sample.shape[1]
    bits, mean = min(64, dim), sample.mean(0)
    z = sample - mean
    axes = np.linalg.eigh(z.T @ z)[1][:, ::-1][:, :bits]
    z = z @ axes
    turn = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.where(z @ turn > 0, 1.0, -1.0).T @ z)
        turn = (u @ v).T
    return Codes(mean, axes @ turn)


class Tables:
    """A block's substring tables."""

    def __init__(self, codes: np.ndarray, bits: int):
        self.codes, self.pieces = codes, -(-bits // PIECE)
        self.tables = []
        for j in range(self.pieces):
            part = (codes >> np.uint64(PIECE * j) & np.uint64(0xFFFF)).astype(np.int64)
            starts = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=1 << PIECE))])
            self.tables.append((np.argsort(part, kind="stable"), starts, np.flatnonzero(np.diff(starts))))

    def within(self, code: int, radius: int) -> np.ndarray:
        """All rows whose codes differ from this one in at most so many bits."""
        share, more = divmod(radius, self.pieces)
        seen = np.zeros(len(self.codes), bool)
        for j, (order, starts, used) in enumerate(self.tables):
            own = min(PIECE, share if j <= more else share - 1)
            if own < 0:
                continue
            value = int(code) >> PIECE * j & 0xFFFF
            if UP_TO[own] < len(used):
                keys = BY_ONES[: UP_TO[own]] ^ value
            else:  # fewer values are in use than would be probed
                keys = used[np.bitwise_count(used ^ value) <= own]
            begin, n = starts[keys], starts[keys + 1] - starts[keys]
            begin, n = begin[n > 0], n[n > 0]
            ends = np.cumsum(n)
            if len(ends):
                seen[order[np.arange(ends[-1]) + np.repeat(begin - (ends - n), n)]] = True
        rows = np.flatnonzero(seen)
        return rows[np.bitwise_count(self.codes[rows] ^ np.uint64(code)) <= radius]


def nearest(query: np.ndarray, rows: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k rows of largest cosine and their scores; equal scores by id. Each row's sum has one order, wherever it stands."""
    score = (vectors[rows] * query).sum(axis=1)
    order = np.lexsort((ids[rows], -score))[:k]
    return rows[order], score[order]


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, "<f8").reshape(-1, dim)


def usable(vector: str) -> Column:
    v = F.col(vector)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return v.isNotNull() & F.coalesce(whole, F.lit(False)) & F.exists(v, lambda x: x != 0)


def build(table: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", sample_rows: int = 20_000) -> tuple[DataFrame, Codes | None, int]:
    """The index, rows (row, id, code, unit as bytes), its codes and the vectors' length. Codes are learned on at most sample_rows rows."""
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter(usable("v"))
    lengths = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    spark = table.sparkSession
    schema = "row long, id long, code long, unit binary"
    if lengths is None:
        return spark.createDataFrame([], schema), None, 0
    dim, total = lengths["dim"], lengths["n"]
    rows = rows.filter(F.size("v") == dim).select("id", F.col("v").cast("array<double>").alias("v"))
    share = min(1.0, 0.9 * sample_rows / total)
    drawn = rows.filter(F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).limit(sample_rows).toArrow()
    codes = learn(unit(np.array(drawn.column("v").to_pylist(), dtype=np.float64).reshape(-1, dim)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = unit(b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(codes.of(u).view(np.int64)), pa.array([x.tobytes() for x in u], pa.binary())], ["row", "id", "code", "unit"])

    return materialize(map_rows(rows.select(F.monotonically_increasing_id().alias("row"), "id", "v"), work, schema), "index"), codes, dim


def learn_radius(index: DataFrame, codes: Codes, dim: int, *, k: int, calibrate: int = 128, recall: float = 0.98) -> int:
    """The smallest radius that holds this share of the true neighbours of so many vectors, chosen by a hash."""
    probes = index.orderBy(F.xxhash64("row"), "row").limit(calibrate).toArrow()
    own, q = probes.column("row").to_numpy(), _matrix(probes.column("unit"), dim)
    q_codes = probes.column("code").to_numpy().view(np.uint64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, v = b.column(0).to_numpy(), _matrix(b.column(3), dim)
            scores = q @ v.T
            scores[own[:, None] == rows[None, :]] = -2
            apart = np.bitwise_count(q_codes[:, None] ^ b.column(2).to_numpy().view(np.uint64)[None, :])
            top = np.argsort(-scores, axis=1)[:, :k]
            probe = np.repeat(np.arange(len(q)), top.shape[1])
            s, d = scores[probe, top.reshape(-1)], apart[probe, top.reshape(-1)]
            real = s > -2
            yield pa.RecordBatch.from_arrays([pa.array(probe[real]), pa.array(s[real]), pa.array(d[real].astype(np.int32))], ["probe", "score", "apart"])

    found = map_rows(index, work, "probe long, score double, apart int")
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), "apart"))).filter(F.col("n") <= k).select("apart").toArrow()
    apart = np.sort(best.column("apart").to_numpy())
    return int(apart[min(len(apart) - 1, int(np.ceil(recall * len(apart))) - 1)]) if len(apart) else 0


def search(index: DataFrame, queries: DataFrame, codes: Codes | None, dim: int, radius: int, *, k: int = 5) -> DataFrame:
    """Rows (query_row, query_id, rank, vec_id, score): the nearest k of each query, which are rows of the index."""
    spark = index.sparkSession
    if codes is None:
        return spark.createDataFrame([], "query_row long, query_id long, rank int, vec_id long, score double")
    parts, blocks = index.count() // ROWS + 1, queries.count() // QUERIES + 1
    cell = lambda df, own, n, other, m: df.withColumn(own, F.pmod(F.xxhash64("row"), F.lit(n))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))))
    data, asked = cell(index, "part", parts, "block", blocks), cell(queries, "block", blocks, "part", parts)
    bits = codes.bits

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            rows, ids = left.column("row").to_numpy(), left.column("id").fill_null(LAST).to_numpy()
            vectors, block = _matrix(left.column("unit"), dim), left.column("code").to_numpy().view(np.uint64)
            tables = Tables(block, bits)
            for row, ident, code, q in zip(right.column("row").to_pylist(), right.column("id").to_pylist(), right.column("code").to_numpy().view(np.uint64).tolist(), _matrix(right.column("unit"), dim), strict=True):
                near = tables.within(code, radius)
                near = near[rows[near] != row]
                if len(near) < k:
                    near = np.flatnonzero(rows != row)
                for r, s in zip(*nearest(q, near, vectors, ids, k), strict=True):
                    out.append((row, ident, None if ids[r] == LAST else int(ids[r]), float(s)))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        return pa.table([pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)], ["query_row", "query_id", "vec_id", "score"])

    found = data.groupBy("part", "block").cogroup(asked.groupBy("part", "block")).applyInArrow(work, "query_row long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_row", "query_id", "rank", "vec_id", "score")


def neighbours(table: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5, recall: float = 0.98) -> DataFrame:
    """Searches all rows for those whose id is divisible by ``every``."""
    index, codes, dim = build(table, id_col=id_col, vector_col=vector_col)
    radius = learn_radius(index, codes, dim, k=k, recall=recall) if codes else 0
    return search(index, index.filter(F.col("id") % every == 0), codes, dim, radius, k=k)
