"""Best-fit packing whose bin counts are certified by dual-feasible-function bounds.

Documents become token ids; only those longer than a sequence are cut. The pieces are dealt to packing partitions of a
bounded size, by a hash of their row, and each partition packs its pieces by best-fit decreasing. Dual feasible
functions then give a lower bound on the sequences that any packing of those pieces needs. A partition that meets its
bound is settled. Those with a gap give up the pieces of their sequences that are not full; these are dealt anew
together, so that partitions exchange documents, and packed again. It goes on while that saves sequences; what gap is
left is told with each row.

Only slim rows move: the ids themselves never do. Pieces of full length are sequences of their own.

Defined results: a null text counts as empty and has the end id alone; repeated rows are packed as documents of their
own; equal lengths are taken in the order of id, piece and row; a text of any length is encoded whole; columns other
than the id's and the text's are left out, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import discard, map_rows, materialize
from sluice.llm.tokens import Encoder, with_end

CAPACITY = 2048
#: Pieces in a packing partition, about.
PART = 200_000
#: Rounds of exchange that sequence ids have room for; they end as soon as one saves nothing.
MAX_ROUNDS = 127


def pieces(docs: DataFrame, tokenizer: str, *, rule: str | None = "dropped", id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32) of every document, with the end id behind its ids."""
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer, rule)
        for b in batches:
            ids, ends = with_end(*encoder.encode_all(b.column(1)), end_id)
            size = np.diff(ends, prepend=0)
            n = -(-size // capacity)
            last = np.cumsum(n)
            piece = np.arange(int(n.sum())) - np.repeat(last - n, n)
            at, start = np.repeat(np.arange(len(n)), n), piece * capacity
            length = np.minimum(capacity, size[at] - start)
            begin, data = 4 * ((ends - size)[at] + start), memoryview(ids.astype("<u4", copy=False)).cast("B")
            crc = [zlib.crc32(data[a:e]) for a, e in zip(begin.tolist(), (begin + 4 * length).tolist(), strict=True)]
            columns = [b.column(0).take(pa.array(at)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "piece", "start", "length", "ids_crc32"])

    return map_rows(slim, work, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs: the largest bound of the Martello-Toth functions and of the rounding ones, k from 1 to 32.

    Each maps lengths so that what fits into a sequence still does; the mapped total over the capacity is a bound.
    """
    n = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    s = np.arange(capacity + 1)
    best = -(-int(n @ s) // capacity)
    count, mass = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * s)])
    half = capacity // 2
    a = np.arange(1, half + 1)  # lengths under a count nothing, those over capacity - a the whole sequence
    big = count[-1] - count[capacity - a + 1]
    mid = count[capacity - a + 1] - count[half + 1]
    mid_mass = mass[capacity - a + 1] - mass[half + 1]
    small_mass = mass[half + 1] - mass[a]
    best = max(best, int((big + mid + np.maximum(0, -(-(small_mass - (mid * capacity - mid_mass)) // capacity))).max(initial=0)))
    for k in range(1, 33):  # an x with (k + 1) x / capacity whole stays, else that quotient is rounded down and divided by k
        q, r = np.divmod((k + 1) * s, capacity)
        value = np.where(r == 0, k * (k + 1) * s, q * capacity * (k + 1))  # in units of 1 / (capacity * k * (k + 1))
        best = max(best, -(-int(n @ value) // (capacity * k * (k + 1))))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length, which come in descending order, and what each bin holds."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, room = 0, []  # rooms: bit r is set while some bin has r tokens left
    for i, x in enumerate(lengths.tolist()):
        above = rooms >> x
        if above:
            r = x + (above & -above).bit_length() - 1
            own = by_room[r]
            k = own.pop()
            if not own:
                rooms &= ~(1 << r)
        else:
            r, k = capacity, len(room)
            room.append(r)
        bins[i], offsets[i] = k, capacity - r
        room[k] = r = r - x
        if r:
            by_room[r].append(k)
            rooms |= 1 << r
    return bins, offsets, capacity - np.array(room, dtype=np.int64)


def _pack(rows: DataFrame, turn: int, capacity: int) -> DataFrame:
    """rows: with part. Adds sequence_id, offset, held (tokens of its sequence) and gap (of its partition)."""
    names = rows.columns

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("id", "ascending"), ("piece", "ascending"), ("row", "ascending")])
        lengths = table.column("length").to_numpy()
        bins, offsets, held = best_fit_decreasing(lengths, capacity)
        gap = len(held) - lower_bound(lengths, capacity)
        part = table.column("part")[0].as_py()
        ids = bins + (turn << 56 | part << 28)
        return pa.table([*table.columns, pa.array(ids), pa.array(offsets), pa.array(held[bins]), pa.array(np.full(len(ids), gap))], [*names, "sequence_id", "offset", "held", "gap"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.groupBy("part").applyInArrow(work, f"{schema}, sequence_id long, offset long, held long, gap long")


def pack(rows: DataFrame, *, capacity: int = CAPACITY, part_size: int = PART, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Adds sequence_id, offset, held and gap to rows (id, piece, length, ...). gap: sequences over the bound where the row was packed last."""
    if max_rounds > MAX_ROUNDS:
        raise ValueError(f"at most {MAX_ROUNDS} rounds")
    if part_size >= 1 << 28:
        raise ValueError("a packing partition holds fewer than 2^28 pieces")
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "pieces")
    deal = lambda df, turn, parts: df.withColumn("part", F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(parts)))
    parts = rows.count() // part_size + 1
    now = materialize(_pack(deal(rows, 0, parts), 0, capacity), "packed")
    loose = F.expr(f"gap > 0 and held < {capacity}")
    for turn in range(1, max_rounds):
        if parts == 1:
            break
        pool = now.filter(loose)
        before = pool.agg(F.count("*").alias("n"), F.count(F.when(F.col("offset") == 0, 1)).alias("bins")).first()
        if not before["n"]:
            break
        parts = before["n"] // part_size + 1
        again = materialize(_pack(deal(pool.drop("part", "sequence_id", "offset", "held", "gap"), turn, parts), turn, capacity).select(now.columns), "packed")
        if again.filter("offset = 0").count() >= before["bins"]:
            discard(again)
            break
        now = materialize(now.filter(~loose).union(again), "packed")
        discard(again)
    return now.drop("part", "row")
