"""SimHash near-duplicates found by covering locality-sensitive hashing.

A fingerprint bit is the majority of that bit over the XXH64 values of a text's word shingles, repeats included. For a
radius r each of the 2^(r+1)-1 tables keeps the bits whose vector has an odd inner product with the table's number:
bit i carries the vector 1 + i mod (2^(r+1)-1), and as r linear conditions on r+1 unknowns have a solution other than
zero, every pair that differs in at most r bits agrees in some table. No pair within the radius is missed.

Buckets hold distinct fingerprints only, so copies never meet there. A bucket of two is decided at once. Members of
larger buckets are linked without comparing all of them: each names every key within r - r // 2 flipped bits; keys that
someone reaches within r // 2 flips link all who name them to the least such member. By the triangle inequality each of
those pairs is within r, and any pair within r meets at a key on the way: the components are exact, no group makes
pairs, no bucket is capped.

Defined results: a null or wordless text has fingerprint zero and is linked like any other; fewer words than a shingle
give one shingle of all of them. Equal texts share a fingerprint. Rows with a null id get a component, though no
component is named after them (one of null ids alone has a null name). Repeated rows stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import map_rows, materialize, utf8
from sluice.plans.components import components

BITS = 64
SEED = 42
#: Words whose shingles are hashed at a time.
STEP = 1 << 16


def fingerprint(data: bytes, width: int) -> int:
    """The fingerprint of a text in UTF-8, as a signed 64-bit integer."""
    words = data.lower().split()
    if not words:
        return 0
    if len(words) < width:
        words, width = [b" ".join(words)], 1
    total, ones = len(words) - width + 1, np.zeros(BITS, dtype=np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, total, STEP):
        part = words[at : at + STEP + width - 1]
        grams = zip(*[part[k:] for k in range(width)], strict=False)
        values = np.fromiter((digest(join(g), SEED) for g in grams), dtype=">u8")
        ones += np.unpackbits(values.view(np.uint8)).reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total).view(">i8")[0])


def fingerprints(docs: DataFrame, *, carry: list[str], text_col: str = "text", width: int = 3) -> DataFrame:
    """The columns in ``carry`` and fp, a long."""
    slim = docs.select(*carry, utf8(text_col).alias("__text"))
    schema = ", ".join(f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in carry)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t, width) for t in b.column(len(carry)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(carry)], pa.array(fps, pa.int64())], [*carry, "fp"])

    return map_rows(slim, work, f"{schema}{', ' * bool(carry)}fp long")


def masks(radius: int) -> list[int]:
    """The covering masks, as signed 64-bit integers."""
    n = 2 ** (radius + 1) - 1
    out = [sum(1 << i for i in range(BITS) if ((1 + i % n) & v).bit_count() & 1) for v in range(1, n + 1)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in out]


def _flips(least: int, most: int) -> list[int]:
    """All words of 64 bits with so many ones, signed."""
    out = [sum(1 << i for i in c) for k in range(least, most + 1) for c in combinations(range(BITS), k)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in out]


def links(distinct: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of fingerprints within the radius. distinct: column fp, no repeats."""
    if not 0 <= radius <= 4:
        raise ValueError("the radius is 0 to 4")
    table = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(masks(radius))]))
    placed = distinct.select("fp", table.alias("at")).select("fp", "at.t", "at.k")
    full = placed.groupBy("t", "k").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1")
    full = materialize(full, "buckets")
    pairs = full.filter(f"n = 2 and bit_count(a ^ b) <= {radius}").select("a", "b")
    many = placed.join(full.filter("n > 2").select("t", "k"), ["t", "k"], "left_semi").select("fp").distinct()
    near, far = radius // 2, radius - radius // 2
    keys = lambda least, most, own: F.explode(F.transform(F.array(*[F.lit(m) for m in _flips(least, most)]), lambda m: F.struct(F.col("fp").bitwiseXOR(m).alias("key"), F.lit(own).alias("own"))))
    named = many.select("fp", keys(0, near, True).alias("at"))
    if far > near:
        named = named.union(many.select("fp", keys(near + 1, far, False).alias("at")))
    named = named.select("fp", "at.key", "at.own")
    hubs = named.groupBy("key").agg(F.min(F.when(F.col("own"), F.col("fp"))).alias("a"), F.count("*").alias("n")).filter("n > 1 and a is not null").select("key", "a")
    return pairs.union(named.join(hubs, "key").select("a", F.col("fp").alias("b")).filter("a <> b").distinct())


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, radius: int = 2) -> DataFrame:
    """Rows (id, fp, fingerprint, component_id), one for each row of docs."""
    rows = materialize(fingerprints(docs.select(id_col, text_col), carry=[id_col], text_col=text_col, width=width), "fingerprints")
    least = materialize(rows.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct")
    roots = materialize(components(links(least.select("fp"), radius), "a", "b"), "roots")
    named = least.join(roots, least["fp"] == roots["node"]).groupBy("root").agg(F.min("least").alias("first"))
    moved = roots.join(named, "root").select(F.col("node").alias("fp"), "first")
    own = least.join(moved, "fp", "left").select("fp", F.when(F.col("first").isNull() | (F.col("least") < F.col("first")), F.col("least")).otherwise(F.col("first")).alias("component_id"))
    return rows.join(own, "fp").select(id_col, "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
