"""Token-id files: ids of documents in ascending order of their ids, in groups of range-coded, checksummed blocks.

A file is one range of documents. It holds groups: a header with a JSON line that names the documents, their numbers of
ids and the panels (bytes and CRC-32 of the model, and for each block its ids, CRC-32 and bytes), the header's own CRC-32,
then models and blocks. A group closes once it has GROUP ids, so both writing and reading hold one group and the batch
that closed it, and a document is never split between groups. The last line names the totals. Files of failed attempts
stay unnamed: the manifest lists those that count.

Documents are range-partitioned by id and a hash of the text, so equal ids spread, and sorted by both in their range.

Defined results: a null text counts as empty and has the end id alone; null ids come first; rows that repeat an id
follow each other in the order of their texts' hashes; a text of any length is encoded whole; columns other than the
id's and the text's are left out, whatever their names; an empty table gives no file. A block whose checksum fails is an
error that names it, as is a model's, a header's or a file's end.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm import mixcoder
from sluice.llm.common import fresh_path, map_rows, materialize
from sluice.llm.tokens import Encoder, with_end

MAGIC = b"IDMIX2\n"
#: Ids in a group, about: as many blocks as are coded side by side.
GROUP = mixcoder.BLOCK * mixcoder.LANES


class BrokenFile(ValueError):
    """A header, block or end that does not check."""


def group_bytes(names: list[int | None], sizes: list[int], ids: np.ndarray) -> bytes:
    panels = list(mixcoder.encode(ids))
    told = [{"model": [len(m), zlib.crc32(m)], "blocks": [(n, crc, len(data)) for n, crc, data in blocks]} for m, blocks in panels]
    head = json.dumps({"docs": names, "sizes": sizes, "panels": told}, separators=(",", ":")).encode()
    body = [x for m, blocks in panels for x in (m, *(b[2] for b in blocks))]
    return b"".join([len(head).to_bytes(4, "little"), zlib.crc32(head).to_bytes(4, "little"), head, *body])


def read_groups(file) -> Iterator[tuple[list[int | None], list[int], np.ndarray]]:
    """Documents, their numbers of ids, and the ids, group by group."""
    if file.read(len(MAGIC)) != MAGIC:
        raise BrokenFile("no file of ids")
    docs = total = 0
    while True:
        lead = file.read(8)
        if len(lead) < 8:
            raise BrokenFile("the file has no end")
        size, crc = int.from_bytes(lead[:4], "little"), int.from_bytes(lead[4:], "little")
        head = file.read(size)
        if zlib.crc32(head) != crc:
            raise BrokenFile("a header does not check")
        told = json.loads(head)
        if "end" in told:
            if told["end"] != [docs, total]:
                raise BrokenFile("the totals do not check")
            return
        parts = []
        for panel in told["panels"]:
            size, crc = panel["model"]
            model = file.read(size)
            if zlib.crc32(model) != crc:
                raise BrokenFile("a model does not check")
            parts.append(mixcoder.decode(model, [(n, c, file.read(b)) for n, c, b in panel["blocks"]]))
        ids = np.concatenate(parts) if parts else np.zeros(0, "<u4")
        if len(ids) != sum(told["sizes"]):
            raise BrokenFile("a group's sizes do not check")
        docs, total = docs + len(told["docs"]), total + len(ids)
        yield told["docs"], told["sizes"], ids


def write(docs: DataFrame, tokenizer: str, folder: str | None = None, *, rule: str | None = "kept", id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, parts: int | None = None) -> DataFrame:
    """Writes the files and returns the manifest: (part, path, docs, ids), part ascending with the documents' ids."""
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "ids")
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    ordered = slim.repartitionByRange(parts, "id", "h").sortWithinPartitions("id", "h", "text").select("id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(folder)
        store.create_dir(at, recursive=True)
        encoder, name, out = Encoder.of(tokenizer, rule), f"{uuid.uuid4().hex}.ids", None
        names, sizes, data, size, docs_n, ids_n = [], [], [], 0, 0, 0

        def flush() -> None:
            nonlocal names, sizes, data, size, docs_n, ids_n
            ids = np.concatenate(data)
            out.write(group_bytes(names, sizes, ids))
            docs_n, ids_n = docs_n + len(names), ids_n + len(ids)
            names, sizes, data, size = [], [], [], 0

        for b in batches:
            if b.num_rows and out is None:
                out = store.open_output_stream(f"{at}/{name}", compression=None)
                out.write(MAGIC)
            ids, ends = with_end(*encoder.encode_all(b.column(1)), end_id)
            names += b.column(0).to_pylist()
            sizes += np.diff(ends, prepend=0).tolist()
            data.append(ids)
            size += len(ids)
            if size >= GROUP:
                flush()
        if out is None:
            return
        if names:
            flush()
        head = json.dumps({"end": [docs_n, ids_n]}).encode()
        out.write(len(head).to_bytes(4, "little") + zlib.crc32(head).to_bytes(4, "little") + head)
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([f"{folder}/{name}"]), pa.array([docs_n], pa.int64()), pa.array([ids_n], pa.int64())], ["part", "path", "docs", "ids"])

    return materialize(map_rows(ordered, work, "part long, path string, docs long, ids long"), "manifest")


def read(manifest: DataFrame, *, ids: bool = False) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) from the files, and the ids as bytes if asked for. start: ids of all documents before."""
    # A row a file: as many as the writer had partitions.
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    files = manifest.select("path", before.alias("base"))
    files = files.repartition(max(1, min(manifest.count(), 100_000)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_stream(at, compression=None) as file:
                    for names, sizes, values in read_groups(file):
                        ends = np.cumsum(sizes)
                        data = values.tobytes()
                        own = [data[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), sizes, strict=True)]
                        columns = [pa.array(names, pa.int64()), pa.array(base + ends - sizes), pa.array(sizes, pa.int64()), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                        yield pa.RecordBatch.from_arrays([*columns, *([pa.array(own, pa.binary())] if ids else [])], ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if ids else [])])
                        base += len(values)

    return map_rows(files, work, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids)
