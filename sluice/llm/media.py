"""Media columns: payloads stored as progressive JPEG, and pictures read as RGB tensors.

store() turns texts into pictures that hold their bytes without loss (see jpeg.py); the stored column is written to the
shared folder. payloads() and tensors() read such a column, or any column of progressive JPEG, back: bytes, features
and full-resolution RGB, which store_tensors() keeps as a table. A row's work needs its own text only, so there is no shuffle, and memory is bounded by a batch.

Defined results: a null text is an empty one, whose payload is MCU blanks; equal texts give equal pictures. A picture
that can't be decoded (or is null) gives nulls and its error, where the reader is given foreign ones. A very long text
becomes one picture; its coefficients and pixels are many times the text and stand in one task at a time. Columns other
than the id's and the text's are left out, whatever their names; repeated rows stay; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import jpeg
from sluice.llm.common import map_rows, materialize, utf8

PAD = b"\x20"
#: What a picture that is none may raise.
BROKEN = (ValueError, KeyError, IndexError, TypeError, struct.error, ZeroDivisionError, OverflowError, MemoryError)


def padded(data: bytes) -> bytes:
    """The data and blanks up to a positive multiple of an MCU."""
    return data + PAD * (-len(data) % jpeg.MCU or (0 if data else jpeg.MCU))


def store(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_bytes, media), written to the shared folder."""
    slim = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("data"))
    kind = slim.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in data], pa.int64()), pa.array([jpeg.encode(padded(x)) for x in data], pa.binary())], ["id", "n_bytes", "media"])

    return materialize(map_rows(slim, work, f"id {kind}, n_bytes long, media binary"), "media", "zstd")


def feature(pixels: np.ndarray) -> str:
    """Size, sums of the three channels and of each half of the picture, and a checksum of the tensor."""
    h, w = pixels.shape[:2]
    sums = pixels.reshape(-1, 3).sum(0, dtype=np.int64).tolist()
    left = int(pixels[:, : w // 2].sum(dtype=np.int64))
    return f"{h}x{w}x3;rgb={','.join(map(str, sums))};left={left};crc={zlib.crc32(pixels.tobytes()):08x}"


def payloads(stored: DataFrame) -> DataFrame:
    """From rows (id, n_bytes, media): id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, error."""
    kind = stored.schema["id"].dataType.simpleString()
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def one(media: bytes | None) -> tuple:
        if media is None:
            return (None,) * 6 + ("no picture",)
        size, digest = len(media), hashlib.sha256(media).hexdigest()
        try:
            picture = jpeg.decode(media)
            data = jpeg.payload(picture)
            return len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), size, digest, feature(jpeg.rgb(picture)), None
        except BROKEN as e:
            return None, None, None, size, digest, None, str(e)[:200] or type(e).__name__

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [one(m) for m in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([o[i] for o in out], k) for i, k in enumerate(kinds))], ["id", "n_bytes", *names])

    return map_rows(stored.select("id", "n_bytes", "media"), work, f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")


def tensors(pictures: DataFrame, *, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """Rows (id, height, width, rgb, error) of any progressive pictures; rgb is height x width x 3 bytes, row by row."""
    slim = pictures.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    kind = slim.schema["id"].dataType.simpleString()

    def one(media: bytes | None) -> tuple:
        if media is None:
            return None, None, None, "no picture"
        try:
            pixels = jpeg.rgb(jpeg.decode(media))
            return pixels.shape[0], pixels.shape[1], pixels.tobytes(), None
        except BROKEN as e:
            return None, None, None, str(e)[:200] or type(e).__name__

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [one(m) for m in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([o[i] for o in out], k) for i, k in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.string())))], ["id", "height", "width", "rgb", "error"])

    return map_rows(slim, work, f"id {kind}, height int, width int, rgb binary, error string")


def store_tensors(pictures: DataFrame, *, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """tensors(), written to the shared folder and read back."""
    return materialize(tensors(pictures, id_col=id_col, media_col=media_col), "tensors", "zstd")
