"""Media columns: bytes stored as progressive JPEG, and JPEGs read to full-resolution RGB tensors (see jpeg.py)."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jpeg
from .common import by_bytes, map_arrow, sent_by_bytes, text_or_empty

#: Bytes that are coded together at most (or one row); bounds a worker's memory.
TOGETHER = 2_000_000
#: The encoder takes fewer: its arrays then stay in the allocator's reach and in cache.
ENCODED_TOGETHER = 400_000


def payload(text: str) -> bytes:
    """UTF-8 and bytes 0 up to a positive multiple of 64."""
    raw = text.encode("utf-8")
    return raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


def together(items: list[bytes], limit: int = TOGETHER) -> Iterator[list[int]]:
    """Row numbers in groups of at most `limit` bytes."""
    group, size = [], 0
    for i, x in enumerate(items):
        if group and size + len(x) > limit:
            yield group
            group, size = [], 0
        group.append(i)
        size += len(x)
    if group:
        yield group


def encoded(payloads: list[bytes]) -> list[bytes]:
    return [m for g in together(payloads, ENCODED_TOGETHER) for m in jpeg.stored([payloads[i] for i in g])]


def feature(tensor: np.ndarray) -> str:
    """Width, height, mean and deviation of each channel, and a checksum of an RGB tensor, all from whole numbers."""
    flat = tensor.reshape(-1, 3)
    n, total, square = len(flat), flat.sum(axis=0, dtype=np.int64), np.einsum("ij,ij->j", flat, flat, dtype=np.int64)
    mean = [int(x) * 1000 // n for x in total]
    deviation = [int(max(0, n * int(q) - int(s) ** 2) ** 0.5 * 1000 / n) for q, s in zip(square, total, strict=True)]
    return f"{tensor.shape[1]}x{tensor.shape[0]} mean {mean} std {deviation} crc {zlib.crc32(tensor.tobytes()):08x}"


def to_media(df: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, media (a progressive JPEG) of each row; a null text counts as empty.  Map-only, rows keep repeats."""

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [payload(t) for t in batch.column(1).to_pylist()]
        media = encoded(texts)
        return pa.record_batch([batch.column(0), pa.array([len(t.encode("utf-8")) for t in batch.column(1).to_pylist()], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return map_arrow(rows, per_batch, "doc_id long, n_bytes long, media binary")


def tensors(files: list[bytes]) -> list[np.ndarray | None]:
    """RGB tensors of JPEG files decoded together; None for what is no progressive JPEG or is broken."""
    out: list[np.ndarray | None] = [None] * len(files)
    images, own = [], []
    for i, data in enumerate(files):
        try:
            images.append(jpeg.parsed(data))
            own.append(i)
        except jpeg.BROKEN:
            continue
    try:
        coef = jpeg.coefficients(images)
        blocks = jpeg.samples(images, coef)
        for i, image in zip(own, images, strict=True):
            out[i] = jpeg.rgb(image, blocks)
    except jpeg.BROKEN:
        if len(own) > 1:  # one by one, so that a broken file costs no other
            for i in own:
                out[i] = tensors([files[i]])[0]
    return out


def rgb_tensors(df: DataFrame, media: str = "media") -> DataFrame:
    """doc_id, width, height, rgb (height x width x 3 bytes) of each progressive JPEG.

    Null, empty, broken and other files (baseline frames too) give nulls; rows keep repeats, an empty table gives none,
    further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            data = [m or b"" for m in batch.column(1).to_pylist()]
            for group in together(data):
                got = tensors([data[i] for i in group])
                size = lambda k: pa.array([None if x is None else x.shape[k] for x in got], pa.int32())  # noqa: B023, E731
                yield pa.record_batch([batch.column(0).take(pa.array(group)), size(1), size(0), pa.array([None if x is None else x.tobytes() for x in got], pa.binary())], names=["doc_id", "width", "height", "rgb"])

    return sent_by_bytes(df).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(media).alias("media")).mapInArrow(run, "doc_id long, width int, height int, rgb binary")


def stored_features(df: DataFrame, text: str = "text") -> DataFrame:
    """Each text stored as JPEG, read back from the stored bytes, and digested, in one pass over the data.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32 (both of what was read back), media_bytes, media_sha256,
    feature (of the RGB tensor).  A null text counts as empty and has a payload of 64 bytes 0; a text of any length is
    stored whole; equal texts give equal values; rows keep repeats, an empty table gives none, further columns are ignored.
    Tensors are digested where they are made: they take several times the bytes of the texts.
    """

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        payloads, rows = [payload(t) for t in texts], []
        for group in together(payloads):
            media = encoded([payloads[i] for i in group])
            images, coef = jpeg.decoded(media)
            blocks = jpeg.samples(images, coef)
            for i, m, image in zip(group, media, images, strict=True):
                back = jpeg.payload_of(image, coef)
                rows.append((len(texts[i].encode("utf-8")), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature(jpeg.rgb(image, blocks))))
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.record_batch([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=["doc_id", *names])

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return map_arrow(rows, per_batch, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
