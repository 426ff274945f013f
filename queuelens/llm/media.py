"""Media columns: payloads stored as lossless WebP files and read back as pixel arrays."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queuelens.llm import webp
from queuelens.llm.common import table, text_or_empty

#: A payload is a multiple of ROW bytes: one row of WIDTH pixels of three samples. A file has at most ROWS rows, so a
#: long payload is a run of files, which are decoded side by side.
WIDTH, ROWS = 64, 64
ROW = 3 * WIDTH
DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def payload_of(text: str) -> bytes:
    raw = text.encode("utf-8", "surrogatepass")
    return raw.ljust(max(1, -(-len(raw) // ROW)) * ROW, b" ")


def store(payload: bytes) -> list[bytes]:
    """The WebP files that hold a payload, in order; stored one after the other."""
    return webp.encode_rgb_many(_files_of(payload), WIDTH)


def _files_of(payload: bytes) -> list[np.ndarray]:
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, 3)
    return [pixels[at : at + WIDTH * ROWS] for at in range(0, len(pixels), WIDTH * ROWS)]


def store_many(payloads: list[bytes]) -> list[bytes]:
    """Each payload's files as one value; files of all payloads are written side by side."""
    parts = [_files_of(p) for p in payloads]
    files = iter(webp.encode_rgb_many([f for fs in parts for f in fs], WIDTH))
    return [b"".join(next(files) for _ in fs) for fs in parts]


def files_in(media: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(media):
        n = 8 + struct.unpack_from("<I", media, at + 4)[0]
        out.append(media[at : at + n])
        at += n
    return out


def read_back(media: list[bytes]) -> list[np.ndarray]:
    """The pixels (n, 3) of each stored value; files of all values are decoded side by side."""
    files = [files_in(m) for m in media]
    pixels = webp.decode_many([f for fs in files for f in fs])
    out, at = [], 0
    for fs in files:
        out.append(np.concatenate(pixels[at : at + len(fs)]))
        at += len(fs)
    return out


def feature(pixels: np.ndarray) -> str:
    """Rows of pixels, and each channel's mean and mean absolute step between neighbours, in thousandths, whole numbers."""
    wide = pixels.astype(np.int64)
    mean = wide.sum(axis=0) * 1000 // len(wide)
    step = np.abs(np.diff(wide, axis=0)).sum(axis=0) * 1000 // max(1, len(wide) - 1)
    return f"rows={len(wide) // WIDTH};mean={','.join(map(str, mean))};step={','.join(map(str, step))}"


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Array, list[str]]]:
    for batch in batches:
        texts, at, size = batch.column(1).to_pylist(), 0, 0
        for i, t in enumerate(texts):
            if size and size + len(t) > most:
                yield batch.column(0).slice(at, i - at), texts[at:i]
                at, size = i, 0
            size += len(t)
        yield batch.column(0).slice(at), texts[at:]


def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in _chunks(batches, 8 << 20):
        media = store_many([payload_of(t) for t in texts])
        yield pa.RecordBatch.from_arrays([ids, pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def digest(batches: Iterator[pa.RecordBatch], most: int = 6 << 20) -> Iterator[pa.RecordBatch]:
    names = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    for batch in batches:
        ids, sizes, media = (c.to_pylist() for c in batch.columns)
        at = 0
        while at < len(media):
            end, size = at, 0
            while end < len(media) and (end == at or size + len(media[end]) <= most):
                size += len(media[end])
                end += 1
            rows = []
            for i, pixels in zip(range(at, end), read_back(media[at:end]), strict=True):
                raw, m = pixels.tobytes(), media[i]
                rows.append((ids[i], sizes[i], len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature(pixels)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            at = end


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: the stored form of each text's payload (UTF-8 bytes, then spaces up to a positive
    multiple of 192). Null text counts as empty; null ids and repeated rows are kept; an empty table gives no rows; other
    columns are not read. Very long texts are runs of files, so memory follows the batch, not the text's image; equal
    texts, tied or repeated, have equal values."""
    pairs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return pairs.mapInArrow(encode, "doc_id long, n_bytes long, media binary")


def media_digests(media: DataFrame) -> DataFrame:
    """Reads each stored value back; sizes and hashes of payload and stored form, and the feature of the pixels."""
    return media.mapInArrow(digest, DIGESTS)


def _pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rgb = read_back([m])[0]
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([WIDTH], pa.int32()), pa.array([len(rgb) // WIDTH], pa.int32()), pa.array([rgb.tobytes()], pa.binary())], names=["doc_id", "width", "height", "pixels"])


def pixel_arrays(media: DataFrame) -> DataFrame:
    """doc_id, width, height, pixels: each stored value as an array of height x width x 3 samples, row by row."""
    return media.select("doc_id", "media").mapInArrow(_pixels, "doc_id long, width int, height int, pixels binary")


def stored_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """media_digests(to_media(docs)) in one pass: the stored forms stay in the task that made them."""
    pairs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return pairs.mapInArrow(lambda batches: digest(encode(batches)), DIGESTS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_digests(table(spark, sf_dir, "documents"))
