"""Numpy records that travel through Spark shuffles in blocks, and groups read back one at a time."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id in integer records; it sorts before every other id.
NULL_ID = -(2**63)
_M = np.uint64(0xD6E8FEB86659FD93)
_32 = np.uint64(32)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> _32)
        x = x * _M
        x = x ^ (x >> _32)
        x = x * _M
        return x ^ (x >> _32)


def pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length as bytes, byte planes apart so that small numbers compress."""
    out = [len(columns[0]).to_bytes(8, "little")]
    for c in columns:
        c = np.ascontiguousarray(c)
        out.append(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes())
    return b"".join(out)


def unpack(blob: bytes, kinds: tuple[str, ...]) -> list[np.ndarray]:
    n, at, out = int.from_bytes(blob[:8], "little"), 8, []
    for kind in kinds:
        size = n * np.dtype(kind).itemsize
        planes = np.frombuffer(blob, np.uint8, size, at).reshape(-1, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += size
    return out


def gather(blobs: list[bytes], kinds: tuple[str, ...]) -> list[np.ndarray]:
    parts = [unpack(b, kinds) for b in blobs]
    return [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.empty(0, k) for k in kinds]


def in_buckets(key: np.ndarray, buckets: int, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Blobs of the records of each range of keys (unsigned 64 bits, evenly spread)."""
    return _dealt(((key >> np.uint64(40)).astype(np.int64) * buckets) >> 24, columns)


def by_doc(doc: np.ndarray, buckets: int, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Blobs of the records of each bucket of documents, as doc_bucket() deals them."""
    ids, at = np.unique(doc, return_inverse=True)
    bucket = np.fromiter((zlib.crc32(str(i).encode()) % buckets for i in ids.tolist()), np.int64, len(ids))
    return _dealt(bucket[at], columns)


def doc_bucket(doc: Column, buckets: int) -> Column:
    return (F.crc32(doc.cast("string").cast("binary")) % buckets).cast("int")


def _dealt(bucket: np.ndarray, columns: tuple[np.ndarray, ...]) -> Iterator[tuple[int, bytes]]:
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    edges = np.flatnonzero(np.diff(bucket, prepend=-1))
    columns = tuple(c[order] for c in columns)
    for a, b in zip(edges, [*edges[1:], len(bucket)], strict=True):
        yield int(bucket[a]), pack(*(c[a:b] for c in columns))


def starts(*columns: np.ndarray) -> np.ndarray:
    """Where each run of equal records begins, as booleans."""
    n = len(columns[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return new


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of rows sorted by their first columns; one group in memory at a time."""
    now, rows = None, []
    for batch in (b.slice(at, 64) for b in batches for at in range(0, len(b), 64)):
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != now:
                if rows:
                    yield now, rows
                now, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield now, rows


def bucket_count(spark: SparkSession, size: int, each: int, most: int = 1 << 16) -> int:
    """Buckets of about ``each`` of ``size`` bytes, and at least three for each shuffle partition, so that these get
    about as much; ``most`` bounds the pieces that a task sends."""
    return min(most, max(16, 3 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each)))


def ids_of(column: pa.Array) -> np.ndarray:
    return column.fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)
