"""Packed columns: numbers as compressed bytes, and counted keys that are summed by bucket."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import record
from .textkernel import U64, mix

COUNTED = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
COUNTED_DDL = "bucket int, keys binary, counts binary"
#: Distinct keys that a task holds before it sends them.
HELD = 4_000_000


def pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def unpack(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=dtype)


def pack_sorted(a: np.ndarray) -> bytes:
    """Ascending unsigned keys, by their differences and those byte by byte."""
    d = np.diff(a, prepend=U64(0)).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_sorted(b: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(raw.T).view("<u8").reshape(-1), dtype=U64)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their counts."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The parts' keys and counts one after the other; the list is emptied, so that they aren't held twice."""
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    parts.clear()
    return keys, counts


class Counter:
    """Sums counts of 64-bit keys in a task and sends them by bucket. Keys that only differ in their low `free` bits share one."""

    def __init__(self, buckets: int, free: int = 0):
        self.buckets, self.free, self.parts, self.size = buckets, U64(free), [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        if counts is None:
            keys, counts = np.unique(keys, return_counts=True)
        self.parts.append((keys, counts.astype(np.int64)))
        self.size += len(keys)
        if self.size > HELD:
            self.parts = [summed(*_joined(self.parts))]
            self.size = len(self.parts[0][0])
            if self.size > HELD // 2:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        keys, counts = summed(*_joined(self.parts))
        self.size = 0
        bucket = (mix(keys >> self.free) % U64(self.buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        keys, counts, bucket = keys[order], counts[order], bucket[order]
        edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(keys) else []
        for i, j in zip(edge, [*edge[1:], len(keys)]):
            yield record(COUNTED, [bucket[i]], [pack_sorted(keys[i:j])], [pack(np.minimum(counts[i:j], 2**32 - 1).astype(np.uint32))])


def total(sent: DataFrame, result: Callable[[np.ndarray, np.ndarray], Iterator[pa.RecordBatch]], ddl: str, buckets: int) -> DataFrame:
    """What `result` makes of the summed keys of each bucket. Every task sends a key once at most for each flush, so no key is hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            for k, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                parts.append((unpack_sorted(k), unpack(c, np.uint32).astype(np.int64)))
                size += len(parts[-1][0])
                if size > HELD:
                    parts = [summed(*_joined(parts))]
                    size = len(parts[0][0])
        if parts:
            yield from result(*summed(*_joined(parts)))

    # a task for each bucket: by a hash of it, some tasks would hold several
    return sent.repartitionById(buckets, F.col("bucket")).mapInArrow(run, ddl)
