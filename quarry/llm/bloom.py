"""A Bloom filter of bounded size over 64-bit hashes, built by Spark and asked in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bits per key, and in all at least and at most (16 MB); beyond that the filter only lets more through.
BLOOM_RATE, BLOOM_LEAST, BLOOM_MOST = 16, 1 << 20, 1 << 27


def _spots(keys: np.ndarray, bits: int) -> np.ndarray:
    """Two bit positions per key in a filter of ``bits`` bits (a power of two)."""
    u = keys.view(np.uint64)
    return np.stack([u & np.uint64(bits - 1), (u >> np.uint64(32)) & np.uint64(bits - 1)]).astype(np.int64)


def _bloom_part(bits: int):
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits, dtype=bool)
        for batch in batches:
            own[_spots(batch.column(0).to_numpy(zero_copy_only=False), bits).ravel()] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(own).tobytes()], pa.binary())], ["bits"])

    return part


def bloom(table: DataFrame, column: str) -> bytes:
    """Bloom filter of a long column: four parts of ``BLOOM_MOST`` / 8 bytes at most reach the driver."""
    keys = table.select(column).distinct()
    bits = 1 << int(np.clip(keys.count() * BLOOM_RATE, BLOOM_LEAST, BLOOM_MOST) - 1).bit_length()
    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in keys.coalesce(4).mapInArrow(_bloom_part(bits), "bits binary").collect():
        out |= np.frombuffer(r["bits"], dtype=np.uint8)
    return out.tobytes()


def known(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys the filter may hold."""
    one, two = _spots(keys, 8 * len(bits))
    bit = lambda at: (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
    return (bit(one) & bit(two)).astype(bool)
