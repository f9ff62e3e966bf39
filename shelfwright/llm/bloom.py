"""A Bloom filter of 64-bit keys that is built on the executors and has a size bound whatever their number."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: Bits for each key, and bits at most. A full filter lets more through and stays right.
BITS, MOST = 16, 1 << 28
MIX = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    x = (x ^ (x >> np.uint64(29))) * MIX
    return x ^ (x >> np.uint64(32))


def places(key: np.ndarray, bits: int) -> list[np.ndarray]:
    key = key.view(np.uint64)
    return [(mix(key + np.uint64(7 * i)) & np.uint64(bits - 1)).astype(np.int64) for i in range(2)]


def bloom(keys: DataFrame) -> np.ndarray:
    """Packed bits for the long column `key`; parts of the filter are or-ed before they come to the driver."""
    bits = min(MOST, max(1 << 16, 1 << (BITS * keys.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in places(batch.column("key").to_numpy(zero_copy_only=False), bits):
                yield pa.RecordBatch.from_arrays([pa.array(p >> 5), pa.array(np.left_shift(np.int64(1), p & 31))], ["w", "v"])

    words = map_arrow(keys.select("key"), run, "w long, v long").groupBy("w").agg(F.bit_or("v").alias("v"))
    out = np.zeros(bits >> 5, np.uint32)
    found = words.toArrow()  # MOST / 32 rows at most
    out[found["w"].to_numpy()] = found["v"].to_numpy()
    return out


def in_bloom(table: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which keys may be in the filter."""
    ok = np.ones(len(key), bool)
    for p in places(key, 32 * len(table)):
        ok &= (table[p >> 5] >> (p & 31).astype(np.uint32)) & 1 == 1
    return ok
