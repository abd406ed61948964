"""Bloom filter of bounded size: 2 MB, or as many bits as asked for, whatever the number of keys.

It only spares work: a row that passes is always checked again by a join. With so
many keys that the filter is full, every row passes and the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import scramble

BITS = 24


def _places(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = scramble(key.view(np.uint64))
    return (h >> np.uint64(64 - bits)).astype(np.int64), (h & np.uint64((1 << bits) - 1)).astype(np.int64)


def bloom_of(keys: DataFrame, size: int = BITS) -> np.ndarray:
    """Bit words of the filter of a frame's only column (long, no nulls), 2 ** ``size`` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(np.concatenate(_places(b.column(0).to_numpy(), size)))
            word, first = np.unique(at >> 6, return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first) if len(at) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits.view(np.int64))], ["word", "bits"])

    rows = keys.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (size - 6), np.uint64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def passing(bloom: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in the filter."""
    hit = [(bloom[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1 for at in _places(keys, len(bloom).bit_length() + 5)]
    return hit[0] & hit[1]
