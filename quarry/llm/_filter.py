"""A bitmap of fixed size over 64-bit hashes: what it doesn't hold is certainly not among the keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """The first bits of all keys (key long), as a map of 2^bits bits that the parts are added to one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, dtype=bool)
        for b in batches:
            seen[b.column("key").to_numpy().view(np.uint64) >> np.uint64(64 - bits)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(seen).tobytes()], pa.binary())], ["bits"])

    out = np.zeros(max(1, 1 << bits >> 3), dtype=np.uint8)
    for r in keys.select("key").coalesce(16).mapInArrow(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def may_hold(seen: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes (uint64) the bitmap holds."""
    at = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    return (seen[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)
