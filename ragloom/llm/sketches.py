"""Corpus-wide counters of fixed width: each task counts into one array, the arrays are summed slice by slice."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE = 1 << 12


def slices(counts: np.ndarray):
    """An array of counts as record batches of (slice, little-endian int64 values); slices of zeros are left out."""
    parts = counts.astype("<i8").reshape(-1, min(SLICE, len(counts)))
    used = np.flatnonzero(parts.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([parts[i].tobytes() for i in used], pa.binary())], names=["slice", "counts"])


def summed(found: DataFrame, width: int) -> np.ndarray:
    """Sum of the tasks' arrays: two rounds by slice, then ``width`` numbers to the driver."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column("slice").to_pylist(), b.column("counts").to_pylist(), strict=True):
                x = np.frombuffer(x, "<i8")
                total[k] = total[k] + x if k in total else x
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.astype("<i8").tobytes() for x in total.values()], pa.binary())], names=["slice", "counts"])

    size = min(SLICE, width)
    out = np.zeros(width, np.int64)
    n = min(32, max(1, width // size))
    for row in found.repartition(4 * n).mapInArrow(add, found.schema).repartition(n, "slice").mapInArrow(add, found.schema).toLocalIterator():
        out[row["slice"] * size : (row["slice"] + 1) * size] += np.frombuffer(row["counts"], "<i8")
    return out


def sample(df: DataFrame, key: str, most: int, seed: int = 7) -> DataFrame:
    """About ``most`` rows, the same ones each time, by a hash of the key; all rows if there are no more."""
    n = df.count()
    return df if n <= most else df.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 40)) < int(most / n * (1 << 40)))
