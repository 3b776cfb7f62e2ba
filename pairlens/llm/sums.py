"""Sums of equally long arrays over all tasks, for models whose size is a parameter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

BLOCKS = "block int, part int, data binary"
# Floats in a block, and groups of tasks that are summed before the last step.
BLOCK, PARTS = 16_384, 16
# Blocks that a summing task is meant to hold: starting a task costs more than adding a block of some tasks.
HELD = 4


def blocks(array: np.ndarray, part: int) -> pa.RecordBatch:
    """Rows (block, part, data) for a task's float array."""
    flat = np.ascontiguousarray(array, dtype=np.float32).ravel()
    pieces = [flat[i : i + BLOCK].tobytes() for i in range(0, len(flat), BLOCK)]
    columns = [pa.array(range(len(pieces)), pa.int32()), pa.array([part % PARTS] * len(pieces), pa.int32()), pa.array(pieces, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["block", "part", "data"])


def _add(part_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for block, part, data in zip(*(c.to_pylist() for c in batch.columns)):
                key, values = (block, part_of(part)), np.frombuffer(data, np.float32).astype(np.float64)
                totals[key] = totals[key] + values if key in totals else values
        for (block, part), total in sorted(totals.items()):
            columns = [pa.array([block], pa.int32()), pa.array([part], pa.int32()), pa.array([total.astype(np.float32).tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "part", "data"])

    return run


def total(rows: DataFrame, size: int) -> np.ndarray:
    """The sum of all tasks' arrays of ``size`` floats: first within groups of tasks, then over the groups.

    Each summing task holds its blocks only, never a group of rows.  The driver gets one array.
    """
    n = max(1, -(-size // BLOCK))
    tasks = -(-n // HELD)
    partial = rows.repartition(tasks * 2, "block", "part").mapInArrow(_add(lambda p: p), BLOCKS)
    whole = partial.repartition(tasks, "block").mapInArrow(_add(lambda p: 0), BLOCKS)
    out = np.zeros(n * BLOCK, dtype=np.float32)
    for r in whole.collect():
        values = np.frombuffer(r["data"], np.float32)
        out[r["block"] * BLOCK : r["block"] * BLOCK + len(values)] = values
    return out[:size]


def task_number() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def bounded_sample(rows: DataFrame, size: int, *key: str) -> list:
    """About ``size`` rows, all if there are fewer and ``2 * size`` at most, chosen by a hash of ``key``.

    The share to keep follows from a count, so that each task sends only its part of the sample.
    Where many rows share a key and the share is too large, those of smallest hash stay; rows that
    tie differ in nothing but order, or in columns that cannot be ordered, so reruns agree.
    """
    n = rows.count()
    hashed = F.pmod(F.xxhash64(*key), F.lit(1 << 30))
    if n > size:
        rows = rows.where(hashed < int((1 << 30) * size / n))
    return rows.orderBy(hashed, F.xxhash64(*rows.columns)).limit(2 * size).collect()
