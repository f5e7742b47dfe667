"""Sums of fixed-size arrays over all documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lodestone.llm.words import tidy

SLICES = 16
SCHEMA = "slice int, salt int, counts binary"


def sum_arrays(frame: DataFrame, count: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None], cells: int) -> np.ndarray:
    """The sum over tasks of ``count``'s arrays of ``cells`` (a multiple of 16) counts.

    Slices of the arrays are added in two rounds, streaming, so that no task holds more than
    one array however many tasks there are, and the driver receives one array.
    """

    def rows(parts: dict[int, np.ndarray], salt: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(parts), pa.int32()), pa.array([salt] * len(parts), pa.int32()), pa.array([p.tobytes() for p in parts.values()], pa.binary())],
            names=["slice", "salt", "counts"],
        )

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = count(batches)
        if total is not None:
            parts = np.split(total.astype(np.uint64), SLICES)
            yield rows(dict(enumerate(parts)), TaskContext.get().partitionId() % 64)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column("slice").to_pylist(), batch.column("counts")):
                own = np.frombuffer(raw.as_buffer(), np.uint64)
                parts[i] = parts[i] + own if i in parts else own.copy()
        if parts:
            yield rows(parts, 0)

    summed = frame.mapInArrow(tidy(first), SCHEMA).repartition("slice", "salt").mapInArrow(add, SCHEMA).repartition("slice").mapInArrow(add, SCHEMA)
    out, width = np.zeros(cells, np.uint64), cells // SLICES
    for r in summed.collect():
        out[r["slice"] * width : (r["slice"] + 1) * width] += np.frombuffer(bytes(r["counts"]), np.uint64)
    return out
