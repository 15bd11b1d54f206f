"""Sums of fixed-size number arrays over all rows of a table.

Every task adds up its rows in one array and emits it in blocks; blocks are
added up in parallel, so no task and not the driver holds more than the
array's size times a small factor. The size is a parameter of the caller and
does not grow with the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tillage.llm.tables import released

BLOCKS = 64
_SCHEMA = "block int, sums binary"


def _emit(total: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())],
                           names=["block", "sums"])


def _add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for block, raw in zip(b.column("block").to_pylist(), b.column("sums")):
            x = np.frombuffer(raw.as_buffer(), np.float64)
            total[block] = total[block] + x if block in total else x
    if total:
        yield _emit(total)


def summed(df: DataFrame, task: Callable[[Iterator[pa.RecordBatch]], np.ndarray], size: int) -> np.ndarray:
    """The sum over all tasks of ``task(batches)``, an array of ``size`` doubles (counts stay exact below 2**53)."""
    width = -(-size // BLOCKS)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = np.zeros(width * BLOCKS)
        x[:size] = task(batches)
        parts = {i: p for i, p in enumerate(x.reshape(BLOCKS, width)) if p.any()}
        if parts:
            yield _emit(parts)

    out = np.zeros((BLOCKS, width))
    for r in df.mapInArrow(released(rows), _SCHEMA).repartition(BLOCKS, "block").mapInArrow(_add_blocks, _SCHEMA).collect():
        out[r.block] = np.frombuffer(r.sums, np.float64)
    return out.reshape(-1)[:size]
