"""Arrays of a fixed size that every task fills and that are merged, block by block, in a tree on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What tasks send: the block's number, the task's, and the block's values.
KIND = "block int, part int, data binary"
#: How many arrays of one block a group merges at most.
FAN = 32


def cut(part: int, values: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
    """A task's array as rows of ``size`` values; blocks of zeros are left out."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for i in range(0, len(values), size):
        if (block := values[i : i + size]).any():
            yield pa.RecordBatch.from_pydict({"block": pa.array([i // size], pa.int32()), "part": pa.array([part], pa.int32()), "data": pa.array([squeeze(block.tobytes())], pa.binary())})


def merged(parts: DataFrame, tasks: int, length: int, dtype: type, size: int, merge: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The merged array, of ``length`` values.  No group holds more than FAN blocks, however many tasks there are."""

    def join(group: pa.Table) -> pa.Table:
        total = None
        for x in group.column("data").to_pylist():
            values = np.frombuffer(zstandard.decompress(x), dtype)
            total = values if total is None else merge(total, values)
        first = group.slice(0, 1).to_pylist()[0]
        data = zstandard.ZstdCompressor(level=1).compress(total.tobytes())
        return pa.table({"block": pa.array([first["block"]], pa.int32()), "part": pa.array([first["part"] // FAN], pa.int32()), "data": pa.array([data], pa.binary())})

    while tasks > 1:
        parts = parts.groupBy("block", F.expr(f"part div {FAN}").alias("_g")).applyInArrow(join, KIND)
        tasks = -(-tasks // FAN)
    out = np.zeros(length, dtype)
    for r in parts.toLocalIterator():
        block = np.frombuffer(zstandard.decompress(bytes(r["data"])), dtype)
        at = r["block"] * size
        out[at : at + len(block)] = merge(out[at : at + len(block)], block)
    return out
