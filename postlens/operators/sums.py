"""Sums of vectors over tasks, added in a tree; their size is fixed by the caller, not by the rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

SUMS = "part int, sums binary"
_SCHEMA = pa.schema([("part", pa.int32()), ("sums", pa.binary())])


def part_sum(sums: np.ndarray) -> pa.RecordBatch:
    """What a task yields: its sums under its own number."""
    return pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "sums": sums.tobytes()}], _SCHEMA)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, first = None, 0
    for batch in batches:
        for part, sums in zip(batch.column("part").to_pylist(), batch.column("sums").to_pylist()):
            own = np.frombuffer(sums)
            total, first = (own, part) if total is None else (total + own, first)
    if total is not None:
        yield pa.RecordBatch.from_pylist([{"part": first, "sums": total.tobytes()}], _SCHEMA)


def tree_sum(parts: DataFrame, count: int) -> np.ndarray:
    """The sum of ``parts`` of about ``count`` tasks: in as many groups as the root of ``count``, then on the driver.

    Parts are added in the order of their numbers, so a sum repeats. No parts give an empty vector.
    """
    groups = max(1, int(count ** 0.5))
    dealt = parts.repartition(groups, F.pmod("part", F.lit(groups))).sortWithinPartitions("part")
    rows = sorted((r["part"], bytes(r["sums"])) for r in dealt.mapInArrow(_added, SUMS).collect())
    total = np.zeros(0)
    for _, sums in rows:
        own = np.frombuffer(sums)
        total = total + own if len(total) else own
    return total
