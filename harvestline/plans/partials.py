"""Sums of numpy arrays over the rows of a DataFrame.

Each task adds up its Arrow batches and emits one binary row per array. Arrays of one key are
added in two steps, first over groups of tasks and then over the groups, so no task and not the
driver ever reads one array per task. What reaches the driver is one array per key.
"""

from __future__ import annotations

from typing import Callable, Hashable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from harvestline.session import ship_package

Sums = dict[Hashable, np.ndarray]
FAN_IN = 32  # arrays of one key added by a task of the first step, about
SCHEMA = "k int, part int, v binary"


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the arrays of each key in a partition."""
    total: Sums = {}
    part = {}
    for batch in batches:
        for k, p, v in zip(*(c.to_pylist() for c in batch.columns)):
            arr = np.frombuffer(v, "<f8")
            total[k] = total[k] + arr if k in total else arr
            part[k] = p
    yield array_rows([(k, part[k] // FAN_IN, arr) for k, arr in total.items()])


def array_rows(items: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    """Rows (key, part, array) of ``SCHEMA``."""
    return pa.RecordBatch.from_arrays(
        [pa.array([k for k, _, _ in items], pa.int32()), pa.array([p for _, p, _ in items], pa.int32()),
         pa.array([a.astype("<f8").tobytes() for _, _, a in items], pa.binary())], names=["k", "part", "v"])


def sum_arrays(df: DataFrame, batch_sums: Callable[[pa.RecordBatch], Sums], tasks: int | None = None) -> Sums:
    """``batch_sums`` maps an Arrow batch to {integer key: 1-d array}; returns the totals.
    ``tasks`` is the number of partitions of ``df`` if known: one task needs no adding up."""
    ship_package(df.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total: Sums = {}
        for batch in batches:
            if batch.num_rows:
                for key, arr in batch_sums(batch).items():
                    total[key] = total[key] + arr if key in total else arr
        part = TaskContext.get().partitionId() // FAN_IN
        yield array_rows([(int(k), part, np.asarray(a, "float64")) for k, a in total.items()])

    return add_up(df.mapInArrow(task, SCHEMA), tasks)


def add_up(found: DataFrame, tasks: int | None = None) -> Sums:
    """Totals of the arrays of each key in rows of ``SCHEMA`` that ``tasks`` tasks made; with one
    row per key, ``tasks=1`` saves the adding."""
    if tasks is None or tasks > FAN_IN:
        found = found.repartition("k", "part").mapInArrow(_added, SCHEMA)
    if tasks != 1:
        found = found.repartition("k").mapInArrow(_added, SCHEMA)
    return {r["k"]: np.frombuffer(r["v"], "<f8") for r in found.collect()}


def matrix(column: pa.Array | pd.Series, width: int) -> np.ndarray:
    """Array column to a 2-d array; missing elements become NaN."""
    if isinstance(column, pd.Series):
        column = pa.array(column.tolist())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().cast(pa.float64())
    if flat.null_count:
        flat = flat.fill_null(float("nan"))
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), width)
