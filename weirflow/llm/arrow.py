"""Arrow-batch plumbing shared by the operators of this folder."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weirflow.session import ship


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch. Empty batches are passed over. The search
    for reference cycles rests within a batch: the operators make none, and it would walk
    over all rows of the batch again and again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                gc.disable()
                try:
                    yield from fn(batch)
                finally:
                    gc.enable()

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def int_lists(values, offsets) -> pa.Array:
    """A list<int32> array from flat values and row offsets."""
    return pa.ListArray.from_arrays(pa.array(np.asarray(offsets, dtype=np.int32)), pa.array(np.asarray(values, dtype=np.int32)))


def summed(df: DataFrame, count: Callable[[Iterator[pa.RecordBatch]], np.ndarray], size: int, chunk: int = 1 << 15) -> np.ndarray:
    """The sum over all tasks of the tables of ``size`` counts that ``count`` makes of a
    task's batches. The tables travel in chunks that are added up on the executors; the
    driver receives one table."""
    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = count(batches)
        if n.any():
            for at in range(0, size, chunk):
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([n[at:at + chunk].astype(np.int64).tobytes()], pa.binary())], ["at", "data"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = np.frombuffer(data, np.int64)
                sums[at] = sums[at] + n if at in sums else n
        for at, n in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([n.astype(np.float32).tobytes()], pa.binary())], ["at", "data"])

    ship(df.sparkSession)
    out = np.zeros(size, np.float32)
    for row in df.mapInArrow(tables, "at bigint, data binary").repartition(16, "at").mapInArrow(add, "at bigint, data binary").collect():
        out[row["at"]:row["at"] + chunk] = np.frombuffer(row["data"], np.float32)
    return out
