"""Arrow batches of sorted partitions, cut at the edges of equal keys."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch of texts, unless the session has its own setting: a batch is in memory several times, here and in the JVM.
TEXT_ROWS = 2048
_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def slim(texts: DataFrame) -> DataFrame:
    """The same rows, which go to Python workers in batches of TEXT_ROWS where the session has Spark's default of 10,000."""
    conf = texts.sparkSession.conf
    if conf.get(_SETTING) == "10000":
        conf.set(_SETTING, TEXT_ROWS)
    return texts


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Inside, jobs send TEXT_ROWS rows a batch to Python workers where the session has Spark's default of 10,000; afterwards the setting is as before."""
    before = spark.conf.get(_SETTING)
    try:
        if before == "10000":
            spark.conf.set(_SETTING, TEXT_ROWS)
        yield
    finally:
        spark.conf.set(_SETTING, before)


def give_back() -> None:
    """Returns memory that this process has freed to the system, which else keeps it for the process's next use."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function of batches, after which the worker gives back its memory: workers live on between stages, beside the JVM that needs it then."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def sorted_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of equal keys of sorted batches, with the run's number of each row."""
    kept: list[pa.RecordBatch] = []  # parts of the last run, put together once it ends

    def ends(batch: pa.RecordBatch) -> tuple:
        return tuple(batch.column(k)[-1].as_py() for k in keys)

    def numbered(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        for k in keys:
            x = t.column(k).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.cumsum(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        if kept and ends(kept[0]) == ends(batch) == tuple(batch.column(k)[0].as_py() for k in keys):
            kept.append(batch)
            continue
        t = pa.Table.from_batches([*kept, batch])
        run = numbered(t)
        last = int(np.searchsorted(run, run[-1]))
        if last:
            yield t.slice(0, last), run[:last]
        kept = t.slice(last).combine_chunks().to_batches()
    if kept:
        t = pa.Table.from_batches(kept)
        yield t, numbered(t)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column of one length, as float64."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))
