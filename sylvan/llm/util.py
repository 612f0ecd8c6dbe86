"""Helpers that the operators of this subpackage share: tables, the shared folder, blocks and bucket exchange."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes that Spark sends a Python worker at once; without a bound it counts rows alone, whatever their size.
BATCH_BYTES = "4m"



def steady(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work, after which the worker gives freed memory back to the machine: workers outlive their tasks, and what the
    allocators of those that wait keep would add up beside the busy ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    import ctypes

    with suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) in (None, "67108864b"):  # unset, or Spark's default
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, and all of Spark is one process (tests), below a folder of
    this machine. A cluster must name a folder that its machines share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='sylvan-')}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/sylvan/{tag}-{uuid.uuid4().hex}"


def stored(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """df written once to the shared folder and read back: cuts lineage and survives lost executors."""
    df.write.parquet(path := shared_dir(spark, tag))
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as make it one that df has not."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.Table]]:
    """Runs of equal key of a stream that is sorted by key, one table at a time."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.asarray(batch.column(key))
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and keys[a] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = int(keys[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


def bytes_of(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A binary column as one byte array and the offsets of its rows."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], pa.binary())
    wide = array.cast(pa.large_binary())
    if not len(wide):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = np.frombuffer(wide.buffers()[2], np.uint8) if wide.buffers()[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], at: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that column number `at` of each holds about `most` bytes; one row may hold more."""
    for batch in batches:
        column = batch.column(at)
        if not len(column):
            continue
        sizes = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0)))
        cuts = np.unique(np.append(np.searchsorted(sizes, np.arange(most, sizes[-1] + most, most), side="left") + 1, len(column)))
        a = 0
        for b in cuts[cuts <= len(column)]:
            if b > a:
                yield batch.slice(a, b - a)
            a = b
