"""Blocks of rows as files in the shared folder, written once and read by any task later."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from sylvan.llm.util import shared_dir, slices, steady

MANIFEST = "block long, path string"
#: Numbers of blocks that each task has of its own.
PER_TASK = 1 << 32


def file_system(path: str):  # noqa: ANN201
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def store_blocks(spark: SparkSession, df: DataFrame, at: int, block_bytes: int) -> DataFrame:
    """Writes df in blocks of about block_bytes of its column number `at`, without a shuffle; returns their manifest.

    Written under a name of the attempt and renamed, so a task that runs twice leaves one file."""
    folder = shared_dir(spark, "blocks")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        k, held, size = 0, [], 0

        def close() -> pa.RecordBatch:
            nonlocal k, held, size
            system, final = file_system(f"{folder}/blocks/{task.partitionId():07d}-{k:06d}.parquet")
            temp = f"{os.path.dirname(final)}/_open-{task.taskAttemptId()}-{k}"
            system.create_dir(os.path.dirname(final), recursive=True)
            with system.open_output_stream(temp, compression=None) as out:
                pq.write_table(pa.Table.from_batches(held), out, compression="zstd", use_dictionary=False, write_statistics=False)
            system.move(temp, final)
            made = pa.RecordBatch.from_arrays([pa.array([task.partitionId() * PER_TASK + k], pa.int64()), pa.array([f"{folder}/blocks/{os.path.basename(final)}"])], ["block", "path"])
            k, held, size = k + 1, [], 0
            return made

        for part in slices(batches, at, block_bytes):
            held.append(part)
            size += part.column(at).nbytes
            if size >= block_bytes:
                yield close()
        if held:
            yield close()

    df.mapInArrow(steady(write), MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_block(entry: pa.Table) -> tuple[int, pa.Table]:
    """The block that a row of a manifest tells of."""
    system, at = file_system(entry["path"][0].as_py())
    with system.open_input_file(at) as f:
        return entry["block"][0].as_py(), pq.read_table(f)


def spread(manifest: DataFrame, n: int) -> DataFrame:
    """One row of a manifest for each task."""
    return manifest.coalesce(1).repartition(n)
