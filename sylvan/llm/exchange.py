"""Distributed lookup of keys by blocks of documents.

Each block sends its sorted distinct 64-bit keys, cut into buckets by their high bits and delta-coded, once; each bucket
works on the keys of all blocks and sends one small integer for each key back, in the order it came. So a key costs a few
bytes each way, a hot key one entry for each block, and no table of all keys exists in one place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sylvan.llm.blocks import read_block, spread
from sylvan.llm.util import give_back, grouped, steady

SENT = "bucket int, block long, keys binary, vals binary"
ANSWERS = "block long, bucket int, answers binary, stats array<bigint>"


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers in as many bytes each as the largest needs."""
    values = np.ascontiguousarray(values, "<u8")
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + values.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(data: bytes) -> np.ndarray:
    width = data[0]
    body = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    out = np.zeros((len(body), 8), np.uint8)
    out[:, :width] = body
    return out.reshape(-1).view("<u8")


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, without the low bits that are zero in all."""
    steps = np.diff(keys, prepend=np.uint64(0))
    low = int(np.bitwise_or.reduce(steps)) or 1
    shift = (low & -low).bit_length() - 1
    return bytes([shift]) + int(steps[0] if len(steps) else 0).to_bytes(8, "little") + pack(steps[1:] >> np.uint64(shift))


def unpack_sorted(data: bytes) -> np.ndarray:
    rest = unpack(data[9:])
    out = np.empty(len(rest) + 1, np.uint64)
    out[0] = int.from_bytes(data[1:9], "little")
    out[1:] = rest << np.uint64(data[0])
    return np.cumsum(out, dtype=np.uint64)


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    """The one of n buckets of equal key range that each key falls into."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def bounds(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(the buckets that sorted keys fall into, where each begins, and the end)."""
    own = bucket_of(keys, n)
    heads = np.flatnonzero(np.diff(own, prepend=-1))
    return own[heads], np.append(heads, len(keys))


def group_sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, group of each ordered entry, sum of values by group) of equal keys."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    heads = np.flatnonzero(new)
    return order, np.cumsum(new) - 1, np.add.reduceat(values[order], heads) if len(heads) else values[:0]


Emit = Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]
Answer = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, list[int]]]


def answer_batch(blocks: np.ndarray, bucket: int, answers: list[bytes], stats: list[int] | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array([bucket] * len(blocks), pa.int32()), pa.array(answers, pa.binary()), pa.array([stats] * len(blocks), pa.list_(pa.int64()))], ["block", "bucket", "answers", "stats"])


def sent_by(block: int, keys: np.ndarray, vals: np.ndarray, n_buckets: int) -> Iterator[pa.RecordBatch]:
    full, cuts = bounds(keys, n_buckets)
    for at in range(0, len(full), 256):
        part = range(at, min(at + 256, len(full)))
        packed = [pa.array([f(x[cuts[k] : cuts[k + 1]]) for k in part], pa.binary()) for f, x in ((pack_sorted, keys), (pack, vals))]
        yield pa.RecordBatch.from_arrays([pa.array(full[part.start : part.stop], pa.int32()), pa.array([block] * len(part), pa.int64()), *packed], ["bucket", "block", "keys", "vals"])


def answered(sent: DataFrame, answer: Answer, n_buckets: int) -> DataFrame:
    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in grouped(batches, "bucket"):
            keys = [unpack_sorted(x.as_py()) for x in rows["keys"]]
            sizes = np.array([len(x) for x in keys])
            found, stats = answer(np.concatenate(keys), np.concatenate([unpack(x.as_py()) for x in rows["vals"]]))
            parts = np.split(found, np.cumsum(sizes)[:-1])
            blocks_of = np.asarray(rows["block"])
            for at in range(0, len(parts), 256):
                yield answer_batch(blocks_of[at : at + 256], bucket, [pack(x) for x in parts[at : at + 256]], None)
            yield answer_batch(np.array([-1]), bucket, [b""], stats)

    return sent.repartition(n_buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(steady(decide), ANSWERS)


def look_up_blocks(manifest: DataFrame, emit: Emit, answer: Answer, n_buckets: int) -> DataFrame:
    """emit gives the sorted distinct keys of a block (a file, see blocks) and a value for each; answer gives, for all entries
    of a bucket, an unsigned integer each, and numbers about the bucket (kept in a row of block -1). Returns ANSWERS."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block, rows = read_block(pa.Table.from_batches([batch.slice(row, 1)]))
                yield from sent_by(block, *emit(rows), n_buckets)

    return answered(spread(manifest, n_buckets).mapInArrow(steady(send), SENT), answer, n_buckets)


def answers_of(rows: pa.Table) -> np.ndarray:
    """A block's answers in the order of its keys."""
    order = np.argsort(np.asarray(rows["bucket"]), kind="stable")
    parts = rows["answers"].to_pylist()
    return np.concatenate([unpack(parts[i]) for i in order]) if len(order) else np.empty(0, np.uint64)


def with_answers(manifest: DataFrame, answers: DataFrame, work: Callable[[pa.Table, np.ndarray], pa.Table], schema: str, n: int) -> DataFrame:
    """work(rows of a block, its answers) for each block; only the answers are shuffled, the rows are read from their file."""

    def both(entry: pa.Table, back: pa.Table) -> pa.Table:
        out = work(read_block(entry)[1], answers_of(back))
        give_back()
        return out

    own = answers.filter("block >= 0").select("block", "bucket", "answers").repartition(n, "block")
    return manifest.repartition(n, "block").groupBy("block").cogroup(own.groupBy("block")).applyInArrow(both, schema)
