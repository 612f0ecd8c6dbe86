"""Exact removal of repeated substrings by a common-prefix-aware distributed merge sort of suffixes.

Every byte that a string of `length` bytes covers which also starts anywhere else is removed. Windows fall into cells by a
content-defined anchor (see windows), and only windows with equal anchor blocks, at equal distance, can be equal. So:

1. Blocks of documents tell which anchor blocks they hold; those that no other cell has are out. An anchor with over HOT
   different surroundings (a common line) would make one task's work unbounded: each of its windows becomes a cell of its
   own, asked for by a hash of all its bytes, and those that come once are out too.
2. Each block sends, to the bucket of their anchor, the suffixes that start at its other cells' anchors, and the text
   before the anchors read backwards: two sorted runs, front-coded (shared prefix length, rest).
3. A bucket merges the runs of either kind with a loser tree that keeps for each entry how many bytes it shares with the
   last winner and compares bytes only behind those. The shared prefix lengths of both merged orders decide: the window that
   starts d bytes before an anchor is repeated if another entry shares `length` - d bytes behind it and d bytes before it.
4. Each block gets back, for each entry that it sent, which of its windows are repeated, and removes what they cover.

Blocks are files in the shared folder, written once, so the texts are never shuffled and lost executors can read them again.
Bytes decide everywhere; hashes only choose what is compared.

Cases: a null text is empty; texts under `length` bytes keep everything; repeated rows are repeats of each other; a null id
is treated like any other; overlapping repeats, also in one document, count. No rows give no rows. Only doc_id and text are
read.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.llm.blocks import read_block, store_blocks
from sylvan.llm.exchange import SENT, answered, answers_of, bounds, group_sums, look_up_blocks, pack, sent_by, unpack
from sylvan.llm.hashing import mix, span_hashes
from sylvan.llm.util import bytes_of, grouped, steady, stored
from sylvan.llm.windows import Cells, cells

LENGTH, ANCHOR = 200, 64
#: Text of one block.
BLOCK_BYTES = 3 << 20
#: Different surroundings of an anchor, beyond two for each block, from which its windows are told apart before they are sent.
HOT = 4096
#: Strings of a run that are unpacked together.
CHUNK = 256
#: What one block sends to one bucket: two sorted runs, the places of their strings among the entries, and which entries
#: stand for several equal cells.
RUNS = "bucket int, block long, right binary, left binary, right_of binary, left_of binary, many binary"
REPLIES = "block long, bucket int, reply binary"
#: Answers to a block's keys.
ONCE, REPEATED, COMMON = 0, 1, 2


class Sent(NamedTuple):
    """The entries of a block in the order they are sent, and the entry of each cell."""

    order: np.ndarray  # first cell of each entry
    many: np.ndarray
    hash: np.ndarray
    of: np.ndarray


def shared_prefix(a: bytes, b: bytes, known: int) -> int:
    """How many bytes a and b share, of which `known` need not be looked at."""
    low, high = known, min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    while high - low > 8:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    while a[low] == b[low]:
        low += 1
    return low


def sized(data: bytes) -> bytes:
    return len(data).to_bytes(4, "little") + data


def front_code(strings: list[bytes]) -> bytes:
    """A sorted run as shared prefix lengths and rests, the latter in chunks."""
    prefix = [0, *(shared_prefix(a, b, 0) for a, b in zip(strings, strings[1:], strict=False))]
    head = sized(pack(np.array([len(s) for s in strings]))) + sized(pack(np.array(prefix)))
    rests = [b"".join(s[p:] for s, p in zip(strings[a : a + CHUNK], prefix[a : a + CHUNK], strict=True)) for a in range(0, len(strings), CHUNK)]
    return b"".join(sized(zlib.compress(x, 1)) for x in (head, *rests))


def run_of(data: bytes) -> Iterator[tuple[bytes, int]]:
    """The strings of a front-coded run, each with what it shares with the one before; one chunk is unpacked at a time."""

    def parts() -> Iterator[bytes]:
        at = 0
        while at < len(data):
            size = int.from_bytes(data[at : at + 4], "little")
            yield zlib.decompress(data[at + 4 : at + 4 + size])
            at += 4 + size

    chunks = parts()
    head = next(chunks)
    cut = 4 + int.from_bytes(head[:4], "little")
    sizes, prefixes = unpack(head[4:cut]).tolist(), unpack(head[cut + 4 :]).tolist()
    last = b""
    for a in range(0, len(sizes), CHUNK):
        raw, at = next(chunks), 0
        for size, prefix in zip(sizes[a : a + CHUNK], prefixes[a : a + CHUNK], strict=True):
            last = last[:prefix] + raw[at : at + size - prefix]
            at += size - prefix
            yield last, prefix


def merge_runs(runs: list[Iterator[tuple[bytes, int]]]) -> Iterator[tuple[bytes, int, int]]:
    """All strings of the runs in order, each with the length it shares with the one before, and its run.

    A loser tree: an inner node keeps the loser of its last match and how much it shares with the string that won. Of two
    that are matched, the one that shares more with the last winner is smaller; only if both share equally much are bytes
    compared, from there on."""
    k = 1
    while k < len(runs):
        k *= 2
    heads: list[bytes | None] = []
    for r in range(k):
        first = next(runs[r], None) if r < len(runs) else None
        heads.append(first[0] if first else None)
    losers, shared = [0] * k, [0] * k

    def match(a: int, same_a: int, b: int, same_b: int) -> tuple[int, int, int, int]:
        """(winner, what it shares with the last winner, loser, what that shares with the new one)."""
        x, y = heads[a], heads[b]
        if x is None:
            return b, same_b, a, 0
        if y is None:
            return a, same_a, b, 0
        if same_a != same_b:
            return (a, same_a, b, same_b) if same_a > same_b else (b, same_b, a, same_a)
        n = shared_prefix(x, y, same_a)
        if n == len(x) or (n < len(y) and x[n] < y[n]):
            return a, same_a, b, n
        return b, same_b, a, n

    def start(node: int) -> int:
        if node >= k:
            return node - k
        winner, _, loser, same = match(start(2 * node), 0, start(2 * node + 1), 0)
        losers[node], shared[node] = loser, same
        return winner

    winner, same = start(1) if k > 1 else 0, 0
    while (head := heads[winner]) is not None:
        yield head, same, winner
        following = next(runs[winner], None)
        heads[winner], same = following or (None, 0)
        node = (winner + k) // 2
        while node:
            other, other_same = losers[node], shared[node]
            # Most matches end here, without a look at the strings.
            if heads[winner] is not None and heads[other] is not None and same != other_same:
                if other_same > same:
                    losers[node], shared[node], winner, same = winner, same, other, other_same
            else:
                winner, same, losers[node], shared[node] = match(winner, same, other, other_same)
            node //= 2


def contents(c: Cells, data: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all bytes of each cell and of where its anchor lies in them."""
    return mix(span_hashes(data, c.low, c.high + length) ^ (c.anchor - c.low).astype(np.uint64))


def to_send(c: Cells, data: np.ndarray, length: int) -> Sent:
    """Equal cells are one entry; entries are ordered by anchor hash."""
    content = contents(c, data, length)
    while True:
        by = np.lexsort((content, c.hash))
        h, x = c.hash[by], content[by]
        new = np.ones(len(by), bool)
        new[1:] = (h[1:] != h[:-1]) | (x[1:] != x[:-1])
        group, heads = np.cumsum(new) - 1, np.flatnonzero(new)
        first = by[heads][group]
        other = [int(k) for k, f in zip(by[~new], first[~new], strict=True) if c.high[k] - c.low[k] != c.high[f] - c.low[f] or not np.array_equal(data[c.low[k] : c.high[k] + length], data[c.low[f] : c.high[f] + length])]
        if not other:
            break
        content[other] += np.arange(1, len(other) + 1, dtype=np.uint64)  # hashes that meet by chance
    of = np.empty(len(by), np.int64)
    of[by] = group
    return Sent(by[heads], np.diff(np.append(heads, len(by))) > 1, h[heads], of)


def block_cells(rows: pa.Table, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, Cells]:
    data, offsets = bytes_of(rows["text"])
    return data, offsets, cells(data, offsets, length, anchor)


def anchor_keys(c: Cells, data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct anchor hashes, and how many different cells have each (2 at least, if it has several)."""
    content = contents(c, data, length)
    by = np.lexsort((content, c.hash))
    h, x = c.hash[by], content[by]
    key = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.empty(0, np.int64)
    new = np.ones(len(h), np.int64)
    new[1:] = (h[1:] != h[:-1]) | (x[1:] != x[:-1])
    different = np.add.reduceat(new, key) if len(key) else key
    return h[key], np.maximum(different, np.minimum(np.diff(np.append(key, len(h))), 2))


def repeated(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """ONCE, REPEATED or COMMON for each key; how many are common."""
    order, group, sums = group_sums(keys, counts.astype(np.int64))
    blocks = np.bincount(group, minlength=len(sums))
    verdict = np.where(sums <= 1, ONCE, np.where(sums - 2 * blocks > HOT, COMMON, REPEATED))
    out = np.empty(len(keys), np.uint64)
    out[order] = verdict[group]
    return out, [int((verdict == COMMON).sum())]


def chosen(c: Cells, which: np.ndarray) -> Cells:
    return Cells(*(x[which] for x in c))


def verdicts(c: Cells, back: pa.Table) -> np.ndarray:
    """The answer to each cell's anchor."""
    keys, at = np.unique(c.hash, return_inverse=True)
    return answers_of(back)[at] if len(keys) else np.empty(0, np.uint64)


def windows_alone(c: Cells, data: np.ndarray, length: int) -> Cells:
    """Each window of the cells as a cell of its own, whose anchor is its start."""
    size = c.high - c.low + 1
    start = np.repeat(c.low - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return Cells(start, start, start, span_hashes(data, start, start + length))


def window_keys(c: Cells, data: np.ndarray, length: int, back: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the windows of common anchors, and how many have each, up to 2."""
    keys, counts = np.unique(windows_alone(chosen(c, verdicts(c, back) == COMMON), data, length).hash, return_counts=True)
    return keys, np.minimum(counts, 2)


def entries(c: Cells, data: np.ndarray, length: int, back: pa.Table, windows_back: pa.Table) -> Cells:
    """The cells that may be repeated, and the windows of common anchors that may, by place."""
    verdict = verdicts(c, back)
    some, alone = chosen(c, verdict == REPEATED), windows_alone(chosen(c, verdict == COMMON), data, length)
    if len(alone.low):
        alone = chosen(alone, verdicts(alone, windows_back) != ONCE)
    both = Cells(*(np.concatenate(x) for x in zip(some, alone, strict=True)))
    return chosen(both, np.argsort(both.low, kind="stable"))


def runs_of_block(block: int, c: Cells, data: np.ndarray, length: int, n: int) -> pa.Table:
    """RUNS of one block, for each bucket that its anchors fall into."""
    sent = to_send(c, data, length)
    buckets, cuts = bounds(sent.hash, n)
    columns: dict[str, list] = {x.split()[0]: [] for x in RUNS.split(", ")}
    for k, bucket in enumerate(buckets.tolist()):
        a, b = cuts[k], cuts[k + 1]
        own = sent.order[a:b]
        row = {"bucket": bucket, "block": block, "many": pack(sent.many[a:b])}
        for side, low, high, step in (("right", c.anchor[own], c.high[own] + length, 1), ("left", c.low[own], c.anchor[own], -1)):
            strings = [data[x:y][::step].tobytes() for x, y in zip(low.tolist(), high.tolist(), strict=True)]
            by = sorted(range(len(strings)), key=strings.__getitem__)
            row |= {side: front_code([strings[i] for i in by]), f"{side}_of": pack(np.array(by))}
        for name, value in row.items():
            columns[name].append(value)
    types = {"bucket": pa.int32(), "block": pa.int64()}
    return pa.table({name: pa.array(values, types.get(name, pa.binary())) for name, values in columns.items()})


class Order(NamedTuple):
    """The strings of all runs in merged order."""

    place: np.ndarray  # of each entry
    shared: np.ndarray  # with the string before, by place; and 0 at the end
    size: np.ndarray  # by entry

    def near(self) -> np.ndarray:
        """The most that each entry's string shares with any other."""
        return np.maximum(self.shared[self.place], self.shared[self.place + 1])

    def classes(self, size: int, some: np.ndarray) -> np.ndarray:
        """Equal numbers for entries whose strings share `size` bytes, for strings as long as that."""
        return np.cumsum(self.shared < size)[self.place[some]]


def merged_order(runs: pa.ChunkedArray, of: list[np.ndarray]) -> Order:
    first = np.cumsum([0, *map(len, of)])
    seen = [0] * len(of)
    entry, shared, size = array("q"), array("i"), array("i")
    for string, same, run in merge_runs([run_of(x.as_py()) for x in runs]):
        entry.append(first[run] + of[run][seen[run]])
        shared.append(same)
        size.append(len(string))
        seen[run] += 1
    by = np.frombuffer(entry, np.int64)
    place, sizes = np.empty(len(by), np.int64), np.empty(len(by), np.int64)
    place[by], sizes[by] = np.arange(len(by)), np.frombuffer(size, np.int32)
    return Order(place, np.append(np.frombuffer(shared, np.int32), 0), sizes)


def judge(rows: pa.Table, length: int, anchor: int) -> list[bytes]:
    """For each run of a bucket, a code for each entry (0 nothing, 1 all its windows, 2 some) and the bits of the latter,
    by how far before the anchor the windows start."""
    sides = [merged_order(rows[side], [unpack(x.as_py()).astype(np.int64) for x in rows[f"{side}_of"]]) for side in ("right", "left")]
    right, left = sides
    many = np.concatenate([unpack(x.as_py()) for x in rows["many"]]) > 0
    n, width = len(many), length - anchor + 1
    bits = np.zeros((n, (width + 7) // 8), np.uint8)
    low = length - np.minimum(right.size, right.near())
    high = np.minimum(left.size, left.near())
    for d in range(width):
        some = np.flatnonzero((low <= d) & (d <= high))
        _, at, counts = np.unique(right.classes(length - d, some) * (n + 1) + left.classes(d, some), return_inverse=True, return_counts=True)
        bits[some[counts[at] > 1], d >> 3] |= np.uint8(1 << (d & 7))
    found = np.bitwise_count(bits).sum(1)
    codes = np.where(many | (found == left.size - (length - right.size) + 1), 1, np.where(found > 0, 2, 0)).astype(np.uint8)
    cuts = np.cumsum([0, *(len(unpack(x.as_py())) for x in rows["many"])])
    return [zlib.compress(codes[a:b].tobytes() + bits[a:b][codes[a:b] == 2].tobytes(), 1) for a, b in zip(cuts, cuts[1:], strict=False)]


def covered(c: Cells, data: np.ndarray, replies: dict[int, bytes], length: int, anchor: int, n: int) -> np.ndarray:
    """Which bytes the repeated windows of the entries cover."""
    sent = to_send(c, data, length)
    buckets, cuts = bounds(sent.hash, n)
    code, bits = np.zeros(len(sent.order), np.uint8), np.zeros((len(sent.order), (length - anchor + 8) // 8), np.uint8)
    for k, bucket in enumerate(buckets.tolist()):
        a, b = int(cuts[k]), int(cuts[k + 1])
        reply = np.frombuffer(zlib.decompress(replies[bucket]), np.uint8)
        code[a:b] = reply[: b - a]
        bits[a:b][code[a:b] == 2] = reply[b - a :].reshape(-1, bits.shape[1])
    whole, some = (np.flatnonzero(code[sent.of] == k) for k in (1, 2))
    cell, d = np.nonzero(np.unpackbits(bits[sent.of[some]], axis=1, bitorder="little"))
    start = c.anchor[some[cell]] - d
    edge = np.zeros(len(data) + 1, np.int32)
    for first, last in ((c.low[whole], c.high[whole]), (start, start)):
        np.add.at(edge, first, 1)
        np.subtract.at(edge, last + length, 1)
    return np.cumsum(edge[:-1]) > 0


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def without_repeats(spark: SparkSession, docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, texts: bool = False) -> DataFrame:
    """RESULT for each document; texts: also kept, the bytes that stay."""
    schema = RESULT + (", kept binary" if texts else "")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("binary"), F.lit(bytearray())).alias("text"))
    manifest = store_blocks(spark, rows, 1, BLOCK_BYTES)
    n = max(1, manifest.count())

    def emit(block: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        data, _, c = block_cells(block, length, anchor)
        return anchor_keys(c, data, length)

    anchors = stored(spark, look_up_blocks(manifest, emit, repeated, n), "anchors")
    # Dealt by number: by its bytes alone a manifest would be coalesced into a few tasks.
    manifest = manifest.repartition(n, "block")
    asked = anchors.filter("block >= 0").select("block", "bucket", "answers", F.lit(1).alias("kind"))
    if anchors.agg(F.sum(F.element_at("stats", 1))).first()[0]:

        def ask(entry: pa.Table, back: pa.Table) -> pa.Table:
            block, rows = read_block(entry)
            data, _, c = block_cells(rows, length, anchor)
            sent = list(sent_by(block, *window_keys(c, data, length, back), n))
            return pa.Table.from_batches(sent) if sent else pa.table({"bucket": pa.array([], pa.int32()), "block": pa.array([], pa.int64()), "keys": pa.array([], pa.binary()), "vals": pa.array([], pa.binary())})

        sent = manifest.groupBy("block").cogroup(asked.repartition(n, "block").groupBy("block")).applyInArrow(ask, SENT)
        windows = stored(spark, answered(sent, repeated, n), "windows")
        asked = asked.union(windows.filter("block >= 0").select("block", "bucket", "answers", F.lit(2).alias("kind")))

    def entries_of(rows: pa.Table, back: pa.Table) -> tuple[np.ndarray, np.ndarray, Cells]:
        data, offsets, c = block_cells(rows, length, anchor)
        first, second = (back.filter(pa.compute.equal(back["kind"], k)) for k in (1, 2))
        return data, offsets, entries(c, data, length, first, second)

    def send(entry: pa.Table, back: pa.Table) -> pa.Table:
        block, rows = read_block(entry)
        data, _, c = entries_of(rows, back)
        return runs_of_block(block, c, data, length, n)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, runs in grouped(batches, "bucket"):
            yield pa.RecordBatch.from_arrays([runs["block"].combine_chunks(), pa.array([bucket] * runs.num_rows, pa.int32()), pa.array(judge(runs, length, anchor), pa.binary())], ["block", "bucket", "reply"])

    runs = manifest.groupBy("block").cogroup(asked.repartition(n, "block").groupBy("block")).applyInArrow(send, RUNS)
    replies = stored(spark, runs.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(steady(merge), REPLIES), "replies")

    def finish(entry: pa.Table, back: pa.Table) -> pa.Table:
        block, rows = read_block(entry)
        data, offsets, c = entries_of(rows, back)
        last = back.filter(pa.compute.equal(back["kind"], 3))
        gone = covered(c, data, dict(zip(last["bucket"].to_pylist(), last["answers"].to_pylist(), strict=True)), length, anchor, n)
        counts = np.concatenate([[0], np.cumsum(gone)])
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        begins[offsets[:-1][offsets[:-1] < len(data)]] |= gone[offsets[:-1][offsets[:-1] < len(data)]]
        spans = np.concatenate([[0], np.cumsum(begins)])
        kept = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(offsets, offsets[1:], strict=False)]
        out = {"doc_id": rows["doc_id"], "n_bytes": np.diff(offsets), "n_removed": np.diff(counts[offsets]), "n_spans": np.diff(spans[offsets]), "kept_sha256": [hashlib.sha256(x).hexdigest() for x in kept]}
        return pa.table(out | ({"kept": pa.array(kept, pa.binary())} if texts else {}))

    every = asked.union(replies.select("block", "bucket", F.col("reply").alias("answers"), F.lit(3).alias("kind")))
    return manifest.groupBy("block").cogroup(every.repartition(n, "block").groupBy("block")).applyInArrow(finish, schema)
