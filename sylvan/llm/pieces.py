"""SentencePiece encoding and decoding by a batched Viterbi search in numpy.

A text is cut into units (a run of spaces and what follows) that no piece crosses. Distinct units of equal length advance
together, one character a step: the hashes of all their substrings probe the sorted hashes of the pieces, and the maxima
over the pieces that end at a step are stored with their backpointers.

In a unigram model a path's value is the sum of its scores. In a merge (BPE) model a piece may follow another only if
merging their characters anew would give just these two; every prefix has exactly one such path, and it is the merge
result, so the search gives the ids of the reference encoder for either kind. Whether two pieces may meet is found by
undoing merges at their border in reverse order, for all pairs of a step at once.

Characters outside the vocabulary become byte pieces, or the unknown piece where there are none.

Cases: a null or empty text has no pieces and decodes to an empty text; the sign that stands for a space is read as a
space; repeated rows and null ids are treated like any other; texts of any length are read whole. No rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylvan.llm.hashing import mix, powers, span_hashes
from sylvan.llm.util import bytes_of, slices, steady

SPACE = "▁"
BASE = np.uint64(0xD1342543DE82EF95)
FILTER = 22
CACHE = 20
#: Cells of unit, step and length that are searched at once.
CELLS = 1 << 19
#: Texts that are encoded together; a worker holds about thirty times as much.
SLICE = 1 << 20
#: Units that are longer are cut where no piece can lie across.
LONG = 48
UNIGRAM, BPE = 1, 2


class Vocabulary(NamedTuple):
    kind: int
    pieces: list[str]
    keys: np.ndarray  # sorted hashes of the pieces that units can hold
    ids: np.ndarray  # their ids
    maybe: np.ndarray  # low bits of keys
    scores: np.ndarray
    hashes: np.ndarray  # by id
    lengths: np.ndarray
    longest: int
    left: np.ndarray  # the last merge that makes a piece; -1 for single characters
    right: np.ndarray
    rank: np.ndarray  # of merges, early ones first
    byte_ids: np.ndarray  # -1 without byte pieces
    unknown: int
    dummy: bool  # a space is put before a text
    crossed: bool  # a piece may hold a space behind another character
    pairs: np.ndarray  # sorted keys of all neighbouring characters in pieces
    out: np.ndarray  # bytes of all pieces for decoding
    out_at: np.ndarray


def string_hash(s: str) -> int:
    h = 0
    for c in s:
        h = (h * int(BASE) + ord(c) + 1) & (1 << 64) - 1
    return h


def merge(word: str, rank: dict[str, int]) -> tuple[list[str], tuple[str, str] | None]:
    """Plain merging of a short string: the result, and the last merge."""
    parts, last = list(word), None
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: (rank.get(parts[i] + parts[i + 1], 1 << 40), i))
        if parts[best] + parts[best + 1] not in rank:
            break
        last = (parts[best], parts[best + 1])
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts, last


def load(path: str) -> Vocabulary:
    """A vocabulary from a .model file."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    if model.normalizer_spec.remove_extra_whitespaces or len(model.normalizer_spec.precompiled_charsmap):
        raise ValueError("only models without text normalisation are supported")
    kind = model.trainer_spec.model_type
    pieces = [p.piece for p in model.pieces]
    scores = np.array([p.score for p in model.pieces])
    normal = [i for i, p in enumerate(model.pieces) if p.type == 1]
    n = len(pieces)
    hashes = np.array([string_hash(p) for p in pieces], np.uint64)
    left, right, rank = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.full(n, 1 << 40, np.int64)
    usable = normal
    if kind == BPE:
        place = {pieces[i]: r for r, i in enumerate(sorted(normal, key=lambda i: (-scores[i], i)))}
        number = {pieces[i]: i for i in normal}
        usable = []
        for i in normal:
            rank[i] = place[pieces[i]]
            parts, last = merge(pieces[i], place)
            if len(parts) == 1:  # else the piece never comes of merging
                usable.append(i)
                if last:
                    left[i], right[i] = number[last[0]], number[last[1]]
    usable = np.array(usable)
    order = np.argsort(hashes[usable])
    maybe = np.zeros(1 << FILTER, bool)
    maybe[mix(hashes[usable]) & np.uint64((1 << FILTER) - 1)] = True
    byte_ids = np.full(256, -1, np.int64)
    for i, p in enumerate(model.pieces):
        if p.type == 6:
            byte_ids[int(p.piece[3:5], 16)] = i
    raw = [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else b" \xe2\x81\x87 " if p.type == 2 else b"" if p.type == 3 else p.piece.replace(SPACE, " ").encode() for p in model.pieces]
    return Vocabulary(
        kind, pieces, hashes[usable][order], usable[order], maybe, scores, hashes, np.array([len(p) for p in pieces]), int(max(len(pieces[i]) for i in usable)), left, right, rank, byte_ids,
        next((i for i, p in enumerate(model.pieces) if p.type == 2), 0), model.normalizer_spec.add_dummy_prefix, any(SPACE in p.lstrip(SPACE) for p in (pieces[i] for i in usable)),
        np.array(sorted({ord(a) << 32 | ord(b) for i in usable for a, b in zip(pieces[i], pieces[i][1:], strict=False)}), np.uint64), np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]),
    )


def probe(v: Vocabulary, h: np.ndarray) -> np.ndarray:
    """Ids of the pieces with these hashes, -1 for none."""
    out = np.full(h.shape, -1, np.int64)
    some = np.flatnonzero(v.maybe[mix(h) & np.uint64((1 << FILTER) - 1)])
    place = np.minimum(np.searchsorted(v.keys, h.ravel()[some]), len(v.keys) - 1)
    hit = v.keys[place] == h.ravel()[some]
    out.ravel()[some[hit]] = v.ids[place[hit]]
    return out


class Meeting:
    """Whether piece b may follow piece a in a merge result; answers are kept in a table of fixed size."""

    def __init__(self, v: Vocabulary) -> None:
        self.v, self.n = v, len(v.pieces)
        self.power = np.array([pow(int(BASE), int(k), 1 << 64) for k in range(2 * v.longest + 1)], np.uint64)
        self.key, self.answer = np.full(1 << CACHE, -1, np.int64), np.zeros(1 << CACHE, bool)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pair = a * self.n + b
        slot = mix(pair.view(np.uint64)) & np.uint64((1 << CACHE) - 1)
        out = self.answer[slot]
        miss = np.flatnonzero(self.key[slot] != pair)
        if len(miss):
            fresh, first, inverse = np.unique(pair[miss], return_index=True, return_inverse=True)
            found = self.undo(a[miss][first], b[miss][first])
            out[miss] = found[inverse]
            self.key[slot[miss][first]], self.answer[slot[miss][first]] = fresh, found
            same = self.key[slot[miss][first]] == fresh  # a slot that two pairs want holds the last
            self.answer[slot[miss][first][same]] = found[same]
        return out

    def undo(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Takes the pieces apart at the border, latest merge first: at no time may a merge across have come earlier."""
        v, ok = self.v, np.ones(len(a), bool)
        at, a, b = np.arange(len(a)), a.copy(), b.copy()
        limit = np.full(len(a), 1 << 41, np.int64)
        top = np.int64(1 << 42)
        while len(at):
            across = probe(v, v.hashes[a] * self.power[np.minimum(v.lengths[b], len(self.power) - 1)] + v.hashes[b])
            bad = (across >= 0) & (v.rank[np.maximum(across, 0)] < limit)
            ok[at[bad]] = False
            # The border's next state back in time: of both pieces, the one that was made last comes apart. Where both were
            # made by the same merge, the left one was made first.
            made_a, made_b = np.where(v.left[a] >= 0, v.rank[a], -1), np.where(v.left[b] >= 0, v.rank[b], -1)
            go = ~bad & ((made_a >= 0) | (made_b >= 0))
            part_a = made_a > made_b
            # Left of the border a merge across wins a tie against what lies to its right only.
            limit = np.where(part_a, made_a, np.minimum(made_b + 1, top))
            a, b = np.where(part_a, v.right[a], a), np.where(part_a, b, v.left[b])
            at, a, b, limit = at[go], a[go], b[go], limit[go]
        return ok


def cut_long(v: Vocabulary, units: list[str]) -> tuple[list[str], np.ndarray]:
    """(parts of all units, how many each has): long units are cut between characters that are neighbours in no piece."""
    parts: list[str] = []
    times = np.ones(len(units), np.int64)
    for i, unit in enumerate(units):
        if len(unit) <= LONG or not len(v.pairs):
            parts.append(unit)
            continue
        codes = np.frombuffer(unit.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        pair = codes[:-1] << np.uint64(32) | codes[1:]
        cuts = [0, *(np.flatnonzero(v.pairs[np.minimum(np.searchsorted(v.pairs, pair), len(v.pairs) - 1)] != pair) + 1).tolist(), len(unit)]
        parts += [unit[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        times[i] = len(cuts) - 1
    return parts, times


def encode_units(v: Vocabulary, meeting: Meeting, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all units one after the other, where each begins and the end)."""
    sizes = np.array([len(u) for u in units], np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []  # (unit, id) parts, in order within a unit
    order = np.argsort(sizes, kind="stable")
    low = 0
    while low < len(order):
        n = int(sizes[order[low]])
        high = int(np.searchsorted(sizes[order], n, side="right"))
        if n:
            step = max(1, CELLS // (n * min(n, v.longest)))
            for a in range(low, high, step):
                rows = order[a : min(a + step, high)]
                codes = np.frombuffer("".join([units[i] for i in rows]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(rows), n)
                found.append(paths(v, meeting, rows, codes))
        low = high
    if not found:
        return np.empty(0, np.int64), np.zeros(len(units) + 1, np.int64)
    unit, ids = np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])
    by = np.argsort(unit, kind="stable")
    return ids[by], np.searchsorted(unit[by], np.arange(len(units) + 1))


def paths(v: Vocabulary, meeting: Meeting, rows: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best path of each unit, as (unit, id) in order."""
    m, n = codes.shape
    most = min(n, v.longest)
    prefix = np.zeros((m, n + 1), np.uint64)
    for j in range(n):
        prefix[:, j + 1] = prefix[:, j] * BASE + codes[:, j] + np.uint64(1)
    ids = np.full((n, most, m), -1, np.int32)  # the piece that ends behind character j and is k + 1 long
    power = powers(int(BASE), most + 1)
    for k in range(most):
        ids[k:, k] = probe(v, prefix[:, k + 1 :] - prefix[:, : n - k] * power[k + 1]).T
    lone = ids[:, 0] < 0  # characters that are no piece
    value, length, last = np.zeros((n + 1, m)), np.zeros((n, m), np.int64), np.full((n + 1, m), -1, np.int64)
    penalty = v.scores.min() - 10
    every = np.arange(m)
    for j in range(n):
        reach = min(j + 1, most)
        here = ids[j, :reach].astype(np.int64)
        good = here >= 0
        if v.kind == BPE:
            before = last[j + 1 - np.arange(1, reach + 1)]
            ask = np.nonzero(good & (before >= 0))
            good[ask] = meeting.find(before[ask], here[ask])
            worth = np.where(good, np.arange(1, reach + 1)[:, None], 0.0)
            worth[0] = np.maximum(worth[0], 0.5)  # a character that is no piece
        else:
            worth = np.where(good, v.scores[np.maximum(here, 0)] + value[j + 1 - np.arange(1, reach + 1)], -np.inf)
            worth[0] = np.where(lone[j], value[j] + penalty, worth[0])
        best = reach - 1 - worth[::-1].argmax(0)  # of equal values the longest piece
        length[j] = best + 1
        value[j + 1] = worth[best, every]
        last[j + 1] = here[best, every]  # -1 where the character is no piece
    # Back along the pointers, all units together.
    at, out_unit, out_id = np.full(m, n), [], []
    live = every
    while len(live):
        end = at[live] - 1
        out_unit.append(rows[live])
        out_id.append(np.where(last[at[live], live] >= 0, last[at[live], live], -1 - codes[live, end].astype(np.int64)))
        at[live] -= length[end, live]
        live = live[at[live] > 0]
    unit, ids_ = np.concatenate(out_unit[::-1]), np.concatenate(out_id[::-1])
    missing = np.flatnonzero(ids_ < 0)
    if len(missing):
        as_bytes = [v.byte_ids[list(chr(-1 - int(ids_[i])).encode("utf-8", "replace"))] if v.byte_ids[0] >= 0 else np.array([v.unknown]) for i in missing]
        times = np.ones(len(ids_), np.int64)
        times[missing] = [len(x) for x in as_bytes]
        unit, ids_ = np.repeat(unit, times), np.repeat(ids_, times)
        ids_[ids_ < 0] = np.concatenate(as_bytes)
    return unit, ids_


def encode(v: Vocabulary, meeting: Meeting, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, where each begins and the end) of a binary column without nulls."""
    column = pa.compute.replace_substring(column, SPACE.encode(), b" ")
    if v.dummy:
        column = pa.compute.if_else(pa.compute.equal(pa.compute.binary_length(column), 0), column, pa.compute.binary_join_element_wise(pa.scalar(b" ", column.type), column, pa.scalar(b"", column.type)))
    data, offsets = bytes_of(column)
    blank = data == 32
    begins = np.zeros(len(data), bool)
    if not v.crossed:
        begins = blank.copy()
        begins[1:] &= ~blank[:-1]
    begins[offsets[:-1][offsets[:-1] < len(data)]] = True
    start = np.flatnonzero(begins)
    end = np.append(start[1:], len(data))[: len(start)]
    _, first, inverse = np.unique(span_hashes(data, start, end), return_index=True, return_inverse=True)
    whole = data.tobytes()
    units = [whole[a:b].decode("utf-8", "replace").replace(" ", SPACE) for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
    parts, times = cut_long(v, units)
    ids, at = encode_units(v, meeting, parts)
    at = at[np.concatenate([[0], np.cumsum(times)])]
    size = np.diff(at)[inverse]
    sums = np.concatenate([[0], np.cumsum(size)])
    flat = ids[np.arange(sums[-1]) + np.repeat(at[inverse] - sums[:-1], size)]
    return flat, sums[np.searchsorted(start, offsets)]


def decode(v: Vocabulary, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, where each begins and the end) of ids."""
    size = (v.out_at[1:] - v.out_at[:-1])[ids]
    sums = np.concatenate([[0], np.cumsum(size)])
    data = v.out[np.arange(sums[-1]) + np.repeat(v.out_at[:-1][ids] - sums[:-1], size)]
    cuts = sums[at]
    if v.dummy:  # the space before a text goes
        full = cuts[1:] > cuts[:-1]
        first = cuts[:-1][full]
        gone = first[data[first] == 32]
        lost = np.zeros(len(data) + 1, np.int64)
        lost[gone + 1] = 1
        data = np.delete(data, gone)
        cuts = cuts - np.cumsum(lost)[cuts]
    return data, cuts


def with_pieces(docs: DataFrame, path: str, name: str = "pieces", digest: bool = False) -> DataFrame:
    """docs with a column of ids and round_trip, whether decoding gives the text back; digest: instead of the ids n_pieces,
    ids_sha256 (of little-endian 32-bit ids) and n_bytes (how many are byte pieces). Columns of these names are replaced."""
    docs = docs.drop(*(("n_pieces", "ids_sha256", "n_bytes") if digest else (name,)), "round_trip")
    v, names, at = load(path), docs.columns, docs.columns.index("text")
    more = [T.StructField("n_pieces", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("n_bytes", T.LongType()), T.StructField("round_trip", T.BooleanType())] if digest else [T.StructField(name, T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meeting = Meeting(v)
        is_byte = np.zeros(len(v.pieces), bool)
        is_byte[v.byte_ids[v.byte_ids >= 0]] = True
        for part in slices(batches, at, SLICE):
            text = pa.compute.fill_null(part.column(at).cast(pa.binary()), b"")
            ids, cuts = encode(v, meeting, text)
            back, ends = decode(v, ids, cuts)
            whole, source = back.tobytes(), text.to_pylist()
            trip = pa.array([whole[a:b] == s for a, b, s in zip(ends.tolist(), ends.tolist()[1:], source, strict=False)], pa.bool_())
            if not digest:
                new = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids, pa.int32())), trip]
            else:
                small = ids.astype("<i4")
                marks = np.concatenate([[0], np.cumsum(is_byte[ids])])[cuts]
                new = [pa.array(np.diff(cuts)), pa.array([hashlib.sha256(small[a:b]).hexdigest() for a, b in zip(cuts, cuts[1:], strict=False)]), pa.array(np.diff(marks)), trip]
            yield pa.RecordBatch.from_arrays([*part.columns, *new], [*names, *(f.name for f in more)])

    return docs.mapInArrow(steady(run), T.StructType([*docs.schema.fields, *more]))


def decoded(docs: DataFrame, path: str, pieces: str = "pieces", name: str = "text") -> DataFrame:
    """docs with the text of a column of ids; a column of its name is replaced."""
    docs = docs.drop(name)
    v, names, at = load(path), docs.columns, docs.columns.index(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = pa.compute.fill_null(batch.column(at), pa.scalar([], batch.column(at).type))
            size = np.asarray(pa.compute.list_value_length(lists)).astype(np.int64)
            data, cuts = decode(v, np.asarray(lists.flatten()).astype(np.int64), np.concatenate([[0], np.cumsum(size)]))
            whole = data.tobytes()
            text = pa.array([whole[a:b].decode("utf-8", "replace") for a, b in zip(cuts.tolist(), cuts.tolist()[1:], strict=False)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, text], [*names, name])

    return docs.mapInArrow(steady(run), T.StructType([*docs.schema.fields, T.StructField(name, T.StringType())]))


def piece_digests(docs: DataFrame, path: str) -> DataFrame:
    rows = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    return with_pieces(rows, path, digest=True).select(F.col("doc_id"), "n_pieces", "ids_sha256", "n_bytes", "round_trip")
