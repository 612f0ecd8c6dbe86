"""Benchmark decontamination by latent semantic retrieval.

Passages of 2 * BLOCK words (every BLOCK words) of all documents are TF-IDF vectors over the rarer words of the benchmark.
A randomised SVD of that matrix is made in one distributed pass: tasks sum the document frequencies and the product of the
matrix's Gram with a random test matrix, and the driver gets the singular vectors from it (Nystrom's method; the sums have
one row for each benchmark word). In a second pass passages and items are compared by the cosine of their latent vectors.
The latent space serves frequent terms best, so exact candidates stand beside the cosine: whatever holds LCS_SHARE of an
item's words holds j of any (size - needed + j) of them, so surroundings with j of an item's rarest words are compared too,
as are those with its answer. Together they leave out no pair that the check would pass; so MIN_TERMS and the cosine's limit,
which keep the latent search cheap, lose nothing.
Each pair is then checked on words: the longest common subsequence of the item with the passage's surroundings must hold
LCS_SHARE of the item, or PARAPHRASE_SHARE and the item's answer (its last ANSWER words, in a row). has_answer tells of every
pair whether the answer was found; items of fewer than MIN_WORDS words are found where all their words stand in a row.

Items longer than 64 words are looked for in parts of equal length, any of which suffices; the answer is the item's, in
surroundings of its length. A benchmark is worked on in groups of MAX_ITEMS items, so that what the driver and the tasks hold
of it is bounded.

Cases: null or empty texts contain nothing; items without words are not looked for; items of equal text are found each; repeated rows give repeated rows; a null id is kept. Without items or documents there are no
rows. Only doc_id, text and item_id, text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.llm.hashing import Tokens, tokens
from sylvan.llm.util import grouped, slices, steady

BLOCK, RANK, MIN_COSINE = 12, 64, 0.6
LCS_SHARE, PARAPHRASE_SHARE, ANSWER = 0.7, 0.5, 4
MIN_WORDS, MAX_ITEMS, MAX_WORDS = 8, 4096, 64
#: A word of more than this share of the items is too common to be a term, unless an item has few others.
COMMON, FEW = 0.015, 6
#: Rare words that a passage needs.
MIN_TERMS = 3
FILTER = 20
#: Cost of the check of a chance candidate, counted in words looked up.
CHECK = 1000
FOUND = "doc_id long, item_id long, lcs_share double, cosine double, has_answer boolean"


class Items(NamedTuple):
    """Parts of items: their words' numbers, one part after the other; and which words are terms."""

    words: np.ndarray  # sorted hashes of all words
    maybe: np.ndarray
    term: np.ndarray  # number as a term, by word; -1 for common words
    part: list[np.ndarray]
    item_id: np.ndarray  # by part
    item: np.ndarray  # number of the item, by part
    first: np.ndarray  # first part of each item, and the end
    length: np.ndarray  # words of each item
    cell: np.ndarray  # sorted part * (words + 1) + word for all words of all parts
    bits: np.ndarray  # the places where the part has the word, by cell


def number(words: np.ndarray, maybe: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The words' numbers, len(words) for unknown ones."""
    out = np.full(len(h), len(words), np.int64)
    some = np.flatnonzero(maybe[h & np.uint64((1 << FILTER) - 1)])
    place = np.minimum(np.searchsorted(words, h[some]), len(words) - 1)
    hit = words[place] == h[some]
    out[some[hit]] = place[hit]
    return out


def read_items(rows: pa.Table) -> Items | None:
    t = tokens(rows["text"])
    parts, ids, item, length = [], [], [], []
    for i, ident in enumerate(rows["item_id"].to_pylist()):
        h = t.hash[t.first[i] : t.first[i + 1]]
        if len(h):
            cut = np.array_split(h, -(-len(h) // MAX_WORDS))
            parts += cut
            ids += [ident] * len(cut)
            item += [len(length)] * len(cut)
            length.append(len(h))
    if not parts:
        return None
    words = np.unique(np.concatenate(parts))
    maybe = np.zeros(1 << FILTER, bool)
    maybe[words & np.uint64((1 << FILTER) - 1)] = True
    parts = [number(words, maybe, p) for p in parts]
    have = np.bincount(np.concatenate([np.unique(p) for p in parts]), minlength=len(words))
    rare = have <= max(2, COMMON * len(parts))
    for p in parts:  # each part gets its rarest words at least
        own = np.unique(p)
        if rare[own].sum() < FEW:
            rare[own[np.argsort(have[own], kind="stable")[:FEW]]] = True
    term = np.append(np.where(rare, np.cumsum(rare) - 1, -1), -1)
    size = np.array([len(p) for p in parts])
    key = np.repeat(np.arange(len(parts)), size) * (len(words) + 1) + np.concatenate(parts)
    place = np.arange(len(key)) - np.repeat(np.cumsum(size) - size, size)
    cell, at = np.unique(key, return_inverse=True)
    bits = np.zeros(len(cell), np.uint64)
    np.bitwise_or.at(bits, at, np.uint64(1) << place.astype(np.uint64))
    item = np.array(item)
    return Items(words, maybe, term, parts, np.array([x if x is not None else -1 for x in ids], np.int64), item, np.searchsorted(item, np.arange(len(length) + 1)), np.array(length), cell, bits)


class Passages(NamedTuple):
    """Blocks of a column of texts; a passage is a block and the next one of the same text."""

    word: np.ndarray  # number of each word
    t: Tokens
    first: np.ndarray  # first block of each text
    row: np.ndarray  # text of each block
    term: np.ndarray  # of the words that are terms
    block: np.ndarray  # of those

    @property
    def pairs(self) -> np.ndarray:
        return np.flatnonzero(self.row[1:] == self.row[:-1])

    def sums(self, by_term: np.ndarray) -> np.ndarray:
        """Sum of by_term over the terms of each passage."""
        out = np.zeros((len(self.row), by_term.shape[1]), np.float32)
        heads = np.flatnonzero(np.diff(self.block, prepend=-1))
        size = np.diff(np.append(heads, len(self.block)))
        for k in range(int(size.max(initial=0))):  # at most BLOCK times: the k-th term of every block
            at = heads[size > k] + k
            out[self.block[at]] += by_term[self.term[at]]
        both = out.copy()
        both[self.pairs] += out[self.pairs + 1]
        return both


def passages(items: Items, column: pa.Array) -> Passages:
    t = tokens(column)
    word = number(items.words, items.maybe, t.hash)
    n = -(-np.diff(t.first) // BLOCK)
    first = np.concatenate([[0], np.cumsum(n)])
    block = first[t.row] + (np.arange(len(t.row)) - t.first[t.row]) // BLOCK
    term = items.term[word]
    kept = np.flatnonzero(term >= 0)
    return Passages(word, t, first, np.repeat(np.arange(len(n)), n), term[kept], block[kept])


def test_matrix(n: int, k: int) -> np.ndarray:
    return np.random.default_rng(20).standard_normal((n, k)).astype(np.float32)


def gather(docs: DataFrame, items: Items, rank: int, at_once: int = 256) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(passages, document frequency of each term, Gram of the term counts times the test matrix, occurrences of each word) over all documents."""
    n, n_words = int(items.term.max()) + 1, len(items.words)
    words_at_once = -(-n_words // -(-n // at_once))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = test_matrix(n, rank)
        total, count, df, seen = np.zeros((n, rank)), 0, np.zeros(n, np.int64), np.zeros(n_words, np.int64)
        for part in slices(batches, 0):
            p = passages(items, part.column(0))
            count += len(p.row)
            seen += np.bincount(p.word, minlength=n_words + 1)[:n_words]
            if not len(p.term):
                continue
            df += np.bincount(np.unique(p.block * n + p.term) % n, minlength=n)
            y = p.sums(g)
            back = y.copy()  # by block: of the two passages that it belongs to
            back[p.pairs + 1] += y[p.pairs]
            by = np.argsort(p.term, kind="stable")
            ordered = p.term[by]
            heads = np.flatnonzero(np.diff(ordered, prepend=-1))
            total[ordered[heads]] += np.add.reduceat(back[p.block[by]], heads, axis=0)
        for a in range(0, n, at_once):
            b = a // at_once * words_at_once
            yield pa.RecordBatch.from_arrays([pa.array([a], pa.int32()), pa.array([count if a == 0 else 0], pa.int64()), pa.array([df[a : a + at_once].tobytes()], pa.binary()), pa.array([total[a : a + at_once].astype("<f4").tobytes()], pa.binary()), pa.array([seen[b : b + words_at_once].tobytes()], pa.binary())], ["at", "n", "df", "z", "seen"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, rows in grouped(batches, "at"):
            df = sum(np.frombuffer(x.as_buffer(), np.int64) for x in rows["df"])
            z = sum(np.frombuffer(x.as_buffer(), "<f4").astype(np.float64) for x in rows["z"])
            seen = sum(np.frombuffer(x.as_buffer(), np.int64) for x in rows["seen"])
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([int(np.asarray(rows["n"]).sum())], pa.int64()), pa.array([df.tobytes()], pa.binary()), pa.array([z.tobytes()], pa.binary()), pa.array([seen.tobytes()], pa.binary())], ["at", "n", "df", "z", "seen"])

    schema = "at int, n long, df binary, z binary, seen binary"
    whole = docs.select("text").mapInArrow(steady(sums), schema).repartition(-(-n // at_once), "at").sortWithinPartitions("at").mapInArrow(steady(add), schema).orderBy("at").toArrow()
    df, z, seen = np.zeros(n, np.int64), np.zeros((n, rank)), np.zeros(n_words, np.int64)
    for at, d, x, y in zip(whole["at"].to_pylist(), whole["df"], whole["z"], whole["seen"], strict=True):
        b = at // at_once * words_at_once
        seen[b : b + words_at_once] = np.frombuffer(y.as_buffer(), np.int64)
        df[at : at + at_once] = np.frombuffer(d.as_buffer(), np.int64)
        z[at : at + at_once] = np.frombuffer(x.as_buffer(), np.float64).reshape(-1, rank)
    return int(np.asarray(whole["n"]).sum()) if len(whole) else 0, df, z, seen


def projection(n_passages: int, df: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Latent vector of one occurrence of each term.

    With weights w and test matrix g / w, the Gram of the weighted matrix times the test matrix is w * z, whose inner product
    with the test matrix is g' z; from both Nystrom's method gives the singular vectors."""
    k = z.shape[1]
    w = np.log((n_passages + 1) / (df + 1)) ** 2
    inner = test_matrix(len(df), k).T.astype(np.float64) @ z
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    good = values > 1e-9 * max(values.max(), 1e-300)
    if not good.any():  # no term was seen: any orthogonal directions do
        return (test_matrix(len(df), k) / np.sqrt(k)).astype(np.float32)
    left = np.linalg.svd((w[:, None] * z) @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)[0]
    return (w[:, None] * left).astype(np.float32)


def common_subsequence(items: Items, part: np.ndarray, size: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each part with its words [pair, step], by bit-parallel steps."""
    v = np.full(len(part), ~np.uint64(0))
    masks = np.zeros(words.shape, np.uint64)
    pair, step = np.nonzero(words < len(items.words))
    key = part[pair] * (len(items.words) + 1) + words[pair, step]
    place = np.minimum(np.searchsorted(items.cell, key), len(items.cell) - 1)
    hit = items.cell[place] == key
    masks[pair[hit], step[hit]] = items.bits[place[hit]]
    for j in range(words.shape[1]):
        m = masks[:, j]
        u = v & m
        v = (v + u) | (v - u)
    inside = np.where(size >= 64, ~np.uint64(0), (np.uint64(1) << np.minimum(size, 63).astype(np.uint64)) - np.uint64(1))
    return np.bitwise_count(~v & inside).astype(np.int64)


class Exact(NamedTuple):
    """By which words a text must be compared with a part."""

    first: np.ndarray  # parts that ask for word w: part[first[w]:first[w + 1]]
    part: np.ndarray
    least: np.ndarray  # of its words, those that surroundings must hold, by part
    ends: np.ndarray  # whether an answer ends with the word
    answer: np.ndarray  # sorted keys of the answers of items that are long enough for one
    answer_of: np.ndarray  # their items


def answer_keys(words: np.ndarray) -> np.ndarray:
    key = np.zeros(len(words), np.uint64)
    for j in range(words.shape[1]):
        key = key * np.uint64(0x9E3779B97F4A7C15) + words[:, j].astype(np.uint64) + np.uint64(1)
    return key


def exact_index(items: Items, seen: np.ndarray) -> Exact:
    """Of each part the share of its rarest words that costs least: few lookups, but seldom enough of them by chance."""
    rate = seen / max(1, seen.sum())
    asks, least = [], np.empty(len(items.part), np.int64)
    for k, p in enumerate(items.part):
        needed = len(p) if items.length[items.item[k]] < MIN_WORDS else int(np.ceil(LCS_SHARE * len(p)))
        order = np.argsort(seen[p], kind="stable")
        ordered = p[order]
        new = np.zeros(len(p), bool)
        new[np.unique(ordered, return_index=True)[1]] = True
        sums = np.cumsum(np.where(new, rate[ordered], 0))[len(p) - needed :]  # for j = 1, 2, ..., needed
        mean = sums * 2 * (BLOCK + len(p))
        j = np.arange(needed)
        # Chance that a word has j others about it, as for independent words.
        below = np.exp(-mean)[:, None] * np.cumprod(np.where(j > 0, mean[:, None] / np.maximum(j, 1), 1), 1)
        chance = np.maximum(0, 1 - np.where(j < j[:, None], below, 0).sum(1))
        best = int(np.argmin(sums * (1 + CHECK * chance)))
        least[k] = best + 1
        asks.append(np.unique(ordered[: len(p) - needed + best + 1]))
    word, part = np.concatenate(asks), np.repeat(np.arange(len(asks)), [len(x) for x in asks])
    order = np.argsort(word, kind="stable")
    ends = np.zeros(len(items.words) + 1, bool)
    able = np.flatnonzero(items.length >= MIN_WORDS)
    tails = np.array([np.concatenate(items.part[items.first[k] : items.first[k + 1]][-2:])[-ANSWER:] for k in able], np.int64).reshape(-1, ANSWER)
    ends[tails[:, -1]] = True
    keys = answer_keys(tails)
    by = np.argsort(keys, kind="stable")
    return Exact(np.searchsorted(word[order], np.arange(len(items.words) + 2)), part[order], least, ends, keys[by], able[by])


def ragged(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(k, place) for all places first[k], ..., first[k] + size[k] - 1."""
    k = np.repeat(np.arange(len(size)), size)
    return k, first[k] + np.arange(len(k)) - (np.cumsum(size) - size)[k]


def answers_in(exact: Exact, p: Passages) -> tuple[np.ndarray, np.ndarray]:
    """(item, place of its last word) of all answers."""
    tail = np.flatnonzero(exact.ends[p.word])
    tail = tail[tail - p.t.first[p.t.row[tail]] >= ANSWER - 1]
    keys = answer_keys(p.word[tail[:, None] + np.arange(1 - ANSWER, 1)])
    a, b = np.searchsorted(exact.answer, keys), np.searchsorted(exact.answer, keys, side="right")
    k, place = ragged(a, b - a)
    return exact.answer_of[place], tail[k]


def exact_candidates(items: Items, exact: Exact, p: Passages, answers: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(block, part): all whose surroundings hold enough of the part's rarest words, or its item's answer."""
    sizes = np.array([len(x) for x in items.part])
    asked = np.flatnonzero(exact.first[p.word + 1] > exact.first[p.word])
    k, place = ragged(exact.first[p.word[asked]], np.diff(exact.first)[p.word[asked]])
    part, low = exact.part[place], asked[k]
    order = np.lexsort((low, part))
    part, low = part[order], low[order]
    last = np.arange(len(part)) + exact.least[part] - 1
    at = np.flatnonzero(last < len(part))
    last = last[at]
    good = (part[last] == part[at]) & (p.t.row[low[last]] == p.t.row[low[at]]) & (low[last] - low[at] < 2 * (BLOCK + sizes[part[at]]))
    part, begin, end = part[at[good]], low[at[good]], low[last[good]]
    reach = sizes[part]
    item, last = answers
    k, place = ragged(items.first[item], items.first[item + 1] - items.first[item])
    part, reach = np.concatenate([part, place]), np.concatenate([reach, items.length[item[k]]])
    begin, end = np.concatenate([begin, last[k] - ANSWER + 1]), np.concatenate([end, last[k]])
    # Blocks whose surroundings hold the words from begin to end.
    row = p.t.row[begin]
    start = p.t.first[row]
    a = np.maximum(0, -((2 * BLOCK + reach + start - end - 1) // BLOCK))
    b = np.minimum(p.first[row + 1] - p.first[row] - 1, (begin + reach - start) // BLOCK)
    k, block = ragged(p.first[row] + a, np.maximum(0, b - a + 1))
    key = np.unique(block * len(sizes) + part[k])
    return key // len(sizes), key % len(sizes)


def cosine_of(vectors: np.ndarray, norm: np.ndarray, latent: np.ndarray, owner: np.ndarray, block: np.ndarray, part: np.ndarray) -> np.ndarray:
    """The greatest cosine of each block with a window of its part; 0 where there is none."""
    first, end = np.searchsorted(owner, part), np.searchsorted(owner, part, side="right")
    k, place = ragged(first, end - first)
    out = np.where((end > first) & (norm[block] > 0), -1, 0).astype(np.float32)
    np.maximum.at(out, k, (vectors[block[k]] * latent[place]).sum(1) / np.where(norm[block[k]] > 0, norm[block[k]], 1))
    return out


def search(items: Items, by_term: np.ndarray, latent: np.ndarray, owner: np.ndarray, exact: Exact, column: pa.Array, min_cosine: float) -> tuple[np.ndarray, ...]:
    """(row, part, common words, cosine, has answer) of the pairs that pass."""
    p = passages(items, column)
    none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, bool))
    count = np.bincount(p.block, minlength=len(p.row))
    count[p.pairs] += count[p.pairs + 1]
    vectors = p.sums(by_term)
    norm = np.linalg.norm(vectors, axis=1)
    some = np.flatnonzero((count >= MIN_TERMS) & (norm > 0))
    # A passage that holds a whole short part has other words too, and so a lesser cosine.
    limit = (min_cosine * np.minimum(1, np.array([len(x) for x in items.part]) / (2 * BLOCK)))[owner].astype(np.float32)
    answers = answers_in(exact, p)
    more = exact_candidates(items, exact, p, answers)
    blocks, parts, cosines = [more[0]], [more[1]], [np.full(len(more[0]), -2, np.float32)]
    for a in range(0, len(some), 4096):
        at = some[a : a + 4096]
        cosine = (vectors[at] / norm[at, None]) @ latent.T
        i, j = np.nonzero(cosine >= limit)
        blocks.append(at[i])
        parts.append(owner[j])
        cosines.append(cosine[i, j])
    if not sum(map(len, blocks)):
        return none
    block, part, cosine = np.concatenate(blocks), np.concatenate(parts), np.concatenate(cosines)
    # One check for each passage and part.
    order = np.lexsort((-cosine, part, block))
    block, part, cosine = block[order], part[order], cosine[order]
    new = np.ones(len(block), bool)
    new[1:] = (block[1:] != block[:-1]) | (part[1:] != part[:-1])
    block, part, cosine = block[new], part[new], cosine[new]
    sizes = np.array([len(x) for x in items.part])
    size = sizes[part]
    row = p.row[block]
    low, end = p.t.first[row], p.t.first[row + 1]
    start = low + (block - p.first[row]) * BLOCK
    word = np.append(p.word, len(items.words))
    lcs, in_a_row = np.empty(len(block), np.int64), np.zeros(len(block), bool)
    short = items.length[items.item[part]] < MIN_WORDS
    for a in range(0, len(block), 1 << 13):
        at = slice(a, a + (1 << 13))
        reach = size[at].max()
        place = start[at, None] - reach + np.arange(2 * BLOCK + 2 * reach)
        inside = (place >= np.maximum(low[at], start[at] - size[at])[:, None]) & (place < np.minimum(end[at], start[at] + 2 * BLOCK + size[at])[:, None])
        words = word[np.where(inside, place, len(word) - 1)]
        lcs[at] = common_subsequence(items, part[at], size[at], words)
        for i in np.flatnonzero(short[at] & (lcs[at] == size[at])):
            own = items.part[part[a + i]]
            in_a_row[a + i] = (np.lib.stride_tricks.sliding_window_view(words[i], len(own)) == own).all(1).any()
    # Whether the item's answer lies in surroundings of the item's length.
    length = items.length[items.item[part]]
    key = np.sort(answers[0] * (len(word) + 1) + answers[1])
    first = np.maximum(low, start - length) + ANSWER - 1
    found = np.append(key, np.iinfo(np.int64).max)[np.searchsorted(key, items.item[part] * (len(word) + 1) + first)]
    answer = in_a_row | (found < items.item[part] * (len(word) + 1) + np.minimum(end, start + 2 * BLOCK + length))
    good = np.where(short, in_a_row, (lcs >= LCS_SHARE * size) | (answer & (lcs >= PARAPHRASE_SHARE * size)))
    row, part, block, lcs, cosine, answer = row[good], part[good], block[good], lcs[good], cosine[good], answer[good]
    new = np.flatnonzero(cosine == -2)
    cosine[new] = cosine_of(vectors, norm, latent, owner, block[new], part[new])
    return row, part, lcs, cosine, answer


def item_windows(items: Items, by_term: np.ndarray, step: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(unit latent vectors of the windows of all parts, their parts)."""
    vectors, owner = [], []
    for k, p in enumerate(items.part):
        for a in range(0, max(1, len(p) - 2 * BLOCK + step), step):
            term = items.term[p[a : a + 2 * BLOCK]]
            vectors.append(by_term[term[term >= 0]].sum(0))
            owner.append(k)
    matrix = np.array(vectors, np.float32)
    norm = np.linalg.norm(matrix, axis=1)
    return matrix[norm > 0] / norm[norm > 0, None], np.array(owner)[norm > 0]


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, rank: int = RANK, min_cosine: float = MIN_COSINE) -> DataFrame:
    """FOUND: a row for each document row and item that it holds."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).cast("binary").alias("text"))
    out = spark.createDataFrame([], FOUND)
    for k, index in enumerate(indexes(rows, benchmark, rank)):
        out = found_by(rows, index, min_cosine) if k == 0 else out.union(found_by(rows, index, min_cosine))
    return out


def uncontaminated(docs: DataFrame, benchmark: DataFrame, rank: int = RANK, min_cosine: float = MIN_COSINE) -> DataFrame:
    """The rows of docs that hold no item, with all their columns."""
    for index in indexes(docs.select(F.coalesce(docs["text"], F.lit("")).cast("binary").alias("text")), benchmark, rank):
        docs = kept_by(docs, index, min_cosine)
    return docs


class Index(NamedTuple):
    items: Items
    by_term: np.ndarray
    latent: np.ndarray
    owner: np.ndarray
    exact: Exact


def indexes(rows: DataFrame, benchmark: DataFrame, rank: int) -> Iterator[Index]:
    """One for each group of items."""
    asked = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].cast("binary").alias("text")).filter("text is not null")
    groups = -(-asked.count() // MAX_ITEMS)
    for group in range(groups):
        items = read_items(asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == group).toArrow())
        if items is not None:
            *sums, seen = gather(rows, items, rank)
            by_term = projection(*sums)
            yield Index(items, by_term, *item_windows(items, by_term), exact_index(items, seen))


def found_by(rows: DataFrame, index: Index, min_cosine: float) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            row, part, lcs, cosine, answer = search(*index, batch.column(1), min_cosine)
            ids, size = index.items.item_id[part], np.array([len(x) for x in index.items.part])[part]
            share = lcs / np.maximum(size, 1)
            by = np.lexsort((-cosine, -share, ids, row))
            new = np.ones(len(by), bool)
            new[1:] = (row[by][1:] != row[by][:-1]) | (ids[by][1:] != ids[by][:-1])
            best = by[new]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[best])), pa.array(ids[best]), pa.array(share[best]), pa.array(cosine[best].astype(np.float64)), pa.array(answer[best])], [x.split()[0] for x in FOUND.split(", ")])

    return rows.mapInArrow(steady(find), FOUND)


def kept_by(docs: DataFrame, index: Index, min_cosine: float) -> DataFrame:
    names, at = docs.columns, docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            stays = np.ones(batch.num_rows, bool)
            stays[search(*index, pa.compute.fill_null(batch.column(at).cast(pa.binary()), b""), min_cosine)[0]] = False
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(stays)) for c in batch.columns], names)

    return docs.mapInArrow(steady(keep), docs.schema)
