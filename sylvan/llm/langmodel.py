"""Language-model scores by deleted interpolation.

Maximum-likelihood estimates of a bigram, a unigram and a uniform model are mixed. The weights depend on how often the
context was seen (buckets of powers of two of its count) and are learned by expectation-maximisation on held-out counts:
each block of training texts in turn is held out, and its tokens are estimated from the counts of all other blocks.

Counts are looked up block by block (see exchange), so neither the vocabulary nor the bigrams are ever in one place. For
the weights each block gives, for cells of half an octave of either estimate, how many of its tokens fall into the cell and
the sums of their exact estimates. The number of cells is fixed by the grid, whatever the size of the corpus.

Cases: with one training text there is nothing to hold out and the weights fall to the uniform estimate; a null or empty text has one token, its end; a null id is not held out; repeated rows count as often as they come;
with no training text every estimate is uniform; no rows give no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.llm.blocks import store_blocks
from sylvan.llm.exchange import group_sums, look_up_blocks, with_answers
from sylvan.llm.hashing import chain, mix, tokens
from sylvan.llm.toxicity import held_out
from sylvan.llm.util import stored

#: Hash of the token that ends a text, and of the context before its first token.
END, START = (int(x) for x in mix(np.array([1, 2], np.uint64)))
#: Keys of bigrams have the lowest bit set, those of single tokens have not.
ONE = np.uint64(1)
BUCKETS = 24
#: Text of one block; a worker holds about forty times as much.
BLOCK_BYTES = 6 << 20
#: Texts are dealt to so many blocks at least, so that there are others where one is held out.
MIN_BLOCKS = 8


def sequence(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, context, row) of all tokens, each text's end included."""
    t = tokens(column)
    rows = len(t.first) - 1
    row = np.repeat(np.arange(rows), np.diff(t.first) + 1)
    token = np.full(len(row), END, np.uint64)
    token[np.arange(len(t.hash)) + t.row] = t.hash
    context = np.full(len(row), START, np.uint64)
    context[1:] = token[:-1]
    context[t.first[:-1] + np.arange(rows)] = START
    return token, context, row


def keys_of(token: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the tokens alone and with their context."""
    return token & ~ONE, chain(context, token) | ONE


def weighted(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of a block, the place of each token and bigram among them, row and whether it is training text."""
    token, context, row = sequence(rows["text"])
    one, two = keys_of(token, context)
    learn = ~np.asarray(rows["held_out"])[row]
    keys, place = np.unique(np.concatenate([one, two]), return_inverse=True)
    return keys, place[: len(one)], place[len(one) :], row, learn


def emit(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys, one, two, _, learn = weighted(rows)
    return keys, np.bincount(np.concatenate([one[learn], two[learn]]), minlength=len(keys))


def totals(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """The sum of each key over all blocks; and of the tokens alone, how many were seen, how often, and the ends."""
    order, group, sums = group_sums(keys, counts)
    out = np.empty(len(keys), np.uint64)
    out[order] = sums[group]
    heads = keys[order][np.flatnonzero(np.diff(group, prepend=-1))]
    alone = (heads & ONE) == 0
    return out, [int((alone & (sums > 0)).sum()), int(sums[alone].sum()), int(sums[heads == np.uint64(END) & ~ONE].sum())]


def context_counts(c1: np.ndarray, row: np.ndarray, starts: int) -> np.ndarray:
    """How often each token's context was seen in training: that of the token before, of texts for the first."""
    out = np.empty(len(c1), np.float64)
    out[1:] = c1[:-1]
    first = np.ones(len(row), bool)
    first[1:] = row[1:] != row[:-1]
    out[first] = starts
    return out


def bucket(c: np.ndarray) -> np.ndarray:
    """0 for an unseen context, then by powers of two."""
    return np.minimum(np.where(c > 0, np.log2(np.maximum(c, 1)).astype(int) + 1, 0), BUCKETS - 1)


#: Half-octaves of a probability that have a cell of their own; smaller ones share the last.
OCTAVES = 128


def half_octave(p: np.ndarray) -> np.ndarray:
    """Cells of probabilities: 0 for 0, else half-octaves below 1."""
    return np.where(p > 0, np.minimum(np.floor(-2 * np.log2(np.maximum(p, 1e-300))), OCTAVES - 2) + 1, 0).astype(np.int64)


def expectation(at: np.ndarray, n: np.ndarray, p1: np.ndarray, p2: np.ndarray, uniform: float, rounds: int = 60) -> np.ndarray:
    """Weights (bucket of the context, [uniform, unigram, bigram]) from cells: their bucket, tokens, and sums of estimates."""
    weights = np.tile([0.05, 0.35, 0.6], (BUCKETS, 1))
    weights[0] = [0.1, 0.9, 0.0]  # an unseen context has no bigram estimate
    if not len(n):
        return np.tile([1.0, 0.0, 0.0], (BUCKETS, 1))
    p = np.stack([np.full(len(n), uniform), p1 / n, p2 / n], 1)
    for _ in range(rounds):
        share = weights[at] * p
        share *= (n / np.maximum(share.sum(1), 1e-300))[:, None]
        new = np.stack([np.bincount(at, share[:, k], BUCKETS) for k in range(3)], 1) + [0.5, 0.25, 0]  # never without the uniform part
        weights = np.where(np.arange(BUCKETS)[:, None] == 0, np.append(new[:, :2] / new[:, :2].sum(1, keepdims=True), np.zeros((BUCKETS, 1)), 1), new / new.sum(1, keepdims=True))
    return weights


def language_model(spark: SparkSession, docs: DataFrame, mod: int = 7, rest: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) for each document."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).cast("binary").alias("text"))
    rows = rows.withColumn("held_out", held_out(F.col("doc_id"), mod, rest))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    manifest = store_blocks(spark, rows, 1, min(BLOCK_BYTES, max(1, total // MIN_BLOCKS)))
    n = max(1, manifest.count())
    answers = stored(spark, look_up_blocks(manifest, emit, totals, n), "counts")
    vocabulary, n_train, starts = (int(x or 0) for x in answers.agg(*(F.sum(F.element_at("stats", k)) for k in (1, 2, 3))).first())
    uniform = 1 / (vocabulary + 1)

    def gather(table: pa.Table, found: np.ndarray) -> pa.Table:
        """The block's training tokens, estimated without the block, by cells."""
        _, one, two, row, learn = weighted(table)
        others = found.astype(np.int64) - np.bincount(np.concatenate([one[learn], two[learn]]), minlength=len(found))
        c1, c2 = others[one], others[two]
        ch = context_counts(c1, row, starts - int((~np.asarray(table["held_out"])).sum()))
        p1, p2 = c1 / max(1, n_train - int(learn.sum())), np.where(ch > 0, c2 / np.maximum(ch, 1), 0)
        ch, p1, p2 = ch[learn], p1[learn], p2[learn]
        key = (bucket(ch) * OCTAVES + half_octave(p1)) * OCTAVES + half_octave(p2)
        n_tokens, *sums = (np.bincount(key, x, BUCKETS * OCTAVES * OCTAVES) for x in (None, p1, p2))
        cells = np.flatnonzero(n_tokens)
        return pa.table({"bucket": cells // OCTAVES**2, "q1": cells // OCTAVES % OCTAVES, "q2": cells % OCTAVES, "n": n_tokens[cells].astype(np.int64), "p1": sums[0][cells], "p2": sums[1][cells]})

    cells = with_answers(manifest, answers, gather, "bucket long, q1 long, q2 long, n long, p1 double, p2 double", n).groupBy("bucket", "q1", "q2").agg(*(F.sum(k).alias(k) for k in ("n", "p1", "p2")))
    found = cells.toPandas().sort_values(["bucket", "q1", "q2"])
    weights = expectation(*(found[k].to_numpy() for k in ("bucket", "n", "p1", "p2")), uniform)

    def finish(table: pa.Table, found: np.ndarray) -> pa.Table:
        _, one, two, row, _ = weighted(table)
        counts = found.astype(np.float64)
        c1, c2 = counts[one], counts[two]
        ch = context_counts(c1, row, starts)
        w = weights[bucket(ch)]
        p = w[:, 0] * uniform + w[:, 1] * (c1 / max(1, n_train)) + w[:, 2] * (c2 / np.maximum(ch, 1))
        k = table.num_rows
        size = np.bincount(row, minlength=k)
        score = np.bincount(row, np.log10(p), k)
        return pa.table(
            {
                "doc_id": table["doc_id"], "held_out": table["held_out"], "n_tokens": size.astype(np.int64), "n_known": np.bincount(row, c1 > 0, k).astype(np.int64), "train_tokens": np.full(k, n_train, np.int64),
                "base_score": np.bincount(row, np.log10((c1 + 1) / (n_train + vocabulary + 1)), k), "score": score, "perplexity": 10 ** np.minimum(-score / size, 300),
            }
        )

    return with_answers(manifest, answers, finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double", n)
