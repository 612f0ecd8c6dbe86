"""Toxicity scores by non-negative positive-unlabelled learning.

Positives are rows that are labelled toxic; the unlabelled set is drawn from the rows of the labels table that may be
learnt from, and their labels are not looked at. A linear model on the presence of words and word beginnings is fitted in numpy to the risk
``p * E_P[loss(g)] + max(0, E_U[loss(-g)] - p * E_P[loss(-g)])`` with class prior p; where the second part turns negative,
the step goes up its gradient instead.

Bounds: the classifier is fitted on a sample of the labelled rows, at most MAX_POSITIVE and MAX_UNLABELLED, those of the
smallest hashed id; all rows are scored.

Cases: a null or empty text gets the score of no evidence; several labels of one document count as toxic if one is; a null
id is scored, not learnt from; repeated rows are scored each; without a single positive all scores are 0. Only the named
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylvan.llm.hashing import ALNUM, span_hashes, tokens
from sylvan.llm.util import slices, steady

MAX_POSITIVE, MAX_UNLABELLED = 4_000, 8_000
#: Bytes of the word beginnings that are features beside whole words.
PREFIXES = (4, 5, 6, 7)
MAX_FEATURES, MIN_POSITIVE = 8_192, 4
FILTER_BITS = 20


class Model(NamedTuple):
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float


def evidence(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Feature hashes and their rows: first of whole words, then of word beginnings of each length."""
    t = tokens(column, ALNUM)
    yield t.hash, t.row
    for k in PREFIXES:
        long = np.flatnonzero(t.end - t.start > k)
        yield span_hashes(t.data, t.start[long], t.start[long] + k) ^ np.uint64(k), t.row[long]


def distinct(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Each feature once for each row that has it."""
    hashes, rows = (np.concatenate(x) for x in zip(*evidence(column), strict=True))
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(rows), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    return hashes[new], rows[new]


def design(column: pa.Array, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature number) of the features that are in each row."""
    rows, cols = [], []
    for at in range(0, len(column), 500):
        h, r = distinct(column[at : at + 500])
        place = np.minimum(np.searchsorted(features, h), len(features) - 1)
        hit = features[place] == h
        rows.append(r[hit] + at)
        cols.append(place[hit])
    return np.concatenate(rows), np.concatenate(cols)


def select(positive: pa.Array, unlabelled: pa.Array) -> np.ndarray:
    """The features whose share of the positives differs most from that of the unlabelled, by a z score."""
    counts = []
    for column in (positive, unlabelled):
        h = np.concatenate([distinct(column[at : at + 500])[0] for at in range(0, len(column), 500)] or [np.empty(0, np.uint64)])
        counts.append(np.unique(h, return_counts=True))
    (keys, p), (others, u) = counts
    keep = p >= MIN_POSITIVE
    keys, p = keys[keep], p[keep].astype(float)
    place = np.minimum(np.searchsorted(others, keys), max(0, len(others) - 1))
    u = np.where(others[place] == keys, u[place], 0).astype(float) if len(others) else np.zeros(len(keys))
    n, m = len(positive), max(1, len(unlabelled))
    share = (p + u + 1) / (n + m + 2)
    z = (p / n - u / m) / np.sqrt(share * (1 - share) * (1 / n + 1 / m))
    return np.sort(keys[np.argsort(-np.abs(z), kind="stable")[:MAX_FEATURES]])


def fit(positive: pa.Array, unlabelled: pa.Array, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-3) -> Model:
    features = select(positive, unlabelled)
    if not len(features) or not len(unlabelled):
        return Model(np.zeros(1, np.uint64), np.zeros(1), float(np.log(prior / (1 - prior))))
    n, m, k = len(positive), len(unlabelled), len(features)
    rows, cols = design(positive, features)
    more, more_cols = design(unlabelled, features)
    rows, cols = np.concatenate([rows, more + n]), np.concatenate([cols, more_cols])
    is_p = np.arange(n + m) < n
    w, first, second = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1)
    w[k] = np.log(prior / (1 - prior))
    for step in range(1, steps + 1):
        g = np.bincount(rows, w[cols], n + m) + w[k]
        s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
        loss_neg = np.logaddexp(0, g)
        negative = loss_neg[n:].mean() - prior * loss_neg[:n].mean()
        # Derivatives by g: of loss(g) on positives, and of the negative part.
        up = np.where(is_p, -prior * s / n, s / m)
        slope = np.where(is_p, prior * (s - 1) / n, 0) + up if negative >= 0 else -up
        grad = np.append(np.bincount(cols, slope[rows], k), slope.sum()) + decay * np.append(w[:k], 0) * prior
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Model(features, w[:k], float(w[k]))


def scores(model: Model, column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Of each text, 0 to 1."""
    mask = np.uint64((1 << FILTER_BITS) - 1)
    maybe = np.zeros(1 << FILTER_BITS, bool)
    maybe[model.features & mask] = True
    rows, cols = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for h, r in evidence(column):
        some = np.flatnonzero(maybe[h & mask])
        place = np.minimum(np.searchsorted(model.features, h[some]), len(model.features) - 1)
        hit = model.features[place] == h[some]
        rows.append(r[some][hit])
        cols.append(place[hit])
    k = len(model.features)
    pairs = np.unique(np.concatenate(rows) * k + np.concatenate(cols))
    g = np.bincount(pairs // k, model.weights[pairs % k], len(column)) + model.bias
    return 1 / (1 + np.exp(-np.clip(g, -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, may_learn: F.Column, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model | None:
    """may_learn: a condition on doc_id that holds for the rows to learn from. None if no positive is known."""
    known = labels.select(labels["doc_id"].alias("doc_id"), labels["toxic"].alias("toxic")).filter(may_learn & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    if not prior:
        return None
    texts = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text")).filter(may_learn)
    by = F.xxhash64("doc_id")
    parts = []
    for kind, (ids, most) in enumerate(((known.filter("toxic = 1").select("doc_id"), max_positive), (known.select("doc_id"), max_unlabelled))):
        chosen = ids.orderBy(by, "doc_id").limit(most)  # at most `most` rows, so small enough to broadcast
        rows = texts.join(F.broadcast(chosen), "doc_id").orderBy(by, "doc_id", "text").limit(most)
        parts.append(rows.select(F.lit(kind).alias("kind"), F.coalesce("text", F.lit("")).cast("binary").alias("text")))
    return fitted(parts[0].union(parts[1]), min(max(prior, 1e-4), 1 - 1e-4))


def fitted(rows: DataFrame, prior: float) -> Model | None:
    """fit on the rows of kind 0 and 1, in one task: the texts and their features never reach the driver, the model does."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[pa.Array]] = [[], []]
        for batch in batches:
            for kind, part in enumerate(parts):
                part.append(batch.column("text").filter(pa.compute.equal(batch.column("kind"), kind)))
        positive, unlabelled = (pa.concat_arrays([pa.array([], pa.binary()), *part]) for part in parts)
        if len(positive):
            m = fit(positive, unlabelled, prior)
            yield pa.RecordBatch.from_arrays([pa.array([m.features.tobytes()]), pa.array([m.weights.tobytes()]), pa.array([m.bias])], ["features", "weights", "bias"])

    row = rows.coalesce(1).mapInArrow(steady(work), "features binary, weights binary, bias double").first()
    return row and Model(np.frombuffer(row["features"], np.uint64), np.frombuffer(row["weights"], np.float64), row["bias"])


def score(docs: DataFrame, model: Model | None, name: str = "score") -> DataFrame:
    """Adds a column of that name to docs, which keep their columns; one of that name is replaced."""
    docs = docs.drop(name)
    if model is None:
        return docs.withColumn(name, F.lit(0.0))
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, at):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores(model, part.column(at).cast(pa.binary())))], [*names, name])

    return docs.mapInArrow(steady(run), schema)


def held_out(ident: F.Column, mod: int, rest: int) -> F.Column:
    """crc32 of the id as text, by its remainder; false for a null id."""
    return F.coalesce(F.crc32(ident.cast("string")) % mod == rest, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each document; learns from rows that are not held out."""
    model = learn(docs, labels, ~held_out(F.col("doc_id"), 3, 1) & F.col("doc_id").isNotNull())
    rows = score(docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text")), model)
    return rows.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
