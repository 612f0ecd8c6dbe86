"""Approximate nearest neighbours on robust-pruned directed graphs.

The vectors are dealt to shards, whose size grows with the table. In each shard a graph is grown: greedy searches from the medoid
propose neighbours for a point, and a candidate is kept only if no kept neighbour is nearer to it by the factor ALPHA
(relaxed pruning keeps diverse edges). Vectors that single precision hardly tells apart are one point of the graph. Queries
run a beam search in every shard, block by block; every vector of the points found is scored in double precision, and where
more than k + 1 are the best within the rounding of single precision, all vectors of the shard are. The best are scored
again in extended precision, so that vectors of one direction tie and the lesser vec_id goes first. Every row is indexed;
equal vectors are one node that carries its k + 1 least ids, which is all that ties can need.

Cases: vectors that are null, empty, zero or hold null or non-finite components take no part, neither do null ids; vectors
of other lengths are no candidates of a query; repeated rows count once; fewer candidates than k are all returned; no
rows give no rows. Only vec_id and embedding are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sylvan.llm.util import steady, stored

#: Vectors of a shard at least and at most; between them a table has SHARDS shards, so that a query asks no more of a larger table.
SHARD, SHARD_MOST, SHARDS = 4096, 32768, 24
#: BEAM is that of a shard of SHARD vectors; each doubling adds MORE.
DEGREE, BUILD_BEAM, BEAM, MORE, ALPHA = 32, 64, 112, 48, 1.25
#: Points that one step of a search opens.
WIDE = 4
#: Queries that are searched at once.
BLOCK = 256


def beam_search(points: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The `width` nearest points found for each query and their squared distances; -1 and inf where fewer. A step opens the WIDE
    nearest points that are not open yet."""
    n, q = len(points), len(queries)
    most = max(width, WIDE)
    ids = np.full((q, most), n, np.int32)
    far = np.full((q, most), np.inf, np.float32)
    open_ = np.zeros((q, most), bool)
    # Marks of the points seen: of a point that several neighbours propose in one step, the place whose mark stays is the one that counts.
    seen = np.zeros((q, n + 1), np.uint8)
    seen[:, n] = 255  # where a point has fewer neighbours
    ids[:, 0], far[:, 0], open_[:, 0], seen[:, entry] = entry, 2 - 2 * (queries @ points[entry]), True, 255
    mark = (np.arange(WIDE * graph.shape[1]) % 254 + 1).astype(np.uint8)  # WIDE * degree is at most 254, so marks differ
    live = np.arange(q)
    while len(live):
        left = np.where(open_[live], far[live], np.inf)
        best = np.argpartition(left, WIDE - 1, 1)[:, :WIDE]
        going = np.take_along_axis(left, best, 1) < np.inf
        some = going.any(1)
        live, best, going = live[some], best[some], going[some]
        if not len(live):
            break
        row = live[:, None]
        open_[row, best] = False
        near = np.where(going[:, :, None], graph[np.minimum(ids[row, best], n - 1)], n).reshape(len(live), -1)
        new = seen[row, near] == 0
        seen[row, near] = np.where(new, mark, 255)
        new &= seen[row, near] == mark
        seen[row, near] = 255
        dist = np.where(new, 2 - 2 * np.matmul(points[np.minimum(near, n - 1)], queries[live][:, :, None])[:, :, 0], np.inf)
        every = np.concatenate([far[live], dist], 1)
        keep = np.argpartition(every, most - 1, 1)[:, :most]
        far[live] = np.take_along_axis(every, keep, 1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], near], 1), keep, 1)
        open_[live] = np.take_along_axis(np.concatenate([open_[live], new], 1), keep, 1) & np.isfinite(far[live])
    order = np.argsort(far, 1, kind="stable")[:, :width]
    far = np.take_along_axis(far, order, 1)
    return np.where(np.isfinite(far), np.take_along_axis(ids, order, 1), -1).astype(np.int64), far


def robust_prune(points: np.ndarray, own: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Of each row's candidates (-1: none) the neighbours to keep; filled up with len(points)."""
    n = len(points)
    candidates = np.where(candidates == own[:, None], -1, candidates)
    vectors = points[np.maximum(candidates, 0)]
    dist = np.where(candidates >= 0, 2 - 2 * np.einsum("bcd,bd->bc", vectors, points[own]), np.inf)
    order = np.argsort(dist, 1, kind="stable")
    candidates, dist = np.take_along_axis(candidates, order, 1), np.take_along_axis(dist, order, 1)
    # A point that is proposed twice counts once.
    by = np.argsort(candidates, 1, kind="stable")
    ordered = np.take_along_axis(candidates, by, 1)
    again = np.zeros(ordered.shape, bool)
    again[:, 1:] = ordered[:, 1:] == ordered[:, :-1]
    np.put_along_axis(dist, by, np.where(again, np.inf, np.take_along_axis(dist, by, 1)), 1)
    vectors = points[np.maximum(candidates, 0)]
    between = 2 - 2 * np.matmul(vectors, vectors.transpose(0, 2, 1))
    alive = np.isfinite(dist)
    kept = np.full((len(own), degree), n, np.int64)
    rows = np.arange(len(own))
    for k in range(degree):
        any_ = alive.any(1)
        if not any_.any():
            break
        pick = np.where(alive, dist, np.inf).argmin(1)
        kept[any_, k] = candidates[rows, pick][any_]
        alive &= alpha * between[rows, pick] > dist
        alive[rows, pick] = False
    return kept


def build(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 7) -> tuple[np.ndarray, int]:
    """(neighbours of each point, entry point) for unit vectors. Missing neighbours are len(points)."""
    n = len(points)
    rng = np.random.default_rng(seed)
    entry = int((points @ points.mean(0)).argmax())
    graph = np.full((n, degree), n, np.int64)
    if n <= degree + 1:
        for i in range(n):
            graph[i, : n - 1] = np.delete(np.arange(n), i)
        return graph, entry
    order = rng.permutation(n)
    first = order[: degree + 1]
    for i in first:
        graph[i, :degree] = first[first != i]
    if entry not in first:  # the entry is linked from the start
        order = np.concatenate([first, [entry], np.setdiff1d(order[degree + 1 :], [entry], assume_unique=True)])
        graph[entry, :degree] = first[:degree]
    at, step = degree + 1, 32
    passes = [order, rng.permutation(n)]
    for turn, points_of in enumerate(passes):
        at = degree + 1 if turn == 0 else 0
        while at < n:
            now = points_of[at : at + step]
            found, _ = beam_search(points, graph, entry, points[now], beam)
            graph[now] = robust_prune(points, now, np.concatenate([found, np.where(graph[now] < n, graph[now], -1)], 1), degree, alpha)
            back(points, graph, now, degree, alpha)
            at += len(now)
            step = min(BLOCK, at)
    return graph, entry


def back(points: np.ndarray, graph: np.ndarray, now: np.ndarray, degree: int, alpha: float) -> None:
    """Edges from the new neighbours to the points in now."""
    n = len(points)
    target, source = graph[now].ravel(), np.repeat(now, degree)
    real = target < n
    target, source = target[real], source[real]
    order = np.argsort(target, kind="stable")
    target, source = target[order], source[order]
    nodes, begin, size = np.unique(target, return_index=True, return_counts=True)
    order = np.argsort(size, kind="stable")  # nodes of about as many new edges together
    nodes, begin, size = nodes[order], begin[order], size[order]
    for low in range(0, len(nodes), BLOCK):
        own, b, s = nodes[low : low + BLOCK], begin[low : low + BLOCK], size[low : low + BLOCK]
        more = np.full((len(own), int(s.max())), -1, np.int64)
        inner = np.arange(int(s.sum())) - np.repeat(np.cumsum(s) - s, s)
        more[np.repeat(np.arange(len(own)), s), inner] = source[np.repeat(b, s) + inner]
        old = np.where(graph[own] < n, graph[own], -1)
        graph[own] = robust_prune(points, own, np.concatenate([old, more], 1), degree, alpha)


def unit(vectors: np.ndarray) -> np.ndarray:
    # Scaled first, so that neither very large nor very small components overflow.
    v = vectors / np.abs(vectors).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of a and b, to the last bit of double precision but for rare halves."""
    a, b = a.astype(np.longdouble), b.astype(np.longdouble)
    a, b = a / np.abs(a).max(1, keepdims=True), b / np.abs(b).max(1, keepdims=True)
    return ((a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))).astype(np.float64)


def rounding(dim: int) -> float:
    """Bound of the error of a cosine in single precision."""
    return (dim + 4) * 2.0**-23


def leaders(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows that lead, number of the leader of each row): a row follows the first leader that it equals within rounding."""
    n, dim = points.shape
    leads, of, heads = np.zeros(n, bool), np.empty(n, np.int64), []
    step = max(64, min(512, (1 << 22) // max(n, 1)))
    for a in range(0, n, step):
        near = points[a : a + step] @ points.T >= 1 - 2 * rounding(dim)
        for i in range(a, min(n, a + step)):
            before = near[i - a, :i] & leads[:i]
            if before.any():
                of[i] = of[before.argmax()]
            else:
                of[i], leads[i] = len(heads), True
                heads.append(i)
    return np.array(heads, np.int64), of


def best_of_shard(raw: np.ndarray, points: np.ndarray, members: np.ndarray, of: np.ndarray, found: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the query, vec_id, score): the k best other ids for each query, of the leaders found for it (-1: none) and their followers; of all rows if these are no safe choice. points: the vectors raw as unit vectors."""
    n, dim = raw.shape
    asked = unit(queries)
    hit = np.zeros(int(of.max()) + 2, bool)
    nodes = []
    for i in range(len(queries)):
        hit[found[i]] = True
        hit[-1] = False
        rows = np.flatnonzero(hit[of])
        hit[found[i]] = False
        width = k + 1  # one may be the query's own
        while True:
            score = points[rows] @ asked[i]
            order = np.argsort(-score, kind="stable")
            rows, score = rows[order], score[order]
            edge = score[min(width, len(rows)) - 1]
            near = rows[score >= edge - (dim + 4) * 2.0**-51]
            whole = len(rows) == n
            if not whole and (len(rows) <= width or score[width] >= edge - 2 * rounding(dim)):
                rows = np.arange(n)
            elif len(near) == n or len(np.setdiff1d(members[near], [-1, own[i]])) >= k:
                break
            else:  # an id of several vectors counts once
                width *= 2
        nodes.append(near)
    row, node = np.repeat(np.arange(len(nodes)), [len(x) for x in nodes]), np.concatenate(nodes).astype(np.int64)
    exact = np.concatenate([np.empty(0), *(cosines(queries[row[a : a + 8192]], raw[node[a : a + 8192]]) for a in range(0, len(row), 8192))])
    row, ids, exact = np.repeat(row, members.shape[1]), members[node].ravel(), np.repeat(exact, members.shape[1])
    good = (ids >= 0) & (ids != own[row])
    row, ids, exact = row[good], ids[good], exact[good]
    by = np.lexsort((-exact, ids, row))
    row, ids, exact = row[by], ids[by], exact[by]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (ids[1:] != ids[:-1])
    row, ids, exact = row[new], ids[new], exact[new]
    by = np.lexsort((ids, -exact, row))
    row, ids, exact = row[by], ids[by], exact[by]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], ids[place < k], exact[place < k]


INDEX = "shard long, dim int, vectors binary, graph binary, entry int, ids binary, leader binary"
FOUND = "query_id long, vec_id long, score double"


def nodes_of(vectors: DataFrame, ids: int) -> DataFrame:
    """(embedding, members): distinct usable vectors, each with its least ids."""
    good = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("embedding")).filter("vec_id is not null and size(embedding) > 0")
    good = good.filter(F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))) & F.exists("embedding", lambda x: x != 0)).distinct()
    least = good.withColumn("place", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).filter(F.col("place") <= ids)
    return least.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("members"))


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()).reshape(-1, dim)


def index(nodes: DataFrame, n_shards: int, ids: int, degree: int, beam: int, alpha: float) -> DataFrame:
    """A row for each shard: its vectors, graph, entry point and ids."""

    def grow(key: tuple, rows: pa.Table) -> pa.Table:
        dim = key[1].as_py()
        vectors = matrix(rows["embedding"], dim)
        points = unit(vectors).astype(np.float32)
        heads, of = leaders(points)
        graph, entry = build(points[heads], degree, beam, alpha)
        members = np.full((len(vectors), ids), -1, np.int64)
        for i, m in enumerate(rows["members"].to_pylist()):
            members[i, : len(m)] = m
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "dim": pa.array([dim], pa.int32()), "vectors": [vectors.tobytes()], "graph": [graph.astype(np.int32).tobytes()], "entry": pa.array([entry], pa.int32()), "ids": [members.tobytes()], "leader": [of.astype(np.int32).tobytes()]})

    return nodes.select(F.pmod(F.xxhash64("embedding"), F.lit(n_shards)).alias("shard"), F.size("embedding").alias("dim"), "embedding", "members").groupBy("shard", "dim").applyInArrow(grow, INDEX)


def shard_for(n: int) -> int:
    """How many of n vectors a shard holds: as many queries as vectors grow meet a number of shards that does not."""
    return min(max(SHARD, -(-n // SHARDS)), SHARD_MOST)


def beam_for(n: int, beam: int) -> int:
    """The beam in a shard of n vectors."""
    return beam + round(MORE * max(0.0, float(np.log2(max(n, 1) / SHARD))))


def nearest(spark: SparkSession, vectors: DataFrame, is_query: F.Column, k: int = 5, shard: int | None = None, degree: int = DEGREE, build_beam: int = BUILD_BEAM, beam: int = BEAM, alpha: float = ALPHA) -> DataFrame:
    """(query_id, rank, vec_id, score): of each row that is_query holds for, the k nearest rows found but itself."""
    nodes = stored(spark, nodes_of(vectors, k + 1), "vectors")
    n = nodes.count()
    n_shards = max(1, -(-n // (shard or shard_for(n))))
    shards = stored(spark, index(nodes, n_shards, k + 1, degree, build_beam, alpha), "graphs")
    asked = stored(spark, vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("embedding")).filter(is_query).distinct(), "queries")
    # Queries in blocks of a bounded size, each sent to every shard of its dimension.
    n_blocks = max(1, -(-asked.count() // 4096))
    usable = nodes_of(asked, 1).select("embedding")
    # Joins merge: a table of queries that is just small enough to be sent to all tasks is more than a driver holds beside its plans.
    blocks = asked.join(usable.hint("merge"), "embedding", "left_semi").groupBy(F.size("embedding").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).alias("block")).agg(F.collect_list("vec_id").alias("query_ids"), F.flatten(F.collect_list("embedding")).alias("queries"))
    sent = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shards - 1).cast("long")))).repartition(n_blocks * n_shards, "shard", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = {name: batch.column(name)[row] for name in ("dim", "vectors", "graph", "entry", "ids", "leader", "query_ids", "queries")}
                dim = one["dim"].as_py()
                raw = np.frombuffer(one["vectors"].as_buffer(), np.float64).reshape(-1, dim)
                members = np.frombuffer(one["ids"].as_buffer(), np.int64).reshape(len(raw), -1)
                of = np.frombuffer(one["leader"].as_buffer(), np.int32).astype(np.int64)
                heads = np.unique(of, return_index=True)[1]
                graph = np.frombuffer(one["graph"].as_buffer(), np.int32).reshape(len(heads), -1)
                queries, query_ids = np.asarray(one["queries"].values).reshape(-1, dim), np.asarray(one["query_ids"].values)
                points = unit(raw)
                small = points.astype(np.float32)[heads]
                width = min(beam_for(len(heads), beam), len(heads))
                for at in range(0, len(queries), BLOCK):
                    q, own = queries[at : at + BLOCK], query_ids[at : at + BLOCK]
                    found, _ = beam_search(small, graph, one["entry"].as_py(), unit(q).astype(np.float32), width)
                    asks, ids, scores = best_of_shard(raw, points, members, of, found, q, own, k)
                    yield pa.RecordBatch.from_arrays([pa.array(own[asks]), pa.array(ids), pa.array(scores)], ["query_id", "vec_id", "score"])

    found = sent.join(shards.hint("merge"), ["shard", "dim"]).select("dim", "vectors", "graph", "entry", "ids", "leader", "query_ids", "queries").mapInArrow(steady(run), FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order))
    return best.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
