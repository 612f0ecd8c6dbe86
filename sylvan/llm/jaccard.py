"""N-gram Jaccard join by T-occurrence search.

Two documents link if ``den * |A & B| >= num * |A | B|`` for their sets of word shingles. Then they share at least
T = ceil(num / den * size) shingles of either set. Within a shard, the inverted lists of a document's shingles are parted:
the short ones are merged (as sorted runs, by a stable sort) and give the documents that occur often enough, the long ones
are only probed by binary search for those (DivideSkip).

Shards: shingles are ranked by how many documents have them, rare ones first. A pair that links shares one of the first
``size - T + 1`` shingles of both sets, so the lists of these, joined to components, part the documents into classes that
no link leaves; sets whose first shingles are all their own link with nothing. A class is cut by set size into bands of
ratio num / den, each with the band below, and large bands further into pairs of parts, so memory is bounded. Documents
of equal sets are one node throughout.

Cases: a null or empty text, or one without words, has no shingles and links with nothing; with fewer words than a shingle
the whole sequence is one shingle; repeated rows and copies share a component; a null id takes the least id of its
component, null if there is none. No rows give no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.llm.blocks import store_blocks
from sylvan.llm.components import components, find
from sylvan.llm.exchange import group_sums, look_up_blocks, with_answers
from sylvan.llm.hashing import mix, shingles, tokens
from sylvan.llm.util import free_name, grouped, steady, stored

#: Text of one block; a worker holds about forty times as much while it sorts shingles.
BLOCK_BYTES = 3 << 20
#: Document frequencies count up to this; they order shingles and decide no link.
MOST_DF = 250
#: Bytes of sets that a part of a shard may hold.
PART_BYTES = 24 << 20


def distinct_shingles(rows: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle), each once, by row."""
    h, r = shingles(tokens(rows["text"]), k)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return r[new], h[new]


def signatures(r: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each row's set."""
    sums = np.zeros(n, np.uint64)
    if len(r):
        heads = np.flatnonzero(np.diff(r, prepend=-1))
        sums[r[heads]] = np.add.reduceat(mix(h ^ np.uint64(0x5851F42D4C957F2D)), heads)
    return mix(sums + np.bincount(r, minlength=n).astype(np.uint64)).view(np.int64)


def needed(size: np.ndarray | int, num: int, den: int) -> np.ndarray | int:
    """The least overlap of a set with any set it links to."""
    return -(-size * num // den)


def sets_of(spark: SparkSession, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(doc_id, mark, size, node, prefix, shingles): for documents that may link, their shared shingles, rare ones first, and how
    many of them belong to the first size - T + 1; else null. One row of a block carries the shingles of equal sets."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_mark("text").alias("mark"), F.coalesce(docs["text"], F.lit("")).cast("binary").alias("text"))
    manifest = store_blocks(spark, rows, 2, BLOCK_BYTES)
    n = max(1, manifest.count())
    # Frequencies may be of shortened hashes: any order of shingles that all documents share gives all links.
    cut = np.uint64(max(0, 23 - int(math.log2(n))))

    def emit(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = np.unique(distinct_shingles(table, k)[1] >> cut << cut, return_counts=True)
        return keys >> cut << cut, counts

    def frequency(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list[int]]:
        order, group, sums = group_sums(keys, counts)
        out = np.empty(len(keys), np.uint64)
        out[order] = np.minimum(sums, MOST_DF)[group]
        return out, []

    def work(table: pa.Table, found: np.ndarray) -> pa.Table:
        r, h = distinct_shingles(table, k)
        keys, at = np.unique(h >> cut << cut, return_inverse=True)
        df = found[at].astype(np.int64)
        size = np.bincount(r, minlength=table.num_rows)
        node = signatures(r, h, table.num_rows)
        first = size - needed(size, num, den) + 1
        order = np.lexsort((h, df, r))
        r, h, df = r[order], h[order], df[order]
        rank = np.arange(len(r)) - np.repeat(np.cumsum(size) - size, size)
        shared = df > 1
        prefix = np.bincount(r[shared & (rank < first[r])], minlength=table.num_rows)
        bounds = np.cumsum(np.bincount(r[shared], minlength=table.num_rows))
        kept = h[shared]
        carries = np.zeros(table.num_rows, bool)
        carries[np.unique(node, return_index=True)[1]] = True
        carries &= prefix > 0
        packed = [kept[e - c : e].tobytes() if use else None for e, c, use in zip(bounds, np.diff(bounds, prepend=0), carries, strict=True)]
        return pa.table({"doc_id": table["doc_id"], "mark": table["mark"], "size": size.astype(np.int64), "node": node, "prefix": prefix.astype(np.int32), "shingles": pa.array(packed, pa.binary())})

    answers = stored(spark, look_up_blocks(manifest, emit, frequency, n), "frequencies")
    return stored(spark, with_answers(manifest, answers, work, "doc_id long, mark long, size long, node long, prefix int, shingles binary", n), "sets")


def postings(sets: DataFrame) -> DataFrame:
    """(shingle, node) of the first shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [np.frombuffer(s.as_buffer(), np.int64)[:p] for s, p in zip(batch.column("shingles"), batch.column("prefix").to_pylist(), strict=True)]
            if values:
                nodes = np.repeat(np.asarray(batch.column("node")), [len(v) for v in values])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(values)), pa.array(nodes)], ["shingle", "node"])

    return sets.select("node", "prefix", "shingles").mapInArrow(steady(run), "shingle long, node long")


def merged(postings: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, how often) of those that occur at least `least` times in sorted lists that lie one behind the other:
    numpy's stable sort finds the sorted runs and merges them."""
    postings = np.sort(postings, kind="stable")
    heads = np.flatnonzero(np.diff(postings, prepend=-1))
    times = np.diff(np.append(heads, len(postings)))
    return postings[heads[times >= least]], times[times >= least]


def roots(parent: np.ndarray) -> np.ndarray:
    while (parent[parent] != parent).any():
        parent = parent[parent]
    return parent


def join(parent: np.ndarray, x: int, y: int) -> None:
    a, b = find(parent, x), find(parent, y)
    parent[max(a, b)] = min(a, b)


def search(size: np.ndarray, sets: list[np.ndarray], home: np.ndarray, part: np.ndarray, apart: bool, num: int, den: int) -> np.ndarray:
    """For each document the first one of its component in this shard. Pairs need one document at home; apart: of
    different parts. Links inside a component that is already known are not looked for."""
    n = len(sets)
    order = np.argsort(size, kind="stable")
    size, sets, home, part = size[order], [sets[i] for i in order], home[order], part[order]
    counts = np.array([len(s) for s in sets])
    words, at = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(counts)
    index = np.sort(at * n + np.repeat(np.arange(n), counts))  # the lists, one after the other, each by document
    begin = np.searchsorted(index, np.arange(len(words) + 1) * n)
    docs = (index % n).astype(np.int32)
    parent = np.arange(n, dtype=np.int32)

    def allowed(x: int, y: np.ndarray) -> np.ndarray:
        return (size[y] * den >= size[x] * num) & (home[y] | home[x]) & ((part[y] != part[x]) if apart else True)

    def probe(mine: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many of the lists hold each y, by binary search."""
        want = mine[:, None] * n + y
        return (index[np.minimum(np.searchsorted(index, want), len(index) - 1)] == want).sum(0)

    def links(x: int, y: np.ndarray, both: np.ndarray) -> np.ndarray:
        return y[den * both >= num * (size[x] + size[y] - both)]

    for x in range(1, n):
        mine = at[ends[x] - counts[x] : ends[x]]
        if len(mine) < (t := needed(int(size[x]), num, den)):
            continue
        # Postings of documents before x only.
        stop = np.searchsorted(index, mine * n + x)
        lengths = stop - begin[mine]
        by = np.argsort(lengths, kind="stable")
        longest = max(2, int(lengths[by[-1]]))
        skip = min(t - 1, int(t / (0.02 * math.log2(longest) + 1)))  # lists that are only probed
        short, long = by[: len(mine) - skip], mine[by[len(mine) - skip :]]
        lists = [docs[a:b] for a, b in zip(begin[mine[short]].tolist(), stop[short].tolist(), strict=True) if b > a]
        if not lists:
            continue
        # In a group of near copies one link to the last of them spares the search for all others.
        near = np.unique([i[-1] for i in lists[:3]]).astype(np.int64)
        near = near[allowed(x, near)]
        for y in links(x, near, probe(mine, near)).tolist():
            join(parent, x, y)
        parent[:] = roots(parent)
        postings = np.concatenate(lists)
        found, times = merged(postings[parent[postings] != parent[x]], t - skip)
        keep = allowed(x, found)
        found, times = found[keep].astype(np.int64), times[keep]
        found, times, some = found[::-1], times[::-1], 8
        while len(found):  # a few first: what they link need not be asked of the rest of their component
            for y in links(x, found[:some], times[:some] + probe(long, found[:some])).tolist():
                join(parent, x, y)
            parent[:] = roots(parent)
            left = np.flatnonzero(parent[found[some:]] != parent[x]) + some
            found, times, some = found[left], times[left], min(4 * some, 1024)
    out = np.empty(n, np.int64)
    out[order] = order[[find(parent, x) for x in range(n)]]
    return out


def links(spark: SparkSession, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Edges (a, b) between nodes whose components are those of all links."""
    nodes = stored(spark, sets.filter("shingles is not null").groupBy("node").agg(F.first("size").alias("size"), F.first("prefix").alias("prefix"), F.first("shingles").alias("shingles")), "nodes")
    lists = postings(nodes)
    pivots = lists.groupBy("shingle").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("shingle", "pivot")
    classes = components(spark, lists.join(pivots, "shingle").select(F.col("node").alias("a"), F.col("pivot").alias("b")).filter("a <> b").distinct())
    known = classes.select("node", F.col("root").alias("class")).union(classes.select(F.col("root").alias("node"), F.col("root").alias("class")).distinct())
    band = F.floor(F.log("size") / F.log(F.lit(den / num)) + 1e-9).cast("int")
    rows = nodes.join(known, "node").select("node", "size", "shingles", "class", band.alias("band"))
    rows = rows.withColumn("at", F.explode(F.array(F.struct("band", F.lit(True).alias("home")), F.struct((F.col("band") + 1).alias("band"), F.lit(False).alias("home")))))
    rows = rows.select("node", "size", "shingles", "class", F.col("at.band").alias("band"), F.col("at.home").alias("home"))
    sizes = rows.groupBy("class", "band").agg(F.ceil(F.sum(F.length("shingles")) / PART_BYTES).cast("int").alias("parts"), F.count(F.lit(1)).alias("n"), F.max("home").alias("any")).filter("n > 1 and any")
    rows = rows.join(sizes.select("class", "band", "parts"), ["class", "band"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    shard = F.xxhash64("class", "band", F.least("part", "other"), F.greatest("part", "other"))
    rows = rows.select(shard.alias("shard"), "node", "size", "shingles", "home", "part", (F.col("part") != F.col("other")).alias("apart"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in grouped(batches, "shard"):
            node, part = np.asarray(t["node"]), np.asarray(t["part"])
            values = [np.frombuffer(s.as_buffer(), np.uint64) for s in t["shingles"]]
            apart = part.min() != part.max()
            first = search(np.asarray(t["size"]), values, np.asarray(t["home"]), part, apart, num, den)
            moved = first != np.arange(len(first))
            if moved.any():
                yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[first[moved]])], ["a", "b"])

    return rows.drop("apart").repartition("shard").sortWithinPartitions("shard").mapInArrow(steady(run), "a long, b long")


def jaccard_components(spark: SparkSession, docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each document; component_id is the least id that links reach."""
    return rooted(spark, docs, k, num, den).select("doc_id", "n_shingles", "component_id")


def rooted(spark: SparkSession, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """jaccard_components with mark, a hash of the text, and root, which names the component (null without shingles)."""
    sets = sets_of(spark, docs, k, num, den)
    linked = components(spark, links(spark, sets, num, den))
    # Nodes of sets that are not empty, with the least id of their rows.
    nodes = sets.filter("size > 0").groupBy("node").agg(F.min("doc_id").alias("least")).join(linked, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    named = stored(spark, nodes.join(nodes.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "root", "component_id"), "names")
    whole = sets.select("doc_id", "mark", "size", F.when(F.col("size") > 0, F.col("node")).alias("node")).join(named, "node", "left")
    return whole.select("doc_id", "mark", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "root")


def one_of_each(spark: SparkSession, docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs without all but one row of each component; columns stay. The row of the least id stays (null ids come last), of
    equal ids that of the least hash of its text. Documents without words link with nothing and stay; of rows of equal id and
    text one stays."""
    found = rooted(spark, docs, k, num, den)
    first = found.filter("n_shingles > 0").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("f")).select("f.doc_id", "f.mark")
    first = stored(spark, first.union(found.filter("n_shingles = 0").select("doc_id", "mark")).groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("rows")), "first")
    ident, mark, left, right = (free_name(docs, n) for n in ("_ident", "_mark", "_key_ident", "_key_mark"))
    marked = docs.withColumn(ident, docs["doc_id"].cast("long")).withColumn(mark, text_mark("text"))
    keys = first.select(F.col("doc_id").alias(left), F.col("mark").alias(right))
    kept = marked.join(keys, F.col(ident).eqNullSafe(F.col(left)) & (F.col(mark) == F.col(right)), "left_semi")
    # A kept key may stand in several rows; only those keys' rows are compared.
    repeated = found.groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
    if repeated:
        kept = kept.dropDuplicates([ident, mark])
    return kept.select(*(F.col(c) for c in docs.columns))


def text_mark(column: str) -> F.Column:
    return F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit("")))
